import hashlib

import pytest

from capturemill.llm import warc

BODY = "<p>" + "ab" * 60 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/é%20\r\n", BODY), (2, None, BODY), (9, "http://c", BODY), (3, "u", None), (4, "u", ""), (7, "u", "short"), (8, "u", "short"),
            (6, "u", "ü" * 60), (1, "u", "\x1f\u008b\x08" * 50_000 + "WARC/1.1"), (2, "again", BODY), (None, "n", BODY)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


@pytest.mark.parametrize("range_bytes", [64, 997, 1 << 24])
def test_round_trip(spark, pages, range_bytes):
    archives = warc.write_archives(pages)
    got = warc.read_archives(spark, archives, range_bytes, with_payload=True).collect()
    assert len(got) == pages.count() and all(r["digest_matches"] for r in got)
    rows = sorted(pages.collect(), key=lambda r: (r["page_id"] is not None, r["page_id"] or 0, r["url"] or ""))
    got.sort(key=lambda r: (r["page_id"] is not None, r["page_id"] or 0, r["url"] or ""))
    for page, record in zip(rows, got, strict=True):
        payload = (page["html"] or "").encode()
        first = min((p["page_id"] for p in rows if p["html"] == page["html"] and p["page_id"] is not None), default=None)
        revisit = len(payload) >= 100 and page["page_id"] != first
        assert record["url"] == page["url"]
        assert record["record_type"] == ("revisit" if revisit else "response")
        assert record["refers_to"] == (first if revisit else None)
        assert record["payload_bytes"] == len(payload)
        assert record["payload_digest"] == hashlib.sha256(payload).hexdigest()
        assert record["payload"] == (None if revisit else payload)


def test_magic_inside_a_payload_is_no_record(tmp_path):
    inner = warc.record_bytes(1, "u", b"inner", "d", None, "2000-01-01T00:00:00Z")
    # stored without compression, the member shows up byte by byte inside the outer one
    import zlib
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    junk = packer.compress(b"no header" + warc.MAGIC * 10) + packer.flush()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(junk + inner + warc.MAGIC + b"broken" + inner)
    for cut in range(1, path.stat().st_size, 7):
        found = [m for a, b in ((0, cut), (cut, path.stat().st_size)) for m in warc.RangeReader(str(path), a, b).members()]
        assert [warc.parsed(m)["payload"] for _, m in found] == [b"inner", b"inner"]


def test_no_pages(spark, pages):
    archives = warc.write_archives(pages.limit(0))
    assert warc.read_archives(spark, archives).count() == 0
