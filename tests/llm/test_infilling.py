import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from capturemill.llm import infilling, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """Units one by one, joined again."""
    units = UNIT.findall(text)
    h1, h2, h3, h4 = infilling.draws(doc_id, 42)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def random_rows():
    draw = random.Random(4)
    bits = ["a", "Wort", " ", "  ", "\n", "\t\x0b", "é", "中文", "😀", "<", "<P", "S>", "\x00", "\x85", " ", "\x1f"]
    rows = [(i, "".join(draw.choices(bits, k=draw.randrange(0, 60)))) for i in range(400)]
    return rows + [(500 + i, f"one {mark} two three") for i, mark in enumerate(["<P>", "<S>", "<M>", "<p>"] * 6)]


def test_units_and_forms_equal_single_steps(documents, edges):
    rows = random_rows() + [e[:2] for e in edges]
    got = infilling.fill_in_middle(documents(rows)).withColumn("restored", infilling.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *brute(i, t or ""), t or "") for i, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_long_texts_are_cut_where_units_end(monkeypatch):
    texts = [t for _, t in random_rows()]
    whole = [infilling.unit_ends(t).tolist() for t in texts]
    assert whole == [[m.end() for m in UNIT.finditer(t)] for t in texts]
    monkeypatch.setattr(infilling, "PIECE", 5)
    assert [infilling.unit_ends(t).tolist() for t in texts] == whole


def test_very_long_texts(documents):
    rows = [(i, "wort und " * 700_000 + "ende" if i else "x" * 3_000_000) for i in range(3)]
    got = {r["doc_id"]: r for r in infilling.fill_in_middle(documents(rows), percent=100).collect()}
    assert [got[i]["n"] for i in range(3)] == [1, 1_400_001, 1_400_001]
    for i, text in rows:
        assert len(got[i]["output"]) == len(text) + 9


@pytest.mark.parametrize(("percent", "spm", "forms"), [(0, 50, {"plain"}), (100, 100, {"spm"}), (100, 0, {"psm"})])
def test_rates(documents, percent, spm, forms):
    rows = [(i, f"word {i} of many") for i in range(50)]
    assert {r["form"] for r in infilling.fill_in_middle(documents(rows), percent=percent, spm_percent=spm).collect()} == forms


def test_empty_table(documents):
    assert infilling.fill_in_middle(documents([])).count() == 0


def test_query_equals_sql(spark, documents, edges, tmp_path):
    rows = [r for r in random_rows() if "\x00" not in r[1]] + [e[:2] for e in edges if "\x00" not in (e[1] or "")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_infilling(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.OP11_SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
