"""Rules that read tool log lines, as plain column expressions.

A tool owns an ordered list of rules; the first one that matches a line wins.
A rule states its test, the numbers and text it reads, the counter it feeds and
the message shown instead of the line.  Everything stays on the JVM, and the
same expressions serve batch and streaming tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from capturemill.functions.columns import fixed, thousands

MAX_NUMBERS = 4


@dataclass(frozen=True)
class Rule:
    """One log rule.

    ``pattern`` gives the numbered integer fields, in order.  ``also`` is a second
    pattern that has to match too and adds one integer.  ``contains`` replaces the
    pattern by a plain text test.  ``message`` gets the rule's reader.
    """

    id: str
    pattern: str = ""
    numbers: int = 0
    also: str = ""
    contains: str = ""
    ignore_case: bool = False
    decimal: bool = False
    text: str = ""
    message: Callable[[Reader], Column] | None = field(default=None)


class Reader:
    """Column access to the fields of one rule on the ``line`` column."""

    def __init__(self, rule: Rule, line: Column, total_images: Column, device: str):
        self.rule, self.line, self.total_images, self.device = rule, line, total_images, device

    def test(self) -> Column:
        if self.rule.contains:
            hay = F.lower(self.line) if self.rule.ignore_case else self.line
            return F.contains(hay, F.lit(self.rule.contains))
        matched = self.line.rlike(self.rule.pattern)
        return matched & self.line.rlike(self.rule.also) if self.rule.also else matched

    def raw(self, n: int) -> Column:
        """The n-th field as written (1-based); the ``also`` field comes last."""
        if self.rule.also and n == self.rule.numbers:
            return F.regexp_extract(self.line, self.rule.also, 1)
        return F.regexp_extract(self.line, self.rule.pattern, n)

    def number(self, n: int) -> Column:
        return self.raw(n).try_cast("long")

    def decimal(self) -> Column:
        return F.regexp_extract(self.line, self.rule.pattern, 1).try_cast("double")

    def text(self) -> Column:
        return F.nullif(F.regexp_extract(self.line, self.rule.text, 1), F.lit(""))


def _extracted(r: Reader) -> Column:
    name = F.coalesce(r.text(), F.concat(F.lit("image "), r.number(1)))
    return F.concat(F.lit(f"{r.device} "), name, F.lit(": "), thousands(r.number(3)), F.lit(" features ("),
                    r.number(1), F.lit("/"), r.number(2), F.lit(")"))


def _block(r: Reader) -> Column:
    first, last = block_bounds(r.number(1), r.total_images)
    return block_message(r.number(1), r.number(2), first, last,
                         F.concat(F.lit("Image "), first), F.concat(F.lit("Image "), last))


def block_bounds(block: Column, total_images: Column, size: int = 50) -> tuple[Column, Column]:
    """First and last image number of a match block."""
    return (block - 1) * size + 1, F.least(block * size, total_images)


def block_message(block: Column, blocks: Column, first: Column, last: Column,
                  first_name: Column, last_name: Column) -> Column:
    head = F.concat(F.lit("Processing match block "), block, F.lit("/"), blocks)
    single = F.concat(head, F.lit(" (Image: "), first_name, F.lit(")"))
    several = F.concat(head, F.lit(" (Images: "), first_name, F.lit(" to "), last_name, F.lit(")"))
    return F.when(first == last, single).otherwise(several)


def _error(r: Reader) -> Column:
    value = r.decimal()
    grade = F.when(value < 1.0, "✓ good").when(value < 2.0, "⚠ high").otherwise("✗ poor")
    return F.concat(F.lit("  → Mean reprojection error: "), fixed(value, 3), F.lit("px ("), grade, F.lit(")"))


def _removed(r: Reader) -> Column:
    kind = (
        F.when(is_spurious(r.line), "spurious components").when(is_spike(r.line), "spikes").otherwise("artifacts")
    )
    return F.concat(F.lit("  → Cleaned "), r.number(1), F.lit(" "), kind)


def is_spurious(line: Column) -> Column:
    return F.contains(F.lower(line), F.lit("spurious"))


def is_spike(line: Column) -> Column:
    return ~is_spurious(line) & F.contains(F.lower(line), F.lit("spike"))


def _say(*parts) -> Callable[[Reader], Column]:
    """Message from literal text, ``int`` (field as written) and ``(n,)`` (field with thousands)."""
    def build(r: Reader) -> Column:
        def piece(p):
            if isinstance(p, str):
                return F.lit(p)
            return r.raw(p) if isinstance(p, int) else thousands(r.number(p[0]))

        return F.concat(*[piece(p) for p in parts])

    return build


# Patterns, order and messages of the tool log rules.
RULES: dict[str, list[Rule]] = {
    "extract": [
        Rule("T1", r"Processed file \[(\d+)/(\d+)\]", 3, also=r"num_features=(\d+)", text=r"name=(\S+)",
             message=_extracted),
        Rule("T2", contains="Elapsed time:", message=lambda r: F.concat(F.lit("  ⏱ "), r.line)),
    ],
    "match": [
        Rule("T3", r"Matching block \[(\d+)/(\d+),\s*(\d+)/(\d+)\]", 4,
             message=_say("Processing match block [", 1, "/", 2, ", ", 3, "/", 4, "]...")),
        Rule("T4", r"Matching block \[(\d+)/(\d+)\]", 2, message=_block),
        Rule("T5", r"(\d+) matches for image pair", 1),
        Rule("T6", contains="geometrically verified", ignore_case=True,
             message=lambda r: F.concat(F.lit("  ✓ "), r.line)),
    ],
    "map": [
        Rule("T7", r"Registering image #(\d+) \((\d+)\)", 2,
             message=lambda r: F.concat(F.lit("Adding camera "), r.raw(1), F.lit(" ("), r.raw(2), F.lit(" of "),
                                        F.coalesce(r.total_images.cast("string"), F.lit("?")), F.lit(")"))),
        Rule("T8", r"Image has (\d+)\s*/\s*(\d+) inliers", 2,
             message=_say("  → ", 1, " of ", 2, " feature matches used")),
        Rule("T9", contains="Bundle adjustment", message=_say("  Adjusting...")),
        Rule("T10", r"Merged observations: (\d+)", 1, message=_say("  → Merged ", 1, " track observations")),
        Rule("T11", r"Completed observations: (\d+)", 1, message=_say("  → Completed ", 1, " observations")),
        Rule("T12", r"Triangulated (\d+) points", 1, message=_say("  → Triangulated ", (1,), " new 3D points")),
        Rule("T13", r"Filtered observations: (\d+)", 1,
             message=lambda r: F.concat(F.lit("  → Filtered "), r.number(1), F.lit(" outlier observations"))),
        Rule("T14", r"Mean reprojection error: ([\d.]+)px", decimal=True, message=_error),
    ],
    "densify": [
        Rule("T15", r"Depth-map for image\s+(\d+) estimated using\s+(\d+) images:\s*(\d+)x(\d+)", 4,
             message=_say("[CPU] Estimating depth map for image ", 1, " (", 3, "×", 4, ", ", 2, " views)")),
        Rule("T16", r"(?d)Depth-maps dense fused.*?(\d+) depth-maps.*?(\d+) points", 2,
             message=_say("  → Fused ", 1, " depth maps → ", (2,), " candidate points")),
        Rule("T17", r"(?d)[Dd]ensif(?:y|ying).*?completed.*?(\d+) points", 1,
             message=_say("  → Dense cloud: ", (1,), " points")),
        Rule("T18", r"(?d)Point-cloud trimmed.*?(\d+) points removed", 1,
             message=_say("  → Trimmed ", (1,), " points outside ROI")),
    ],
    "mesh": [
        Rule("T19", r"(\d+) vertices, (\d+) faces", 2,
             message=_say("  → Mesh: ", (1,), " vertices, ", (2,), " faces")),
        Rule("T20", r"[Rr]emoved? (\d+)", 1, message=_removed),
        Rule("T21", r"[Cc]losed? (\d+) holes", 1,
             message=lambda r: F.concat(F.lit("  → Closed "), r.number(1), F.lit(" holes"))),
    ],
}


FIELDS = (*[f"n{n}" for n in range(1, MAX_NUMBERS + 1)], "value", "text")


def _readers(rules: dict[str, list[Rule]] | None, total_images: Column | None, device: str):
    total = F.lit(None).cast("long") if total_images is None else total_images
    return {
        owner: [Reader(rule, F.col("line"), total, device) for rule in owned]
        for owner, owned in (rules or RULES).items()
    }


def rule_match(rules: dict[str, list[Rule]] | None = None) -> Column:
    """Struct of the winning rule and its fields, null where no rule of the tool matches.

    One expression tests each rule once and reads fields only in the winning branch.
    """
    def fields(r: Reader) -> Column:
        numbers = [
            (r.number(n) if n <= r.rule.numbers else F.lit(None)).cast("long").alias(f"n{n}")
            for n in range(1, MAX_NUMBERS + 1)
        ]
        value = r.decimal() if r.rule.decimal else F.lit(None)
        text = r.text() if r.rule.text else F.lit(None)
        return F.struct(F.lit(r.rule.id).alias("rule"), *numbers, value.cast("double").alias("value"),
                        text.cast("string").alias("text"))

    by_tool = None
    for owner, readers in _readers(rules, None, "").items():
        branch = None
        for r in readers:
            branch = F.when(r.test(), fields(r)) if branch is None else branch.when(r.test(), fields(r))
        hit = F.col("tool") == owner
        by_tool = F.when(hit, branch) if by_tool is None else by_tool.when(hit, branch)
    return by_tool


def rule_message(
    total_images: Column | None = None, device: str = "[iGPU]", rules: dict[str, list[Rule]] | None = None
) -> Column:
    """The text shown for a line whose ``rule`` is known; the line itself where the rule has no message."""
    out = None
    for readers in _readers(rules, total_images, device).values():
        for r in readers:
            if r.rule.message is None:
                continue
            hit = F.col("rule") == r.rule.id
            out = F.when(hit, r.rule.message(r)) if out is None else out.when(hit, r.rule.message(r))
    return F.coalesce(out, F.col("line"))
