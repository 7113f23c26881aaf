"""Running folds and dense numbering without a one-task window.

A window over a whole group puts the group into one task.  Here the order key is
cut into buckets of ``2**BUCKET_BITS`` consecutive values; because the key is
unique within its group, no bucket can hold more rows than that.  Bucket totals
are folded the same way, level after level until the key is used up, so every window
sees ``2**BUCKET_BITS`` rows at most, however keys are spread over their 64 bits, and a group
holding a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 16
# Rows, and buckets of 16, 32 and 48 bits.
LEVELS = 64 // BUCKET_BITS

_AGGREGATES = {"sum": F.sum, "max": F.max}


def _combined(kind: str, left: Column, right: Column) -> Column:
    if kind == "max":
        return F.greatest(left, right)
    return F.coalesce(left + right, left, right)


def running_folds(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    folds: Mapping[str, tuple[str, Column]],
    exclusive: bool = False,
) -> DataFrame:
    """Add one running ``sum`` or ``max`` column per entry of ``folds``.

    ``order`` is an integral column, unique within ``group``.  ``folds`` maps the
    new column to ``(kind, value)``; nulls are skipped, and a fold without any
    value so far is null.  ``exclusive`` leaves the current row out.
    """
    names = list(folds)
    kinds = {name: folds[name][0] for name in names}
    values = {name: f"__value_{name}" for name in names}
    def level(n: int) -> str:
        return f"__level{n}"

    rows = df.withColumns({
        **{values[name]: folds[name][1] for name in names},
        **{level(n): F.shiftright(F.col(order).cast("long"), n * BUCKET_BITS) for n in range(1, LEVELS)},
    })
    # totals of the buckets of each level; a level's buckets lie in one of the next level
    totals, table = {}, rows
    for n in range(1, LEVELS):
        table = table.groupBy(*group, *[level(m) for m in range(n, LEVELS)]).agg(
            *[_AGGREGATES[kinds[x]](values[x]).alias(values[x]) for x in names])
        totals[n] = table

    def before(n: int) -> DataFrame:
        """What lies before each bucket of a level, inside its bucket of the next level."""
        above = [level(m) for m in range(n + 1, LEVELS)]
        window = Window.partitionBy(*group, *above).orderBy(level(n)).rowsBetween(Window.unboundedPreceding, -1)
        return totals[n].select(*group, level(n), *above, *[
            _AGGREGATES[kinds[x]](values[x]).over(window).alias(f"__in_{x}") for x in names])

    offsets = before(LEVELS - 1).withColumnsRenamed({f"__in_{x}": f"__off_{x}" for x in names})
    for n in range(LEVELS - 2, 0, -1):
        above = [level(m) for m in range(n + 1, LEVELS)]
        offsets = before(n).join(offsets, [*group, *above]).select(*group, level(n), *above, *[
            _combined(kinds[x], F.col(f"__off_{x}"), F.col(f"__in_{x}")).alias(f"__off_{x}") for x in names])

    last = -1 if exclusive else Window.currentRow
    inside = Window.partitionBy(*group, level(1)).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    local = rows.withColumns({f"__run_{n}": _AGGREGATES[kinds[n]](values[n]).over(inside) for n in names})
    joined = local.join(offsets.select(*group, level(1), *[f"__off_{n}" for n in names]), [*group, level(1)])
    return joined.select(
        *[c for c in df.columns],
        *[_combined(kinds[n], F.col(f"__off_{n}"), F.col(f"__run_{n}")).alias(n) for n in names],
    )


def numbered(df: DataFrame, group: Sequence[str], order: str, name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers within ``group`` by a unique integral ``order`` column."""
    counted = running_folds(df, group, order, {name: ("sum", F.lit(1).cast("long"))})
    return counted.withColumn(name, F.col(name) + F.lit(start - 1)) if start != 1 else counted


def dense_first_seen_index(
    rows: DataFrame, group: Sequence[str], key: Sequence[str], order: str, name: str = "index"
) -> DataFrame:
    """Distinct keys of each group, numbered from 0 by first appearance."""
    first = rows.groupBy(*group, *key).agg(F.min(order).alias("first_seen"))
    return numbered(first, group, "first_seen", name, start=0)
