"""Registry of runnable queries and the plain SQL that states the same result."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturemill.plans.lenses import lens, lens_text, stream_lens

Lens = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, Lens], DataFrame]
    lenses: tuple[str, ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        def view(name: str) -> DataFrame:
            return lens(spark, sf_dir, name)

        view.stream = lambda name: stream_lens(spark, sf_dir, name)
        return tidy(self.build(spark, view))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = textwrap.dedent(self.sql).strip()
        head = f"WITH RECURSIVE {lens_text(list(self.lenses))}"
        text = f"{head},\n{body[5:]}" if body.startswith("WITH ") else f"{head}\n{body}"
        return re.sub(r"round\(round\((.+?), 9\), 6\)", SIX_DIGITS, text)


# Engines settle decimal ties of round() differently; the SQL's round(round(x, 9), 6) is
# spelt out in plain arithmetic, and tidy() does the same steps.
SIX_DIGITS = r"floor(floor((\1) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6"

CATALOG: dict[str, Query] = {}


def query(name: str, *lenses: str, sql: str | None = None):
    """Register a builder ``(spark, lens) -> DataFrame`` under a name."""
    def keep(build):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Query(build, lenses, sql)
        return build

    return keep


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double of six digits."""
    def column(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("long").alias(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            nine = F.floor(c.cast("double") * 1e9 + 0.5) / 1e9
            # adding zero drops the sign of -0.0
            return (F.floor(nine * 1e6 + 0.5) / 1e6 + F.lit(0.0)).alias(field.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])
