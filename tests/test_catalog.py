"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from capturemill.functions.log_rules import RULES
from capturemill.operators import logs
from capturemill.plans import CATALOG
from capturemill.plans.lenses import lens


@pytest.fixture(scope="module")
def db(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_equals_sql(spark, db, sf_dir, name):
    assert check.compare(spark, db, name, sf_dir)[0] == "equal"


def test_every_query_has_sql():
    assert set(CATALOG) <= set(oracle_sql()) and set(CATALOG) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_log_rule_is_met(spark, sf_dir):
    found = {r["rule"] for r in logs.classify(lens(spark, sf_dir, "log_lines")).select("rule").distinct().collect()}
    assert found == {rule.id for owned in RULES.values() for rule in owned} | {None}
