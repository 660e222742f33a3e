"""Every registered query against its SQL on the smallest scale."""

from __future__ import annotations

import re

import pytest
from compare import compare, duck
from conftest import SF_DIR

import __spark_entry__ as entry
from veilgrid.plans import catalog

# the training-data queries, which may be absent, have tests of their own
QUERIES = {k: q for k, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", k)}
SQL = {k: s for k, s in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_sql_has_a_query():
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        problem, rows = compare(df, con, SQL[name])
        assert not problem
        assert rows > 0 or name in MAY_BE_EMPTY
    else:
        assert df.count() > 0


MAY_BE_EMPTY = ("audit_completeness",)


def test_unknown_field_lines_are_parsed_once(spark):
    """Findings and both sides of the gate read a table of parsed lines, not the lines again."""
    lines, found = catalog._unknown_fields(spark, SF_DIR)
    for rows in (lines, found):
        assert "parse_json" not in rows._jdf.queryExecution().optimizedPlan().toString()
