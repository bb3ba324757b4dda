"""Every registered query of the reference's operators against its DuckDB form."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from tutorlens.plans.registry import ORACLES, QUERIES


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in ordered.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["h2_h11_page_records", "h6_sections", "h7_h9_blocks", "h7_document_blocks", "h8_link_places", "k5_ingest_summary", "l4_errors", "h12_class_counts", "l1_requests", "l2_validation", "l4_outcome", "l5_quiz_by_concept"])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
