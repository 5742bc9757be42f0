"""Registered queries: oracle agreement at the smallest scale and plan shape."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import TABLES, compare

from veriloom.plans import ORACLES, QUERIES

SAMPLE = [
    "S5_record_assembly", "S15_content_fingerprint", "Q4_describe_numeric", "Q14_iqr_outliers", "C3_mode_imputation",
    "C10_cleaning_audit", "T3_searchable_text", "T10_tfidf", "T16_query_segments_detailed", "P2_group_sample_to_rows",
    "R2_zero_score_padding", "R4_bm25_grid", "R13_fused_top_100", "E5_operating_points", "E10_group_ranking_metrics",
    "E13_paired_bootstrap", "W1_rank_change", "M20_pair_generation",
]


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    cur = duck.execute(ORACLES[name])
    problem = compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert problem is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["R4_bm25_search", "T11_pair_features", "E11_retrieval_metrics", "C9_valid_rows", "P5_group_holdout"])
def test_no_products_and_no_row_udfs(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_projection_reaches_the_scan(spark, folder):
    text = plan(QUERIES["S1_projected_scan"](spark, folder))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>" in text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
