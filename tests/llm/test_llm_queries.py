"""The registered llm queries: those with SQL against DuckDB, types and values."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tidepool.llm.queries import QUERIES
from tidepool.session import TABLES
from tools.oracle_check import digest
from tools.type_check import SPARK_TO_DUCK

SF = "/root/testdata/sf0.001"
SQL = {k: sql for k, (_, sql) in QUERIES.items() if sql}


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
    assert set(SQL) == {"op2_line_dedup", "op4_chat_formatting", "op5_url_filters", "op7_benchmark_decontamination",
                        "op11_phrase_collocations", "op12_conversation_repair", "op13_hilbert_sharding"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    res = con.sql(SQL[name])
    types = dict(zip(res.columns, map(str, res.types), strict=True))
    assert {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields} == types
    rows, want = [tuple(r) for r in df.collect()], res.fetchall()
    assert len(rows) == len(want) and digest(df.columns, rows)[0] == digest(res.columns, want)[0]


@pytest.mark.parametrize("name", ["op4_chat_formatting", "op7_benchmark_decontamination", "op13_hilbert_sharding"])
def test_native_operators_run_no_python(spark, name):
    plan = QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
