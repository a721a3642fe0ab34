"""The queries that SQL can express, against DuckDB on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from storelens.llm.oracle import ORACLE_SQL
from storelens.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    cols = sorted(d[0] for d in want.description)
    rows = want.fetchall()
    at = [[d[0] for d in want.description].index(c) for c in cols]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rows), key=str)


def test_merkle_sql_on_ragged_groups(spark, save):
    """More groups than one run holds, groups of one row, null fields."""
    rows = [(None if k == 5 else k, None if k % 7 == 0 else f"Text É {k}", None if k % 11 == 0 else f"g{k % 19}", None if k % 5 else "s", k)
            for k in range(300)] + [(1000, "alone", "zz", "s", 1)]
    folder = save(documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cols = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    want = con.execute(f"SELECT {cols} FROM ({ORACLE_SQL['op12_merkle_butterfly']})").fetchall()
    got = QUERIES["op12_merkle_butterfly"](spark, folder).select(*cols.split(", ")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
