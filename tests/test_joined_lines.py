"""Lines of documents joined once: against the SQL, on rows that the driver's small tables don't have."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from loamgraph.functions import text as tx
from loamgraph.plans import catalog

ODD = {
    "blank": [(1, None), (2, ""), (3, " \n\t\n"), (4, "a")],
    "repeated ids": [(1, "b\na\nb"), (1, "b\na\nb"), (2, "x"), (2, "x\n\ny\n x"), (3, None), (3, "only"), (4, " "), (4, None), (5, "whole\ntext")],
    "null ids": [(None, "b\nc"), (None, "b\nc\nd"), (7, "b")],
    "odd white space": [(1, "\x0ba \x0b\nb"), (2, "a \x85\na"), (3, " a　\r\n a \na\xa0"), (4, "a\x1c\n\x1fa"), (5, "\x0b")],
}


@pytest.mark.parametrize("kind", ODD)
@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_joined_lines_equal_sql(spark, tmp_path, kind, broadcast):
    rows = spark.createDataFrame(ODD[kind], "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(catalog.SQL["description_join_unique"])
    assert [d[0] for d in cur.description] == ["doc_id", "joined_md5"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = catalog.QUERIES["description_join_unique"](spark, str(tmp_path)).select("doc_id", "joined_md5").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got), key=repr) == sorted(cur.fetchall(), key=repr)


def test_lines_at_one_place_of_several_texts_have_an_order(spark, tmp_path):
    spark.createDataFrame([(1, "b\nc"), (1, "a\nc\na"), (1, "c")], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["description_join_unique"](spark, str(tmp_path)).first().joined_md5
    assert got == spark.range(1).select(F.md5(F.lit("a\nb\nc"))).first()[0]


def test_tokens_know_the_white_space_that_sql_knows(spark):
    texts = ["a\x0bb c", "\x0b", "x\x85y z"]
    con = duckdb.connect()
    from loamgraph.plans import tables

    want = [con.execute(f"SELECT {tables.SQL_LEXICAL.format('?')}", [x]).fetchone()[0] for x in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    assert [r.x for r in rows.select("i", tx.lexical_tokens(F.col("v")).alias("x")).orderBy("i").collect()] == want
