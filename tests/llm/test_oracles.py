"""Queries next to their SQL, on rows with every edge case and on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from truegauge.llm.queries import ORACLES, QUERIES
from verification.check import compare

TINY = "/root/testdata/sf0.001"
MORE = [
    (20, "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- then text", "en", "g", 1),
    (21, "-----BEGIN PRIVATE KEY-----\nno marker -----END x -----BEGIN PRIVATE KEY----- open", "en", "g", 1),
    (22, "eyJab12.eyJcd34.sig_-99999999999999999999 and ghp_0123456789abcdef0123 xoxb-short", "en", "g", 1),
    (23, "ſecret=abcdefghij toKen: 'zzzzzzzzzz' toKen=kkkkkkkkkk 0123456789abcdef0123456789abcdef", "en", "g", 1),
]
PAGES = [(1, "http://a/", None), (2, None, "é"), (3, "http://b/", ""), (4, "x", "é"), (5, "x", "z" * 70000)]


@pytest.fixture(scope="module")
def edge_tables(spark, edge, tmp_path_factory):
    """Tables with edge rows; items of ten words, of fewer, of none and without an id."""
    folder = str(tmp_path_factory.mktemp("edge"))
    edge.unionByName(spark.createDataFrame(MORE, edge.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    items = [(1, "a B c d e f a b c d e g"), (2, "same LINE other"), (3, None), (4, "..."), (None, "short text"),
             (5, "word7 line7 word8 line8 word9 line9 word10 line10 word11 line11 word12")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i % 40, [((i * j) % 17 - 8) / 8.0 for j in range(64)]) for i in range(60)]
    vectors += [(None, [0.25] * 64), (None, None), (70, [1.0]), (71, [float("nan")] * 64), (72, [None] * 64),
                (73, [float("-inf")] * 64), (74, [])]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def same(spark, name, folder):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        files = f"{folder}/{table}.parquet" + ("" if folder == TINY else "/*.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    said, ok = compare(name, QUERIES[name](spark, folder), connection, ORACLES)
    assert ok, said


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql_on_edge_rows(spark, edge_tables, name):
    same(spark, name, edge_tables)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    same(spark, name, TINY)
