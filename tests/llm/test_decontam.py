"""Winnowing hits against the SQL oracle, on both join paths."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam
from millrace.llm.queries import ORACLES, QUERIES

NAME = "op10_winnowing_decontamination"


@pytest.fixture(scope="module")
def tables(spark):
    item = ("the quick brown fox jumps over the lazy dog again and again until night falls on the quiet village "
            "where nobody sleeps")
    words = item.split()
    items = spark.createDataFrame([(1, item), (2, "Short Item here"), (3, None), (4, ""), (5, "ten words " * 5),
                                   (None, "an item without an id has words too"), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(0, "Intro. " + " ".join(words[3:14]).upper() + " end"), (1, " ".join(words[3:12])), (2, None), (3, ""),
         (4, "a short item, here!"), (5, "short item there"), (6, "ten words " * 40), (7, "An item without an id has words too."),
         (8, item + " x " + item), (8, item + " x " + item), (9, " ".join(words[:9]) + " " + " ".join(words[10:]))],
        "doc_id long, text string")
    return docs, items


def test_paths_agree_with_sql(spark, tables):
    docs, items = tables
    con = duckdb.connect()
    d, b = docs.dropDuplicates(["doc_id"]).toPandas(), items.where("item_id IS NOT NULL").toPandas()
    con.register("documents", d)
    con.register("benchmark", b)
    want = {r[0]: r[1:4] for r in con.execute(ORACLES[NAME]).fetchall()}
    named = items.where("item_id IS NOT NULL")
    for limit in (1 << 24, 0):
        out = decontam.scan(docs, named, broadcast_bytes=limit).collect()
        assert len(out) == docs.count()
        assert {r["id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in out} == want


def test_items_without_id_mark_words_only(tables):
    docs, items = tables
    for limit in (1 << 24, 0):
        out = {r["id"]: r for r in decontam.scan(docs, items, broadcast_bytes=limit).collect()}
        assert (out[7]["n_hit"], out[7]["items"]) == (8, [])
        assert out[0]["items"] == ["1"] and out[1]["n_hit"] == 0


def test_query_equals_oracle_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({ORACLES[NAME]})").fetchall())
    assert sorted(tuple(r) for r in QUERIES[NAME](spark, sf).collect()) == want


def test_edges(edge_docs, no_docs, tables):
    _, items = tables
    assert decontam.scan(edge_docs, items).count() == edge_docs.count()
    assert decontam.scan(no_docs, items).count() == 0
    for limit in (1 << 24, -1):
        out = decontam.scan(edge_docs, items.limit(0), broadcast_bytes=limit)
        assert out.agg(F.sum("n_hit")).first()[0] == 0
    kept = decontam.remove(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


def test_rows_are_removed_by_their_own_text(spark, tables):
    docs, items = tables
    hit = "An item without an id has words too."
    rows = spark.createDataFrame([(None, hit), (None, "a clean row"), (1, hit), (1, "another clean row"), (2, None)],
                                 "doc_id long, text string")
    for limit in (1 << 24, 0):
        kept = decontam.remove(rows, items, broadcast_bytes=limit).collect()
        assert sorted(map(str, kept)) == sorted(map(str, [r for r in rows.collect() if r["text"] != hit]))


def test_words_that_collide_modulo_two_to_the_64th(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    docs = spark.createDataFrame([(0, f"x {a} y"), (1, f"x {b} y")], "doc_id long, text string")
    for limit in (1 << 24, 0):
        got = decontam.scan(docs, items, broadcast_bytes=limit)
        assert {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got.collect()} == {0: (3, 1, ["1"]), 1: (3, 0, [])}
        assert [r["doc_id"] for r in decontam.remove(docs, items, broadcast_bytes=limit).collect()] == [1]
