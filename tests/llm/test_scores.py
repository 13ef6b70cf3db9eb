"""Quality, toxicity and language: held-out accuracy and edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import common, langid, quality, toxicity

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    model = quality.fit(docs, labels.where(~common.held_out("doc_id")))
    scored = quality.score(docs, model).join(labels, F.col("id") == labels["doc_id"]).where(common.held_out("doc_id"))
    hits = scored.select(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert hits > 0.95
    assert quality.keep(docs, model).columns == docs.columns


def test_toxicity_on_held_out_rows(spark):
    large = "/root/testdata/sf0.1"  # 97 toxic documents held out
    docs, labels = spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~common.held_out("doc_id")))
    given = labels.select("doc_id", F.col("toxic").alias("given"))
    out = toxicity.score(docs, model).join(given, F.col("id") == F.col("doc_id")).where(common.held_out("doc_id"))
    flagged = F.avg((F.col("toxic") >= toxicity.THRESHOLD).cast("int"))
    got = {r["given"]: r[1] for r in out.groupBy("given").agg(flagged).collect()}
    assert got[0] < 0.05 and got[1] >= 0.9


def test_earlier_categories_are_found_in_the_labels(spark):
    rnd = random.Random(4)
    neutral = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    groups = [[f"{g}{w}" for w in ("orvax", "ilbut", "endro", "asquith", "umper")] for g in ("zq", "xv")]
    docs, labels, group = [], [], {}
    for i in range(1500):
        words = [rnd.choice(neutral) for _ in range(40)]
        g = rnd.randrange(2) if rnd.random() < 0.15 else None
        if g is not None:
            words += rnd.sample(groups[g], rnd.randint(2, 3))
            group[i] = g
        rnd.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(g is not None)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels.where(~common.held_out("doc_id"))))
    got = out.where(common.held_out("id")).collect()
    assert sum(r["id"] in group for r in got) > 20
    first = next(r for r in got if r["id"] in group)
    swap = (first["kind_1"] > first["kind_2"]) != (group[first["id"]] == 0)  # kinds have no given order
    hits = {0: [], 1: []}
    for r in got:
        p = (r["kind_2"], r["kind_1"]) if swap else (r["kind_1"], r["kind_2"])
        if r["id"] in group:
            g = group[r["id"]]
            hits[g].append(p[g] > 0.5)
            assert p[1 - g] < 0.2 and r["toxic"] > 0.5
        else:
            assert max(p) < 0.2 and r["toxic"] < toxicity.THRESHOLD
    assert all(sum(h) >= 0.9 * len(h) for h in hits.values())


def test_language_on_held_out_rows(tables):
    docs, _ = tables
    out = langid.identify(docs, ~common.held_out("doc_id")).join(docs, F.col("id") == docs["doc_id"])
    held = out.where(common.held_out("doc_id"))
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_edges(spark, edge_docs, no_docs):
    out = {}
    for r in langid.identify(edge_docs, F.lit(True)).collect():
        out.setdefault(r["id"], []).append((r["lang_pred"], r["score"]))
    assert sum(map(len, out.values())) == edge_docs.count()
    for i in (1, 2, 3, 9):
        assert out[i] == [("und", 0.0)]
    assert all(p == "en" and 0 <= s <= 1 for i in (0, 4, 5, 6, 7, 8, None) for p, s in out[i])
    assert {r["lang_pred"] for r in langid.identify(edge_docs, F.lit(False)).collect()} == {"und"}
    assert langid.identify(no_docs, F.lit(True)).count() == 0


def test_training_without_labels_or_with_one_class(spark, edge_docs, no_docs):
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (None, 0, 1), (99, 0, 1)], schema)
    n = edge_docs.count()
    assert [r["score"] for r in quality.score(edge_docs, quality.fit(edge_docs, none)).collect()] == [0.5] * n
    assert [r["score"] for r in quality.score(edge_docs, quality.fit(edge_docs, one)).collect()] == [1.0] * n
    assert {r["toxic"] for r in toxicity.score(edge_docs, toxicity.fit(edge_docs, one)).collect()} == {0.0}
    both = spark.createDataFrame([(0, 1, 0), (4, 1, 0), (1, 0, 1), (5, 0, 1)], schema)
    for df in (edge_docs, no_docs):
        q = quality.score(df, quality.fit(edge_docs, both)).collect()
        t = toxicity.score(df, toxicity.fit(edge_docs, both)).collect()
        assert len(q) == len(t) == df.count()
        assert all(0 <= r["score"] <= 1 for r in q) and all(0 <= r[c] <= 1 for r in t for c in toxicity.CHAIN)
