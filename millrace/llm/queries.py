"""Registered queries of the numbered operators: thin digests of their outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm import bpe
    docs = table(spark, sf_dir, "documents")
    source = bpe.tokenizer(docs, public_tokenizers.path("byte_bpe_50k.json"))
    out = bpe.encode(docs, source, decoded=True)
    return out.select(F.col("id").alias("doc_id"), F.expr("octet_length(ids) div 4").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@register
def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import decontam
    out = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op10_winnowing_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT item, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w
  FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w
  FROM d CROSS JOIN (SELECT DISTINCT n FROM wins)),
hits AS (
  SELECT x.doc_id, x.n, x.i, wins.item
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM dw) x
  JOIN wins ON wins.n = x.n AND wins.win = x.win),
words_hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""


@register
def op5_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import common, langid
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, ~common.held_out("doc_id"))
    return out.select(F.col("id").alias("doc_id"), common.held_out("id").alias("held_out"), "lang_pred", "score")


@register
def op2_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import topk
    out = topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLES["op2_histogram_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rnk FROM s)
SELECT query_id, CAST(rnk AS INTEGER) AS rank, vec_id, score FROM r WHERE rnk <= 5
"""


@register
def op3_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import common, quality
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~common.held_out("doc_id"))
    out = quality.score(docs, quality.fit(docs, labels))
    return out.select(F.col("id").alias("doc_id"), common.held_out("id").alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import common, toxicity
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~common.held_out("doc_id"))
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select(F.col("id").alias("doc_id"), common.held_out("id").alias("held_out"),
                      *(F.col(c).alias(f"p_{c}") for c in toxicity.CHAIN),
                      (F.col(toxicity.LABELLED) >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@register
def op6_bagminhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import bagminhash
    out = bagminhash.classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id")


@register
def op9_line_edit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import line_dedup
    docs = table(spark, sf_dir, "documents")
    gone, counts = line_dedup.find(docs)
    gone = gone.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "first_id", "first_line"))).alias("gone"))
    return (docs.select("doc_id").join(counts, F.col("doc_id") == counts["id"], "left").drop("id")
            .join(gone, F.col("doc_id") == gone["id"], "left")
            .select("doc_id", F.coalesce("lines", F.lit(0)).alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
                    F.col("gone.line").alias("removed_lines"), F.col("gone.first_id").alias("first_doc_ids"),
                    F.col("gone.first_line").alias("first_lines")))


@register
def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import pii
    docs = table(spark, sf_dir, "documents")
    out = pii.find(docs, pii.fit(docs))

    def written(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return out.select(F.col("id").alias("doc_id"), *(count(k) for k in pii.KINDS),
                      F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


@register
def op1_suffix_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import suffix_dedup
    out = suffix_dedup.remove(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register
def op12_block_rotation_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import fim
    out = fim.apply(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


ORACLES["op12_block_rotation_fim"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
g AS (
  SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m,
         substr(t, greatest(a, b) + 1) AS s
  FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""


@register
def op13_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLES["op13_secondary_sort_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rnk
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rnk AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rnk <= 5
"""


@register
def op11_block_rule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import html_text
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
