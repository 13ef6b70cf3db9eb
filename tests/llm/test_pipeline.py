"""The pipeline's stages on the small tables, held against the operators one by one."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bagminhash, common, decontam, line_dedup, quality
from test_near_duplicates import classes

DIR = "/root/testdata/sf0.001"


def test_run_equals_a_plain_version(spark):
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet").where(~common.held_out("doc_id"))
    scores = {r["id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect() if scores[r["doc_id"]] >= 0.3}
    # lines: equal ones, and those one edit apart
    first, kept = [], {}
    seen: dict[str, str] = {}
    for i in sorted(text):
        lines = []
        for x in text[i].split("\n"):
            s = x.strip(" \t\r\v\f")
            again = s and (s in seen or any(len(s) >= 16 and abs(len(s) - len(o)) <= 2
                                            and line_dedup.within(s.encode(), o.encode(), 1) for o in first))
            if s and not again:
                seen[s] = s
                if len(s) >= 16:
                    first.append(s)
            if not again:
                lines.append(x)
        if any(x.strip() for x in lines) or not text[i].strip():
            kept[i] = "\n".join(lines)
    near = classes(kept)
    kept = {i: t for i, t in kept.items() if near[i] == i}
    frame = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    bad = {r["id"] for r in decontam.scan(frame, bench).where("n_hit > 0").collect()}
    kept = {i: t for i, t in kept.items() if i not in bad}
    assert sorted(out) == sorted(kept)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in kept.items():
        ids = np.frombuffer(out[i]["ids"], "<u4").tolist()
        assert ids == whole.encode(t, add_special_tokens=False).ids and out[i]["round_trip"]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "line_dedup", "minhash_near_dedup", "decontamination", "bpe_tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).dtypes == docs.dtypes


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def test_stages_take_edge_rows(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    shared = common.Shared(spark, "pipeline-test")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = shared.write(stage(spark, docs, DIR))
    assert None in {r["doc_id"] for r in docs.collect()}
    assert bagminhash.classes(edge_docs).count() == edge_docs.count()
