"""Block rotation against slicing, exact round trips, and the SQL oracle."""

import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import fim
from millrace.llm.queries import ORACLES, QUERIES

NAME = "op12_block_rotation_fim"


def plain_version(ident, text):
    """(n, form, prefix, middle, output) by slicing a string."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab<>PSM é日🎉\n"), max_size=40), st.data())
def test_every_cut_round_trips(text, data):
    if any(s in text for s in ("<P>", "<S>", "<M>")):
        return
    raw = text.encode()
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    p, m, s = text[:a], text[a:b], text[b:]
    for form, want in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}")):
        made = fim.transform(raw, a, b, form, fim.places(raw))
        assert made.decode() == want
        assert fim.restore(bytes(made), form) == raw


@pytest.mark.parametrize("left,right", [(0, 0), (0, 5), (5, 0), (1, 1), (3, 8), (8, 3)])
def test_rotation(left, right):
    buf = bytearray(b"##" + b"a" * left + bytes(range(65, 65 + right)) + b"##")
    fim.rotate(buf, 2, 2 + left, 2 + left + right)
    assert bytes(buf) == b"##" + bytes(range(65, 65 + right)) + b"a" * left + b"##"


def test_edges_equal_the_plain_version(spark, edge_docs, no_docs):
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["x", "with <P> inside", "<S>", "<", "<<<", "P>S>M>", "ends in <", "é" * 999, "a\u0000b"])] * 3, "doc_id long, text string")
    for df in (edge_docs, extra, extra.withColumnRenamed("doc_id", "n").selectExpr("n as doc_id", "text", "1 as n", "2 as output")):
        want = sorted((r["doc_id"] is None, r["doc_id"], *plain_version(r["doc_id"], r["text"]), r["text"] or "") for r in df.collect())
        got = sorted((r["id"] is None, r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"])
                     for r in fim.apply(df).collect())
        assert repr(got) == repr(want)
    assert fim.apply(no_docs).count() == 0


def test_all_forms_occur_and_query_equals_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES[NAME](spark, sf)
    want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[NAME]})").fetchall())
    got = sorted(tuple(r) for r in df.collect())
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert len(got) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
