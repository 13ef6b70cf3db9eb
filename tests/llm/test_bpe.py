"""Byte-exact agreement with the tokenizers library, whole and in leaves."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def encode_leaves(c, text, leaf):
    out, piece, parts = [], 0, []
    for p, x in c.leaves(text, leaf):
        if p != piece or p == 0:
            out += c.tree(parts)
            piece, parts = p, []
        parts.append(c.bare(x) if p else bpe.unpack(c.encode_all([x])[0]))
    return out + c.tree(parts)


def test_leaves_and_memo_equal_the_library(whole):
    c = bpe.Coder(open(PATH, encoding="utf-8").read())
    rnd = random.Random(3)
    alphabets = ["abcde", "aA 1'", "é日本 \n", "thein tion 's't", "<|endoftext|> a", "   \n\t a", "aaaaaab",
                 "0123456789.,-", "ab\x1c \x85\xa0 ."]
    for i in range(1500):
        a = rnd.choice(alphabets)
        text = "".join("<|endoftext|>" if rnd.random() < 0.01 else rnd.choice(a) for _ in range(rnd.randint(0, 400)))
        want = whole.encode(text, add_special_tokens=False).ids
        assert bpe.unpack(c.encode_all([text])[0]) == want, repr(text)
        assert encode_leaves(c, text, rnd.choice([3, 8, 20, 64])) == want, repr(text)


def test_documents_short_and_long(spark, edge_docs, whole):
    source = bpe.tokenizer(edge_docs, PATH)
    want = sorted((repr(r["doc_id"]), tuple(whole.encode(r["text"] or "", add_special_tokens=False).ids), r["text"] or "")
                  for r in edge_docs.collect())
    for long_chars in (65_536, 20):
        out = bpe.encode(edge_docs, source, long_chars=long_chars, leaf_chars=16, decoded=True).collect()
        assert sorted((repr(r["id"]), tuple(bpe.unpack(r["ids"])), r["text"]) for r in out) == want
    again = bpe.decode(bpe.encode(edge_docs, source), source)
    assert sorted(r["text"] for r in again.collect()) == sorted(w[2] for w in want)


def test_empty_table(no_docs):
    source = bpe.tokenizer(no_docs, PATH)
    assert bpe.encode(no_docs, source, decoded=True).count() == 0


def test_packed_decoding_equals_the_library_for_any_ids(whole, monkeypatch):
    """Random ids too: bytes that are no UTF-8, the special token, ids outside the vocabulary, blocks that end inside a character."""
    c = bpe.Coder(open(PATH, encoding="utf-8").read())
    monkeypatch.setattr(bpe, "DECODE_IDS", 7)
    rnd = random.Random(11)
    lists = [[rnd.choice([rnd.randrange(256), rnd.randrange(50_257), 50_256]) for _ in range(rnd.randint(0, 30))] for _ in range(400)]
    lists += [whole.encode(t, add_special_tokens=False).ids for t in ("", "é日本🎉 a", "x" * 500, "<|endoftext|>")]
    for part in (lists, lists[:1], [], [[]], lists[-4:]):
        assert c.decode_packed([bpe.pack(x) for x in part]).to_pylist() == whole.decode_batch(part, skip_special_tokens=False)
    assert c.decode_packed([bpe.pack([64, 4_000_000, 65])]).to_pylist() == [whole.decode([64, 4_000_000, 65], skip_special_tokens=False)]
