"""Base spans against the plain patterns; labels carried by the random field."""

import random
import re

from millrace.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rnd = random.Random(5)
    for alphabet in ("a1@.-", "12.", "0123456789 -", "+1 ()-.2345678901", "a@b.c @é.", "1234567890+ -.@a"):
        for _ in range(4000):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
            assert pii.base_spans(t) == brute(t), repr(t)


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "+1" + " " * 300_000, "1-" * 150_000, "@" * 300_000):
        pii.base_spans(t)


CARDS = ["4111 1111 1111 1111", "5500005555555559"]


def test_similar_token_takes_the_label(spark, edge_docs):
    rows = [(i, f"pay {c} or {c} from 10.0.0.{i} and mail a{i}@x.org a{i}@x.org") for i in range(40) for c in CARDS]
    rows += [(100 + i, f"order {i} of item {7 * i} for page {i}") for i in range(60)]
    near = "pay 5500005555555559 now, and 5500005555555550 later; order 12"
    df = spark.createDataFrame([*rows, (500, near), (501, "order 12 and 5500005555555550")], "doc_id long, text string")
    model = pii.fit(df)
    out = {r["id"]: r for r in pii.find(df, model).where("id >= 500").collect()}
    assert [tuple(s) for s in out[500]["base"]] == brute(near)
    extra = [(near[s["start"]:s["end"]], s["kind"]) for s in out[500]["spans"] if s["kind"].endswith("_like")]
    assert extra == [("5500005555555550", "card_like")]
    assert out[501]["spans"] == []                      # nothing known beside it
    assert {tuple(s) for s in out[500]["base"]} <= {tuple(s) for s in out[500]["spans"]}


def test_numbers_in_groups_take_the_label(spark):
    rows = [(i, f"call +44 20 7946 0{i:03d} or +44 20 7946 0{i:03d}; pay 4111 1111 1111 1111 or 4111 1111 1111 1111") for i in range(60)]
    rows += [(100 + i, f"order {i} of item {7 * i} for page {i}") for i in range(60)]
    near = ("call +44 20 7946 0958 or pay 4111 1111 1111 1111; some plain words that stand between the numbers of this text, "
            "then 44 20 7946 0958 again, more plain words that stand between the numbers, and 4111 1111 1111 1112 at the end")
    df = spark.createDataFrame([*rows, (500, near)], "doc_id long, text string")
    out = pii.find(df, pii.fit(df)).where("id = 500").first()
    assert [tuple(s) for s in out["base"]] == brute(near)
    assert [(near[s["start"]:s["end"]], s["kind"]) for s in out["spans"] if s["kind"].endswith("_like")] == [
        ("44 20 7946 0958", "phone_like"), ("4111 1111 1111 1112", "card_like")]


def test_shapes_and_groups_read_whole_texts():
    assert pii.shape("ab-" * 30 + "1") != pii.shape("ab-" * 30 + "12")
    for t in ("1 " * 150_000, "1" + " " * 300_000, "1((((" * 60_000, "1 1 " + "a" * 300_000):
        assert pii.nodes(t, []) is not None
    text = "x 1234-5678 and 12 34 and " + "1 " * 30
    assert [text[a:b] for a, b in pii.grouped(text, [])] == ["1234-5678"]


def test_edges(edge_docs, no_docs):
    model = pii.fit(edge_docs)
    out = pii.find(edge_docs, model).collect()
    assert len(out) == edge_docs.count() and all(r["base"] == [] for r in out)
    assert pii.find(no_docs, pii.fit(no_docs)).count() == 0
