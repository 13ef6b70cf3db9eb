"""BagMinHash classes and line classes against pairwise comparison."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import bagminhash as bm
from millrace.llm import common, line_dedup, linking

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def bag(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def jaccard(a, b):
    both = sum(min(v, b.get(k, 0)) for k, v in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


def classes(texts):
    sets, bags = Sets(), {i: bag(t) for i, t in texts.items()}
    ids = sorted(texts)
    for n, a in enumerate(ids):
        sets.find(a)
        for b in ids[:n]:
            if texts[a] == texts[b] or (bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= 0.8):
                sets.join(a, b)
    return {i: sets.find(i) for i in ids}


def corpus(seed, n=120):
    rnd = random.Random(seed)
    out, base = {}, [" ".join(f"w{rnd.randint(0, 400)}" for _ in range(120)) for _ in range(6)]
    for i in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        out[i] = " ".join(w) if rnd.random() < 0.85 else " ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(40))
    return out


@pytest.mark.parametrize("seed, few", [(1, 0), (2, 10**6)])
def test_classes_equal_pairwise_comparison(spark, monkeypatch, seed, few):
    monkeypatch.setattr(linking, "FEW", few)
    t = corpus(seed)
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    assert {r["id"]: r["class_id"] for r in bm.classes(df).collect()} == classes(t)


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    for vocabulary in (12, 4000):                      # many repeats, and none
        a = [f"w{i}" for i in r.integers(0, vocabulary, 400)]
        b = [x if r.random() > 0.15 else f"z{k}" for k, x in enumerate(a)]
        s = bm.shingles(*common.text_buffer(pa.array([" ".join(a), " ".join(b)])), size=1)
        parts = [(np.zeros((s[0] == k).sum(), np.int64), s[1][s[0] == k], s[2][s[0] == k]) for k in (0, 1)]
        sig = bm.signatures(*s, 2, 4096)
        assert abs((sig[0] == sig[1]).mean() - bm.similarity(*parts, 1)[0]) < 0.03


def test_signature_filter_loses_no_more_than_the_bands():
    for similarity in (0.8, 0.805, 0.81, 0.83):
        slot = similarity + (1 - similarity) / 256
        least = bm.least_agreement(bm.THRESHOLD)
        filtered = sum(math.comb(bm.SLOTS, k) * slot**k * (1 - slot) ** (bm.SLOTS - k) for k in range(least))
        assert filtered <= (1 - similarity**bm.ROWS) ** bm.BANDS


@pytest.fixture()
def refined(monkeypatch):
    """Numbers of pairs that open buckets give."""
    seen, real = [], linking._refined_pairs

    def counted(*args):
        pairs = real(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(linking, "_refined_pairs", counted)
    monkeypatch.setattr(linking, "FEW", 10**6)  # no pivots before
    return seen


def test_documents_of_one_pattern_form_no_pairs(spark, refined):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    docs = {}
    for i in range(150):
        at = rnd.randrange(250)  # 40 words in a row are its own: similarity about 0.55
        docs[i] = " ".join(base[:at] + [f"e{i}x{k}" for k in range(40)] + base[at + 40:])
    docs[200] = docs[7].replace("w299", "other")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["id"]: r["class_id"] for r in bm.classes(df).collect()} == classes(docs)
    assert len(refined) == 1 and refined[0] < len(docs)


def test_lines_with_a_serial_number_form_few_pairs(spark, refined):
    rnd = random.Random(6)
    head, tail = ("".join(rnd.choice("abcdefgh ") for _ in range(150)) for _ in range(2))
    docs = {i: f"{head}{rnd.randrange(10**12):012d}{tail}x" for i in range(150)}
    docs[200] = docs[9].replace("x", "y")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    gone, _ = line_dedup.find(df)
    assert [(r["id"], r["first_id"]) for r in gone.collect()] == [(200, 9)]
    # lines that share four digits of their numbers by chance still meet
    assert len(refined) == 1 and 0 < refined[0] < len(docs) ** 2 / 40


def test_lines_with_a_short_insertion_form_few_pairs(spark, refined):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    docs = {}
    for i in range(120):  # two such lines are 8 edits apart, each is 4 from the line without
        k = rnd.randrange(60)
        docs[i] = " ".join([*words[:k], words[k] + "".join(rnd.choice("uvwxyz") for _ in range(4)), *words[k + 1:]])
    docs[200] = docs[3] + "s"
    sets = Sets()
    for a in docs:
        sets.find(a)
        for b in docs:
            if a < b and line_dedup.within(docs[a].encode(), docs[b].encode(), 3):
                sets.join(a, b)
    gone, _ = line_dedup.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r["id"]: r["first_id"] for r in gone.collect()} == {i: sets.find(i) for i in docs if sets.find(i) != i}
    assert len(refined) == 1 and refined[0] < len(docs) ** 2 / 8  # insertions in one word or neighbouring ones


def test_sketches_and_places_pass_all_links(spark):
    rnd = random.Random(13)
    pairs = []
    for _ in range(400):
        n, k = rnd.choice([(16, 1), (63, 1), (64, 2), (127, 2), (131, 3), (300, 3)]), rnd.randint(0, 3)
        a = bytes(rnd.choice(b"abcd") for _ in range(n[0]))
        b = edited(rnd, a, min(k, n[1]), b"abcd")
        if len(b) >= 16 and line_dedup.within(a, b, 1 if min(len(a), len(b)) < 64 else 2 if min(len(a), len(b)) < 128 else 3):
            pairs.append((a, b))
    assert len(pairs) > 200
    rows = []
    for a, b in pairs:
        raw, off = np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)])
        sk = line_dedup.sketch(raw, off[:-1], off[1:]).view(np.int64).tolist()
        owner, el, size, most, place = line_dedup._placed_grams(raw, off[:-1], off[1:], line_dedup.MAX_EDITS)
        alone, row = [set(el[owner == x].tolist()) for x in (0, 1)], []
        for x in (0, 1):
            at = [p for e, p, o in zip(el.tolist(), place.tolist(), owner.tolist()) if o == x and p >= 0 and e not in alone[1 - x]]
            row += [(len((a, b)[x]), *sk[x]), (int(size[owner == x][0]), len(at), min(at, default=None), max(at, default=None))]
        rows.append(row)
    words = ", ".join(f"w{i}: bigint" for i in range(16))
    kind = ", ".join(f"s{x} struct<length: bigint, {words}>, p{x} struct<size: int, lost: int, lo: int, hi: int>" for x in "ab")
    df = spark.createDataFrame(rows, kind)
    ok = line_dedup.alike(df["sa"], df["sb"], line_dedup.MAX_EDITS) & line_dedup.affordable(df["pa"], df["pb"], line_dedup.MAX_EDITS)
    assert df.where(ok).count() == len(rows)


def test_a_written_table_leaves_no_shuffle_files(spark):
    shared = common.Shared(spark, "cleanup-test")
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    for _ in range(3):
        assert shared.write(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()).count() == 700
    assert tracker.shuffleStatuses().size() <= before + 3  # the counts' own
    assert spark.conf.get(common.CLEANUP) == "false"


def test_near_duplicate_edges(edge_docs, no_docs):
    got = {}
    for r in bm.classes(edge_docs).collect():
        got.setdefault(r["id"], set()).add(r["class_id"])
    assert got[None] == {None} and got[7] == {0} and got[2] == {1} and got[6] == {6}
    kept = bm.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [0, 1, 3, 4, 5, 6, 6, 8, 9, None]))
    assert bm.classes(no_docs).count() == 0 and bm.keep_first(no_docs).count() == 0


def test_components_of_chains_and_stars(spark, tmp):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(rnd.randint(200, 230), rnd.randint(200, 230)) for _ in range(25)]
    ids = sorted({x for e in edges for x in e})
    shared = common.Shared(spark, "components-test")
    nodes = spark.createDataFrame([(i, i) for i in ids], "id long, comp long")
    got = linking.components(nodes, spark.createDataFrame(edges, "a long, b long"), shared)
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    assert {r["id"]: r["comp"] for r in got.collect()} == {i: sets.find(i) for i in ids}


# ---------------------------------------------------------------------- lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rnd, a, edits, alphabet):
    b = bytearray(a)
    for _ in range(edits):
        k, i = rnd.randint(0, 2), rnd.randint(0, len(b))
        if k == 0:
            b.insert(i, rnd.choice(alphabet))
        elif b and k == 1:
            del b[min(i, len(b) - 1)]
        elif b:
            b[min(i, len(b) - 1)] = rnd.choice(alphabet)
    return bytes(b)


def test_banded_distance_and_complete_buckets():
    rnd = random.Random(3)
    for _ in range(6000):
        a = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 14)))
        b, k = edited(rnd, a, rnd.randint(0, 4), b"abc"), rnd.randint(0, 4)
        assert line_dedup.within(a, b, k) == (distance(a, b) <= k)
    for _ in range(1500):
        k = rnd.randint(1, 3)
        a = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(k + 1, 20)))
        b = edited(rnd, a, k, b"ab")
        if len(b) <= k or distance(a, b) > k:
            continue
        p = common.prefix_hash(np.frombuffer(a + b, np.uint8))
        found = [set(), set()]
        for who, bucket in line_dedup.bucket_rows(p, np.array([0, len(a)]), np.array([len(a), len(a) + len(b)]), k, rnd.randint(1, 4)):
            for w, x in zip(who.tolist(), bucket.tolist()):
                found[w].add(x)
        assert found[0] & found[1], (a, b, k)


def test_lines_within_the_edits_share_a_first_gram():
    rnd = random.Random(8)
    for _ in range(1500):
        k = rnd.randint(1, 3)
        a = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(k + 1, 30)))
        b = edited(rnd, a, k, b"abc")
        if len(b) <= k:
            continue
        owner, el, size, most = line_dedup.grams(np.frombuffer(a + b, np.uint8), np.array([0, len(a)]),
                                                 np.array([len(a), len(a) + len(b)]), k)
        order = np.argsort(common.mix(el ^ np.uint64(rnd.getrandbits(64))), kind="stable")  # any order of elements
        first = []
        for x in (0, 1):
            own = order[owner[order] == x]
            assert len(own) == len(set(el[own].tolist())) == size[own[0]]
            first.append(set(el[own[: most[own[0]]]].tolist()))
        assert first[0] & first[1], (a, b, k)


@pytest.mark.parametrize("edits", [1, 2])
def test_removed_lines_equal_pairwise_comparison(spark, edits):
    rnd = random.Random(edits)
    lines = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(17, 40))) for _ in range(25)] + ["ab", "ac", "", "  "]
    docs = {i: "\n".join(edited(rnd, rnd.choice(lines).encode(), rnd.choice([0, 0, 1, 2]), b"xyz").decode()
                         for _ in range(rnd.randint(0, 6))) for i in range(60)}
    places = [(i, n, x.strip(" \t\n\r\v\f")) for i, t in sorted(docs.items()) for n, x in enumerate(t.split("\n"))]
    places = [p for p in places if p[2]]
    sets, distinct = Sets(), sorted({p[2] for p in places})
    for n, a in enumerate(distinct):
        sets.find(a)
        for b in distinct[:n]:
            if min(len(a), len(b)) >= 16 and distance(a.encode(), b.encode()) <= edits:
                sets.join(a, b)
    first = {}
    for i, n, x in places:
        first.setdefault(sets.find(x), (i, n))
    want = sorted((i, n, *first[sets.find(x)]) for i, n, x in places if first[sets.find(x)] != (i, n))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    gone, counts = line_dedup.find(df, max_edits=edits)
    assert sorted(tuple(r) for r in gone.collect()) == want
    assert {r["id"]: r["lines"] for r in counts.collect()} == collections.Counter(i for i, _, _ in places)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.remove(df, max_edits=edits).collect()}
    bad = {(i, n) for i, n, _, _ in want}
    for i, t in docs.items():
        own = [n for j, n, _ in places if j == i]
        if own and all((i, n) in bad for n in own):
            assert i not in kept
        else:
            assert kept[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in bad)


def test_edits_grow_with_the_length_of_the_line(spark):
    rnd = random.Random(11)
    steps = [(16, 1), (64, 2), (128, 3)]
    lines = []
    for size in (18, 40, 63, 64, 65, 90, 127, 128, 130, 300):
        for _ in range(3):
            a = "".join(rnd.choice("abcdefgh ") for _ in range(size - 2)).encode()
            a = b"s" + a + b"e"
            lines += [a, *(b"s" + edited(rnd, a[1:-1], k, b"xyz") + b"e" for k in (1, 2, 3, 4))]
    lines = [x.decode() for x in dict.fromkeys(lines)]
    sets = Sets()
    for n, a in enumerate(lines):
        sets.find(n)
        for m, b in enumerate(lines[:n]):
            short = min(len(a), len(b))
            if line_dedup.within(a.encode(), b.encode(), max((e for least, e in steps if short >= least), default=0)):
                sets.join(n, m)
    assert sum(sets.find(n) != n for n in range(len(lines))) > 40
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone, _ = line_dedup.find(df)
    assert {r["id"]: r["first_id"] for r in gone.collect()} == {n: sets.find(n) for n in range(len(lines)) if sets.find(n) != n}


def test_field_hashes_are_the_polynomials(monkeypatch):
    rnd = random.Random(7)
    base, raw = common.draw_base(), np.array([rnd.randrange(256) for _ in range(700)], np.uint8)
    monkeypatch.setattr(common, "BLOCK", 64)
    start = np.array([rnd.randrange(700) for _ in range(200)])
    end = np.array([rnd.randint(s, 700) for s in start])
    want = [sum((int(raw[t]) + 1) * pow(base, -int(t - s), common.PRIME) for t in range(s, e)) % common.PRIME for s, e in zip(start, end)]
    got = common.field_hash(common.field_prefix(raw, base), start, end, base)
    assert (got == common.mix(np.array(want, np.uint64))).all()
    big = np.full(3, common.PRIME - 1, np.uint64)
    assert (common.field_product(big, big) == 1).all()


def test_lines_that_collide_modulo_two_to_the_64th(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer((a + b).encode(), np.uint8)
    same = common.span_hash(common.prefix_hash(raw), np.array([0, 2048]), np.array([2048, 4096]))
    assert same[0] == same[1]
    docs = {0: a, 1: b, 2: b, 3: b[:-1] + "c", 4: a}
    gone, _ = line_dedup.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert sorted((r["id"], r["first_id"]) for r in gone.collect()) == [(2, 1), (3, 1), (4, 0)]


def test_line_edges(edge_docs, no_docs):
    kept = line_dedup.remove(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [0, 1, 2, 3, 4, 5, 6, 6, 8, 9, None]))
    assert line_dedup.remove(no_docs).count() == 0
    assert line_dedup.remove(edge_docs.where(F.col("text").isNull())).first()["text"] is None
    named = edge_docs.withColumn("_gone_lines", F.lit("x")).withColumn("_GONE_ID", F.lit("y")).withColumn("_gone_all", F.lit("z"))
    again = line_dedup.remove(named)
    assert again.columns == named.columns
    assert sorted(map(str, again.drop("_gone_lines", "_GONE_ID", "_gone_all").collect())) == sorted(map(str, kept.collect()))
    assert {tuple(r) for r in again.select("_gone_lines", "_GONE_ID", "_gone_all").collect()} == {("x", "y", "z")}


def test_lines_travel_packed_by_parts(spark, monkeypatch):
    """Buckets cross the shuffle in a few rows and lines meet whatever the number of parts."""
    rnd = random.Random(31)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(n)).strip() + "." for n in (20, 40, 90, 150, 400) * 30]
    docs = {i: t for i, t in enumerate(texts)} | {1000 + i: t[:7] + "#" + t[7:] for i, t in enumerate(texts) if i % 3 == 0}
    rows = list(docs.items())
    monkeypatch.setattr(line_dedup, "PACK_ROWS", 200)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])
    found = {}
    for parts in (1, 16):
        packed = list(line_dedup._bucket_lines(iter([batch]), line_dedup.MAX_EDITS, 16, 12345, parts))
        assert sum(b.num_rows for b in packed) <= parts * len(packed)
        ordered = pa.Table.from_batches(packed).sort_by("part").to_batches(max_chunksize=3)
        found[parts] = set().union(*(b.column("id").to_pylist() for b in line_dedup._meeting(iter(ordered))))
    assert found[1] == found[16] and len(found[1]) == 100
    monkeypatch.setattr(line_dedup, "PART_ROWS", 64)
    gone, _ = line_dedup.find(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["id"], r["first_id"]) for r in gone.collect()} == {(1000 + i, i) for i in range(0, 150, 3)}


def test_few_pairs_are_compared_without_elements(spark, monkeypatch):
    """Where buckets hold few pairs, lines are compared by sketches at once and no substring is counted."""
    monkeypatch.setattr(linking, "_refined_pairs", lambda *a: pytest.fail("elements of every line"))
    rnd = random.Random(32)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(200)).strip() + "." for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t[:90] + "#" + t[90:]) for i, t in enumerate(texts)]
    gone, _ = line_dedup.find(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["id"], r["first_id"]) for r in gone.collect()} == {(100 + i, i) for i in range(40)}


@pytest.mark.parametrize("base", [True, False])
def test_large_buckets_do_not_pair_all_their_lines(spark, monkeypatch, base):
    """Lines of one family that differ in different words are no candidates, and no link between them is lost."""
    monkeypatch.setattr(linking, "DIRECT", 10**6)
    monkeypatch.setattr(line_dedup, "alike", lambda x, y, max_edits: F.lit(True))  # all candidates are verified
    seen, real = [], linking._bucket_pairs

    def counted(*args):
        pairs = real(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(linking, "_bucket_pairs", counted)
    rnd = random.Random(33)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    docs = {0: " ".join(words)} if base else {}
    for i in range(1, 151):
        own = list(words)
        for k in rnd.sample(range(60), 1 + i % 2):
            own[k] = "".join(rnd.choice("uvwxyz") for _ in range(7))
        docs[i] = " ".join(own)
    for i in range(1, 151, 5):
        docs[200 + i] = edited(rnd, docs[i].encode(), rnd.randint(1, 3), b"abcdefgh").decode()
        if base:
            docs[400 + i] = edited(rnd, " ".join(words).encode(), rnd.randint(1, 3), b"abcdefgh").decode()
    sets = Sets()
    for a in docs:
        sets.find(a)
        for b in docs:
            if a < b and line_dedup.within(docs[a].encode(), docs[b].encode(), 3):
                sets.join(a, b)
    gone, _ = line_dedup.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    want = {i: sets.find(i) for i in docs if sets.find(i) != i}
    assert len(want) >= 30 and {r["id"]: r["first_id"] for r in gone.collect()} == want
    assert len(seen) == 1 and seen[0] < len(docs) ** 2 / 10  # half the square before


def test_linked_lines_differ_from_a_third_in_the_same_places():
    rnd = random.Random(34)
    met = apart = 0
    for n in range(12000):
        letters = (b"ab", b"abcd")[n % 2]
        pivot, k = bytes(rnd.choice(letters) for _ in range(rnd.randint(5, 40))), rnd.randint(1, 3)
        a = edited(rnd, pivot, rnd.randint(0, 8), letters)
        b = edited(rnd, a if n % 5 else pivot, rnd.randint(0, 3 if n % 5 else 8), letters)
        near = [line_dedup.within(pivot, x, k) for x in (a, b)]
        x, y = (line_dedup.differences(pivot, z, k, linked) for z, linked in zip((a, b), near))
        assert x[0] <= x[1] and x[2] <= x[3]
        both = all(max(x[i], y[i]) <= min(x[i + 1], y[i + 1]) for i in (0, 2))
        if not all(near):
            if line_dedup.within(a, b, k):
                met += 1
                assert both
            else:
                apart += not both
    assert met > 1000 and apart > 100


def test_signatures_are_made_in_bounded_pieces(monkeypatch):
    """Short texts make as many points as long ones, so rows are bounded beside bytes."""
    sizes, real = [], bm.signatures
    monkeypatch.setattr(bm, "signatures", lambda row, h, c, n, *a: sizes.append(n) or real(row, h, c, n, *a))
    texts = [f"word{i} other{i}" for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([b""] * 1000), pa.array(texts)], names=["id", "copy", "text"])
    signed = pa.Table.from_batches(list(bm._sign(iter([batch]))))
    assert max(sizes) <= bm.PIECE_ROWS and signed.column("id").to_pylist() == list(range(1000))


def test_texts_cross_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    counted = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    got = common.Shared(spark, "batches").write(spark.range(0, 5000, 1, 1).mapInArrow(counted, "n long"))
    assert sum(r["n"] for r in got.collect()) == 5000 and max(r["n"] for r in got.collect()) <= common.BATCH_ROWS
    assert spark.conf.get(name) == before
