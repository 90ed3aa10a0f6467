"""Exact, near, substring and line dedup against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import CLASH, docs, rows_of, words
from tidemark.llm import components as cc
from tidemark.llm import exactdedup as ed
from tidemark.llm import joins, rowdrop, simhash, substring
from tidemark.llm import linededup as ld

R = random.Random(4)
VOCAB = ["".join(R.choice("abcdefé") for _ in range(R.randint(1, 7))) for _ in range(60)]


def prose(n, sep=" "):
    return sep.join(R.choice(VOCAB) for _ in range(n))


BASE = [prose(60) for _ in range(6)]
MIXED = (
    [(i, t, "a") for i, t in enumerate(BASE)]
    + [(10 + i, BASE[0].replace(" ", R.choice(["  ", "\n", "\t "])), None) for i in range(5)]
    + [(20 + i, " ".join(BASE[1].split()[: 55 + i]), "b") for i in range(4)]
    + [(30, prose(15) + " " + " ".join(BASE[2].split()[20:50]) + " " + prose(9), "b"), (31, None, None), (32, "", "a"), (33, " \n", "a"), (34, "one", "a"), (35, "one two", "a")]
    + [(40, prose(4000), "long"), (41, "é" * 30_000, "long"), (None, BASE[3], "a"), (None, "alone", "a"), (50, BASE[4], "x"), (50, BASE[4], "x")]
)


def test_filter_is_lossless():
    rng = np.random.default_rng(1)
    for bits, n in ((10, 300), (61, 1), (40, 5000), (64, 100)):
        v = np.unique(rng.integers(0, 2**bits, n, dtype=np.uint64))
        c = rng.integers(1, 5, len(v)).astype(np.uint64)
        got_v, got_c = ed.cqf_decode(ed.cqf_encode(v, c, bits), bits)
        assert (got_v == v).all() and (got_c == c).all()
    v, c = ed.cqf_merge([(np.array([1, 5], np.uint64), np.array([1, 2], np.uint64)), (np.array([5, 9], np.uint64), np.array([1, 1], np.uint64))])
    assert v.tolist() == [1, 5, 9] and c.tolist() == [1, 3, 1]


@pytest.mark.parametrize("clash", [False, True])
def test_exact(spark, clash):
    groups = defaultdict(list)
    for i, t, _ in MIXED:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i if i is not None else float("inf"), i))
    want = []
    for norm, g in groups.items():
        named = [x for x in g if x[2] is not None]
        best = min(named) if named else None
        for n, _, i in g:
            keep = best[2] if best else None
            kept = best is None or (i == keep and n == best[0])
            want.append((i, keep, len(g), kept, hashlib.sha256(norm.encode()).hexdigest()))
    assert rows_of(ed.exact_groups(docs(spark, MIXED, clash))) == sorted(want, key=repr)


def test_exact_keeps_all_columns_and_takes_an_empty_table(spark):
    df = docs(spark, MIXED, True)
    left = rowdrop.exact_dedup(df)
    assert set(left.columns) == set(df.columns) and CLASH[0] in left.columns
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert {i for i in ids if i is not None} == {0, 1, 2, 3, 4, 5, 20, 21, 22, 23, 30, 33, 34, 35, 40, 41} - {0} | {min(10 + i for i in range(5) if len(MIXED[6 + i][1]) == max(len(m[1]) for m in MIXED[6:11]))}
    none = df.limit(0)
    assert ed.exact_groups(none).count() == 0 and rowdrop.exact_dedup(none).count() == 0


def test_lookup_join_beyond_the_broadcast(spark):
    left = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)] + [(None, -1)], "k int, v int")
    right = spark.createDataFrame([(k, sum((x % 7 if x % 3 else 0) == k for x in range(300)), k * 10) for k in range(5)], "k int, w long, x int")
    for how in ("left", "inner"):
        assert rows_of(joins.lookup(left, right, ["k"], "w", how, broadcast_rows=0)) == rows_of(left.join(right, ["k"], how))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=30))
def test_union_find(edges):
    a, b = np.array(edges).T
    nodes, roots = cc.union_find(a, b)
    label = {v: v for e in edges for v in e}
    for _ in label:
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    assert dict(zip(nodes.tolist(), roots.tolist())) == label


def test_components_with_and_without_one_task(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
    one = {r["node"]: r["root"] for r in cc.components(df).collect()}
    assert {k: v for k, v in one.items() if k != 200} == want
    many = {r["node"]: r["root"] for r in cc.components(df, single=0).collect()}
    assert {k: v for k, v in many.items() if k != 200} == want


def near(rows):
    prints = []
    for _, t, _ in rows:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    linked = [[j for j in range(len(rows)) if j != i and (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(len(rows))]
    label = [r[0] if r[0] is not None else float("inf") for r in rows]
    for _ in rows:
        label = [min([label[i], *(label[j] for j in linked[i])]) for i in range(len(rows))]
    return sorted(((r[0], f"{p:016x}", len(n), None if x == float("inf") else x) for r, p, n, x in zip(rows, prints, linked, label)), key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_simhash(spark, clash):
    assert rows_of(simhash.near_duplicates(docs(spark, MIXED, clash))) == near(MIXED)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_pairs_of_a_crowd(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)}
    fps = {f - 2**64 if f >= 2**63 else f for f in fps}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = sorted((a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert rows_of(simhash.near_pairs(df)) == sorted(want, key=repr)
    assert rows_of(simhash.near_pairs(df, crowd=3)) == sorted(want, key=repr)


def test_simhash_keeps_one_of_each_component(spark):
    df = docs(spark, MIXED)
    left = {r["doc_id"] for r in rowdrop.drop_near_duplicates(df).collect()}
    assert left == {r[0] for r in near(MIXED) if r[0] is None or r[0] == r[3]}


def repeats(rows, n=13):
    first = {}
    for i, t, _ in rows:
        i = float("inf") if i is None else i
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, float("inf")), i)
    out = []
    for i, t, _ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (float("inf") if i is None else i):
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_substring(spark, clash):
    assert rows_of(substring.remove_repeats(docs(spark, MIXED, clash))) == repeats(MIXED)
    assert substring.remove_repeats(docs(spark, [])).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.lists(st.sampled_from("abc"), max_size=40)), max_size=8))
def test_substring_short_windows(spark, rows):
    rows = [(i, " ".join(w), "s") for i, w in rows]
    got = rows_of(substring.remove_repeats(docs(spark, rows), window=4))
    assert got == repeats(rows, 4)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With two bits of each word the first hash is worthless, yet only what is equal goes."""
    import pyarrow as pa

    whole = substring.tx.word_hashes
    monkeypatch.setattr(substring.tx, "word_hashes", lambda b, t, which=0: whole(b, t, which) & np.uint64(3 if which == 0 else 2**64 - 1))
    rows = [(i, t, s) for i, t, s in MIXED if i is not None and i < 40] + [(60 + i, prose(40), "a") for i in range(60)]
    chunks = [pa.table({"doc_id": pa.array([r[0] for r in rows[k::3]], pa.int64()), "text": pa.array([r[1] for r in rows[k::3]], pa.string())}) for k in range(3)]
    lengths, answers = substring.levels(13), [None] * 3
    for k in range(len(lengths)):
        asked = pa.concat_tables([substring._asked(lengths, k, 2)((pa.scalar(c, pa.int32()),), chunks[c], answers[c]) for c in range(3)])
        tell = substring._least if k == len(lengths) - 1 else substring._repeated
        told = pa.concat_tables([tell(None, asked.filter(pa.compute.equal(asked["bucket"], b))) for b in set(asked["bucket"].to_pylist())])
        answers = [told.filter(pa.compute.equal(told["chunk"], c)) for c in range(3)]
    got = [tuple(r.values()) for c in range(3) for r in substring._remove(13, False)(None, chunks[c], answers[c]).to_pylist()]
    assert sorted(got, key=repr) == repeats(rows)


@pytest.mark.parametrize("window", [3, 30, 50, 700])
def test_substring_of_other_lengths(spark, window):
    rows = MIXED + [(70, prose(5) + " " + MIXED[-10][1][:9000], "long")]
    assert rows_of(substring.remove_repeats(docs(spark, rows), window=window)) == repeats(rows, window)


def test_blobs():
    rng = np.random.default_rng(3)
    for v in (np.zeros(0, np.uint64), np.array([0, 0, 1, 2**64 - 1], np.uint64), np.sort(rng.integers(0, 2**64, 1001, dtype=np.uint64))):
        assert (substring.unpack(substring.pack(v)) == v).all()


def lines(rows, threshold=0.8):
    places, sets = defaultdict(list), {}
    for i, t, _ in rows:
        for k, x in ld.normal_lines((t or "").encode()):
            places[x].append((float("inf") if i is None else i, k, i, t))
            sets[x] = ld.shingles(x.decode())
    names = list(places)
    label = {x: x for x in names}
    pairs = [(x, y) for n, x in enumerate(names) for y in names[:n] if ld.jaccard(sets[x], sets[y]) >= threshold]
    for _ in names:
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
    first = {}
    for x in names:
        first[label[x]] = min(first.get(label[x], (float("inf"),) * 2), min(p[:2] for p in places[x]))
    keep = set(first.values())
    out = []
    for i, t, _ in rows:
        n = [k for k, _ in ld.normal_lines((t or "").encode())]
        kept = [k for k in n if (float("inf") if i is None else i, k) in keep]
        out.append((i, len(n), len(n) - len(kept), tuple(kept)))
    return sorted(out, key=repr)


LINES = [(i, "\n".join(R.sample(BASE, 3) + [prose(30)] + ["", "ab", " \t"]), "a") for i in range(8)]
LINES += [(20 + i, "\n".join([BASE[5].replace(VOCAB[i], VOCAB[i + 1], 1), BASE[4].upper() + " ", "  x"]), "b") for i in range(12)]
LINES += [(40, None, None), (41, "", "a"), (42, prose(3000), "a"), (43, "\n\n", "a"), (None, BASE[0] + "\nlast of all, with no number", "a")]


@pytest.mark.parametrize("clash", [False, True])
def test_lines(spark, clash):
    assert rows_of(ld.dedup_lines(docs(spark, LINES, clash))) == lines(LINES)
    assert ld.dedup_lines(docs(spark, [])).count() == 0


def test_lines_removed_from_texts(spark):
    kept = {r[0]: set(r[3]) for r in lines(LINES)}
    for r in ld.remove_lines(docs(spark, LINES)).collect():
        text = next(t for i, t, _ in LINES if i == r["doc_id"])
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if not x.strip() or k in kept[r["doc_id"]])
        assert r["text"] == want


def test_signature_estimates_the_similarity():
    a, b = prose(80), None
    b = " ".join(a.split()[4:] + prose(4).split())
    s = ld.signatures([a, b] * 1)
    true = ld.jaccard(ld.shingles(a), ld.shingles(b))
    assert abs(float((s[0] == s[1]).mean()) - true) < 0.15
    assert Counter((s == ld._EMPTY).reshape(-1).tolist())[True] == 0


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é", "漢字かな交じり文\U0001f600", "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))])
def test_lines_are_compared_exactly(letters):
    rng = random.Random(3)
    lines = []
    for _ in range(120):
        x = "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 30, 120])))
        y = list(x)
        for _ in range(rng.randint(0, 3)):
            y[rng.randrange(len(y))] = rng.choice(letters)
        lines += [x, "".join(y), x + "\0", x + rng.choice(letters)]
    a, b = (np.array([rng.randrange(len(lines)) for _ in range(3000)] + list(more)) for more in (range(len(lines) - 1), range(1, len(lines))))
    want = [ld.jaccard(ld.shingles(lines[i]), ld.shingles(lines[j])) >= 0.8 for i, j in zip(a, b)]
    assert any(want) and ld.alike(lines, a, b, 0.8).tolist() == want


def test_lines_of_one_hash_are_compared():
    places = [np.array(p, np.int64) for p in ([3, 1, 2, 0], [0, 0, 0, 0], [0, 0, 0, 0])]
    blob = ld._put(np.array([7, 7, 7, 9], np.uint64), places, [b"one", b"two", b"one", b"two"])
    import pyarrow as pa

    got = ld._make_nodes((pa.scalar(0),), pa.table({"lines": pa.array([blob], pa.binary())}))
    assert sorted(zip(got["line"].to_pylist(), got["doc_id"].to_pylist())) == [("one", 2), ("two", 0), ("two", 1)]


@pytest.mark.parametrize("length", [22, 60, 260, 640])
def test_lines_at_the_threshold_share_a_band(length):
    """Pairs of a similarity of 0.8 are found."""
    rng = random.Random(length)
    changed = (length - 4) // 9
    pairs = []
    for _ in range(250):
        x = "".join(rng.choice("abcdefghijklmnop ") for _ in range(length))
        pairs += [x, x[: length - changed] + "".join(rng.choice("ABCDEFGH") for _ in range(changed))]
    assert 0.8 <= ld.jaccard(ld.shingles(pairs[0]), ld.shingles(pairs[1])) <= 0.84
    keys = ld.band_keys(ld.signatures(pairs)).reshape(250, 2, -1)
    assert (keys[:, 0] == keys[:, 1]).any(axis=1).mean() >= 0.98
