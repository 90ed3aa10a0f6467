"""Decontamination, chat formatting, secrets, mixing and the pipeline."""

import base64
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import docs, rows_of, words
from tidemark.llm import chat, decontam, mixing, rowdrop, secretscan, simhash

R = random.Random(5)
VOCAB = ["".join(R.choice("abcdé") for _ in range(R.randint(1, 4))) for _ in range(40)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


ITEMS = [(1, prose(30)), (2, prose(12)), (3, prose(9)), (11, "Zwei Wörter"), (4, ""), (5, None), (2, prose(11)), (None, prose(14))]
TEXTS = [(1, prose(200), "a"), (2, prose(20) + " " + ITEMS[0][1].upper() + ", " + prose(5), "a"), (3, "zwei-wörter; " + prose(8) + " " + ITEMS[2][1], None), (4, None, "a"), (5, "", "a")]
TEXTS += [(6, " ".join(ITEMS[1][1].split()[2:]), "a"), (6, ITEMS[1][1], "a"), (None, ITEMS[7][1], "b"), (8, prose(3000) + " " + " ".join(ITEMS[0][1].split()[5:16]) + " " + prose(3000), "b")]


def alnum(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(rows, items):
    out = []
    for i, t, _ in rows:
        w, hit, found = alnum(t), set(), set()
        for item, x in items:
            v = alnum(x)
            n = min(10, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add("null" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_contamination(spark, clash):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows_of(decontam.contamination(docs(spark, TEXTS, clash), items)) == contaminated(TEXTS, ITEMS)


def test_contamination_in_blocks_of_items(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = decontam.build_index(docs(spark, TEXTS))
    whole, parts = (decontam.search(index, items, block=b).select("doc_id", "items", F.col("spans.start"), F.col("spans.end")) for b in (100, 3))

    def covered(df):
        return sorted((repr(i), names, sorted({k for x, y in zip(a, b) for k in range(x, y)})) for i, names, a, b in rows_of(df))

    assert covered(whole) == covered(parts)


def test_contamination_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(docs(spark, []), items).count() == 0
    none = decontam.contamination(docs(spark, TEXTS), items.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(TEXTS)
    assert {r["doc_id"] for r in rowdrop.drop_contaminated(docs(spark, TEXTS), items).collect()} == {r[0] for r in contaminated(TEXTS, ITEMS) if not r[5]}


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "alpha beta gamma delta", "a"), (2, "alpha beta x gamma delta", "a"), (3, "alpha x y z w beta gamma delta", "a")]
    index = decontam.build_index(docs(spark, rows))
    near = {s: {r["doc_id"] for r in decontam.search(index, items, slop=s).collect() if r["items"]} for s in (0, 1)}
    assert near == {0: {1}, 1: {1, 2}}


def test_proximity_ends_with_the_document(spark):
    """The words of a match are of one document, wherever the others of its segment begin."""
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    index = decontam.build_index(docs(spark, [(1, "x alpha beta gamma y", "a"), (2, "delta z", "a"), (3, "beta alpha delta gamma", "a")]).coalesce(1))
    assert {r["doc_id"] for r in decontam.search(index, items, slop=1).collect() if r["items"]} == {3}
    spans = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in decontam.search(index, items, slop=1).collect()}
    assert spans == {1: [], 2: [], 3: [(0, 4)]}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=9), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=4), min_size=1, max_size=4), st.integers(0, 2))
def test_proximity_by_brute_force(spark, texts, phrases, slop):
    def near(w, p):
        return any(all(any(w[j] == x and abs(j - s - k) <= slop for j in range(len(w))) for k, x in enumerate(p)) for s in range(-slop, len(w) + slop))

    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(phrases)], "item_id long, text string")
    index = decontam.build_index(docs(spark, [(i, " ".join(w), "a") for i, w in enumerate(texts)]).coalesce(1))
    got = {r["doc_id"]: set(r["items"]) for r in decontam.search(index, items, window=4, slop=slop).collect()}
    assert got == {i: {str(k) for k, p in enumerate(phrases) if near(w, p)} for i, w in enumerate(texts)}


def test_mixed_rows_that_have_a_copy_column(spark):
    df = docs(spark, TEXTS).withColumn("copy", F.lit("x")).withColumn("_COPY", F.lit("y"))
    got = mixing.mix(df)
    assert got.columns == [*df.columns, "__copy"] and {r["copy"] for r in got.collect()} <= {"x"}


# --- chat ----------------------------------------------------------------------------

TURN = st.tuples(st.integers(0, 3), st.one_of(st.none(), st.sampled_from(["user", "assistant", "sys\n<#\\n"])), st.one_of(st.none(), st.text("\\<#/parturnlhb> \né", max_size=20)))


@settings(max_examples=8, deadline=None)
@given(st.lists(TURN, min_size=1, max_size=8), st.lists(TURN, max_size=3))
def test_chat_round_trip(spark, one, two):
    rows = [(1, *t) for t in one] + [(None, *t) for t in two]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for key, turns in ((1, one), (None, two)):
        want = sorted((n, r or "", t or "") for n, r, t in turns)
        if want:
            assert [tuple(t) for t in got[key]["turns"]] == [t[1:] for t in want]
            assert got[key]["loss"] == "".join(t for _, r, t in want if r == "assistant")


def test_chat_merges_neighbours_and_takes_long_ones(spark):
    rows = [(1, i, "user" if i < 2 else "assistant", f"t{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df).first()
    assert r["formatted"].startswith("### user\nt0<part>t1</turn>\n### assistant\nt2<part>t3") and r["formatted"].count("### ") == 2
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == [f"t{i}" for i in range(2, 700)]
    d = chat.digests(chat.format_conversations(df)).first()
    assert d["n_turns"] == 700 and d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- secrets -------------------------------------------------------------------------

SECRET = "x password=hunter2secret y"
B64 = base64.b64encode(SECRET.encode()).decode()


def base_spans(s):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", s, re.A | re.I) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", s) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", s) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0]), x[2]))


@pytest.mark.parametrize(
    "wrapped",
    [
        SECRET, B64, B64.rstrip("="), urllib.parse.quote(SECRET, safe=""), urllib.parse.quote(urllib.parse.quote(SECRET)), "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "".join(f"\\x{ord(c):02x}" for c in SECRET), "".join(f"&#{ord(c)};" for c in SECRET), base64.b64encode(gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(zlib.compress(B64.encode())).decode(), urllib.parse.quote(base64.b64encode(B64.encode()).decode(), safe=""),
        "".join(f"%{b:02X}" for b in gzip.compress(gzip.compress(SECRET.encode()))), "path/to/" + B64,
    ],
)
def test_secrets_below_encodings(wrapped):
    text = f"é some words {wrapped} more words"
    spans = secretscan.all_spans(text)
    assert any(k == "assign" and text.index(wrapped) <= i < j <= text.index(wrapped) + len(wrapped) for k, i, j in spans)
    assert set(base_spans(text)) <= set(spans)


def test_span_of_an_escaped_secret_is_exact():
    text = "é é password%3Dhunter2secret end"
    assert ("assign", 4, 28) in secretscan.all_spans(text)
    inside = "a" * 9 + SECRET
    text = "é " + base64.b64encode(inside.encode()).decode()
    (kind, i, j), = secretscan.all_spans(text)
    lo, hi = inside.index("password"), inside.index(" y")
    assert i == 2 + lo * 8 // 6 and j == 2 + -(-hi * 8 // 6)


def test_each_place_of_a_repeated_layer_has_its_spans():
    nested = base64.b64encode(B64.encode()).decode()
    for run in (B64, nested, base64.b64encode(gzip.compress(SECRET.encode())).decode()):
        text = f"a {run} b {run} c {run}"
        places = [m.start() for m in re.finditer(re.escape(run), text)]
        spans = [x for x in secretscan.all_spans(text) if x[0] == "assign"]
        assert len(places) == 3 and all(any(at <= i < j <= at + len(run) for _, i, j in spans) for at in places)
    loop = "a " + SECRET + " " + base64.b64encode(gzip.compress(f"{SECRET} {B64}".encode())).decode()
    assert len({(i, j) for _, i, j in secretscan.all_spans(loop)}) == 2


@pytest.mark.parametrize("data", [b"\xff" + SECRET.encode(), SECRET.encode() + b"\x80\x81", ("\u00a0\u200b" + SECRET).encode(), b"\x1b[0m\f" + SECRET.encode() + b"\0", SECRET.encode("utf-16"), SECRET.encode("utf-16-be"), gzip.compress(SECRET.encode("utf-16"))])
def test_a_layer_of_any_bytes_is_scanned(data):
    for front in ("", "config-", "a/b_c"):
        text = "é " + front + base64.b64encode(data).decode() + " end"
        spans = [x for x in secretscan.all_spans(text) if x[0] == "assign"]
        assert spans and all(2 <= i < j <= len(text) - 4 for _, i, j in spans)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  \t"])
def test_wrapped_base64_is_one_layer(end):
    noise = "".join(R.choice("klmnopqrstuvw") for _ in range(400))
    for data in (b"a" * 45 + SECRET.encode(), gzip.compress(f"{noise} {SECRET}".encode()), zlib.compress(f"{noise} {SECRET}".encode())):
        run = base64.b64encode(data).decode()
        wrapped = end.join(run[i : i + 76] for i in range(0, len(run), 76))
        for front in ("é ", "averyverylongheadingline" + end):
            text = front + wrapped + "\n\nmore words"
            spans = [x for x in secretscan.all_spans(text) if x[0] == "assign"]
            assert spans and all(len(front) <= i < j <= len(front) + len(wrapped) for _, i, j in spans)


def test_members_and_streams_of_any_size(monkeypatch):
    import bz2
    import lzma

    import zstandard

    z = zstandard.ZstdCompressor().compressobj()
    stream = z.compress(SECRET.encode()) + z.flush()
    assert zstandard.frame_content_size(stream) < 0
    packed = [stream, gzip.compress(SECRET.encode())[:-4]]
    packed += [f(b"nothing here") + f(SECRET.encode()) for f in (gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress)]
    big = b"some, words\n" * 400_000
    packed += [f(big + SECRET.encode() + b", " + big) for f in (gzip.compress, bz2.compress, zstandard.ZstdCompressor().compress)]
    packed += [gzip.compress(gzip.compress(big + B64.encode())), gzip.compress(b"a" * 3_000_000 + b" " + SECRET.encode())]
    monkeypatch.setattr(secretscan, "LAYER_MAX", 2 << 20)
    for data in packed:
        for run in (base64.b64encode(data).decode(), "".join(f"%{b:02x}" for b in data)):
            spans = secretscan.all_spans(f"é {run} end")
            assert any(k == "assign" and 2 <= i < j <= 2 + len(run) for k, i, j in spans), data[:10]


def test_harmless_texts_have_no_spans():
    for text in ("", "%", "%%% 100%", "\\u12 \\x", "averyveryverylongwordwithoutanything", "AKIA123", "token: abc", base64.b64encode(b"nothing to see here, really").decode()):
        assert secretscan.all_spans(text) == []
    loop = "%25" * 40
    assert secretscan.all_spans(loop) == []


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("passwordtokn=:'\" AKIA01fé\n%\\u"), max_size=80), st.sampled_from(["", "secret = 'abc_def'", "API_KEY:123456", "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "ſecret=abcdefg"]))
def test_base_findings(noise, planted):
    text = noise + planted + noise
    assert secretscan.order(secretscan.base_spans(text)) == base_spans(text)
    own, _ = secretscan.suspicious(text.encode())
    assert own or not base_spans(text)


def test_scan_documents(spark):
    rows = [(1, SECRET, "a"), (2, None, "a"), (3, "", None), (None, B64, "a"), (5, "word " * 30_000 + SECRET, "a"), (5, "word " * 30_000 + SECRET, "a")]
    got = rows_of(secretscan.scan_secrets(docs(spark, rows, True)))
    want = []
    for i, t, _ in rows:
        b = base_spans(t or "")
        n = Counter(k for k, _, _ in b)
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(secretscan.render(b).encode()).hexdigest(), secretscan.render(secretscan.all_spans(t or ""))))
    assert got == sorted(want, key=repr)
    assert secretscan.scan_secrets(docs(spark, [])).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secretscan.redact(docs(spark, rows)).collect()}
    assert clean[1] == "x [secret] y" and clean[2] is None and "hunter2" not in clean[5] and secretscan.all_spans(clean[None]) == []


# --- mixing ---------------------------------------------------------------------------


def targets(sizes):
    """Targets of {source: words}, round by round."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


MIX = [(i, prose(R.randint(0, 60)), R.choice(["a", "b", "c", "é", "d"])) for i in range(300)] + [(400 + i, prose(5), None) for i in range(40)]
MIX += [(500, None, "a"), (501, "", "only empty"), (502, prose(4000), "b"), (None, prose(7), "c"), (503, prose(3), "c"), (503, prose(3), "c")]


def test_mixing(spark):
    sizes = defaultdict(int)
    for _, t, s in MIX:
        sizes[s] += len(words(t))
    want = targets(sizes)
    plan = mixing.mix_plan(docs(spark, MIX, True)).collect()
    assert len(plan) == len(MIX) and Counter((r["doc_id"], r["size"]) for r in plan) == Counter((i, len(words(t))) for i, t, _ in MIX)
    taken = defaultdict(int)
    for r in plan:
        s = None if r["skey"] == "1" else r["skey"][1:]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, t in want.items():
        largest = max(len(words(x)) for _, x, y in MIX if y == s)
        assert abs(taken[s] - t) <= 2 * largest + 1, s
    assert rows_of(mixing.mix_plan(docs(spark, MIX).repartition(7))) == rows_of(mixing.mix_plan(docs(spark, MIX)))
    assert mixing.mix_plan(docs(spark, [])).count() == 0


def test_mix_emits_each_copy(spark):
    df = docs(spark, MIX[:300], True)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(df).collect()}
    out = mixing.mix(df)
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter({k: v for k, v in copies.items() if v})
    assert out.columns == [*df.columns, "copy"]


# --- pipeline -------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, prose(R.randint(15, 60)) if i % 4 else "!! ".join(prose(30).split()).upper(), R.choice("ab")) for i in range(120)]
    rows += [(200 + i, rows[1][1].replace(" ", "  ", i), "a") for i in range(3)]
    long = prose(300)
    rows += [(300, long, "b"), (301, long + " end", "b"), (310, prose(10) + " " + ITEMS[0][1] + " " + prose(10), "a"), (311, None, "a"), (312, "", None)]
    df = docs(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS[:1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, at, seen = str(tmp_path), df, {}
    for name, stage in p.STAGES:
        at = stage(spark, at, d)
        seen[name] = at.collect()
        at = spark.createDataFrame(seen[name], at.schema)
        assert set(at.columns) >= set(df.columns)
    ids = {k: {r["doc_id"] for r in v} for k, v in seen.items()}
    clean = {i for i in range(120) if i % 4}
    assert clean <= ids["quality"] and not any(i % 4 == 0 and i < 120 for i in ids["quality"])
    assert ids["exact_dedup"] & {1, 200, 201, 202} == {202} and clean - {1} <= ids["exact_dedup"]
    linked = {r[0] for r in simhash_drops(spark, seen["exact_dedup"], df.schema)}
    assert ids["simhash_near_dedup"] == ids["exact_dedup"] - linked
    assert 310 not in ids["decontamination"] and ids["decontamination"] == ids["simhash_near_dedup"] - {310}
    assert ids["mixing"] <= ids["decontamination"]
    assert rows_of(p.run(spark, d)) == sorted((tuple(r) for r in seen["mixing"]), key=repr)


def test_stages_decide_for_each_row(spark, tmp_path):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    spark.createDataFrame(ITEMS[:1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad, long = prose(10) + " " + ITEMS[0][1], prose(300)
    own = [prose(40) for _ in range(4)]

    def left(stage, rows):
        return sorted(((r["doc_id"], r["text"]) for r in stages[stage](spark, docs(spark, rows), str(tmp_path)).collect()), key=repr)

    rows = [(None, own[0], "a"), (None, own[0], "b"), (None, own[1], "a"), (7, own[1], "a"), (5, own[1], "a"), (5, own[2], "a"), (5, own[2], "a"), (None, None, "a"), (None, "", "a")]
    got = left("exact_dedup", rows)
    assert sorted(t or "" for _, t in got) == sorted([own[0], own[1], own[2], ""]) and (5, own[1]) in got and (5, own[2]) in got
    rows = [(None, long, "a"), (None, long + " end", "a"), (9, long, "a"), (9, own[3], "a"), (2, own[0], "a")]
    assert left("simhash_near_dedup", rows) == sorted([(9, long), (9, own[3]), (2, own[0])], key=repr)
    rows = [(None, bad, "a"), (None, own[0], "a"), (3, bad, "a"), (3, own[1], "a")]
    assert left("decontamination", rows) == sorted([(None, own[0]), (3, own[1])], key=repr)
    assert all(left(s, []) == [] for s in ("exact_dedup", "simhash_near_dedup", "decontamination"))


def simhash_drops(spark, rows, schema):
    return simhash.near_duplicates(spark.createDataFrame(rows, schema)).filter("doc_id <> component_id").collect()
