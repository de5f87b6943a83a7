"""Near-duplicates of texts and vectors, repeated passages, components: against brute force."""

import hashlib
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import op2_dartminhash as D
from cadenza.llm import op4_rabitq as R
from cadenza.llm import op10_suffix as S
from cadenza.llm import prefix_free
from cadenza.llm.common import block_keys
from cadenza.llm.components import components


def smallest(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(20, 60)] + [(99, i) for i in range(70, 99)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = smallest(links, {n for p in links for n in p})
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def classes(texts, least=0.8):
    sets = {d: shingles(t) for d, t in texts.items()}
    holds = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            holds[x].add(d)
    links = []
    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in holds[x] if e < d).items():
            if n >= least * (len(s) + len(sets[e]) - n):
                links.append((e, d))
    return smallest(links, texts)


def test_near_duplicates(spark, sf, sample):
    got = {r.doc_id: (r.class_id, r.kept) for r in D.op2_dartminhash(spark, sf).collect()}
    want = classes(sample)
    assert got == {d: (c, c == d) for d, c in want.items()}


def test_near_duplicates_of_a_large_group(spark):
    """Copies of one text with more and more changes: many links, some buckets of several components."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    texts = {}
    for d in range(260):
        words = list(base)
        for _ in range(d % 26):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[d] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in D.near_duplicates(df).collect()}
    want = classes(texts)
    assert sum(got[d] != want[d] for d in texts) <= 2  # documents at the very threshold can share no band


def test_near_duplicates_of_odd_texts(odd, none):
    rows = D.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and D.near_duplicates(none).count() == 0
    got = {(r.doc_id, r.class_id, r.kept) for r in rows}
    assert {(0, 0, True), (1, 1, True), (4, 4, True), (5, 4, False), (None, None, True)} <= got


def test_weighted_agreement():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    u, v = rng.integers(1, 9, 400) * 1.0, rng.integers(1, 9, 400) * 1.0
    a, b = D.dart_minhash(x, u, 1600), D.dart_minhash(x, v, 1600)
    assert abs((a == b).mean() - np.minimum(u, v).sum() / np.maximum(u, v).sum()) < 0.05
    few = D.dart_minhash(x[:1], None, 64)
    assert (few == D.dart_minhash(x[:1], None, 64)).all() and (few != D.dart_minhash(x[1:2], None, 64)).all()
    both, half = D.dart_minhash(x[:200], None, 1600), D.dart_minhash(x[100:300], None, 1600)
    assert abs((both == half).mean() - 1 / 3) < 0.05


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([centres[rng.integers(12, size=500)] + 0.18 * rng.normal(size=(500, 24)), rng.normal(size=(300, 24))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, x[i % 3].tolist(), 0) for i in range(40)]
    bad = [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [float("nan")] * 24, 0), (2003, [1.0, None], 0), (2004, [], 0), (2005, [float("inf")] * 24, 0), (2006, [1.0, 0.0], 0), (None, x[0].tolist(), 0)]
    got = {r.vec_id: r for r in R.near_vectors(vectors(spark, rows + bad)).collect()}
    full = np.array([r[1] for r in rows], np.float32).astype(float)
    full /= np.linalg.norm(full, axis=1)[:, None]
    s = full @ full.T >= 0.95
    np.fill_diagonal(s, False)
    ids = [r[0] for r in rows]
    want = smallest([(ids[a], ids[b]) for a, b in zip(*np.nonzero(s))], ids)
    wrong = [i for k, i in enumerate(ids) if (got[i].n_links, got[i].component_id, got[i].kept) != (s[k].sum(), want[i], want[i] == i)]
    assert len(wrong) <= 4  # a link at the threshold can share no bucket
    assert all((got[b[0]].n_links, got[b[0]].component_id) == (0, b[0]) for b in bad)
    assert R.near_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    x = (base + 0.12 * rng.normal(size=(90, 16))).astype(np.float32)
    got = {r.vec_id: r.n_links for r in R.near_vectors(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()}
    full = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert list(got[i] for i in range(90)) == ((full @ full.T >= 0.95).sum(axis=1) - 1).tolist()


def test_estimates_are_unbiased():
    rng = np.random.default_rng(5)
    x = R.unit(rng.normal(size=(300, 64)))
    q = R.unit(x + 0.3 * rng.normal(size=x.shape))
    about, error = R.estimate(R.sketches(q), R.sketches(x))
    off = (about - q @ x.T) / error
    assert abs(off.mean()) < 0.05 and 0.7 < off.std() < 1.3 and (np.abs(off) < R.CONFIDENCE).all()


def removed(docs):
    """Brute force of the contract."""
    first = {}
    ordered = sorted(docs, key=lambda r: (r[0] is None, r[0]))
    big = 2**63 - 1
    for d, t in ordered:
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], big if d is None else d)
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < (big if d is None else d):
                gone[s : s + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def of(rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=repr)


def test_repeated_passages(spark, sf, sample):
    got = S.op10_suffix(spark, sf).collect()
    want = removed([(d, t.encode()) for d, t in sample.items()])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == want


def test_repeated_passages_of_odd_texts(odd, none):
    docs = [(r.doc_id, (r.text or "").encode()) for r in odd.select("doc_id", "text").collect()]
    assert of(S.deduplicate(odd).collect()) == removed(docs)
    assert S.deduplicate(none).count() == 0 and S.deduplicate_texts(none).count() == 0
    whole = S.deduplicate_texts(odd)
    assert whole.dtypes == odd.dtypes and whole.count() == odd.count()
    assert [r.text for r in whole.filter("doc_id = 1").collect()] == [None]


def by_steps(docs, blocks):
    """The operator's steps without Spark, which is left to deal rows by key and block."""
    keys = block_keys(blocks)
    held = defaultdict(list)
    for d, t in docs:
        held[keys[(d or 0) % blocks]].append((d, t))
    packed = [(k, zstandard.ZstdCompressor().compress(pickle.dumps(rows))) for k, rows in held.items()]

    def run(step, rows, kinds):
        names = {4: ["key", "bucket", "block", "data"], 2: ["block", "data"]}[len(kinds)]
        return [r for b in step(iter([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)])) for r in b.to_pylist()] if rows else []

    def dealt(step, rows):
        return [x for k in keys for x in run(step, [(r["key"], r["bucket"], r["block"], r["data"]) for r in rows if r["key"] == k], [pa.int32()] * 3 + [pa.binary()])]

    def table(rows, kinds):
        return pa.table({n: pa.array([r[n] for r in rows], t) for n, t in kinds.items()})

    one = {"block": pa.int32(), "data": pa.binary()}
    known = dealt(S.shared, run(S.seeds_of(keys), packed, [pa.int32(), pa.binary()]))
    lefts = {k: table([{"block": k, "data": data}], one) for k, data in packed}
    contexts = [x for k, left in lefts.items() for x in S.contexts_of(keys)((pa.scalar(k),), left, table([r for r in known if r["block"] == k], one)).to_pylist()]
    answers = dealt(S.smallest, contexts)
    kinds = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
    got = [x for k, left in lefts.items() for x in S.remover(kinds)((pa.scalar(k),), left, table([r for r in answers if r["block"] == k], one | {"own": pa.bool_()})).to_pylist()]
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=repr)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["ab" * 30, "c" * 70, "the same passage again and again, of many words, ", "x", "é", "0123456789" * 6]), max_size=6), min_size=1, max_size=8), st.sampled_from([64, 1 << 18]))
def test_repeated_passages_at_random(parts, part):
    before, S.PART = S.PART, part
    try:
        docs = [(i if i != 5 else None, "".join(p)) for i, p in enumerate(parts)]
        got = by_steps(docs, 3)
    finally:
        S.PART = before
    assert got == removed([(d, t.encode()) for d, t in docs])


def corpus(strings, least):
    """Suffixes in order, and what each shares with the one before, without any parsing."""
    found = sorted(s[i:] for s in strings for i in range(len(s) - least + 1))
    shared = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(found, found[1:])]
    return found, shared[: len(found)]


def ordered(strings, least):
    which, place, shared = prefix_free.corpus_order(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64), least)
    return [strings[w][p:] for w, p in zip(which.tolist(), place.tolist())], shared.tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"ab", b"a", b"\0", b"\0" * 30, b"a" * 100, b"the same passage, ", b"abcabcabc" * 9, b"\xff\xfe"]), max_size=9).map(b"".join), max_size=7), st.sampled_from([7, 10, 50]))
def test_corpus_order(strings, least):
    assert ordered(strings, least) == corpus(strings, least)


@pytest.mark.parametrize("data", [b"banana" * 40, b"a" * 300, bytes(range(256)), random.Random(1).randbytes(3000)])
def test_corpus_order_of_one_string(data):
    assert ordered([data, b"", data[:100]], 50) == corpus([data, b"", data[:100]], 50)


def test_corpus_order_of_long_repeats():
    """Periodic text of 200,000 bytes: ties that a comparison from the front would take quadratic time for."""
    data = b"abc" * 66_000
    which, place, shared = prefix_free.corpus_order(np.frombuffer(data + data, np.uint8), np.array([len(data)] * 2), 50)
    assert len(which) == 2 * (len(data) - 49) and shared[1::2].tolist() == (len(data) - place[1::2]).tolist()
