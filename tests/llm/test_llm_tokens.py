"""BPE and packing against the libraries that define them."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as PT
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.llm import common as C
from cadenza.llm import op3_bpe as B
from cadenza.llm import op7_packing as P

PATH = PT.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query(spark, sf, sample, reference):
    got = B.op3_bpe(spark, sf).collect()
    assert len(got) == len(sample)
    for r in got:
        ids = reference.encode_ordinary(sample[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sample[r.doc_id].encode()).hexdigest()


def test_odd_texts(odd, none, reference):
    got = B.encode(odd).collect()
    assert len(got) == odd.count() and B.encode(none).count() == 0
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        assert bytes(r.decoded).decode() == texts[r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(texts[r.doc_id])


def test_words_fold_to_the_library_s_ids_and_back(spark, reference):
    words = ["hello", " world", "é", "日本語", "\x00", "a", "aaaaaaaaaaaaaaaaaaaaaaa", " Unbelievable", "🙂🙂"]
    df = spark.createDataFrame([(i, list(w.encode())) for i, w in enumerate(words)], "i int, w array<int>")
    rows = df.select("i", B.encode_word(F.col("w"), PATH).alias("ids")).select("i", "ids", B.decode_ids(F.col("ids"), PATH).alias("back")).orderBy("i").collect()
    assert [r.ids for r in rows] == [reference._encode_single_piece(w.encode()) for w in words]
    assert [bytes(r.back).decode() for r in rows] == words


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aé 'sStlre\n\t\r1²-.\xa0\x85ß日🙂"), max_size=30))
def test_splitters_agree(text):
    import regex

    assert B.splitter(PT.PATTERN)(text) == regex.findall(PT.PATTERN, text)


def test_spark_s_hash(spark):
    numbers = [0, 1, -1, 12345678901, 2**62]
    want = [r.h for r in spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n bigint").orderBy("i").select(F.hash("n").alias("h")).collect()]
    keys = np.array(numbers, np.int64)
    assert C.murmur([keys & 0xFFFFFFFF, keys >> 32]).tolist() == want
    keys = C.block_keys(13)
    assert sorted(r.h for r in spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(13)).alias("h")).collect()) == list(range(13))


@given(st.lists(st.integers(0, 2**64 - 1)), st.lists(st.integers(0, 255)))
def test_squeeze(a, b):
    back = C.unsqueeze(C.squeeze(np.array(a, np.uint64), np.array(b, np.uint8)))
    assert [x.tolist() for x in back] == [a, b]


def check_packed(rows, texts, tokenizer, window):
    """Every id is in one piece, sequences are gapless and hold a window at most."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc]})
        at = 0
        for start, length, crc, total in pieces:
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PT.path(P.TOKENIZER))
    t.encode_special_tokens = True
    return t


def test_packing(spark, sf, sample, tokenizer):
    rows = P.op7_packing(spark, sf).collect()
    check_packed(rows, sample, tokenizer, 1024)
    assert sum(r.length for r in rows) / (1024 * len({r.sequence_id for r in rows})) > 0.95


def test_packing_of_odd_texts(odd, none, tokenizer):
    rows = P.pack_documents(odd, window=16).collect()
    check_packed(rows, {r.doc_id: r.text or "" for r in odd.collect()}, tokenizer, 16)
    assert P.pack_documents(none).count() == 0


@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_is_the_tightest(lengths):
    lengths = sorted(lengths, reverse=True)
    seq, off = P.best_fit(np.array(lengths, np.int64), 64)
    fill: list[int] = []
    for n, s, o in zip(lengths, seq.tolist(), off.tolist()):
        open_ = [64 - f for f in fill if 64 - f >= n and f < 64]
        if open_:
            assert 64 - fill[s] == min(open_) and o == fill[s]
            fill[s] += n
        else:
            assert s == len(fill) and o == 0
            fill.append(n)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_both_libraries_agree(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PT.path(P.TOKENIZER))
    t.encode_special_tokens = True
    text = text.encode("utf-8", "ignore").decode()
    assert P.encoder(PT.path(P.TOKENIZER)).encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def test_packing_of_a_long_run_of_blanks(spark, tokenizer):
    texts = {1: "a" + " " * 1_100_000 + "b c", 2: "plain text", 3: "d " * 60_000, 4: "\n" * 1_100_000}
    rows = P.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    check_packed(rows, texts, tokenizer, 1024)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("a1. \n\t\x1f\x85\u3000é日"), max_size=30))
def test_runs_of_blanks_agree_by_either_library(text):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "LONGEST_RUN", 1)
        one = P.text_ids(text, PT.path(P.TOKENIZER))
    assert one == P.text_ids(text, PT.path(P.TOKENIZER))


def test_packing_of_a_spelled_out_separator(spark):
    from tokenizers import Tokenizer

    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|>", 3: "x<|endoftext|><|endoftext|> \n\n<|endoftext|>  y " * 90, 4: "<|endoftext| >"}
    library = Tokenizer.from_file(PT.path(P.TOKENIZER))
    assert library.encode(texts[1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    check_packed(P.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), window=16).collect(), texts, library, 16)
