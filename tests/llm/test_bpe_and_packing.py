import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tsforge.llm import bpe_chunks, packing
from tsforge.llm.textcodes import slabs

PATH = bpe_chunks.tokenizer_path()
LIB = Tokenizer.from_file(PATH)
LIB.no_truncation()
LIB.no_padding()
CODER = bpe_chunks.ChunkEncoder(bpe_chunks.WordEncoder(PATH), chunk=8)


def library(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def chunked(text):
    import pyarrow as pa

    return [np.frombuffer(x, "<u4").tolist() for s in slabs(pa.array([text, text])) for x in CODER.slab(s)]


PIECES = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "É", "É", "H̱", "İ", "Σ", "ς", " ",
                          "\xa0", "\x01", "\x1c", "\x85", " ", "\n", "\t", "́", "中文", "½", "१२", "...", "word ", "Ab,", "😀", "‍", "\x00"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PIECES, st.text(max_size=6)), max_size=40).map("".join))
def test_any_text_is_encoded_as_the_library_does(text):
    assert chunked(text) == [library(text)] * 2


def test_recurring_and_odd_texts():
    passage = "A passage that many documents share, whatever stands before it. " * 4
    for text in (passage, "x" + passage, passage * 3 + "<|endoftext|>end", "a" * 5000, "é" * 3000, " " * 900, "\x01 " * 50):
        assert chunked(text) == [library(text)] * 2


def test_small_memo_gives_the_same():
    words = bpe_chunks.WordEncoder(PATH, kept=20)
    coder = bpe_chunks.ChunkEncoder(words, chunk=16, kept=3)
    import pyarrow as pa

    texts = [" ".join(f"w{i * j % 97}x" for i in range(60)) for j in range(30)]
    for s in slabs(pa.array(texts), limit=500):
        for i, raw in enumerate(coder.slab(s)):
            assert np.frombuffer(raw, "<u4").tolist() == library(texts[s.first + i])
    assert len(words.memo) < 400


def test_query_columns(small):
    rows, df = small
    got = {r.doc_id: tuple(r)[1:] for r in bpe_chunks.round_trip_digests(df).collect()}
    for i, t, *_ in rows:
        ids = library(t)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False)))


def test_encode_then_decode(small):
    rows, df = small
    ids = bpe_chunks.encode(df)
    text = {r.doc_id: r.decoded for r in bpe_chunks.decode(ids).collect()}
    lists = {r.doc_id: r.ids for r in ids.collect()}
    for i, t, *_ in rows:
        assert lists[i] == library(t)
        assert text[i] == LIB.decode(lists[i], skip_special_tokens=False)


def test_packing(small, nothing):
    rows, df = small
    got = packing.pack_documents(df, capacity=64, open_bins=8, shard_pieces=50, with_ids=True).cache()
    by_doc = {}
    for r in got.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        want = [*library(t), 1]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == list(range(0, len(want), 64))
        assert sum((r.ids for r in own), []) == want
        assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
        assert all(r.length == 64 for r in own[:-1])
    fill = {}
    for r in sorted(got.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 64
    seqs = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    assert {k: len(v) for k, v in seqs.items()} == fill
    assert packing.pack_documents(nothing).count() == 0
    odd = df.withColumn("shard", F.lit("x")).withColumn("stretch", F.lit(2)).withColumn("turn", F.lit(1)).withColumn("piece", F.lit(7))
    assert packing.pack_documents(odd, capacity=64).count() == got.count()


def test_packing_is_tight(spark):
    rng = np.random.default_rng(0)
    sizes = np.minimum(4096, rng.lognormal(6.3, 1, 30_000).astype(int) + 1).tolist()
    cut = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert packing.pack(cut).select("sequence_id").distinct().count() <= 1.002 * sum(sizes) / 4096 + 1


def test_best_fit_is_tight():
    rng = np.random.default_rng(0)
    sizes = np.minimum(4096, rng.lognormal(6.3, 1, 20_000).astype(int) + 1)
    bins = packing.BestFit(4096, 4096)
    for s in sizes.tolist():
        bins.place(s)
    assert bins.n_bins <= 1.01 * sizes.sum() / 4096 + 1


@pytest.mark.parametrize("open_bins", [1, 3])
def test_few_open_bins_never_overflow(open_bins):
    rng = np.random.default_rng(1)
    bins, fill = packing.BestFit(10, open_bins), {}
    for s in rng.integers(1, 11, 500).tolist():
        b, at = bins.place(s)
        assert at == fill.get(b, 0)
        fill[b] = at + s
        assert fill[b] <= 10 and bins.n_open <= open_bins


def test_shared_chunks_are_encoded_once():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghéß") for _ in range(rnd.randint(1, 9))) for _ in range(800)]
    shared = " ".join(rnd.choice(words) for _ in range(400))
    texts = [f"{'x' * rnd.randrange(9)}{shared[rnd.randrange(40):]}{rnd.randrange(10 ** 6)}" for _ in range(40)]
    coder = bpe_chunks.ChunkEncoder(bpe_chunks.WordEncoder(PATH), chunk=64)
    made = []
    plain = coder.words.words
    coder.words.words = lambda w: made.append(len(w)) or plain(w)
    got = [np.frombuffer(x, "<u4").tolist() for s in slabs(pa.array(texts)) for x in coder.slab(s)]
    whole = Tokenizer.from_file(PATH)
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.reused > 5 * coder.encoded  # the passage's chunks are the same wherever it stands
    n_words = sum(len(t.split()) for t in texts)
    assert sum(made) < n_words / 2  # words put through the encoder: those of new chunks, and one for each join
    before = coder.encoded
    again = [np.frombuffer(x, "<u4").tolist() for s in slabs(pa.array(texts)) for x in coder.slab(s)]
    assert again == got and coder.encoded == before


def test_bpe_on_odd_tables(spark, nothing):
    from tsforge.llm import queries  # noqa: F401
    assert bpe_chunks.encode(nothing).count() == 0 and bpe_chunks.round_trip_digests(nothing).count() == 0
    long = "lorem ipsum " * 450_000  # 5 MB, more than a slab or a batch
    df = spark.createDataFrame([(1, long), (1, long), (2, None), (None, "x"), (3, "")], "doc_id long, text string").selectExpr("*", "'q' AS ids", "1 AS n_tokens")
    got = sorted((r.doc_id, len(r.ids)) for r in bpe_chunks.encode(df).collect())
    n = len(Tokenizer.from_file(PATH).encode("lorem ipsum", add_special_tokens=False).ids) * 450_000
    assert got == [(1, n), (1, n), (2, 0), (3, 0)]
