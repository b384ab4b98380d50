"""Token counts, packing and byte-level BPE against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowsift.llm import byte_bpe, catalog, common, packing, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = st.text(st.one_of(st.sampled_from(" \n\t ▁　ab'sé0<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=40)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def byte_level():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces_of(encode, texts):
    flat, at = encode(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


def test_units_are_encoded_in_one_call(monkeypatch):
    # A call per distinct word cost as much as the encoding itself.
    encoding, calls = packing.rank_encoding(BYTES), []
    units = ["plain", "It's", "x\n", "\u00e9\u4e2d\U0001f600", "<|endoftext|>", "12,3.4", "#$%", "\x00", "plain"]
    want = [encoding.encode_ordinary(" " + u) for u in units]
    monkeypatch.setattr(type(encoding), "encode_ordinary", lambda self, text: calls.append(text) or [])
    flat, counts = packing.units_encoder(encoding)(units)
    assert [part.tolist() for part in np.split(flat, np.cumsum(counts)[:-1])] == want and not calls
    flat, counts = packing.units_encoder(encoding)([])
    assert len(flat) == len(counts) == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=6))
def test_units_encode_like_whole_texts(texts):
    from tokenizers import Tokenizer

    model = test_units_encode_like_whole_texts.model = getattr(test_units_encode_like_whole_texts, "model", None) or Tokenizer.from_file(BYTES)
    encode = test_units_encode_like_whole_texts.encode = getattr(test_units_encode_like_whole_texts, "encode", None) or packing.encoder(BYTES)
    assert pieces_of(encode, texts) == [model.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=6))
def test_units_count_like_whole_texts(texts):
    whole, later, unsafe = test_units_count_like_whole_texts.c = getattr(test_units_count_like_whole_texts, "c", None) or token_counts._counter(PIECES)
    flat, at = common.expand(pa.array(texts, pa.string()), lambda t: (whole(t),), lambda t: (later(t),), lambda t: (whole(t),), unsafe)
    assert [int(flat[a:b].sum()) for a, b in zip(at, at[1:])] == [whole(t) for t in texts]


def test_counts_of_a_table(spark, sf, texts, pieces):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in catalog.op3_token_counts(spark, sf).collect()}
    assert got == {k: (len(t.encode()), n := len(pieces.encode(t)), n > 4096) for k, t in texts.items()}


def test_counts_of_odd_rows(odd_docs, no_docs, pieces):
    rows = token_counts.count_tokens(odd_docs, PIECES).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(pieces.encode(r.text or ""))) for r in odd_docs.collect()]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == Counter(want)
    assert token_counts.count_tokens(no_docs, PIECES).count() == 0


def test_counts_by_a_library_without_units(odd_docs, byte_level):
    rows = token_counts.count_tokens(odd_docs, BYTES).collect()
    want = [(r.doc_id, len(byte_level.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect()]
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter(want)


def check_packing(rows, ids, window=1024):
    """Every id in exactly one piece, sequences gapless; returns the sequences' lengths. ids: list of (key, ids)."""
    by_key = {}
    for r in rows:
        by_key.setdefault(r.doc_id, []).append(r)
    for key in {k for k, _ in ids}:
        want = Counter((start, n) for start, n in [(0, 0)])
        pieces = Counter()
        for r in by_key[key]:
            pieces[r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        copies = [x for k, x in ids if k == key]
        total = 0
        for (start, n, crc, tokens), times in pieces.items():
            fits = [x for x in copies if len(x) == tokens and zlib.crc32(x[start:start + n].tobytes()) == crc]
            assert len(fits) >= 1 and times <= len(copies)
            total += n * times
        assert total == sum(map(len, copies)), want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= window
    return [sum(n for _, n in p) for p in sequences.values()]


def test_packing_of_a_table(spark, sf, texts, byte_level):
    ids = [(k, np.array(byte_level.encode(t, add_special_tokens=False).ids + [0], "<u4")) for k, t in texts.items()]
    lengths = check_packing(catalog.op4_packing(spark, sf).collect(), ids)
    assert len(lengths) <= sum(len(x) for _, x in ids) / 1024 + 2 and sum(n < 1024 for n in lengths) <= 2


def test_packing_of_odd_rows(odd_docs, no_docs, byte_level):
    ids = [(r.doc_id, np.array(byte_level.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")) for r in odd_docs.collect()]
    check_packing(packing.pack(odd_docs, BYTES).collect(), ids)
    assert packing.pack(no_docs, BYTES).count() == 0


@pytest.mark.parametrize("counts", [{1: 1500}, {512: 3}, {256: 7, 100: 2}, {k: 50 for k in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)}])
def test_tails_of_a_power_of_two_are_packed(counts):
    h = np.zeros(1024, np.int64)
    for k, n in counts.items():
        h[k] = n
    layout, held = packing.Layout(h, 1024), Counter()
    for k, n in counts.items():
        for rank in range(n):
            for _, size, sequence, _ in layout.place(k, rank):
                held[sequence] += size
    assert sorted(held.values(), reverse=True)[:-1] == [1024] * (len(held) - 1) and len(held) == -(-sum(held.values()) // 1024)


@pytest.mark.parametrize("counts", [{700: 5000}, {512: 3}, {1: 10, 1023: 10}, {300: 100, 424: 50, 724: 30}, {}, {341: 10, 342: 5}])
def test_layout_places_every_tail_once(counts):
    h = np.zeros(1024, np.int64)
    for k, n in counts.items():
        h[k] = n
    layout = packing.Layout(h, 1024)
    spans = {}
    for length, n in counts.items():
        for rank in range(n):
            at = 0
            for start, size, sequence, offset in layout.place(length, rank):
                assert start == at
                at += size
                spans.setdefault(sequence, []).append((offset, size))
            assert at == length
    short = 0
    for parts in spans.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 1024
        short += at < 1024 and at & (at - 1) != 0
    assert short <= 1


def test_bpe_of_a_table(spark, sf, texts, tik):
    rows = {r.doc_id: r for r in catalog.op9_byte_bpe(spark, sf).collect()}
    assert rows.keys() == texts.keys()
    for k, t in texts.items():
        ids = np.array(tik.encode_ordinary(t), "<u4").tobytes()
        assert (rows[k].n_tokens, rows[k].ids_sha256, rows[k].decoded_sha256) == (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_of_odd_rows(odd_docs, no_docs, tik):
    encoded = byte_bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(encoded, RANKS).collect()
    want = [(r.doc_id, np.array(tik.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in odd_docs.collect()]
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in rows) == Counter(want)
    assert byte_bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


@given(st.lists(st.integers(0, (1 << 21) - 1)))
def test_varints_come_back(numbers):
    x = np.array(numbers, np.int64)
    assert byte_bpe.from_varints(byte_bpe.varints(x)).tolist() == numbers


@given(st.lists(st.binary(max_size=5)))
def test_packed_lists_come_back(items):
    sizes, raw = byte_bpe.unpacked(byte_bpe.packed(items))
    assert sizes.tolist() == list(map(len, items)) and raw == b"".join(items)


@pytest.mark.parametrize("entries", [1, 5, 40, 300, 10_000])
def test_frequent_words_within_bounds(spark, entries):
    from collections import Counter

    rng = random.Random(entries)
    texts = [" ".join(f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(60)) for _ in range(200)]
    found = token_counts.frequent(spark.createDataFrame([(t,) for t in texts], "text string").repartition(50), "text", entries)
    counts = Counter(w for t in texts for w in t.split(" "))
    assert len(found) == len(set(found)) <= entries
    if entries >= 10_000:
        assert set(found) == {w for w, n in counts.items() if n > 1}
    elif entries >= 40:
        # All words clearly more frequent than the last one that fits are there.
        limit = sorted(counts.values(), reverse=True)[entries - 1]
        assert {w for w, n in counts.items() if n > 1.2 * limit} <= set(found) and len(found) > entries / 2


def test_scans_that_differ_are_found_out(spark, monkeypatch):
    """Blocks of two scans that hold other rows must not be put together."""
    docs = spark.range(400).selectExpr("id as doc_id", "concat('word', id, ' and more') as text").repartition(2)
    path, real = public_tokenizers.path("byte_bpe_50k.tiktoken"), byte_bpe._blocks
    monkeypatch.setattr(byte_bpe, "_blocks", lambda d, key, text, pattern, buckets, send_words: real(
        d if send_words else d.withColumn("text", d.text.substr(1, 9)), key, text, pattern, buckets, send_words))
    with pytest.raises(Exception, match="two scans"):
        byte_bpe.encode(docs, path, public_tokenizers.PATTERN).collect()
