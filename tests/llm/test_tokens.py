"""Byte-level BPE against the library, and packing against what its rows promise."""

import hashlib
import zlib
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubline.llm import byte_bpe, packing
from tests.conftest import DATA


@pytest.fixture(scope="module")
def library():
    return byte_bpe.Codec(byte_bpe.settings()).encoding


def plain(library, text: str | None) -> tuple:
    ids = library.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


@pytest.mark.parametrize("chunk, overlap", [(32768, 1024), (300, 40), (7, 5)])
def test_encoding_of_documents(spark, texts, library, chunk, overlap):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 4000")
    rows = byte_bpe.encode(docs, replace(byte_bpe.settings(), chunk=chunk, overlap=overlap)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == plain(library, texts[r.doc_id])


def test_encoding_edges(spark, edges, nothing, library):
    rows = byte_bpe.encode(edges, byte_bpe.settings()).collect()
    want = sorted((str(r.doc_id), *plain(library, r.text)) for r in edges.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert byte_bpe.encode(nothing, byte_bpe.settings()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 1'st\n  .é東", max_size=120), st.integers(3, 20), st.integers(0, 15))
def test_stitching(text, chunk, overlap):
    """Chunks of any size give the pre-tokens of the whole, also where words are longer than the overlap."""
    pattern = regex.compile(byte_bpe.settings().pattern)
    got: list[str] = []
    stitcher = byte_bpe.Stitcher(pattern, got.extend)
    overlap = max(1, min(overlap, chunk))
    for begin in range(0, max(1, len(text)), chunk):
        stitcher.add(begin, pattern.findall(text[begin:begin + chunk + overlap]), begin + chunk >= len(text))
    assert got == pattern.findall(text)


# --- packing ---


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.settings().tokenizer)


def checked(rows, ids: dict, length: int) -> list[int]:
    """Rows hold what they say and every id is in one piece; sizes of the sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(own) == r.length > 0 and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))

    def end(spans):
        at = 0
        for begin, n in sorted(spans):
            assert begin == at
            at += n
        return at

    assert {i: end(spans) for i, spans in pieces.items()} == {i: len(x) for i, x in ids.items()}
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = [end(spans) for spans in sequences.values()]
    # nothing is padded: all are full or a power of two
    assert all(n == length or n & (n - 1) == 0 for n in sizes) and sum(n < length for n in sizes) <= length.bit_length()
    return sizes


@pytest.mark.parametrize("length, windows", [(4096, 64), (256, 3), (64, 1)])
def test_packing_of_documents(spark, texts, tokenizer, length, windows):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(5)
    rows = packing.pack(docs, replace(packing.settings(), length=length, windows=windows)).collect()
    made = tokenizer.encode_batch(list(texts.values()), add_special_tokens=False)
    checked(rows, {i: m.ids + [2] for i, m in zip(texts, made)}, length)


def test_packing_edges(spark, edges, nothing):
    rows = packing.pack(edges, packing.settings()).collect()
    # rows of one id are packed each for itself
    whole = defaultdict(int)
    for r in rows:
        whole[r.doc_id] += r.length
    assert whole[1] == whole[2] == whole[5] == 1 and whole[4] == 2 * 9 and whole[None] > 1 and whole[7] == 40_001
    assert packing.pack(nothing, packing.settings()).count() == 0


def test_encoder_equals_library(texts, tokenizer):
    odd = ["it's <|endoftext|> a<|startoftext|>b don't WE'LL 12ab3 'Sx", "Zürich ŉx İstanbul ſtraße ﬁn café ́ ΣΑΣ 東京 😀 \x1c \x85 \xa0 a\xa0b", "", "  \n"]
    encode = packing.Encoder(replace(packing.settings(), known=50))
    for text in [*odd, *texts.values()]:
        assert encode(text.encode()) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 5))
def test_packer_loses_nothing(sizes, windows):
    packer, out = packing.Packer(16, windows), []
    for doc, n in enumerate(sizes):
        for window in packer.add(doc, np.full(n, doc, "<u4").tobytes()):
            assert sum(len(p[2]) for p in window) == 64
            out += window
        assert len(packer.open) <= windows
    rest = list(packer.rest())
    assert sum(sum(len(p[2]) for p in w) < 64 for w in rest) <= 1
    got = defaultdict(int)
    for doc, _, ids, _ in out + [p for w in rest for p in w]:
        got[doc] += len(ids) // 4
    assert dict(got) == dict(enumerate(sizes))


@given(st.integers(0, 100_000))
def test_bounds(total):
    cut = packing.bounds(total, 64)
    steps = [b - a for a, b in zip(cut, cut[1:])]
    assert cut[0] == 0 and cut[-1] == total and all(n == 64 or n & (n - 1) == 0 for n in steps)
