"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenated bytes.

A text is cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from
its own begin, which may lie within a pre-token. Two neighbours are stitched at the
first place in their overlap where both have a boundary: from a true boundary on, the
pattern matches alike whatever came before. Where a chunk is cut off, its last
pre-token is not trusted. If no boundary coincides (one word longer than the overlap),
the stretch is pre-tokenised again from the last true boundary. Pre-tokens are then
encoded one by one; those met before are looked up.

A text of one chunk has nothing to stitch and is not shuffled. Chunks of longer texts
are dealt out by text and number, then brought together in order; the task that stitches
a text holds two chunks of it at a time.

Defined cases: a null or empty text has no id; its hashes are those of nothing. Repeated
rows, and rows with equal or null ids, are encoded each for itself. Very long texts
differ from others only in their number of chunks.
"""

import hashlib
from base64 import b64decode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import slices, table


@dataclass(frozen=True)
class Settings:
    """``ranks``: file of base64 tokens and ranks, present on every executor. ``pattern``: splits a text into
    pre-tokens and covers it. ``chunk``, ``overlap``: characters. ``known``: pre-tokens remembered by a task."""

    ranks: str
    pattern: str
    chunk: int = 32768
    overlap: int = 1024
    known: int = 200_000


def pre_tokens(text: str, pattern: "regex.Pattern") -> list[str]:
    return pattern.findall(text)


class Codec:
    """Ids of pre-tokens and bytes of ids."""

    def __init__(self, s: Settings) -> None:
        import tiktoken
        with open(s.ranks, "rb") as lines:
            ranks = {b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=s.pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.most, self.known = s.known, {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, tokens: list[str]) -> list[tuple[list[int], bytes, bytes]]:
        """(ids, ids in decimal with commas, decoded bytes) of each pre-token."""
        known = self.known
        if new := set(tokens).difference(known):
            if len(known) + len(new) > self.most:
                known.clear()
                new = set(tokens)
            for token in new:
                ids = self.encoding.encode_ordinary(token)
                known[token] = (ids, ",".join(map(str, ids)).encode(), self.decode(ids))
        return list(map(known.__getitem__, tokens))


class Digest:
    """What the query reports of a text, fed with its pre-tokens in order."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.n, self.ids, self.decoded = codec, 0, hashlib.sha256(), hashlib.sha256()

    def feed(self, tokens: list[str]) -> None:
        if not tokens:
            return
        made = self.codec.encode(tokens)
        self.ids.update((b"," if self.n else b"") + b",".join([m[1] for m in made]))
        self.decoded.update(b"".join([m[2] for m in made]))
        self.n += sum([len(m[0]) for m in made])

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


class Stitcher:
    """Takes the chunks of one text in order, with their pre-tokens, and hands on the true ones."""

    def __init__(self, pattern: "regex.Pattern", feed) -> None:
        self.pattern, self.feed = pattern, feed
        self.begin, self.tokens = 0, []  # the open stretch: where it begins, its pre-tokens

    def add(self, begin: int, tokens: list[str], last: bool) -> None:
        if self.tokens:
            held = np.cumsum([0, *map(len, self.tokens)]) + self.begin
            new = np.cumsum([0, *map(len, tokens)]) + begin
            # the last pre-token of a chunk that was cut off is not trusted, so neither is its end
            both = np.intersect1d(held[:-1], new if last else new[:-1])
            both = both[both >= begin]
            if len(both):
                at = int(both[0])
                self.feed(self.tokens[:int(np.searchsorted(held, at))])
                self.begin, self.tokens = at, tokens[int(np.searchsorted(new, at)):]
            else:
                self.feed(self.tokens[:-1])
                whole = self.tokens[-1] + "".join(tokens)[int(held[-1]) - begin:]
                self.begin, self.tokens = int(held[-2]), pre_tokens(whole, self.pattern)
        else:
            self.begin, self.tokens = begin, tokens
        if last:
            self.feed(self.tokens)
            self.tokens = []


_OUT = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _OUT)


def _of_one_chunk(docs: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, pattern = Codec(s), regex.compile(s.pattern)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                digest = Digest(codec)
                digest.feed(pre_tokens(text, pattern) if text else [])
                rows.append((doc, *digest.row()))
            yield _out(rows)

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def chunk_rows(docs: DataFrame, s: Settings) -> DataFrame:
    """row, doc_id, begin, last, text: the chunks of each text, each with the overlap after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, value in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
                text = value.as_py()
                begins = range(0, max(1, len(text)), s.chunk)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row] * len(begins), pa.int64()), pa.array([doc] * len(begins), pa.int64()), pa.array(list(begins), pa.int64()),
                    pa.array([b + s.chunk >= len(text) for b in begins]), pa.array([text[b:b + s.chunk + s.overlap] for b in begins], pa.string())],
                    ["row", "doc_id", "begin", "last", "text"])

    return docs.mapInArrow(run, "row long, doc_id long, begin long, last boolean, text string")


def _of_many_chunks(docs: DataFrame, s: Settings) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(s.pattern)
        for batch in slices(batches):
            tokens = [list(map(len, pre_tokens(t, pattern))) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.int32()))], [*batch.schema.names, "lengths"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, pattern = Codec(s), regex.compile(s.pattern)
        now = digest = stitcher = None
        for batch in slices(batches):
            rows = []
            columns = [batch[c].to_pylist() for c in ("row", "doc_id", "begin", "last")]
            for row, doc, begin, last, text, lengths in zip(*columns, batch["text"], batch["lengths"]):
                if row != now:
                    now, digest = row, Digest(codec)
                    stitcher = Stitcher(pattern, digest.feed)
                whole, ends = text.as_py(), np.cumsum([0, *lengths.as_py()]).tolist()
                stitcher.add(begin, [whole[a:b] for a, b in zip(ends, ends[1:])], last)
                if last:
                    rows.append((doc, *digest.row()))
            yield _out(rows)

    cut = chunk_rows(docs, s).repartition("row", "begin").mapInArrow(split, "row long, doc_id long, begin long, last boolean, text string, lengths array<int>")
    return (cut.repartition("row").sortWithinPartitions("row", "begin")
            .mapInArrow(stitch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def encode(docs: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = F.length("text")
    one = texts.where(size.isNull() | (size <= s.chunk))
    many = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where(size > s.chunk)
    return _of_one_chunk(one, s).union(_of_many_chunks(many, s))


def settings() -> Settings:
    import public_tokenizers
    return Settings(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), settings())
