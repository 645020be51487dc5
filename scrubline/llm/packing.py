"""Packing of token ids into sequences of one length by bounded-space online best fit.

Each partition keeps a fixed number of open windows. What a document has beyond full
sequences goes to the open window with the least space that holds it. When none fits
and all windows are open, the fullest is filled up with the head of the document and
emitted; the rest opens a new one. At its end a partition pours its open windows
together, so that one partial window is left. These leftovers, one per partition, are
laid end to end and cut at full sequences; the very last, shorter stretch is cut into
powers of two, which need no padding. Only their lengths meet in one place.

Texts are not shuffled and nothing but two numbers is collected. The pieces are written
to the shared folder before the leftovers are merged, so that numbers given to
sequences hold whatever executors are lost.

Defined cases: a null or empty text has the end id alone. Repeated rows, and rows with
equal or null ids, are packed each for itself, in the order of the partition. An empty
table gives no piece. Columns besides id and text are not looked at.
"""

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import as_bytes, slices, stored, table


@dataclass(frozen=True)
class Settings:
    """``tokenizer``: file for the tokenizers library, present on every executor. ``end``: id after each document.
    ``length``: ids of a sequence, a power of two. ``windows``: open windows of a partition. ``known``: words
    remembered by a task."""

    tokenizer: str
    end: int = 2
    length: int = 4096
    windows: int = 64
    known: int = 300_000


# The tokenizer's pattern for lower-case words of printable ASCII and Latin letters, whose lower case is
# one letter and which are composed already; what else there may be in a word, or the begin of a special token.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\u017f]+")
_OTHER = re.compile(r"[^\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]|<\|")


def _byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary has for each byte: printable ones stand for themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Ids of texts, as little-endian 32-bit numbers. A token never spans white space, and ASCII white space is always
    that, so a text is encoded word by word and words already met are looked up. New words are cut into letters, digits
    and the rest, which repeat more often and go to the tokenizer's model one by one; a word with characters that need
    normalising, or with a special token, goes through the whole tokenizer."""

    def __init__(self, s: Settings) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.most, self.known, self.pieces = Tokenizer.from_file(s.tokenizer), s.known, {}, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def __call__(self, text: bytes) -> bytes:
        words = text.split()
        if new := set(words).difference(self.known):
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                self.pieces.clear()
                new = set(words)
            for raw in new:
                word = raw.decode()
                if _OTHER.search(word):
                    self.known[raw] = _packed_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
                else:
                    self.known[raw] = b"".join([self.pieces.get(p) or self.learn(p) for p in _PIECE.findall(word.lower())])
        return b"".join(map(self.known.__getitem__, words))

    def learn(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        self.pieces[piece] = ids = _packed_ids([t.id for t in self.model.tokenize(spelt)])
        return ids


def _packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: A piece: document (place in the output of ids), start, ids as bytes, ids of the document.
Piece = tuple[object, int, bytes, int]


class Packer:
    """Emits (pieces of a full window) as documents come; ``rest`` gives what is left."""

    def __init__(self, length: int, windows: int) -> None:
        self.length, self.most = length, windows
        self.open: dict[int, list[Piece]] = {}  # number -> pieces
        self.space: list[tuple[int, int]] = []  # (space left, number), ascending
        self.next = 0

    def add(self, doc, ids: bytes) -> Iterator[list[Piece]]:
        n, at = len(ids) // 4, 0
        while n - at >= self.length:
            yield [(doc, at, ids[4 * at:4 * (at + self.length)], n)]
            at += self.length
        if at == n:
            return
        fits = bisect_left(self.space, (n - at, -1))
        if fits == len(self.space) and len(self.space) == self.most:  # none fits: the fullest goes, filled up
            space, number = self.space.pop(0)
            yield [*self.open.pop(number), (doc, at, ids[4 * at:4 * (at + space)], n)]
            at, fits = at + space, len(self.space)
        if fits < len(self.space):
            space, number = self.space.pop(fits)
        else:
            space, number = self.length, self.next
            self.next, self.open[number] = self.next + 1, []
        self.open[number].append((doc, at, ids[4 * at:], n))
        if space == n - at:
            yield self.open.pop(number)
        else:
            insort(self.space, (space - (n - at), number))

    def rest(self) -> Iterator[list[Piece]]:
        """The open windows poured together, fullest first; the last is the only one that may be partial."""
        now, filled = [], 0
        for _, number in self.space:
            for doc, start, ids, n in self.open[number]:
                while ids:
                    take = ids[:4 * (self.length - filled)]
                    now.append((doc, start, take, n))
                    filled, start, ids = filled + len(take) // 4, start + len(take) // 4, ids[len(take):]
                    if filled == self.length:
                        yield now
                        now, filled = [], 0
        if now:
            yield now


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "sequence", "offset", "ids"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, sequence long, offset long, ids binary"


def _packed(docs: DataFrame, s: Settings) -> DataFrame:
    """The pieces of each partition. ``sequence`` counts full sequences; the leftover has -1 and brings its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, part = Encoder(s), Packer(s.length, s.windows), TaskContext.get().partitionId()
        end, done, rows = _packed_ids([s.end]), 0, []

        def put(window: list[Piece], number: int) -> None:
            at = 0
            for doc, start, ids, n in window:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, part, number, at, ids if number < 0 else None))
                at += len(ids) // 4

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], _NAMES)
            rows.clear()
            return batch

        for batch in slices(batches):
            for doc, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"])):
                for window in packer.add(doc, encode(text) + end):
                    put(window, done)
                    done += 1
            yield out()
        for window in packer.rest():
            full = sum(len(p[2]) for p in window) == 4 * s.length
            put(window, done if full else -1)
            done += full
        yield out()

    return docs.mapInArrow(run, _SCHEMA)


def bounds(total: int, length: int) -> list[int]:
    """Where a stretch of ``total`` ids is cut: full sequences, then descending powers of two."""
    out, at = list(range(0, total + 1, length)), total // length * length
    for bit in reversed(range(length.bit_length() - 1)):
        if total % length >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


def _merged(rest: DataFrame, total: int, first: int, s: Settings) -> DataFrame:
    """The leftovers, each piece with the place (``at``) where it begins in the stretch of all of them, cut anew."""
    whole = total // s.length * s.length
    tail = bounds(total % s.length, s.length) if total % s.length else [0]

    def place(at: int) -> tuple[int, int, int]:
        """(number, offset, end) of the sequence that holds ``at``."""
        if at < whole:
            return at // s.length, at % s.length, (at // s.length + 1) * s.length
        k = max(i for i, b in enumerate(tail) if b <= at - whole)
        return whole // s.length + k, at - whole - tail[k], whole + tail[k + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for r in batch.to_pylist():
                ids, start, at = r["ids"], r["start"], r["at"]
                while ids:
                    number, offset, end = place(at)
                    take = ids[:4 * (end - at)]
                    n = len(take) // 4
                    rows.append((r["doc_id"], start, n, zlib.crc32(take), r["doc_tokens"], first + number, offset))
                    ids, start, at = ids[len(take):], start + n, at + n
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return rest.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack(docs: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece; sequences are numbered without gaps."""
    pieces = stored(_packed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), s))
    # one row for each partition, not for each document
    parts = pieces.groupBy("part").agg(F.coalesce(F.max("sequence") + 1, F.lit(0)).alias("n"),
                                       F.coalesce(F.sum(F.expr("IF(sequence < 0, length, 0)")), F.lit(0)).alias("left"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n", "left",
                                F.coalesce(F.sum("left").over(before), F.lit(0)).alias("at")))
    sums = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("left"), F.lit(0))).first()
    full = (pieces.where("sequence >= 0").join(parts, "part")
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset"))
    rest = (pieces.where("sequence < 0").join(parts, "part")
            .select("doc_id", "start", "doc_tokens", "ids", (F.col("at") + F.col("offset")).alias("at")))
    return full.union(_merged(rest, sums[1], sums[0], s))


def settings() -> Settings:
    import public_tokenizers
    return Settings(public_tokenizers.path("word_bpe_49k.json"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), settings())
