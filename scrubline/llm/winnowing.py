"""Document fingerprints by winnowing, in DataFrame and SQL functions only.

A text is read as a row of short tokens: runs of up to four characters that are no white
space, counted anew after each white space, so that a shift does not outlast a word.
The k-grams of tokens are hashed; of each window of w neighbouring k-grams the least
hash is chosen, the rightmost of equal ones, and kept with its position. Two texts that
share k + w - 1 tokens in a row therefore share a chosen hash. A hash and its position
(of the first token) travel in one long: the hash in the high bits, the position,
counted down, in the low ones, so that the least long is the rightmost least hash.

Windows are local, so they are taken segment by segment. The fingerprint of a text whose
tail is edited keeps the whole segments before the edit.

``next_documents`` brings each document together with the next one: rows are dealt out
by stretches of 64 ids, so that nearly all neighbours meet in one shuffle of the texts;
the first document of each stretch, one in 64, is sent to the stretch before it as well.
No task sees more than a stretch, and no global window touches the documents.

Defined cases: a null text counts as empty; a text without tokens chooses nothing, one
of fewer than k tokens is one k-gram. The likeness of two empty fingerprints is 1, of an
empty and another 0. Rows that share an id follow each other in the order of their
text's hash. A null id comes first. After the last document comes the first; the only
one is its own next.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import stored, table

#: Bits of a position within the long; longer texts count on from zero.
POSITION_BITS = 26


@dataclass(frozen=True)
class Settings:
    """``gram``: tokens of a k-gram. ``window``: k-grams of a window. ``segment``: windows of a segment."""

    gram: int = 4
    window: int = 4
    segment: int = 256


#: What a token is.
TOKEN = r"\\S{1,4}"


def tokens(text: str) -> Column:
    return F.expr(f"regexp_extract_all({text}, '{TOKEN}', 0)")


def _segments(tokens: str, first: str, s: Settings) -> str:
    """SQL: the chosen longs of each segment from number ``first`` on, an array of arrays. ``tokens``: a column."""
    low = (1 << POSITION_BITS) - 1
    last = f"greatest(0, (size({tokens}) - {s.gram + s.window - 1}) div {s.segment})"
    piece = f"slice({tokens}, g * {s.segment} + 1, {s.segment + s.gram + s.window - 2})"
    packed = (f"transform(sequence(0, greatest(0, size(x) - {s.gram})), i -> (xxhash64(slice(x, i + 1, {s.gram})) & {~low}L) "
              f"| ({low} - (g * {s.segment} + i) % {low + 1}))")
    least = f"array_distinct(transform(sequence(0, greatest(0, size(p) - {s.window})), j -> array_min(slice(p, j + 1, {s.window}))))"
    one = f"element_at(transform(array({piece}), x -> element_at(transform(array({packed}), p -> {least}), 1)), 1)"
    return (f"IF(size({tokens}) = 0 OR {first} > {last}, CAST(array() AS array<array<bigint>>), "
            f"transform(sequence(CAST({first} AS INT), CAST({last} AS INT)), g -> {one}))")


def chosen(tokens: str, s: Settings = Settings()) -> Column:
    """The chosen hashes of each segment of a column of tokens, with positions, as an array of arrays."""
    return F.expr(_segments(tokens, "0", s))


def fingerprint(segments: Column) -> Column:
    """The chosen longs of a whole text; neighbouring segments may choose the same one."""
    return F.array_distinct(F.flatten(segments))


def positions(selected: Column) -> Column:
    """Positions of the chosen k-grams, in tokens."""
    return F.transform(selected, lambda x: F.lit((1 << POSITION_BITS) - 1) - x.bitwiseAND((1 << POSITION_BITS) - 1))


def hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of either that both have."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def digest(selected: Column) -> Column:
    return F.md5(F.array_join(selected.cast("array<string>"), ","))


def following(keys: DataFrame) -> DataFrame:
    """key, next_key of distinct longs; after the last comes the first. Keys are sorted in ranges; only the least of
    each range meets the others."""
    placed = stored(keys.repartitionByRange("key").select("key", F.spark_partition_id().alias("part")))
    ranges = placed.groupBy("part").agg(F.min("key").alias("least")).withColumn("all", F.lit(1))
    over = Window.partitionBy("all").orderBy("part")
    ranges = ranges.select("part", F.coalesce(F.lead("least").over(over), F.first("least").over(over)).alias("after"))
    inside = placed.withColumn("next_key", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    return inside.join(ranges, "part").select("key", F.coalesce("next_key", "after").alias("next_key"))


def next_documents(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """doc_id, text, segments, next_text, next_hashes: each document with its segments and what follows it."""
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    texts = docs.select(ids.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.select("id", "text", F.xxhash64("text").alias("tie"), F.shiftright("id", 6).alias("stretch"))
    firsts = (docs.select(ids.alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"))
              .groupBy(F.shiftright("id", 6).alias("stretch")).agg(F.min(F.struct("id", "tie")).alias("least")))
    firsts = stored(firsts)
    before = following(firsts.select(F.col("stretch").alias("key"))).select(F.col("next_key").alias("stretch"), F.col("key").alias("stretch_before"))
    wanted = firsts.join(before, "stretch").select("stretch", "stretch_before", F.col("least.id").alias("id"), F.col("least.tie").alias("tie"))
    dealt = rows.repartition("stretch")
    guests = (dealt.join(wanted, ["stretch", "id", "tie"]).dropDuplicates(["stretch_before"])
              .select(F.col("stretch_before").alias("stretch"), F.col("text").alias("guest_text"), tokens("text").alias("tokens"))
              .withColumn("guest_segments", chosen("tokens", s))
              .select("stretch", "guest_text", hashes(F.flatten("guest_segments")).alias("guest_hashes")))
    mine = (dealt.withColumn("tokens", tokens("text")).withColumn("segments", chosen("tokens", s)).drop("tokens")
            .withColumn("hashes", hashes(F.flatten("segments"))))
    over = Window.partitionBy("stretch").orderBy("id", "tie")
    nothing = F.lead(F.lit(1)).over(over).isNull()
    return (mine.join(guests, "stretch")
            .select(F.expr(f"nullif(id, {-(1 << 63) + 1}L - 1L)").alias("doc_id"), "text", "segments", "hashes",
                    F.when(nothing, F.col("guest_text")).otherwise(F.lead("text").over(over)).alias("next_text"),
                    F.when(nothing, F.col("guest_hashes")).otherwise(F.lead("hashes").over(over)).alias("next_hashes")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the chosen longs
    (``selected``) of each document. The edited text ends with the begin of the next document."""
    met = next_documents(docs, id_col, text_col, s)
    n = F.length("text").cast("long")
    met = met.withColumn("n_chars", n).withColumn("edited", F.expr(
        "concat(substring(text, 1, CAST(n_chars - n_chars div 4 AS INT)), substring(next_text, 1, CAST(n_chars div 4 AS INT)))"))
    # tokens that end before the edit stand in both texts; segments all of whose windows have only such tokens
    met = met.withColumn("edited_tokens", tokens("edited")).withColumn("whole", F.expr(
        f"greatest(0, regexp_count(substring(text, 1, CAST(n_chars - n_chars div 4 AS INT)), '{TOKEN}') - {s.gram + s.window - 1}) div {s.segment}"))
    met = met.withColumn("edited_segments", F.expr(f"concat(slice(segments, 1, CAST(whole AS INT)), {_segments('edited_tokens', 'whole', s)})"))
    met = met.withColumn("selected", fingerprint(F.col("segments"))).withColumn("edited_selected", fingerprint(F.col("edited_segments")))
    met = met.withColumn("edited_hashes", hashes(F.col("edited_selected")))
    return met.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("selected")).alias("fingerprint"),
                      digest(F.col("edited_selected")).alias("edited_fingerprint"), likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
                      likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"), "selected")


def op8_winnowing(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents")).drop("selected")
