"""Benchmark decontamination by spaced seeds.

A document holds part of a benchmark item if some `window` consecutive words of the item
stand in it in order with at most `changes` of them substituted. Fixed masks choose token
positions and ignore the others; the hash of the chosen words is joined between item and
document positions, and every hit is verified: the windows of that diagonal that hold the
seed are compared word by word.

The two masks were found by search to be complete: whichever 2 of 13 words are changed,
one mask still fits somewhere in the window. So the result doesn't depend on the masks.

An item of fewer than `window` words has no such window: it is held where all of its words
stand in order, none of them substituted. Its one seed has all places chosen, and documents
are also probed with runs of the lengths (at most `window` - 1) that such items have.

Only DataFrame expressions. Seeds of the items are broadcast only if they number at most
`broadcast_rows`; then hits are verified where they are found and no words of documents are
shuffled. Otherwise places meet by a shuffle on seed and salt, in rows of keys and numbers
alone; only documents with a hit are shuffled with their words, once, to be verified.

Defined results: words are runs of other bytes than ASCII space, ASCII lower case; null
texts and texts without words match nothing; rows that are equal in id and text are one;
repeated items are reported each under its id. An item of a single common word is held by
every text with that word: leave such items out of `items` where that isn't wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, CHANGES = 13, 2
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
_SPACES = " \t\n\x0b\f\r"


def word_hashes(text: Column) -> Column:
    lower = F.btrim(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_SPACES))
    return F.transform(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str], whole: tuple[int, ...] = ()) -> DataFrame:
    """A row for each place and mask, and for each place and length of `whole`: `keep`, place, seed."""
    long, short = max(m[-1] for m in MASKS) + 1, min(m[-1] for m in MASKS) + 1
    # null, and so no row, under the fewest words; the last places have room for the shorter mask or run only
    least, fewest = min(short, *whole) if whole else short, min((WINDOW, *whole))
    places = F.when(F.size("words") >= fewest, F.sequence(F.lit(0), F.size("words") - F.lit(least)))
    placed = rows.withColumn("place", F.explode(places))
    seeds = []
    for k, mask in enumerate(MASKS):
        seed = F.xxhash64(F.lit(k), *[F.get("words", F.col("place") + F.lit(o)) for o in mask])
        fits = F.col("place") + F.lit(mask[-1]) < F.size("words")
        seeds.append(F.when(fits & (F.size("words") >= WINDOW), seed) if whole else seed if mask[-1] + 1 < long else F.when(fits, seed))
    for n in whole:
        seeds.append(F.when(F.col("place") + F.lit(n) <= F.size("words"), _run_seed(F.slice("words", F.col("place") + F.lit(1), n), F.lit(n))))
    return placed.select(*keep, "place", F.explode(F.array(*seeds)).alias("seed")).where("seed IS NOT NULL")


def _run_seed(words: Column, n: Column) -> Column:
    return F.xxhash64(-n, words)


def _chunks(rows: DataFrame, step: int) -> DataFrame:
    """Words in chunks that overlap by a window less one, so that every window lies in one: base and words."""
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - F.lit(WINDOW), F.lit(0)), F.lit(step)),
        lambda b: F.struct(b.alias("base"), F.slice("words", b + F.lit(1), F.lit(step + WINDOW - 1)).alias("words")),
    )
    return rows.withColumn("chunk", F.explode(cut)).select("id", "text_key", "chunk.base", "chunk.words")


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 200_000, chunk_words: int = 512, salts: int = 8) -> DataFrame:
    """(id, text_key, item, first_word, end_word): documents that hold a verified window of an item, or all of a
    shorter one, and the words from its first to past its last; text_key tells rows with the same id apart.
    Runs two small jobs over `items`, for the number of seeds and the lengths of short items."""
    known = items.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text_col)).alias("words"))
    around, reach = WINDOW - 1, max(m[-1] for m in MASKS) + 1
    # what verification reads of an item: the words up to a window's length on either side of the seed
    near = F.slice("words", F.greatest(F.col("place") - F.lit(around - 1), F.lit(1)), F.lit(2 * around + reach))
    before = F.least("place", F.lit(around))
    brief = known.where(F.size("words").between(1, WINDOW - 1) & (F.get("words", F.lit(0)) != F.xxhash64(F.lit(""))))
    whole = tuple(sorted(r["n"] for r in brief.select(F.size("words").alias("n")).distinct().collect()))  # fewer than a window's words
    index = _seeds(known, ["item", "words"])
    if whole:
        index = index.unionByName(brief.select("item", "words", F.lit(0).alias("place"), _run_seed(F.col("words"), F.size("words")).alias("seed")))
    small = index.limit(broadcast_rows + 1).count() <= broadcast_rows
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("body"))
    chunks = lambda rows: _chunks(rows.select("id", "text_key", word_hashes(F.col("body")).alias("words")), chunk_words)
    if small:
        hits = _seeds(chunks(texts), ["id", "text_key", "base", "words"], whole).join(F.broadcast(index.select("item", "seed", near.alias("near"), before.alias("before"))), "seed")
    else:
        salted = F.sequence(F.lit(0), F.lit(salts - 1))
        # items may repeat under one id, so each row is told by its words too
        sought = index.select("seed", F.struct("item", F.xxhash64("words").alias("item_key"), F.col("place").alias("item_place")).alias("at"), F.explode(salted).alias("salt"))
        places = _seeds(chunks(texts), ["id", "text_key", "base"], whole).withColumn("salt", F.pmod(F.xxhash64("id", "base", "place"), F.lit(salts)).cast("int"))
        met = places.join(sought, ["seed", "salt"]).select("id", "text_key", "base", "place", "at.*").distinct()
        held = met.select(F.col("id").alias("held_id"), F.col("text_key").alias("held_key")).distinct()
        texts_held = chunks(texts.join(held, F.col("id").eqNullSafe(F.col("held_id")) & (F.col("text_key") == F.col("held_key")), "left_semi").dropDuplicates(["id", "text_key"]))
        sliced = met.join(known.select(F.col("item").alias("known_item"), "words").distinct(), F.col("item").eqNullSafe(F.col("known_item")) & (F.col("item_key") == F.xxhash64("words")))
        ready = sliced.select("id", "text_key", "base", F.col("place").alias("own"), "item", "words", F.col("item_place").alias("place")).select(F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key"), F.col("base").alias("hit_base"), "own", "item", near.alias("near"), before.alias("before"))
        hits = texts_held.join(ready, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")) & (F.col("base") == F.col("hit_base"))).withColumn("place", F.col("own"))
    start = F.col("place") - F.col("before")  # the chunk's word that faces near[0]; may lie before the chunk
    facing = F.transform(F.sequence(F.lit(0), F.size("near") - F.lit(1)), lambda i: F.coalesce((F.get("near", i) == F.when(start + i >= 0, F.get("words", start + i))).cast("int"), F.lit(0)))
    # only items under a window have fewer words around a seed: all of theirs, each to be equal
    width = F.least(F.size("near"), F.lit(WINDOW))
    kept = F.when(F.size("near") < WINDOW, F.size("near")).otherwise(F.lit(WINDOW - CHANGES))
    good = F.filter(
        F.sequence(F.lit(0), F.size("near") - width),
        lambda a: (F.aggregate(F.slice("equal", a + F.lit(1), width), F.lit(0), lambda x, y: x + y) >= kept) & (start + a >= 0) & (start + a + width <= F.size("words")),
    )
    seen = hits.withColumn("equal", facing).withColumn("good", good)
    # hits without a good window have null ends and leave after the grouping: before it, the test would move into the join
    ends = seen.groupBy("id", "text_key", "item").agg(
        F.min(F.col("base") + start + F.array_min("good")).cast("long").alias("first_word"), F.max(F.col("base") + start + F.array_max("good") + width).cast("long").alias("end_word")
    )
    return ends.where("first_word IS NOT NULL")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: object) -> DataFrame:
    """`docs` without the rows that hold a verified overlap; other rows and all columns stay as they are."""
    held = overlaps(docs, items, id_col, text_col, **names).select(F.col("id").alias("_held_id"), F.col("text_key").alias("_held_key")).distinct()
    return docs.join(held, F.col(id_col).eqNullSafe(F.col("_held_id")) & (F.xxhash64(text_col) == F.col("_held_key")), "left_anti")
