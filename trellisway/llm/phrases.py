"""Collocations: phrases whose words occur together more often than apart, by language.

1. Rabin-Karp fingerprints, level by level from single words to the longest phrases: prefix sums of a polynomial over the
   hashes of a batch's words give 64 bits of every phrase of one length in numpy, with a second, independent hash of 32
   bits. A batch gives each distinct fingerprint once, with its count and a pointer to a text that holds it.
2. A shuffle adds the counts up by fingerprint, keeps one pointer, and compares the second hashes. Frequent fingerprints
   of a level become a bit table of bounded size, and the next level only looks at phrases whose two shorter phrases are
   in it. A full table lets more through; it never loses a phrase.
3. A fingerprint whose second hashes differ stands for several phrases: these are counted anew by their text, in blocks
   of fingerprints against all texts.
4. Pointers of the other frequent fingerprints are followed, and only these phrases become text.
5. Scores are exact: every cut of a phrase looks up the counts of its two parts, products have decimals of 38 digits.

Nothing but tables of frequent phrases is kept between levels. What is sent to all tasks: the bit table (at most
`MOST_BITS` bits), a block of `BLOCK` fingerprints, and at most `BLOCK` keys of texts that pointers name (beyond that the
texts are joined by a shuffle).

Defined results: null texts are empty, a null language is `und`; empty texts add nothing; repeated rows count each; a
language without words has no row; columns other than the language and the text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellisway.llm.common import WORD_BASES, checkpointed, discard, inverse, member, mix64, powers, shuffle_width, slices, spellings, text_bytes

MOST_BITS = 1 << 27
BLOCK = 1 << 20
#: Bytes of texts whose phrases are looked at together.
_BATCH = 1 << 21

_CUT = np.zeros(256, bool)
_CUT[[10, 11, 12, 13, *b".,;:!?"]] = True
_APART = _CUT.copy()
_APART[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class Phrases:
    """The words of some texts and the fingerprints of their phrases, which cross neither pieces nor texts."""

    def __init__(self, texts: list[bytes | None], languages: list[str], bits: int = 64):
        self.data = _LOWER[np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)]
        edge = np.diff(np.concatenate([[True], _APART[self.data]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.piece = np.searchsorted(np.flatnonzero(_CUT[self.data]), self.start).astype(np.int32)
        self.doc = np.searchsorted(np.cumsum([len(t or b"") + 1 for t in texts]), self.start, side="right").astype(np.int32)
        self.hash = spellings(self.data, self.start, self.end)
        known = {x: _language(x) for x in set(languages)}
        self.language = np.array([known[x] for x in languages], np.uint64)[self.doc] if languages else np.zeros(0, np.uint64)
        self.low = np.uint64((1 << bits) - 1)
        self.sums: dict[int, np.ndarray] = {}

    def places(self, n: int) -> np.ndarray:
        """The first words of all phrases of n words."""
        last = len(self.hash) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def fingerprints(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        base, words = WORD_BASES[which], len(self.hash)
        if which not in self.sums:
            self.sums[which] = np.zeros(words + 1, np.uint64)
            np.cumsum(self.hash * powers(base, words), out=self.sums[which][1:])
        sums = self.sums[which]
        value = mix64((sums[at + n] - sums[at]) * powers(inverse(base), words)[at] + self.language[at], which)
        return value & self.low if which == 0 else value >> np.uint64(32)

    def text(self, at: int, n: int) -> str:
        return b" ".join(self.data[self.start[k] : self.end[k]].tobytes() for k in range(at, at + n)).decode("utf-8", "replace")


class BitTable:
    """Which fingerprints may be in a set: each sets three bits of a table. Never says no to a member."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(bits: int) -> list[str]:
        """SQL of the three bits of `fp`, of a table of `bits` bits, which is a power of two."""
        return [f"(shiftrightunsigned(fp, {shift}) & {bits - 1})" for shift in (0, 19, 37)]

    def has(self, fp: np.ndarray) -> np.ndarray:
        bits = np.uint64(64 * len(self.words) - 1)
        found = np.ones(len(fp), bool)
        for shift in (0, 19, 37):
            k = (fp >> np.uint64(shift)) & bits
            found &= ((self.words[k >> np.uint64(6)] >> (k & np.uint64(63))) & np.uint64(1)).astype(bool)
        return found


def _bit_table(frequent: DataFrame) -> BitTable:
    """The table of a level; made in Spark, and at most MOST_BITS bits reach the driver."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (16 * frequent.count()).bit_length()))
    rows = frequent.select(F.explode(F.array(*[F.expr(x) for x in BitTable.places(bits)])).alias("k"))
    held = rows.groupBy(F.expr("k div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 AS int))")).alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[held["word"].to_numpy()] = held["mask"].to_numpy()
    return BitTable(words.view(np.uint64))


_COUNTED = "lang string, fp long, n long, key long, second long"


def _counted(texts: DataFrame, size: int, least: int, shorter: BitTable | None, bits: int) -> DataFrame:
    """(lang, fp, n, key, low, high): the frequent fingerprints of one length. Of single words also a row for each language
    without a fingerprint: how many words it has."""
    sent = None if shorter is None else texts.sparkSession.sparkContext.broadcast(shorter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _BATCH):
            languages = part.column("lang").to_pylist()
            found = Phrases(text_bytes(part.column("text")), languages, bits)
            at = found.places(size)
            if sent is not None:
                there = np.zeros(len(found.hash) + 1, bool)
                whole = found.places(size - 1)
                there[whole] = sent.value.has(found.fingerprints(whole, size - 1))
                at = at[there[at] & there[at + 1]]
            fp, second = found.fingerprints(at, size), found.fingerprints(at, size, 1)
            order = np.lexsort((second, fp))
            fp, second = fp[order], second[order]
            first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (second[1:] != second[:-1])])) if len(fp) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([first, [len(fp)]]))
            doc = found.doc[at[order[first]]]
            key = part.column("key").to_numpy()[doc]
            names = np.array(languages, object)
            lang = names[doc] if size == 1 else np.full(len(first), None)
            rows = [pa.array(lang, pa.string()), pa.array(fp[first].view(np.int64)), pa.array(n), pa.array(key), pa.array(second[first].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(rows, ["lang", "fp", "n", "key", "second"])
            if size == 1:
                per_text = np.bincount(found.doc, minlength=len(languages))
                total = {x: int(per_text[names == x].sum()) for x in set(languages)}
                none = pa.nulls(len(total), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), none, pa.array(list(total.values()), pa.int64()), none, none], ["lang", "fp", "n", "key", "second"])

    rows = texts.mapInArrow(run, _COUNTED).groupBy("lang", "fp").agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min("second").alias("low"), F.max("second").alias("high"))
    return checkpointed(rows.where(F.col("fp").isNull() | (F.col("n") >= least)))


_FREQUENT = "lang string, size int, phrase string, n long"


def _followed(texts: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(lang, size, phrase, n) of fingerprints (fp, second, size, n, key), read from the texts that their pointers name."""
    pointed = checkpointed(wanted.groupBy("key").agg(F.collect_list(F.struct("size", "fp", "second", "n")).alias("grams")))
    held = texts
    if pointed.count() <= BLOCK:
        held = held.join(F.broadcast(pointed.select("key")), "key", "left_semi")
    # copies of a text are one; should two texts share a key, both are read
    held = held.groupBy("key", F.md5("text").alias("digest")).agg(F.first("lang").alias("lang"), F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1):  # a text at a time
            found = Phrases(text_bytes(part.column("text")), part.column("lang").to_pylist(), bits)
            out: list[tuple] = []
            for lang, grams in zip(part.column("lang").to_pylist(), part.column("grams").to_pylist(), strict=True):
                for size in {g["size"] for g in grams}:
                    at = found.places(size)
                    # of phrases with one fingerprint those that were not counted are told apart by the second hash
                    both = zip(found.fingerprints(at, size).view(np.int64).tolist(), found.fingerprints(at, size, 1).tolist(), strict=True)
                    place = dict(zip(both, at.tolist(), strict=True))
                    out += [(lang, size, found.text(k, size), g["n"]) for g in grams if g["size"] == size and (k := place.get((g["fp"], g["second"]))) is not None]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "size", "phrase", "n"])

    return held.join(pointed, "key").select("lang", "text", "grams").mapInArrow(run, _FREQUENT)


def _recounted(texts: DataFrame, doubtful: DataFrame, size: int, least: int, bits: int) -> DataFrame | None:
    """(lang, size, phrase, n) of the phrases with these fingerprints, counted by their text: in blocks against all texts."""
    out = None
    number = doubtful.count()
    for block in range(-(-number // BLOCK)):
        share = doubtful.where(F.pmod(F.xxhash64("fp"), F.lit(-(-number // BLOCK))) == block).select("fp").toArrow()["fp"].to_numpy()
        sent = texts.sparkSession.sparkContext.broadcast(np.sort(share.view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text", _BATCH):
                languages = part.column("lang").to_pylist()
                found = Phrases(text_bytes(part.column("text")), languages, bits)
                at = found.places(size)
                counts: dict[tuple[str, str], int] = {}
                for k in at[member(found.fingerprints(at, size), sent.value)].tolist():
                    name = languages[found.doc[k]], found.text(k, size)
                    counts[name] = counts.get(name, 0) + 1
                columns = [[x[0] for x in counts], [size] * len(counts), [x[1] for x in counts], list(counts.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "size", "phrase", "n"])

        rows = texts.mapInArrow(run, _FREQUENT).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        out = rows if out is None else out.unionByName(rows)
    return out


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30, text: str = "text", lang: str = "lang", bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all phrases of up to `longest` words that occur at least `least` times, and (lang, n): how
    many words each language has. Both are stored tables: jobs run while they are made. Fingerprints have `bits` bits."""
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text")).where("text <> ''")
    texts = texts.withColumn("key", F.xxhash64("lang", "text"))
    shorter, parts, levels, clear = None, [], [], F.col("low") == F.col("high")
    for size in range(1, longest + 1):
        level = _counted(texts, size, least, shorter, bits)
        levels.append(level)
        frequent = level.where("fp IS NOT NULL")
        parts.append(frequent.where(clear).select("fp", F.col("low").alias("second"), F.lit(size).alias("size"), "n", "key"))
        if size < longest:
            shorter = _bit_table(frequent)
    wanted = parts[0]
    for part in parts[1:]:
        wanted = wanted.unionByName(part)
    found = _followed(texts, wanted, bits)
    for size, level in enumerate(levels, 1):
        again = _recounted(texts, level.where(F.col("fp").isNotNull() & ~clear), size, least, bits)
        found = found if again is None else found.unionByName(again)
    found = checkpointed(found)
    words = checkpointed(levels[0].where("fp IS NULL AND n > 0").select("lang", "n"))
    discard(*levels)
    return found, words


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, most: int = 2000, covered: int = 80, text: str = "text", lang: str = "lang", bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the `most` best phrases of 2 to `longest` words of each language.

    a, l and r count the phrase and the two parts of its lowest-scoring cut (ties: the first), the score is 2,000,000 a /
    (l + r) rounded down. Phrases inside a longer one that occurs at least `covered` percent as often are left out."""
    found, words = frequent_phrases(docs, longest, least, text, lang, bits)
    whole = found.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    count = lambda c, n: found.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    cuts = whole.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size), ' ')").alias("tail"))
    cuts = cuts.join(count("head", "l"), ["lang", "head"]).join(count("tail", "r"), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 AS decimal(7, 0)) * cast(a AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) + cast(r AS decimal(19, 0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inner = whole.where("size > 2").select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR cast(longer AS decimal(19, 0)) * 100 < cast(a AS decimal(19, 0)) * {covered}"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language first, so that no task sorts a language
    shares = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_width(docs.sparkSession))))
    first = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= most).drop("share")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= most)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
