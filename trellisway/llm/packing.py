"""Packing token sequences by dominance reduction and best fit.

Documents are tokenized where they are read and cut into pieces of at most `capacity`
tokens. All that a packing depends on is how many pieces there are of each length: at most
`capacity` numbers, which the driver gets. On them

1. the Martello-Toth reduction fixes bins for good: a piece with the set of others that
   dominates every other set it could share a bin with (alone, when nothing fits; a pair
   that fills the bin; the largest partner, when no second or no better pair fits), and
   shrinks the instance until nothing more can be fixed;
2. the rest is packed best fit, longest first, for all pieces of a length at once.

The plan says which ranks of a length go to which sequences and offsets; it has at most
some rows for each length, whatever the number of documents. Ranks inside a length are
numbered in `splits` parts, so no length is gathered in one task.

Defined results: a null text is an empty one and has the end id alone; repeated rows are
packed once each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellisway.llm.common import checkpointed, member, shuffle_width, slices, spellings

#: Texts with these are encoded whole: combining marks may join over a change of case, and "<|" may begin a special token.
_WHOLE = r"<\||[\x{0300}-\x{036F}]"
#: Words that a worker process keeps the ids of, from task to task; beyond it the table starts anew.
_MOST_CACHED = 1_500_000


class Encoder:
    """Ids as `Tokenizer.encode(text, add_special_tokens=False)` gives them, with every distinct word encoded once.

    For tokenizers that drop white space, lower-case, and split so that nothing crosses a
    space; then a text's ids are those of its words in turn."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        """Known words, by the hash of their spelling: where their ids are, and how many."""
        self.keys, self.starts, self.lengths, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        blocks, lengths = [], []
        for at in range(0, len(words), 5000):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(words[at : at + 5000], add_special_tokens=False)]
            lengths += map(len, found)
            blocks.append(np.fromiter((i for x in found for i in x), np.uint32))
        count = np.array(lengths, np.int32)
        starts = np.cumsum(count, dtype=np.int64) - count + len(self.ids)
        self.ids = np.concatenate([self.ids, *blocks])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.starts, self.lengths = np.insert(self.keys, at, keys[order]), np.insert(self.starts, at, starts[order]), np.insert(self.lengths, at, count[order])

    def _find(self, distinct: pa.Array) -> np.ndarray:
        """Places of the distinct words among the known ones, after learning the new."""
        distinct = distinct.cast(pa.large_binary())
        bounds = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8) if distinct.buffers()[2] else np.zeros(0, np.uint8)
        keys = spellings(data, bounds[:-1], bounds[1:])
        if len(self.keys) + len(keys) > _MOST_CACHED:
            self._clear()
        new = np.flatnonzero(~member(keys, self.keys))
        if len(new):
            self._learn(keys[new], [x.decode() for x in distinct.take(pa.array(new)).to_pylist()])
        return np.searchsorted(self.keys, keys)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pa.array([x or "" for x in texts.to_pylist()], pa.large_string())  # not a slice: some string kernels misread their offsets
        whole = np.flatnonzero(pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False))
        # a comma or full stop after a letter is a token of its own either way; apart, there are fewer distinct words
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z0-9à-öø-ÿ])([.,;:!?])(\s|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(plain)
        words = split.flatten().dictionary_encode()
        at = self._find(words.dictionary)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        lengths = self.lengths[at].astype(np.int64)
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in whole:
            out[k] = np.array(self.tokenizer.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut into pieces of `capacity`."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kinds = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]]
    schema = T.StructType([*kinds, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in slices(batches, 1, 1 << 21):
            rows = []
            for k, ids in enumerate(encoder.encode(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for n, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((k, n, at, len(part), zlib.crc32(part.tobytes()), *[part.tolist()] * with_ids))
            columns = list(zip(*rows, strict=True))
            arrays = [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *[pa.array(x, pa.int64()) for x in columns[2:5]]]
            yield pa.record_batch([*arrays, *[pa.array(x, pa.list_(pa.int32())) for x in columns[5:]]], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(cut, schema)


# ---------------------------------------------------------------- the plan: on counts of lengths only


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins that some best packing has, as (lengths, how many), and the counts that are left."""
    left = {k: n for k, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(bin_: tuple[int, ...], n: int) -> None:
        fixed.append((bin_, n))
        for k in bin_:
            left[k] -= n
            if not left[k]:
                del left[k]

    changed = True
    while changed:
        changed = False
        for a in sorted(left, reverse=True):
            if a not in left:
                continue
            room = capacity - a
            if room == a:  # pairs of halves; one may stay
                if left[a] > 1:
                    fix((a, a), left[a] // 2)  # type: ignore[arg-type]
                    changed = True
                continue
            if room in left:
                fix((a, room), min(left[a], left[room]))
                changed = True
                if a not in left:
                    continue
            lengths = sorted(left)
            rest = left | {a: left[a] - 1}  # the others
            fit = [k for k in lengths[: bisect_right(lengths, room)] if rest[k] > 0]
            if not fit:
                fix((a,), left[a])
                changed = True
                continue
            b = fit[-1]
            two, three = _smallest(fit, rest, 2), _smallest(fit, rest, 3)
            one_more = two is None or two > room
            if one_more or ((three is None or three > room) and _best_pair(fit, rest, room) <= b):
                # a with its largest partner dominates; true as long as both last and the others only shrink
                n = left[a] // 2 if a == b else min(left[a], left[b])
                if n:
                    fix((a, b), n)
                    changed = True
    return fixed, left


def _smallest(fit: list[int], rest: dict[int, int], n: int) -> int | None:
    """The sum of the n smallest others, if there are as many."""
    total = 0
    for k in fit:
        take = min(n, rest[k])
        total, n = total + k * take, n - take
        if not n:
            return total
    return None


def _best_pair(fit: list[int], rest: dict[int, int], room: int) -> int:
    """The largest sum of two others within `room`, 0 if there is none."""
    best, j = 0, len(fit) - 1
    for i, k in enumerate(fit):
        while j >= 0 and fit[j] + k > room:
            j -= 1
        m = j
        if m >= 0 and fit[m] == k and rest[k] < 2:
            m -= 1
        if m >= i or (m >= 0 and m != i):
            best = max(best, k + fit[m])
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first; bins with equal content are kept as one entry with a number."""
    by_room: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, how many]
    rooms: list[int] = []

    def put(room: int, bin_: tuple[int, ...], n: int) -> None:
        if n:
            if room not in by_room:
                rooms.insert(bisect_left(rooms, room), room)
            by_room[room].append([bin_, n])

    for k in sorted(counts, reverse=True):
        n = counts[k]
        while n:
            at = bisect_left(rooms, k)
            if at == len(rooms):
                each = capacity // k
                put(capacity - each * k, (k,) * each, n // each)
                put(capacity - (n % each) * k, (k,) * (n % each), 1 if n % each else 0)
                break
            room = rooms[at]
            bin_, there = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            each = room // k
            full = min(there, n // each)
            put(room - each * k, bin_ + (k,) * each, full)
            n -= full * each
            there -= full
            if there and n:  # fewer than `each` are left
                put(room - n * k, bin_ + (k,) * n, 1)
                there, n = there - 1, 0
            put(room, bin_, there)
    return [(tuple(b), n) for bins in by_room.values() for b, n in bins]


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, sequence of the first, offset) for every place in the bins."""
    fixed, left = reduce_instance(dict(counts), capacity)
    out, base, used = [], 0, defaultdict(int)
    for bin_, n in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for k in bin_:
            out.append((k, used[k], used[k] + n, base, offset))
            used[k] += n
            offset += k
        base += n
    return out


def packed(pieces: DataFrame, capacity: int = 2048, splits: int | None = None) -> DataFrame:
    """`pieces` (id, piece, length, ...) with sequence_id and offset."""
    spark = pieces.sparkSession
    splits = splits or 2 * shuffle_width(spark)
    rows = checkpointed(pieces).withColumn("_split", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(splits)).cast("int"))
    counted = rows.groupBy(F.col("length").alias("_length_at"), F.col("_split").alias("_split_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_length_at").orderBy("_split_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = packing_plan(counts, capacity)
    number = Counter(k for k, *_ in plan)
    # ranks of a length in ranges as wide as its plan's rows are on average, so that a rank meets some two rows of its range
    width = {k: max(1, counts[k] // n) for k, n in number.items()}
    in_ranges = [(k, b, lo, hi, base, offset) for k, lo, hi, base, offset in plan for b in range(lo // width[k], (hi - 1) // width[k] + 1)]
    places = spark.createDataFrame(in_ranges, "_k long, _range long, _lo long, _hi long, _base long, _offset long")
    widths = spark.createDataFrame(list(width.items()), "_of long, _width long")
    ranked = (
        rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_split").orderBy("id", "piece", "ids_crc32")))
        .join(offsets, (F.col("length") == F.col("_length_at")) & (F.col("_split") == F.col("_split_at")))
        .withColumn("_rank", F.col("_before") + F.col("_rank") - F.lit(1))
        .join(F.broadcast(widths), F.col("length") == F.col("_of"))
    )
    here = (F.col("length") == F.col("_k")) & (F.expr("_rank div _width") == F.col("_range"))
    placed = ranked.join(F.broadcast(places), here & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return placed.withColumns({"sequence_id": F.col("_base") + F.col("_rank") - F.col("_lo"), "offset": F.col("_offset")}).select(*pieces.columns, "sequence_id", "offset")
