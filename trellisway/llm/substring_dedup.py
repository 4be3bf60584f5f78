"""Substring dedup by fixed-block anchors.

A repeated run of `window` words holds, in each of its places, one whole block of
`block = (window + 1) // 2` words of that text's own fixed grid. So the work goes in
three rounds over batches of texts (a batch is a hash of the row, dealt once and reused):

1. anchors: every grid block is indexed and every rolling window of `block` words probes
   the index. Both meet in hash buckets; a batch sends each distinct hash once, so a run
   that half of the corpus shares costs one entry a batch.
2. extension: only the windows around hit blocks can repeat. Their full-length hashes
   meet in buckets in the same way; those seen once are sent back.
3. the other windows are repeats; runs of them are the maximal exact repeats, cut from
   the text.

Bounds: a group is one batch of texts or one bucket of distinct hashes; both shrink as
`spark.sql.shuffle.partitions` grows. A single text is never split. Batches send a message to
each bucket, so messages number what a shuffle of that width has blocks.

Defined results: a null text has no words and keeps its null; a null or repeated id is
only carried along; two rows that are equal in id and text are two texts, so each repeats
the other; an empty table gives an empty result; added columns are named by `prefix` and
a clash raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellisway.llm.common import Words, batch_of, dealt, member, no_clash, release_memory, shuffle_width, text_bytes, unique_counts

_MESSAGE = "bucket int, batch int, hashes binary, more binary, grid binary"
_NOTE = "batch int, kind int, bucket int, hashes binary"
_NOTE_ARROW = pa.schema([("batch", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary())])
_MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary()), ("grid", pa.binary())])
_HITS, _SINGLES = 0, 1


def _short(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _grid(words: Words, at: np.ndarray, block: int) -> np.ndarray:
    """Which windows lie on their text's own grid."""
    return (at - words.first[words.doc[at]]) % block == 0 if len(at) else np.zeros(0, bool)


def _send(batch: int, values: np.ndarray, grid: np.ndarray, buckets: int) -> pa.Table:
    """A message for each bucket: distinct hashes, whether more than once here, whether on the grid."""
    distinct, times = unique_counts(values)
    on_grid = member(distinct, np.sort(values[grid]))
    order, bucket, bounds = dealt(distinct, buckets)
    distinct, times, on_grid = distinct[order], times[order], on_grid[order]
    small = _short(distinct)
    cut = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] if len(distinct) else []
    return pa.table(
        [
            pa.array(bucket.astype(np.int32)),
            pa.array(np.full(len(cut), batch, np.int32)),
            pa.array([small[s].tobytes() for s in cut], pa.binary()),
            pa.array([np.packbits(times[s] > 1).tobytes() for s in cut], pa.binary()),
            pa.array([np.packbits(on_grid[s]).tobytes() for s in cut], pa.binary()),
        ],
        schema=_MESSAGE_ARROW,
    )


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _meet(wide: bool):
    """In a bucket: which hashes occur twice or more over all batches; each batch hears of its own."""
    kind = np.uint64 if wide else np.uint32

    def meet(table: pa.Table) -> pa.Table:
        release_memory()
        sent = [np.frombuffer(x, kind) for x in table["hashes"].to_pylist()]
        more = [_bits(x, len(s)) for x, s in zip(table["more"].to_pylist(), sent, strict=True)]
        distinct, times = unique_counts(np.concatenate(sent))
        twice = np.zeros(len(distinct), bool)
        twice[times > 1] = True
        twice[np.searchsorted(distinct, np.concatenate([s[m] for s, m in zip(sent, more, strict=True)]))] = True
        repeated = distinct[twice]
        out, bucket = [], table["bucket"][0].as_py()
        for batch, s, grid in zip(table["batch"].to_pylist(), sent, table["grid"].to_pylist(), strict=True):
            said = s[~member(s, repeated)] if wide else s[(g := _bits(grid, len(s)))][member(s[g], repeated)]
            if len(said):
                out.append((batch, _SINGLES if wide else _HITS, bucket, said.tobytes()))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 4, _NOTE_ARROW, strict=True)], schema=_NOTE_ARROW)

    return meet


def _hit_blocks(words: Words, block: int, notes: pa.Table, buckets: int) -> np.ndarray:
    """First words of the grid blocks that the notes name."""
    at, hashes = words.windows(block)
    grid = _grid(words, at, block)
    at, hashes = at[grid], hashes[grid]
    named = [
        (np.uint64(bucket) << np.uint64(32)) | np.frombuffer(said, np.uint32).astype(np.uint64)
        for kind, bucket, said in zip(notes["kind"].to_pylist(), notes["bucket"].to_pylist(), notes["hashes"].to_pylist(), strict=True)
        if kind == _HITS
    ]
    if not named:
        return at[:0]
    key = ((hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    return at[member(key, np.sort(np.concatenate(named)))]


def _candidates(words: Words, hits: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, second hash) of the windows that hold a hit block whole."""
    at, hashes = words.windows(window)
    n = len(words.hash)
    near = np.zeros(n + 1, np.int64)
    np.add.at(near, np.maximum(hits - (window - block), 0), 1)
    np.add.at(near, hits + 1, -1)
    take = np.cumsum(near)[at] > 0
    return at[take], hashes[take], words.windows(window, 1)[1][take]


def _covered(words: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that begins at one of `starts`."""
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _kept_bytes(words: Words, doc: int, gone: np.ndarray, joined: bool) -> bytes:
    """A text without its covered words: the others joined by a space, or the bytes around them as they were."""
    lo, hi = words.first[doc], words.first[doc + 1]
    base, stop = words.text_start[doc], words.text_start[doc + 1] - 1 if doc + 1 < len(words.text_start) else len(words.data) - 1
    if joined:
        if not gone[lo:hi].any():
            return b" ".join(words.data[base:stop].tobytes().split())
        data = words.data
        return b" ".join(data[words.start[w] : words.end[w]].tobytes() for w in range(lo, hi) if not gone[w])
    edges = np.diff(np.concatenate([[False], gone[lo:hi], [False]]).astype(np.int8))
    out, at = [], base
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        out.append(words.data[at : words.start[lo + a]].tobytes())
        at = words.start[lo + b] if lo + b < hi else stop
    out.append(words.data[at:stop].tobytes())
    return b"".join(out)


def repeated_spans(words: Words, notes: pa.Table, window: int, block: int, buckets: int) -> np.ndarray:
    """The words that some repeated window covers."""
    hits = _hit_blocks(words, block, notes, buckets)
    at, hashes, _ = _candidates(words, hits, window, block)
    singles = [np.frombuffer(s, np.uint64) for k, s in zip(notes["kind"].to_pylist(), notes["hashes"].to_pylist(), strict=True) if k == _SINGLES]
    if singles:
        at = at[~member(hashes, np.sort(np.concatenate(singles)))]
    return _covered(words, at, window)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, prefix: str = "dedup_", new_text: bool = False) -> DataFrame:
    """Rows of `docs` with {prefix}n_words, {prefix}n_removed, {prefix}kept_sha256 and {prefix}spans.

    spans: the maximal repeats, as [first word, past the last word) of the text. With
    `new_text`, {prefix}text is the text without them: a text that loses nothing stays
    byte for byte, in others the bytes between kept words stay.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    added = [f"{prefix}{x}" for x in ("n_words", "n_removed", "kept_sha256", "spans", *["text"] * new_text)]
    no_clash(docs, added)
    block = (window + 1) // 2
    width = shuffle_width(docs.sparkSession)
    batches, buckets = 4 * width, max(1, width // 2)  # their product is the number of messages
    others = [f for f in docs.schema if f.name != text_col]  # the text goes along once, the other columns beside it
    rows = docs.select(batch_of(F.col(id_col), F.col(text_col), batches=batches).alias("batch"), F.col(text_col).alias("body"), F.struct(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(others)]).alias("others"))

    def anchors(table: pa.Table) -> pa.Table:
        release_memory()
        words = Words(text_bytes(table["body"]))
        at, hashes = words.windows(block)
        return _send(table["batch"][0].as_py(), hashes, _grid(words, at, block), buckets)

    def extensions(mine: pa.Table, notes: pa.Table) -> pa.Table:
        release_memory()
        if not len(notes) or not len(mine):
            return _MESSAGE_ARROW.empty_table()
        words = Words(text_bytes(mine["body"]))
        _, hashes, others = _candidates(words, _hit_blocks(words, block, notes, buckets), window, block)
        return _send_wide(mine["batch"][0].as_py(), hashes, others, buckets)

    names, beside = docs.columns, [f.name for f in others]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.ArrayType(T.ArrayType(T.LongType())), T.StringType()]
    out_schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema], *[T.StructField(n, k) for n, k in zip(added, kinds, strict=False)]])

    def cut(mine: pa.Table, notes: pa.Table) -> pa.Table:
        release_memory()
        bodies = text_bytes(mine["body"]) if len(mine) else []
        words = Words(bodies)
        gone = repeated_spans(words, notes, window, block, buckets)
        total = np.concatenate([[0], np.cumsum(gone)])
        lo, hi = words.first[:-1], words.first[1:]
        removed = total[hi] - total[lo]
        shas, texts, spans = [], [], []
        for d, body in enumerate(bodies):
            shas.append(hashlib.sha256(_kept_bytes(words, d, gone, True)).hexdigest())
            edges = np.diff(np.concatenate([[False], gone[lo[d] : hi[d]], [False]]).astype(np.int8)) if removed[d] else np.zeros(0, np.int8)
            spans.append(np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], 1).tolist())
            if new_text:
                texts.append(body if not removed[d] else _kept_bytes(words, d, gone, False))
        more = [pa.array(words.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
        if new_text:
            more.append(pa.array(texts, pa.binary()).cast(pa.string()))
        column = dict(zip(beside, fields(mine["others"]), strict=True)) | {text_col: mine["body"]}
        return pa.table([*[column[n] for n in names], *more], names=[*names, *added])

    first = rows.groupBy("batch").applyInArrow(anchors, _MESSAGE)
    hits = first.groupBy("bucket").applyInArrow(_meet(False), _NOTE)
    second = rows.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(extensions, _MESSAGE)
    singles = second.groupBy("bucket").applyInArrow(_meet(True), _NOTE)
    notes = hits.unionByName(singles)
    return rows.groupBy("batch").cogroup(notes.groupBy("batch")).applyInArrow(cut, out_schema)


def _send_wide(batch: int, hashes: np.ndarray, others: np.ndarray, buckets: int) -> pa.Table:
    """As _send, comparing all 64 bits; the second hash chooses the bucket and so adds its bits to the comparison."""
    bucket = (others % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((hashes, bucket))
    hashes, bucket = hashes[order], bucket[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (bucket[1:] != bucket[:-1])])[: len(hashes)]
    at = np.flatnonzero(new)
    distinct, bucket, times = hashes[at], bucket[at], np.diff(np.concatenate([at, [len(hashes)]]))
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[: len(bucket)]
    pieces = [slice(a, b) for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True)] if len(bucket) else []
    return pa.table(
        [
            pa.array(bucket[cut[: len(pieces)]], pa.int32()),
            pa.array(np.full(len(pieces), batch, np.int32)),
            pa.array([distinct[s].tobytes() for s in pieces], pa.binary()),
            pa.array([np.packbits(times[s] > 1).tobytes() for s in pieces], pa.binary()),
            pa.array([b""] * len(pieces), pa.binary()),
        ],
        schema=_MESSAGE_ARROW,
    )


def fields(column: pa.ChunkedArray) -> list[pa.Array]:
    """The columns of a struct column."""
    return (pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)).flatten()
