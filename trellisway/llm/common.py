"""Helpers shared by the training-data operators: checkpoints, batches, word hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisway.functions.materialize import discard, shared_folder
from trellisway.functions.materialize import stored as checkpointed

__all__ = ["checkpointed", "discard", "shared_folder"]

#: Words of the operators' contracts: runs of bytes other than space and \t \n \v \f \r.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def no_clash(df: DataFrame, added: list[str]) -> None:
    """Raises if columns to be added are there already, in any case."""
    if clash := {x.lower() for x in added} & {x.lower() for x in df.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already; rename them or choose another prefix")


def shuffle_width(spark: SparkSession) -> int:
    """The number of partitions the session deals a shuffle of this input into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def batch_of(*keys: Column, batches: int) -> Column:
    """A batch number for each row; depends on the row's values alone, so a repeated read deals alike."""
    return F.pmod(F.xxhash64(*keys), F.lit(batches)).cast("int")


# ---------------------------------------------------------------- hashes of words, in numpy

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _random_odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 1 << 62)) * 2 + 1


_BYTE_CODES = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_BASE = _random_odd(11)
WORD_BASES = (_random_odd(12), _random_odd(13))  # two hashes of a window that don't depend on one another


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(step)
        done += m
        step = step * step % (1 << 64)
    return out


_POWERS: dict[int, np.ndarray] = {}


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = _powers(base, 1 << max(16, (n - 1).bit_length()))
    return _POWERS[base][:n]


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finisher on 64 bits; other salts give other hashes."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spellings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word data[start:end]: polynomials of coded bytes, by prefix sums over pieces of bounded length."""
    out = np.empty(len(start), np.uint64)
    step, i = 1 << 20, 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + step, side="right")))
        lo, hi = start[i], end[j - 1]
        n = int(hi - lo)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data[lo:hi]] * powers(_BYTE_BASE, n), out=sums[1:])
        out[i:j] = (sums[end[i:j] - lo] - sums[start[i:j] - lo]) * powers(inverse(_BYTE_BASE), n + 1)[start[i:j] - lo]
        i = j
    return mix64(out + (end - start).astype(np.uint64) * _PRIME)


class Words:
    """The words of a run of texts: `doc` is each word's text, `start` and `end` its bytes, `hash` 64 bits of its spelling."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        parts = [t or b"" for t in texts]
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        if lower:
            data = _LOWER[data]
        self.data = data
        lengths = np.fromiter((len(t) for t in parts), np.int64, len(parts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] if len(parts) else np.zeros(0, np.int64)
        edge = np.diff(np.concatenate([[True], _SPACE[data]]).astype(np.int8))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(parts) + 1))  # each text's first word, and one end more
        self.hash = spellings(data, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of `size` words inside one text; `which` of two hashes."""
        base = WORD_BASES[which]
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * powers(base, n), out=sums[1:])
        at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])
        return at, mix64((sums[at + size] - sums[at]) * powers(inverse(base), n)[at])


def text_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string or binary column."""
    return column.cast("binary").to_pylist()


def dealt(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket numbers, bounds): values dealt to buckets by their upper half, ascending inside a bucket."""
    bucket = (values >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((values, bucket))
    bucket = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return order, bucket[at].astype(np.int64), np.concatenate([at, [len(bucket)]])


def unique_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    s = np.sort(values)
    if not len(s):
        return s, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.diff(np.concatenate([at, [len(s)]]))


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values lie in the ascending array `among`."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def release_memory() -> None:
    """Give back what freed arrays still hold: workers live on beside the JVM and other workers of their executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc; other allocators do it by themselves
        trim(0)


def slices(batches, column: str | int, most_bytes: int = 1 << 22):
    """Record batches cut so that `column`, of strings or bytes, has about `most_bytes` in each; no memory follows a batch's size."""
    import pyarrow.compute as pc

    for batch in batches:
        if not len(batch):
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right")))
            yield batch.slice(at, end - at)
            at = end
        release_memory()
