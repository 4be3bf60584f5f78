"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: a vector less the mean of all vectors is scaled to length 1 and rotated at random;
its code is the signs of the rotated parts, with two scalars: the length, and the inner
product of code and vector. Search: a rotated query is rounded to 256 levels, whose bits are
laid out in eight planes of one bit a part, so the code's inner product with it is counted
from packed bits: ones that code and plane share. Divided by the second scalar it estimates
the true one; the error is within `error_factor` times sqrt((1 - f^2) / f^2 / (D - 1)), but
with a small probability, and what rounding took, which is known. The likeliest `tries` times
k candidates are compared first; then all candidates whose lower bound of the distance is
not beyond the k-th exact distance found are reranked with the original vectors in double
precision, so ties at the border are all compared.

Work: rows are dealt into groups of at most about `group_rows`, queries into blocks of about
`block_queries`; each pair of group and block is a task of bounded memory that gives k rows
a query at most. This compares all rows with a stated query set; every row is indexed.
Vectors go along with their codes: with bounds wide enough to miss next to nothing, some
four tenths of all rows are reranked for a query of 64 dimensions, so fetching survivors by
id would move far more than a copy of each vector to each block of queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts, and
rows with a null id, take no part; vectors of other dimension than a query are no
candidates of it; rows with the query's id are its own; of rows that share an id the query
is the one with the smallest vector; repeated candidates are listed once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisway.llm.common import shuffle_width


def usable(vector: Column) -> Column:
    """No null or non-finite parts, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each dimension; as many numbers as the dimensions have parts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                x = _matrix(batch.filter(pa.array(dims == d)).column("vector"), int(d))
                total[int(d)] = total.get(int(d), np.zeros(d + 1)) + np.append(x.sum(0), len(x))
        rows = [(d, i, v) for d, t in total.items() for i, v in enumerate(t)]
        if rows:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["dim", "i", "v"])

    got = vectors.select("dim", "vector").mapInArrow(sums, "dim int, i int, v double").groupBy("dim", "i").agg(F.sum("v").alias("v")).collect()
    out = {d: np.zeros(d + 1) for d in {r["dim"] for r in got}}
    for r in got:
        out[r["dim"]][r["i"]] = r["v"]
    return {d: t[:-1] / t[-1] for d, t in out.items()}


def build_index(vectors: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """`vectors` (id, dim, vector) with code, length and fit: the packed signs and the two scalars."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = _matrix(part.column("vector"), int(d)) - centre[int(d)]
                length = np.sqrt((x * x).sum(1))
                turned = (x / np.where(length > 0, length, 1)[:, None]) @ rotation(int(d)).T
                code = np.packbits(turned > 0, axis=1)
                fit = np.abs(turned).sum(1) / math.sqrt(d)
                yield pa.record_batch([*part.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(fit)], names=[*part.schema.names, "code", "length", "fit"])

    return vectors.select("id", "dim", "vector").mapInArrow(encode, f"id long, dim int, vector {vectors.schema['vector'].dataType.simpleString()}, code binary, length double, fit double")


def exact_distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, parts added in turn."""
    return np.sqrt(np.add.accumulate((rows - query) ** 2, axis=1)[:, -1])


def bit_words(packed: np.ndarray) -> np.ndarray:
    """Rows of packed bits as 64-bit words: (word, row), filled up with zeros."""
    full = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    full[:, : packed.shape[1]] = packed
    return np.ascontiguousarray(full.view(np.uint64).T)


def bit_products(codes: np.ndarray, ones: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, float]:
    """Inner products of signs, as `bit_words` with the number of ones of each, and a query rounded to 256 levels; and
    how far rounding can move one."""
    low = query.min()
    step = (query.max() - low) / 255 or 1.0
    level = np.rint((query - low) / step).astype(np.uint8)
    planes = bit_words(np.packbits(level[None, :] >> np.arange(8, dtype=np.uint8)[:, None] & 1, axis=1))
    shared = np.zeros(codes.shape[1], np.int64)
    for plane in range(8):
        for word in range(len(codes)):
            shared += np.bitwise_count(codes[word] & planes[word, plane]).astype(np.int64) << plane
    return low * (2 * ones - len(query)) + step * (2 * shared - level.sum(dtype=np.int64)), float(np.abs(query - low - step * level).sum())


def _search(ids, x, code, length, fit, query_ids, q, centre, k: int, error_factor: float, tries: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, distances) of the k nearest among these rows, ties to smaller ids."""
    dim = x.shape[1]
    codes = bit_words(code)
    ones = np.bitwise_count(codes).sum(0, dtype=np.int64)
    safe = np.where(fit > 0, fit, 1)
    error = error_factor * np.sqrt(np.maximum(1 - safe**2, 0) / safe**2 / max(dim - 1, 1)) + 1e-5
    turn = rotation(dim).T
    for at in range(0, len(query_ids), 64):
        moved = q[at : at + 64] - centre
        lengths = np.sqrt((moved * moved).sum(1))
        turned = (moved / np.where(lengths > 0, lengths, 1)[:, None]) @ turn
        for j in range(len(moved)):
            product, rounded = bit_products(codes, ones, turned[j])
            inner, wide = product / safe / math.sqrt(dim), error + rounded / safe / math.sqrt(dim)
            own = ids == query_ids[at + j]
            base, scale = length**2 + lengths[j] ** 2, 2 * length * lengths[j]
            guess = np.where(own, np.inf, base - scale * inner)
            n = min(k, int((~own).sum()))
            if not n:
                continue
            most = min(n * tries, int((~own).sum()))
            first = np.argpartition(guess, most - 1)[:most]
            worst = np.partition(exact_distances(x[first], q[at + j]), n - 1)[n - 1]
            near = np.flatnonzero(~own & (base - scale * (inner + wide) <= worst**2 * (1 + 1e-9)))
            near = np.union1d(near, first)
            d = exact_distances(x[near], q[at + j])
            order = np.lexsort((ids[near], d))[:n]
            yield query_ids[at + j], ids[near][order], d[order]


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, group_rows: int = 65_536, block_queries: int = 16_384, error_factor: float = 4.0, tries: int = 32) -> DataFrame:
    """(query_id, rank, id, score): the k nearest of each row for which `queries` holds, by Euclidean distance."""
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), F.col(vector_col).alias("vector"), queries.alias("asks"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    # groups for every task slot where that leaves them some thousand rows
    groups = max(1, math.ceil(n / group_rows), min(shuffle_width(vectors.sparkSession), n // 2048))
    blocks = max(1, math.ceil(asked / block_queries))
    centre = means(rows) if n else {}
    index = build_index(rows, centre).withColumn("row_group", F.pmod(F.xxhash64("id", "vector"), F.lit(groups)).cast("int"))
    asking = rows.where("asks").groupBy("id", "dim").agg(F.min("vector").alias("vector")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    candidates = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    posed = asking.withColumn("row_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cell = ["dim", "row_group", "block"]

    def search(mine: pa.Table, questions: pa.Table) -> pa.Table:
        if not len(mine) or not len(questions):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "id", "score"])
        dim = mine["dim"][0].as_py()
        code = np.frombuffer(b"".join(mine["code"].to_pylist()), np.uint8).reshape(len(mine), -1)
        found = list(_search(mine["id"].to_numpy(), _matrix(mine["vector"], dim), code, mine["length"].to_numpy(), mine["fit"].to_numpy(), questions["id"].to_numpy(), _matrix(questions["vector"], dim), centre[dim], k, error_factor, tries))
        who = np.concatenate([np.full(len(i), q) for q, i, _ in found]) if found else np.zeros(0, np.int64)
        return pa.table([pa.array(who, pa.int64()), pa.array(np.concatenate([i for _, i, _ in found]) if found else [], pa.int64()), pa.array(np.concatenate([d for _, _, d in found]) if found else [], pa.float64())], names=["query_id", "id", "score"])

    found = candidates.groupBy(*cell).cogroup(posed.groupBy(*cell)).applyInArrow(search, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
