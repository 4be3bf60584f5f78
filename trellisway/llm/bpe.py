"""Byte-level byte-pair encoding and decoding of whole texts.

A word's adjacent pairs are the leaves of a segment tree of minima: a leaf holds (rank, place) of its pair's merge, so the
root is the leftmost pair of the lowest rank. A merge changes three leaves, each in logarithmic time: its own, that of
the pair before, and that of the part which went. The word is done when no leaf holds a merge.

Merges never cross the words of the pattern, so a worker merges each distinct word once while a table of bounded size
remembers it, the trees of many words side by side; a word of any length costs n log n. Texts are read as a stream of words and nothing is shuffled.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded each; extra
columns are carried along, and a clash with an added name raises; ids outside the vocabulary decode to nothing, and bytes
that are no UTF-8 to the replacement sign.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import batched
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trellisway.llm.common import no_clash, slices

#: Fixed value: the words of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = 1 << 62
_PLACE = (1 << 32) - 1

#: How many distinct words a worker remembers before it forgets those of earlier texts.
REMEMBERED = 3 << 17
#: Words of more bytes are merged by themselves: trees of one width stand side by side.
_ONE_BY_ONE = 256
#: Bytes of texts of which the words are held together.
_BATCH = 1 << 21
#: Characters or words that are looked at in one go.
_LONG = 1 << 20


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    signs = {chr(b): b for b in plain}
    signs.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in signs)})
    return signs


class MergeTree:
    """The merges of a vocabulary: pairs of ids by rank. A call gives the ids that a word's ids merge to."""

    def __init__(self, merges: Iterable[tuple[int, int, int]]):
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self._sorted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for left, right, whole in merges:
            self.rank.setdefault(left << 32 | right, len(self.made))
            self.made.append(whole)

    def __call__(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        rank, made = self.rank.get, self.made
        size = 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            r = rank(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = r << 32 | i
        for k in range(size - 1, 0, -1):
            x, y = tree[2 * k], tree[2 * k + 1]
            tree[k] = x if x < y else y
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(place: int, value: int) -> None:
            k = size + place
            tree[k] = value
            k >>= 1
            while k:
                x, y = tree[2 * k], tree[2 * k + 1]
                low = x if x < y else y
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        while (top := tree[1]) != _NONE:
            i = top & _PLACE
            j = after[i]
            k = after[j]
            ids[i], ids[j] = made[top >> 32], -1
            after[i] = k
            if k < n:
                before[k] = i
                r = rank(ids[i] << 32 | ids[k])
                put(i, _NONE if r is None else r << 32 | i)
            else:
                put(i, _NONE)
            if j < n - 1:
                put(j, _NONE)
            if (p := before[i]) >= 0:
                r = rank(ids[p] << 32 | ids[i])
                put(p, _NONE if r is None else r << 32 | p)
        return [x for x in ids if x >= 0]


    def forest(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """As a call for each word, with the trees of many words of about one length side by side; each round is a merge in
        every tree that has one left. `ids` holds the words one after another; gives ids of 32 bits."""
        out: list[bytes] = [b""] * len(lengths)
        start = np.cumsum(lengths) - lengths
        shift = np.ceil(np.log2(np.maximum(1, lengths - 1))).astype(np.int64)
        for k in np.unique(shift).tolist():
            for at in np.array_split(found := np.flatnonzero(shift == k), max(1, (len(found) << k) >> 20)):
                merged, counts = self._grown(ids, start[at], lengths[at], 1 << k)
                data, ends = merged.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                for i, begin, end in zip(at.tolist(), [0, *ends], ends, strict=False):
                    out[i] = data[begin:end]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, below 0 where the vocabulary has none."""
        if self._sorted is None:
            pairs = np.fromiter(self.rank, np.int64, len(self.rank))
            order = np.argsort(pairs)
            self._sorted = pairs[order], np.fromiter(self.rank.values(), np.int64, len(self.rank))[order], np.array(self.made, np.int64)
        pairs, ranks, _ = self._sorted
        if not len(pairs):
            return np.full(len(left), -1, np.int64)
        code = (left << 32) | right
        found = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
        return np.where(pairs[found] == code, ranks[found], -1)

    def _grown(self, flat: np.ndarray, start: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        width, at = size + 1, start
        places = np.arange(width)
        inside = places < n[:, None]
        ids = np.where(inside, flat[np.minimum(start[:, None] + places, len(flat) - 1)], -1)
        ids = ids.ravel()
        tree = np.full((len(at), 2 * size), _NONE, np.int64)
        rows, places = np.nonzero(inside[:, 1:])
        r = self._ranks(ids[rows * width + places], ids[rows * width + places + 1])
        tree[rows, size + places] = np.where(r < 0, _NONE, (r << 32) | places)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        tree = tree.ravel()
        after = np.tile(np.arange(1, width + 1), len(at))
        before = np.tile(np.arange(-1, size), len(at))
        made = self._sorted[2]
        live = np.arange(len(at))

        def value(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            r = self._ranks(ids[row * width + i], ids[row * width + j])
            return np.where(r < 0, _NONE, (r << 32) | i)

        def put(row: np.ndarray, place: np.ndarray, now) -> None:
            base, node = row * (2 * size), size + place
            tree[base + node] = now
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])

        while len(live := live[tree[live * (2 * size) + 1] != _NONE]):
            top = tree[live * (2 * size) + 1]
            i = top & _PLACE
            base = live * width
            j = after[base + i]
            k = after[base + j]
            ids[base + i], ids[base + j] = made[top >> 32], -1
            after[base + i] = k
            more = k < n[live]
            before[(base + k)[more]] = i[more]
            now = np.full(len(live), _NONE)
            now[more] = value(live[more], i[more], k[more])
            put(live, i, now)
            inner = j < size
            put(live[inner], j[inner], _NONE)
            p = before[base + i]
            first = p >= 0
            put(live[first], p[first], value(live[first], p[first], i[first]))
        kept = ids.reshape(len(at), width) >= 0
        return ids.reshape(len(at), width)[kept], kept.sum(1)


class WordWise:
    """Encodes texts word by word and remembers words. A vocabulary says what the words are and what they merge to."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in lists of bounded length."""
        raise NotImplementedError

    def learn(self, words: set[str]) -> None:
        """Add the ids of these words to `known`, as little-endian unsigned 32-bit numbers."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; the words of about a slice are held at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for words in self.words(text):
                held.append((i, words))
                size += len(words)
                if size >= _LONG:
                    self._join(held, out)
                    held, size = [], 0
        self._join(held, out)
        return [b"".join(parts) for parts in out]

    def _join(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        every = set().union(*(words for _, words in held))
        new = every - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:  # too many: forget those of earlier texts
            self.known.clear()
            new = every
        if new:
            self.learn(new)
        known = self.known.__getitem__
        for i, words in held:
            out[i].append(b"".join(map(known, words)))


def found_words(pattern: Any, text: str, at: int, end: int) -> Iterator[list[str]]:
    if end - at < _LONG:
        yield pattern.findall(text, at, end)
    else:
        yield from map(list, batched((x.group() for x in pattern.finditer(text, at, end)), _LONG // 8))


class ByteBpe(WordWise):
    """A byte-level vocabulary of a JSON file. `special`: whether the strings of special tokens in a text are these tokens."""

    def __init__(self, path: str, special: bool = True):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        ids, signs = held["model"]["vocab"], byte_signs()
        self.bytes = [b""] * (1 + max([*ids.values(), *(x["id"] for x in held["added_tokens"])]))
        for piece, k in ids.items():
            self.bytes[k] = bytes(signs[c] for c in piece)
        for added in held["added_tokens"]:
            self.bytes[added["id"]] = added["content"].encode()
        pairs = (x if isinstance(x, list) else x.split(" ") for x in held["model"]["merges"])
        self.merge = MergeTree((ids[a], ids[b], ids[a + b]) for a, b in pairs)
        self.of_byte = [ids[c] for c, _ in sorted(signs.items(), key=lambda x: x[1])]
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]} if special else {}
        self.pattern = regex.compile(WORDS)
        #: Leftmost first, and of those at one place the longest.
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def words(self, text: str) -> Iterator[list[str]]:
        """Special tokens are words of their own."""
        at = 0
        for m in [*self.apart.finditer(text), None] if self.apart is not None else [None]:
            yield from found_words(self.pattern, text, at, len(text) if m is None else m.start())
            if m is not None:
                yield [m.group()]
                at = m.end()

    def learn(self, words: set[str]) -> None:
        known, short, datas = self.known, [], []
        for w in words:
            if w in self.special:
                known[w] = self.special[w].to_bytes(4, "little")
            elif len(data := w.encode()) > _ONE_BY_ONE:
                known[w] = np.array(self.merge([self.of_byte[b] for b in data]), "<u4").tobytes()
            else:
                short.append(w)
                datas.append(data)
        ids = np.array(self.of_byte, np.int64)[np.frombuffer(b"".join(datas), np.uint8)]
        known.update(zip(short, self.merge.forest(ids, np.fromiter(map(len, datas), np.int64, len(datas))), strict=True))

    def decode(self, ids: bytes) -> str:
        """The text of ids; those that the vocabulary has not are left out."""
        pieces, known = self.bytes, len(self.bytes)
        part = lambda at: b"".join([pieces[k] for k in np.frombuffer(ids, "<u4", min(_LONG, len(ids) // 4 - at), 4 * at).tolist() if k < known])
        return b"".join(map(part, range(0, len(ids) // 4, _LONG))).decode("utf-8", "replace")


@cache
def vocabulary(path: str, special: bool = True) -> ByteBpe:
    """The vocabulary of a file; a worker reads it once and goes on with the words that it knows."""
    return ByteBpe(path, special)


def encoded(docs: DataFrame, path: str, text: str = "text", prefix: str = "bpe_", special: bool = True, packed: bool = False) -> DataFrame:
    """Adds {prefix}n_tokens and {prefix}ids: an array, or with `packed` the little-endian unsigned 32-bit numbers as bytes."""
    no_clash(docs, [f"{prefix}n_tokens", f"{prefix}ids"])
    kind = T.BinaryType() if packed else T.ArrayType(T.LongType(), containsNull=False)
    schema = T.StructType([*docs.schema.fields, T.StructField(f"{prefix}n_tokens", T.LongType()), T.StructField(f"{prefix}ids", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, special)
        for part in slices(batches, text, _BATCH):
            ids = bpe.encode([t or "" for t in part.column(text).to_pylist()])
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            if packed:
                column = pa.array(ids, pa.binary())
            else:
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts), column], [*part.schema.names, f"{prefix}n_tokens", f"{prefix}ids"])

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, ids: str = "bpe_ids", into: str = "bpe_text") -> DataFrame:
    """Adds the text of ids, which are an array or packed as `encoded` packs them. Null ids are the empty text."""
    no_clash(rows, [into])
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            held = batch.column(ids).to_pylist()
            texts = [bpe.decode(x if isinstance(x, bytes) else np.array([k if k is not None and 0 <= k < 1 << 32 else (1 << 32) - 1 for k in x or []], "<u4").tobytes()) for x in held]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return rows.mapInArrow(run, schema)
