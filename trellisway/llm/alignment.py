"""Two tokenizers on the same texts: groups of tokens that cover the same bytes, and overlaps of single tokens.

A byte-level vocabulary (A) and one of pieces (B) encode a space and the text. Both leave ends of tokens in the same bytes,
two ascending lists whose merging tells everything: an end of either closes a stretch of bytes that one A token and one B
token share, which is a link, and an end of both closes a group.

1. The lists of a batch of texts are merged along the merge path: binary searches on its diagonals cut it into pieces of
   equal numbers of ends, wherever texts or tokens begin. Each piece is merged by itself, with numpy, and gives its links
   and the groups that it closes; a group that began in earlier pieces is stitched together from where the last one closed.
2. A text's distinct linked ids, with how often it links them, are written to a table. How many texts hold a pair is a
   count over that table, and the pairs that an A id shares with the most texts are its best.
3. The counts come back to the texts by a join on the pair, by broadcast only if no more than `MOST_SENT` pairs are
   linked in the whole corpus, else by a shuffle in which Spark splits frequent pairs; links are summed by text.

Defined results: a null or empty text, and one whose tokens don't give back its bytes, has no tokens: zeros, and an empty
string instead of a digest; repeated rows are texts each; columns other than the text are carried along, and a clash with
an added name raises.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellisway.llm.bpe import ByteBpe, WordWise, found_words, vocabulary
from trellisway.llm.common import checkpointed, no_clash, slices

#: Ends in a piece of the merge path.
PIECE = 1 << 16
#: Pairs of ids of which the counts may be sent to all tasks.
MOST_SENT = 1 << 21
#: Bytes of texts that are looked at together.
_BATCH = 1 << 21
#: Bits of an id in a pair.
_ID = 20

_MARK = "▁"


class PieceBpe(WordWise):
    """A vocabulary of pieces, in which a mark stands for a space and each text gets one in front."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.library.is_byte(k) else x.replace(_MARK, " ").encode() for k, x in enumerate(names)]
        self.mark = np.array([self.library.piece_to_id(_MARK)], "<u4").tobytes()
        #: Where no piece has a mark behind another sign, merges don't cross from a word into the marks of the next one.
        self.apart = not any(_MARK in x.lstrip(_MARK) for x in names)
        self.pattern = re.compile(f"[{_MARK} ]+[^{_MARK} ]*")

    def words(self, text: str) -> Iterator[list[str]]:
        if text:
            marked = " " + text
            yield from found_words(self.pattern, marked, 0, len(marked)) if self.apart else [[marked]]

    def learn(self, words: set[str]) -> None:
        listed = [w for w in words if len(w) > 1]
        found = self.library.encode([w[1:] for w in listed], num_threads=1)
        data = np.array([k for ids in found for k in ids], "<u4").tobytes()
        ends = [4 * n for n in accumulate(map(len, found))]
        self.known.update((w, data[x:y]) for w, x, y in zip(listed, [0, *ends], ends, strict=False))
        self.known.update((w, self.mark) for w in words if len(w) == 1)


@cache
def pieces(path: str) -> PieceBpe:
    return PieceBpe(path)


def merge_path(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): how much of each ascending list is merged after every `work` elements, and at the end; of equal elements
    that of `a` comes first. All diagonals are searched side by side."""
    diagonal = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = np.flatnonzero(open_)
        first = a[mid[at]] <= b[diagonal[at] - 1 - mid[at]]
        low[at[first]] = mid[at[first]] + 1
        high[at[~first]] = mid[at[~first]]
    return low, diagonal - low


def piece_links(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one piece: places in a and b of the tokens of each link, and those of the last tokens of each group it closes.

    Nothing but the piece's own ends is read, and the end of `a` before it, with which its first one of `b` may be equal."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    beside_a = j0 + np.searchsorted(own_b, own_a)
    beside_b = i0 + np.searchsorted(own_a, own_b)
    both = np.zeros(len(own_b), bool)
    inner = beside_b < i1
    both[inner] = a[beside_b[inner]] == own_b[inner]
    partner = beside_b.copy()
    if i0 > 0 and len(own_b) and a[i0 - 1] == own_b[0]:
        both[0], partner[0] = True, i0 - 1
    alone = np.flatnonzero(~both)
    closed = np.flatnonzero(both)
    return np.concatenate([np.arange(i0, i1), beside_b[alone]]), np.concatenate([beside_a, j0 + alone]), partner[closed], j0 + closed


def links_and_groups(a: np.ndarray, b: np.ndarray, work: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As piece_links, of whole lists of ends whose last elements are equal."""
    i, j = merge_path(a, b, work)
    found = [piece_links(a, b, *map(int, cut)) for cut in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _written(tokens: list[bytes]) -> list[bytes]:
    """An id before a comma, before the bar and before a semicolon."""
    return [b"%d%s" % (k, sign) for k in range(len(tokens)) for sign in (b",", b"|", b";")]


class _Joined:
    """The bytes of tokens, one after another, to be looked up for many ids at once."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        skipped = np.repeat(self.start[ids] - (np.cumsum(length) - length), length)
        return self.data[skipped + np.arange(len(skipped))]


_joined: dict[int, _Joined] = {}


def _tokens(of: ByteBpe | PieceBpe) -> _Joined:
    if id(of) not in _joined:
        _joined[id(of)] = _Joined(of.bytes)
    return _joined[id(of)]


class Aligned:
    """The tokens, links and groups of some texts."""

    def __init__(self, texts: list[str], byte_level: ByteBpe, of_pieces: PieceBpe, work: int = PIECE):
        whole = [" " + t if t else "" for t in texts]
        sides = [byte_level.encode(whole), of_pieces.encode(texts)]
        counts = [np.fromiter(map(len, side), np.int64, len(side)) // 4 for side in sides]
        ids = [np.frombuffer(b"".join(side), "<u4").astype(np.int64) for side in sides]
        datas = [t.encode() for t in whole]
        sizes = np.fromiter(map(len, datas), np.int64, len(datas))
        tokens = [_tokens(v) for v in (byte_level, of_pieces)]
        number = np.arange(len(texts))
        kept = sizes > 0
        for x in (0, 1):
            kept &= np.bincount(np.repeat(number, counts[x]), tokens[x].length[ids[x]], len(texts)) == sizes
        # of equal length; then also of equal bytes
        data = np.frombuffer(b"".join(d for d, keep in zip(datas, kept.tolist(), strict=True) if keep), np.uint8)
        of_byte = np.repeat(number[kept], sizes[kept])
        for x in (0, 1):
            kept[of_byte[tokens[x].of(ids[x][np.repeat(kept, counts[x])]) != data]] = False
            data, of_byte = data[kept[of_byte]], of_byte[kept[of_byte]]
        self.ids = [ids[x][np.repeat(kept, counts[x])] for x in (0, 1)]
        self.counts = [np.where(kept, c, 0) for c in counts]
        lengths = [t.length for t in tokens]
        ends = [np.cumsum(lengths[x][self.ids[x]]) for x in (0, 1)]
        a, b, last_a, last_b = links_and_groups(*ends, work)
        self.doc = np.repeat(np.arange(len(texts)), self.counts[0])
        self.pair = (self.doc[a] << (2 * _ID)) | (self.ids[0][a] << _ID) | self.ids[1][b]
        self.groups = np.bincount(self.doc[last_a], minlength=len(texts))
        self.links = np.bincount(self.doc[a], minlength=len(texts))
        self.last = last_a, last_b

    def digests(self, written: list[bytes]) -> list[str]:
        """SHA-256 of the groups of each text: ids of A, a bar, ids of B, and semicolons between groups."""
        last_a, last_b = self.last
        count_a, count_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # a group's A ids and then its B ids, with the sign that follows each
        place_a = np.arange(len(self.ids[0])) + np.repeat(np.cumsum(count_b) - count_b, count_a)
        place_b = np.arange(len(self.ids[1])) + np.repeat(np.cumsum(count_a), count_b)
        code = np.empty(len(place_a) + len(place_b), np.int64)
        sign_a, sign_b = np.zeros(len(place_a), np.int64), np.zeros(len(place_b), np.int64)
        sign_a[last_a], sign_b[last_b] = 1, 2
        code[place_a], code[place_b] = 3 * self.ids[0] + sign_a, 3 * self.ids[1] + sign_b
        upto = np.concatenate([[0], np.cumsum(self.counts[0] + self.counts[1])]).tolist()
        text = lambda x, y: b"".join([written[k] for k in code[x:y].tolist()])[:-1]
        return [hashlib.sha256(text(x, y)).hexdigest() if x < y else "" for x, y in zip(upto[:-1], upto[1:], strict=True)]


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", prefix: str = "align_") -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (with the prefix) and drops the text. A table
    of the texts' pairs is written while the plan is made."""
    own = [f"{prefix}{c}" for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    hidden = [f"{prefix}{c}" for c in ("row", "pairs")]
    added = [f"{prefix}n_best", f"{prefix}count_sum"]
    no_clash(docs.drop(text), [*own, *hidden, *added])
    carried = [c for c in docs.columns if c != text]
    kinds = [*[T.LongType()] * 4, T.StringType(), T.LongType(), T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))]
    schema = T.StructType([*[docs.schema[c] for c in carried], *[T.StructField(c, k) for c, k in zip([*own, *hidden], kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_level, of_pieces = vocabulary(byte_path, False), pieces(piece_path)
        written = _written(max(byte_level.bytes, of_pieces.bytes, key=len))
        row = (TaskContext.get() or TaskContext()).partitionId() << 33
        for part in slices(batches, text, _BATCH):
            found = Aligned([t or "" for t in part.column(text).to_pylist()], byte_level, of_pieces)
            pair, times = np.unique(found.pair, return_counts=True)
            upto = np.searchsorted(pair >> (2 * _ID), np.arange(len(part) + 1))
            structs = pa.StructArray.from_arrays([pa.array(pair & ((1 << 2 * _ID) - 1)), pa.array(times)], ["pair", "times"])
            columns = [*found.counts, found.groups, found.links, found.digests(written), row + np.arange(len(part)), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), structs)]
            row += len(part)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carried], *[x if isinstance(x, pa.Array) else pa.array(x) for x in columns]], [*carried, *own, *hidden])

    rows = checkpointed(docs.mapInArrow(run, schema))
    linked = rows.select(F.col(hidden[0]).alias("row"), F.explode(hidden[1]).alias("x")).select("row", "x.*")
    # an A id is linked with no more ids than B has
    best = F.max("n").over(Window.partitionBy(F.shiftright("pair", _ID)))
    counts = checkpointed(linked.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("best", F.col("n") == best))
    sums = linked.join(F.broadcast(counts) if counts.count() <= MOST_SENT else counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias(added[0]), F.sum(F.col("times") * F.col("n")).alias(added[1]))
    zero = F.lit(0).cast("long")
    return rows.drop(hidden[1]).join(sums.withColumnRenamed("row", hidden[0]), hidden[0], "left").select(*carried, *own[:4], *[F.coalesce(c, zero).alias(c) for c in added], own[4])
