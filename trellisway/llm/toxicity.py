"""Toxicity by noisy-channel deobfuscation.

A character language model (trigrams, counted over every document) and a channel of
leetspeak, separators and repeated letters give each suspicious token a lattice of
spellings; Viterbi search with a few best strings for each state restores it, in overlapping
pieces where a token is longer than any word. Separators, and the spaces of words that are spelled
out, may also be boundaries of words, as the model sees fit. The restored text's words and word beginnings are scored with weights learned from labels.

Rounds, each a scan of the texts without a shuffle of them:
1. trigram counts of all texts (a table bounded by the alphabet cubed);
2. document frequencies of words and beginnings in a labelled sample of at most
   `most_toxic` + `most_clean` rows (documented bound, drawn by a hash of the id);
   a weight is the lower confidence bound of a feature's log odds;
3. a logistic fit of two statistics of a text on a part of that sample held apart, its
   constant moved from the sample's odds to those of all labels (counted whole);
4. the scores of every whole text.

Only ids of the sample, the kept weights (fewer than the sample's features) and the
trigram table reach the driver. Rows whose crc32(id as text) mod 5 is 0 are never learned
from; labels, lang, source and id are no inputs of a score.

Defined results: a null or empty text, or one without letters, has the score of a text
without evidence; a null id counts as the empty string (so it is held out); repeated rows
are scored alike; without labels of both kinds the score is the share of toxic labels, 0
if there are none; extra columns are carried along.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellisway.llm.common import Words, mix64, no_clash, release_memory, slices, spellings

# The letters of the model, after the boundary, which is 0.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûüœæ"
K = len(LETTERS) + 1
_CLASS = np.zeros(0x200, np.int64)
for _i, _c in enumerate(LETTERS, 1):
    _CLASS[ord(_c)] = _i
_ID = {c: i for i, c in enumerate(LETTERS, 1)}

# What a character may stand for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "§": "s", "µ": "u"}
WILD = "*#"
SEPARATORS = ".-_~*'`,:;=^​­"
SUBSTITUTED, DELETED, COLLAPSED, ANY, APART = -1.0, -0.7, -0.5, -3.5, -1.5

_CHANNEL = frozenset("".join(LEET) + WILD + SEPARATORS)

# Kinds of characters for the choice of suspicious tokens: letters of plain words, plain at the start or end of a token
# (sentence punctuation, quotes, separators), plain at its end alone, and what may stand for a letter.
_LETTER, _PLAIN, _FINAL, _SIGN = range(4)


def _kind(c: str) -> int:
    """Letters and marks of other alphabets belong to plain words; a wild sign may be a letter also at an edge."""
    if c in _CHANNEL:
        return _FINAL if c == "!" else _PLAIN if c in SEPARATORS and c not in WILD else _SIGN
    return _LETTER if c in _ID or unicodedata.category(c)[0] in "LM" else _PLAIN


_KINDS = np.array([_kind(chr(b)) if b < 128 else _PLAIN for b in range(256)], np.int8)


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of valid UTF-8 belongs to."""
    out = _KINDS[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    more = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    key = np.zeros(len(lead), np.uint32)
    for i in range(4):
        key = (key << np.uint32(8)) | np.where(i <= more, data[np.minimum(lead + i, len(data) - 1)], 0).astype(np.uint32)
    distinct, inverse = np.unique(key, return_inverse=True)
    kind = np.array([_kind(int(k).to_bytes(4, "big").rstrip(b"\0").decode()) for k in distinct], np.int8)[inverse]
    for i in range(4):
        out[lead[i <= more] + i] = kind[i <= more]
    return out


# ---------------------------------------------------------------- language model


def trigram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often each three classes follow one another, over all texts; K x K x K."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K**3, np.int64)
        for batch in slices(batches, 0):
            text = "  ".join(x for x in batch.column(0).to_pylist() if x).lower()
            for at in range(0, len(text), 1 << 20):  # two characters more, so that no three are cut
                points = np.frombuffer(text[at : at + (1 << 20) + 2].encode("utf-32-le", "replace"), np.uint32)
                c = _CLASS[np.minimum(points, 0x1FF)]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * K + c[1:-1]) * K + c[2:], minlength=K**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["code", "n"])

    rows = docs.select(text_col).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(K**3)
    for r in rows:
        out[r["code"]] = r["n"]
    return out.reshape(K, K, K)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with shorter contexts."""
    two, one = counts.sum(0), counts.sum((0, 1))
    p1 = (one + 0.5) / (one.sum() + 0.5 * K)
    p2 = (two + 10 * p1) / (two.sum(1, keepdims=True) + 10)
    return np.log((counts + 10 * p2) / (counts.sum(2, keepdims=True) + 10)).astype(np.float32)


# ---------------------------------------------------------------- the lattice


def choices(token: str, k: int, apart: bool = False) -> list[tuple[str, float]]:
    """What the character may have been, with the channel's cost; '' for nothing. With `apart` a separator, or a space of
    words that were spelled out, may also have been the boundary of two words, ' '."""
    c = token[k]
    if c in _ID:
        out = [(c, 0.0)]
        if k and token[k - 1] == c:
            out.append(("", COLLAPSED))
        return out
    out = [(x, SUBSTITUTED) for x in LEET.get(c, "")]
    if c in WILD:
        out += [(x, ANY) for x in LETTERS[:26]]
    if c in SEPARATORS or not out:
        out.append(("", DELETED))
        if apart:
            out.append((" ", APART))
    elif k and token[k - 1] == c:
        out.append(("", COLLAPSED))
    return out


_Paths = list[tuple[float, str]]


class Lattice:
    """Viterbi search under one language model. Beginnings of tokens and runs of one wild sign at their ends are kept, as
    many tokens have them in common."""

    def __init__(self, lm: np.ndarray, best: int, apart: bool = False):
        self.lm, self.best, self.apart = lm, best, apart
        self.begun: dict[str, dict[tuple[int, int], _Paths]] = {}
        self.ended: dict[tuple[str, int, int, int], _Paths] = {}
        scores = np.full((K, K, best), -np.inf)
        scores[:, :, 0] = lm[:, :, 0]
        self.any = [(scores, np.zeros((K, K, best), np.int64))]  # scores and (letter, rank after it) of the best m letters and the end

    def paths(self, token: str, keep: bool) -> dict[tuple[int, int], _Paths]:
        """The best strings for each state after a token; `keep` also for tokens that begin alike."""
        known = max((k for k in (len(token), 2, 3, 4, 5, 6) if token[:k] in self.begun and k <= len(token)), default=0)
        states: dict[tuple[int, int], _Paths] = self.begun[token[:known]] if known else {(0, 0): [(0.0, "")]}
        lm, best = self.lm, self.best
        if len(self.begun) > 500:
            self.begun.clear()
        if len(self.ended) > 20_000:
            self.ended.clear()
        for k in range(known, len(token)):
            after: dict[tuple[int, int], _Paths] = self.any_letter(states) if token[k] in WILD else {}
            for (a, b), paths in states.items():
                for x, cost in choices(token, k, self.apart):
                    if cost == ANY or (x == " " and b == 0):  # no word between two boundaries
                        continue
                    i = _ID.get(x, 0)
                    key = (b, i) if x else (a, b)
                    step = cost + (float(lm[a, b, i]) if x else 0.0)
                    after.setdefault(key, []).extend((s + step, text + x) for s, text in paths)
            states = {key: [(s, t) for t, s in sorted(dict((t, s) for s, t in sorted(paths)).items(), key=lambda p: (-p[1], p[0]))[:best]] if len(paths) > 1 else paths for key, paths in after.items()}
            if k < 6 and token[0] in WILD:
                self.begun[token[: k + 1]] = states
        if keep:
            self.begun[token] = states
        return states

    def any_letter(self, states: dict[tuple[int, int], _Paths]) -> dict[tuple[int, int], _Paths]:
        """The best strings for each state after one letter more, whichever it is. Strings of different states differ in
        their last two letters, so those that a new state takes its best from are all distinct."""
        by_last: dict[int, list[tuple[float, str, int]]] = {}
        for (a, b), paths in states.items():
            by_last.setdefault(b, []).extend((s, text, a) for s, text in paths)
        out: dict[tuple[int, int], _Paths] = {}
        for b, paths in by_last.items():
            paths.sort(key=lambda p: p[1])
            scores = np.array([p[0] for p in paths])[:, None] + ANY + self.lm[[p[2] for p in paths], b, 1:27].astype(float)
            top = np.argsort(-scores, axis=0, kind="stable")[: self.best]
            for x in range(26):
                out[b, x + 1] = [(float(scores[i, x]), paths[i][1] + LETTERS[x]) for i in top[:, x]]
        return out

    def letters(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.any) <= m:
            after = self.lm[:, :, 1:27, None].astype(float) + self.any[-1][0][None, :, 1:27, :]
            after = after.reshape(K, K, -1)
            at = np.argsort(-after, axis=-1, kind="stable")[:, :, : self.best]
            self.any.append((np.take_along_axis(after, at, axis=-1), at))
        return self.any[m]

    def ends(self, sign: str, n: int, a: int, b: int) -> _Paths:
        """What n wild signs at a token's end may be after the letters a and b, with the end's own cost."""
        if (sign, n, a, b) not in self.ended:
            nothing = DELETED if sign in SEPARATORS else COLLAPSED
            found: list[tuple[float, int, int]] = []
            for m in range(0 if sign in SEPARATORS else 1, n + 1):
                cost = m * ANY + (n - m) * nothing
                if len(found) > self.best and found[self.best][0] >= cost:  # more letters cost more than that
                    break
                scores = self.letters(m)[0][a, b]
                found = sorted([*found, *((cost + float(s), m, r) for r, s in enumerate(scores) if np.isfinite(s))], key=lambda p: -p[0])[: self.best + 1]  # one may be empty
            out = []
            for score, m, r in found:
                text, i, j = "", a, b
                for left in range(m, 0, -1):
                    x, r = divmod(int(self.letters(left)[1][i, j, r]), self.best)
                    text, i, j = text + LETTERS[x], j, x + 1
                out.append((score, text))
            self.ended[sign, n, a, b] = out
        return self.ended[sign, n, a, b]

    def restore(self, token: str) -> list[str]:
        head = token.rstrip(token[-1]) if token[-1] in WILD else token
        states = self.paths(head, head != token)
        if head != token:
            ends = [(s + e, t + x) for (a, b), paths in states.items() for e, x in self.ends(token[-1], len(token) - len(head), a, b) for s, t in paths]
        else:
            ends = [(s + (float(self.lm[a, b, 0]) if b or not a else 0.0), t) for (a, b), paths in states.items() for s, t in paths]
        return list(dict.fromkeys(t for _, t in sorted(ends, key=lambda p: (-p[0], p[1])) if t))[: self.best]


_LATTICES: list[Lattice] = []


def restore(token: str, lm: np.ndarray, best: int = 3, apart: bool = False) -> list[str]:
    """The likeliest spellings of an obfuscated token, best first; with `apart` of the words that it may be, by spaces."""
    if not _LATTICES or _LATTICES[0].lm is not lm or _LATTICES[0].best != best:
        _LATTICES[:] = [Lattice(lm, best), Lattice(lm, best, True)]
    return _LATTICES[apart].restore(token)


def words_apart(token: str, lm: np.ndarray) -> list[str]:
    """The words, if more than one, of the likeliest readings of a token in which separators or spaces may part words."""
    found = [t.split() for t in restore(token, lm, apart=True)] if _PIECES.search(token) else []
    return list(dict.fromkeys(w for words in found if len(words) > 1 for w in words if len(w) > 2))


_STRIPPED = "".join(c for c in SEPARATORS if c not in WILD)
_PIECES = re.compile(rf"[{LETTERS}]+")
_HARD = re.compile(rf"[^{LETTERS}{re.escape(''.join(LEET) + WILD + SEPARATORS)}]+")


def pieces(token: str, most: int = 64) -> Iterator[str]:
    """A token of over `most` characters in pieces that overlap by half, as it holds words and is none: every stretch of
    half that length lies in one of them, and the search's work is in proportion to the token."""
    if len(token) <= most:
        yield token
    else:
        for at in range(0, len(token) - most // 2, most // 2):
            yield token[at : at + most]


def readings(token: str, lm: np.ndarray) -> list[str]:
    """Words that a suspicious token may hold: restored spellings, and its plain pieces."""
    out = [p for p in _PIECES.findall(token) if len(p) > 2]
    for part in dict.fromkeys(x for whole in _HARD.split(token) for x in pieces(whole.strip(_STRIPPED))):
        part = part.strip(_STRIPPED)
        if _PIECES.search(part):
            for spelling in dict.fromkeys((part, part if part[-1] in _ID else part[:-1], part.rstrip(_STRIPPED + "!"), part.strip(_STRIPPED + "!(|"))):  # signs that may be punctuation
                out += restore(spelling, lm)
            if any(c in SEPARATORS for c in part):
                out += words_apart(part, lm)
    return list(dict.fromkeys(out))


# ---------------------------------------------------------------- words of restored texts


def _first_bytes(words: Words, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """A hash of the first n bytes; 0 for shorter words."""
    data = np.concatenate([words.data, np.zeros(n, np.uint8)])
    key = np.full(len(start), n, np.uint64)
    for i in range(n):
        key = (key << np.uint64(8)) | data[start + i].astype(np.uint64)
    return np.where(end - start >= n, mix64(key, n), np.uint64(0))


class Restored:
    """Features of the words of some texts: `doc` and three hashes for each (word, first 4 bytes, first 5)."""

    def __init__(self, texts: list[str | None], lm: np.ndarray, known: dict[str, list[str]]):
        plain = Words([(t or "").lower().encode("utf-8", "replace") for t in texts])
        data, start, end = plain.data, plain.start, plain.end
        kind = byte_kinds(data)
        whole = np.int32 if len(data) < 1 << 31 else np.int64
        letter, place = kind == _LETTER, np.arange(len(data), dtype=whole)
        first = np.minimum.accumulate(np.where(kind != _PLAIN, place, whole(len(data)))[::-1])[::-1]
        last = np.maximum.accumulate(np.where((kind != _PLAIN) & (kind != _FINAL), place, whole(-1)))
        lo, hi = first[start], np.minimum(last[end - 1] + 1, end)
        inside = np.concatenate([np.zeros(1, whole), np.cumsum(letter, dtype=whole)])
        same = np.zeros(len(data), bool)
        for n in (1, 2):  # bytes of a letter
            long = letter & ((data < 128) if n == 1 else (data >= 0xC0))
            back = [np.concatenate([np.zeros(n * k, np.uint8), data])[: len(data)] for k in (1, 2)]
            equal = (data == back[0]) & (data == back[1])
            same |= long & equal & (np.concatenate([equal[1:], [False]]) if n == 2 else True)
        runs = np.concatenate([np.zeros(1, whole), np.cumsum(same, dtype=whole)])
        low, high = np.minimum(lo, end), np.maximum(hi, start)
        has = (low < high) & (inside[np.maximum(low, high)] > inside[low])
        odd = has & ((inside[np.maximum(low, high)] - inside[low] < high - low) | (runs[np.maximum(low, high)] > runs[low]))
        clean = has & ~odd
        docs, spans = [plain.doc[clean]], (lo[clean], hi[clean])
        extra: list[tuple[int, str]] = []
        for w in np.flatnonzero(odd):
            token = data[start[w] : end[w]].tobytes().decode("utf-8", "replace")
            if token not in known:
                known[token] = readings(token, lm)
            extra += [(plain.doc[w], x) for x in known[token]]
        extra += self._spaced(plain, lm, known)
        more = Words([x.encode() for _, x in extra])
        docs.append(np.fromiter((extra[k][0] for k in more.doc), np.int64, len(more.doc)))
        hashes = []
        for words, (a, b) in ((plain, spans), (more, (more.start, more.end))):
            hashes.append(np.stack([mix64(spellings(words.data, a, b), 1), _first_bytes(words, a, b, 4), _first_bytes(words, a, b, 5)]))
        self.doc, self.hashes, self.n = np.concatenate(docs), np.concatenate(hashes, axis=1), len(texts)
        order = np.argsort(self.doc, kind="stable")
        self.doc, self.hashes = self.doc[order], self.hashes[:, order]

    @staticmethod
    def _spaced(words: Words, lm: np.ndarray, known: dict[str, list[str]]) -> list[tuple[int, str]]:
        """Readings of runs of three and more one-character words."""
        characters = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80, dtype=np.int32 if len(words.data) < 1 << 31 else np.int64)])
        one = characters[words.end] - characters[words.start] == 1
        edge = np.diff(np.concatenate([[False], one, [False]]).astype(np.int8))
        out = []
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            for d in range(words.doc[a], words.doc[b - 1] + 1):
                lo, hi = max(a, words.first[d]), min(b, words.first[d + 1])
                if hi - lo < 3:
                    continue
                run = b"".join(words.data[i:j].tobytes() for i, j in zip(words.start[lo:hi], words.end[lo:hi], strict=True)).decode()
                for token in dict.fromkeys(x for whole in (run, run[1:], run[:-1]) for x in pieces(whole)):
                    if token not in known:
                        known[token] = restore(token, lm) if _PIECES.search(token) else []
                    out += [(d, x) for x in known[token]]
                for token in pieces(" ".join(run)):  # several words that were spelled out one after another
                    if token not in known:
                        known[token] = words_apart(token.strip(), lm)
                    out += [(d, x) for x in known[token]]
        return out

    def statistics(self, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each text: the largest weight of a word, and log(1 + the sum of weights)."""
        out = np.zeros((self.n, 2))
        if not len(self.doc) or not len(features):
            return out
        best = np.zeros(len(self.doc))
        for h in self.hashes:
            at = np.minimum(np.searchsorted(features, h), len(features) - 1)
            best = np.maximum(best, np.where(features[at] == h, weights[at], 0.0))
        at = np.flatnonzero(np.concatenate([[True], self.doc[1:] != self.doc[:-1]]))
        out[self.doc[at], 0] = np.maximum.reduceat(best, at)
        out[self.doc[at], 1] = np.log1p(np.add.reduceat(best, at))
        return out


def _restored_batches(batches: Iterator[pa.RecordBatch], lm: np.ndarray, column: str) -> Iterator[tuple[pa.RecordBatch, Restored]]:
    known: dict[str, list[str]] = {}
    for batch in slices(batches, column, 1 << 20):  # the arrays of words take many times as much
        if len(known) > 50_000:
            known.clear()
        yield batch, Restored(batch.column(batch.schema.get_field_index(column)).to_pylist(), lm, known)
    # workers live on, beside those of later stages
    known.clear()
    _LATTICES.clear()
    release_memory()


# ---------------------------------------------------------------- learning and scoring


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(sample_id, toxic, fold): labelled rows that are not held out; an id with both labels is toxic."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("sample_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    return rows.withColumn("fold", fold(F.col("sample_id"))).where("fold <> 0")


def _sample(rows: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """At most so many labelled rows of either kind."""
    pick = [rows.where(F.col("toxic") == t).orderBy(F.xxhash64("sample_id"), "sample_id").limit(n) for t, n in ((1, most_toxic), (0, most_clean))]
    return pick[0].unionByName(pick[1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients with the constant last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 4_000, most_clean: int = 8_000, least_weight: float = 1.0) -> dict:
    """The model: log probabilities, features, their weights, and the fit."""
    lm = language_model(trigram_counts(docs, text_col))
    labelled = _labelled(labels, id_col, label_col)
    sample = _sample(labelled, most_toxic, most_clean).collect()  # at most most_toxic + most_clean narrow rows
    all_of = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    prior = all_of.get(1, 0) / sum(all_of.values()) if all_of else 0.0
    if prior in (0.0, 1.0):
        return {"lm": lm, "features": np.zeros(0, np.uint64), "weights": np.zeros(0), "fit": None, "prior": prior}
    rows = docs.sparkSession.createDataFrame([(r["sample_id"], r["toxic"], r["fold"]) for r in sample], T.StructType([T.StructField("sample_id", docs.schema[id_col].dataType), T.StructField("toxic", T.IntegerType()), T.StructField("fold", T.IntegerType())]))
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("body")).join(F.broadcast(rows), "sample_id").select("body", "toxic", "fold")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _restored_batches(batches, lm, "body"):
            toxic = np.asarray(batch.column("toxic").to_pylist(), np.int64)
            doc = np.tile(words.doc, 3)
            pair = np.unique(np.stack([words.hashes.reshape(-1), doc.astype(np.uint64)]), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
            feature, inverse = np.unique(pair[0], return_inverse=True)
            t = toxic[pair[1].astype(np.int64)]
            yield pa.record_batch([pa.array(feature.view(np.int64)), pa.array(np.bincount(inverse, t, len(feature)).astype(np.int64)), pa.array(np.bincount(inverse, 1 - t, len(feature)).astype(np.int64))], names=["feature", "n1", "n0"])

    learn = texts.where("fold <> 4")
    n1, n0 = (sum(r["toxic"] == t and r["fold"] != 4 for r in sample) for t in (1, 0))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0)) - 1.64 * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    kept = (
        learn.mapInArrow(frequencies, "feature long, n1 long, n0 long").where("feature <> 0").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        .where("n1 >= 3").select("feature", odds.alias("weight")).where(F.col("weight") >= least_weight).collect()
    )
    features = np.array([r["feature"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(features)
    features, weights = features[order], np.array([r["weight"] for r in kept], float)[order]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _restored_batches(batches, lm, "body"):
            x = words.statistics(features, weights)
            yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("toxic")], names=["x0", "x1", "toxic"])

    held = texts.where("fold = 4").mapInArrow(measured, "x0 double, x1 double, toxic int").collect()  # a part of the sample
    fit = _logistic(np.array([[r["x0"], r["x1"]] for r in held]), np.array([r["toxic"] for r in held], float)) if len({r["toxic"] for r in held}) == 2 else None
    if fit is not None:  # from the sample's odds to those of all labels, as the caps bind at different sizes
        drawn = [sum(r["toxic"] == t for r in sample) for t in (0, 1)]
        fit[-1] += np.log(all_of[1] / drawn[1]) - np.log(all_of[0] / drawn[0])
    return {"lm": lm, "features": features, "weights": weights, "fit": fit, "prior": prior}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of `docs`, and {prefix}held_out, {prefix}score, {prefix}predicted."""
    added = [f"{prefix}held_out", f"{prefix}score", f"{prefix}predicted"]
    no_clash(docs, added)
    rows = docs.withColumn(added[0], fold(F.col(id_col)) == 0)
    schema = T.StructType([*rows.schema.fields, T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the alphabet cubed, and weights of a bounded sample

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch, words in _restored_batches(batches, m["lm"], text_col):
            x = words.statistics(m["features"], m["weights"])
            z = np.hstack([x, np.ones((len(x), 1))]) @ m["fit"] if m["fit"] is not None else None
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if z is not None else np.full(len(x), m["prior"])
            yield pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, *added[1:]])

    return rows.mapInArrow(scored, schema)
