"""N-gram Jaccard join: near-duplicate classes of documents by prefix filtering.

A document's set is its distinct `size`-word shingles; documents link when the Jaccard
similarity of their sets is at least `percent` hundredths. The steps:

1. classes: documents with equal word sequences have equal sets and are one class, found by
   a digest. From here on a class is one document, so thousands of copies cost what one does.
2. rare-first order: document frequencies of all shingles of the classes, counted in hash
   buckets; a batch sends each distinct shingle once and hears of those in two documents or
   more. Shingles of one document come first in the order and need no index.
3. candidates: the first n - ceil(percent n) + 1 shingles of each class are its prefix. Two
   classes that link share a prefix shingle; at the first one they share, in that order, at most
   the shingles from there on are common to both (the length and positional filters). The suffix
   filter bounds the rest: shingles that only one class has, and the counts of the others in
   ranges of their hashes. Each pair that passes is verified once.
4. stars: in each shingle's list, the member with the smallest share of shingles of its own
   meets all others. In a group of near copies that is the one nearest to their origin.
5. the rest: in lists that then still hold several components, the members outside the list's
   largest component meet those of other components, by shingle and band of set sizes that may
   link. So pairs inside a known component are skipped and all others are looked at; the
   components are exact, without a group's square of pairs.

No group is gathered: lists exist as rows only and their sums are made before the shuffle;
where one list or class is hot, the joins on it are inner or left ones of which adaptive
execution splits the large side.

Defined results: null texts and texts without words have no shingles and are alone; ids may
repeat (each row is a document); null ids are kept, and a component is named by its smallest
id that is not null, or null if it has none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellisway.llm.common import WORD_BASES, Words, batch_of, checkpointed, dealt, discard, inverse, member, mix64, no_clash, powers, release_memory, shuffle_width, slices, text_bytes, unique_counts

_RANGES = 32
_MOST_DF = 65_535


def shingle_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """(text numbers, shingle hashes) of distinct shingles, text by text; and the words. Texts of fewer words have all words as one."""
    words = Words(texts, lower=True)
    at, hashes = words.windows(size)
    doc, token = [words.doc[at]], [hashes]
    counts = words.counts()
    for k in range(1, size):
        if (counts == k).any():
            at, hashes = words.windows(k)
            short = counts[words.doc[at]] == k
            doc.append(words.doc[at[short]])
            token.append(mix64(hashes[short], k))
    doc, token = np.concatenate(doc), np.concatenate(token)
    # by text, then by the hash; for up to 2^20 texts one sort of single numbers with its upper bits
    order = np.argsort((doc.astype(np.uint64) << np.uint64(44)) | (token >> np.uint64(20))) if len(texts) <= 1 << 20 else np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new], words


def sequence_digests(words: Words) -> list[bytes | None]:
    """16 bytes of each text's whole word sequence; null without words. Texts of equal sequences have equal sets."""
    n, lo, hi = len(words.hash), words.first[:-1], words.first[1:]
    out: list[bytes | None] = [None] * len(lo)
    halves = []
    for base in WORD_BASES:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hash * powers(base, n), out=sums[1:])
        halves.append(mix64((sums[hi] - sums[lo]) * powers(inverse(base), n + 1)[lo] + (hi - lo).astype(np.uint64)))
    pair = np.stack(halves, axis=1)
    for k in np.flatnonzero(hi > lo):
        out[k] = pair[k].tobytes()
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    """(id, batch, key, digest) of every row; key is a hash of id and text."""

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts, 3):
            digests = sequence_digests(Words(text_bytes(part.column(3)), lower=True))
            yield pa.record_batch([*part.columns[:3], pa.array(digests, pa.binary())], names=schema.names)

    kinds = [docs.schema[id_col].dataType, T.IntegerType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(("id", "batch", "key", "digest"), kinds, strict=True)])
    keys = (F.col(id_col), F.col(text_col))
    return docs.select(keys[0].alias("id"), batch_of(*keys, batches=batches).alias("batch"), F.xxhash64(*keys).alias("key"), keys[1].alias("body")).mapInArrow(sketch, schema)


# ---------------------------------------------------------------- frequencies and prefixes

_MESSAGE = "bucket int, batch int, hashes binary, times binary"
_MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("hashes", pa.binary()), ("times", pa.binary())])


def _representatives(mine: pa.Table, homes: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text numbers from 0, shingles, set sizes, digests) of the classes whose home is this batch."""
    bodies = text_bytes(mine["body"]) if len(mine) else []
    wanted, chosen, names = set(homes["digest"].to_pylist()) if len(homes) else set(), [], []
    for k, d in enumerate(sequence_digests(Words(bodies, lower=True))):
        if d in wanted:
            wanted.discard(d)
            chosen.append(bodies[k])
            names.append(d)
    doc, token, _ = shingle_sets(chosen, size)
    return doc, token, np.bincount(doc, minlength=len(chosen)).astype(np.int64), names


def _frequencies(table: pa.Table) -> pa.Table:
    """In a bucket: the document frequency of each hash; batches hear of those of two and more."""
    release_memory()
    sent = [np.frombuffer(x, np.uint32) for x in table["hashes"].to_pylist()]
    every = np.concatenate(sent)
    times = np.concatenate([np.frombuffer(x, np.uint16) for x in table["times"].to_pylist()]).astype(np.int64)
    order = np.argsort(every)
    ordered = every[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.minimum(np.add.reduceat(times[order], at), _MOST_DF).astype(np.uint16)
    df = np.empty(len(every), np.uint16)
    df[order] = np.repeat(total, np.diff(np.concatenate([at, [len(every)]])))
    out, done = [], 0
    for batch, s in zip(table["batch"].to_pylist(), sent, strict=True):
        own = df[done : done + len(s)]
        done += len(s)
        if (own > 1).any():
            out.append((table["bucket"][0].as_py(), batch, s[own > 1].tobytes(), own[own > 1].tobytes()))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 4, _MESSAGE_ARROW, strict=True)], schema=_MESSAGE_ARROW)


_INDEXED = "cid binary, n int, alone int, tokens binary, prefix array<struct<token:bigint,pos:int>>, ranges array<int>"


def indexed_classes(rows: DataFrame, homes: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """Every class with its set size n; those whose prefix has a shingle of another class also with the number of shingles
    that they have alone, the others (by hash), their part of the prefix with places, and their counts in ranges of hashes."""

    def send(mine: pa.Table, home: pa.Table) -> pa.Table:
        release_memory()
        if not len(mine) or not len(home):
            return _MESSAGE_ARROW.empty_table()
        _, token, _, _ = _representatives(mine, home, size)
        distinct, times = unique_counts(token)
        order, bucket, bounds = dealt(distinct, buckets)
        low, times = (distinct[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(times[order], _MOST_DF).astype(np.uint16)
        cut = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] if len(distinct) else []
        return pa.table([pa.array(bucket.astype(np.int32)), pa.array(np.full(len(cut), mine["batch"][0].as_py(), np.int32)), pa.array([low[s].tobytes() for s in cut], pa.binary()), pa.array([times[s].tobytes() for s in cut], pa.binary())], schema=_MESSAGE_ARROW)

    names = ["cid", "n", "alone", "tokens", "prefix", "ranges"]
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())])), pa.list_(pa.int32())]

    def index(mine: pa.Table, told: pa.Table) -> pa.Table:
        release_memory()
        home = told.filter(pc.is_valid(told["digest"])) if len(told) else told
        said = told.filter(pc.is_null(told["digest"])) if len(told) else told
        if not len(mine) or not len(home):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        doc, token, sizes, digests = _representatives(mine, home, size)
        out: list[tuple] = [(d, n, None, None, None, None) for d, n in zip(digests, sizes.tolist(), strict=True)]
        if len(said):
            key = ((token >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (token & np.uint64(0xFFFFFFFF))
            known = np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(h, np.uint32).astype(np.uint64) for b, h in zip(said["bucket"].to_pylist(), said["hashes"].to_pylist(), strict=True)])
            freq = np.concatenate([np.frombuffer(t, np.uint16) for t in said["times"].to_pylist()])
            order = np.argsort(known)
            known, freq = known[order], freq[order]
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            shared = np.flatnonzero(known[at] == key)
            df = freq[at[shared]]
            # shingles of one document come first in the order, so the prefix of most documents has no other
            many = np.bincount(doc[shared], minlength=len(sizes))
            alone, lead = sizes - many, sizes - (-(-percent * sizes // 100)) + 1
            open_ = (alone < lead)[doc[shared]]
            shared, df = shared[open_], df[open_]
            s_doc, s_token = doc[shared], token[shared]
            ranges = np.bincount(s_doc * _RANGES + (s_token >> np.uint64(59)).astype(np.int64), minlength=len(sizes) * _RANGES).reshape(-1, _RANGES)
            by_hash, by_df = np.lexsort((s_token, s_doc)), np.lexsort((s_token, df, s_doc))
            bounds = np.searchsorted(s_doc, np.arange(len(sizes) + 1))
            for k in np.flatnonzero(np.diff(bounds)):
                own = slice(bounds[k], bounds[k + 1])
                first = s_token[by_df[own]][: lead[k] - alone[k]].view(np.int64).tolist()
                out[k] = (digests[k], int(sizes[k]), int(alone[k]), s_token[by_hash[own]].tobytes(), [{"token": t, "pos": int(alone[k]) + i} for i, t in enumerate(first)], ranges[k].tolist())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)

    by_batch = rows.groupBy("batch")
    messages = by_batch.cogroup(homes.groupBy("batch")).applyInArrow(send, _MESSAGE)
    told = messages.groupBy("bucket").applyInArrow(_frequencies, _MESSAGE)
    both = homes.select("batch", "digest").unionByName(told, allowMissingColumns=True)
    return by_batch.cogroup(both.groupBy("batch")).applyInArrow(index, _INDEXED)


# ---------------------------------------------------------------- components


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b), where component is one node of each; null for no links.

    Rounds: each node hangs on its smallest smaller neighbour; paths are halved until all hang on roots; links between
    roots are the next round's graph. Every round at least halves the nodes. Each step is a table in the checkpoint
    folder, dropped when the next is there."""
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while edges.limit(1).count():
        hung = checkpointed(edges.groupBy("a").agg(F.min("b").alias("b")))
        moved = 1
        while moved:
            above = hung.select(F.col("a").alias("b"), F.col("b").alias("c"))
            once = hung.join(above, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().cast("int").alias("moved"))
            seen = Observation()
            last, hung = hung, checkpointed(once.observe(seen, F.sum("moved").alias("moved")).select("a", "b"))
            moved = seen.get["moved"]
            discard(last)
        roots = hung.select(F.col("a").alias("x"), F.col("b").alias("root"))
        if labels is None:
            next_labels = hung.select(F.col("a").alias("node"), F.col("b").alias("component"))
        else:
            raised = labels.join(roots, labels["component"] == roots["x"], "left").select("node", F.coalesce("root", "component").alias("component"))
            next_labels = raised.unionByName(roots.select(F.col("x").alias("node"), F.col("root").alias("component")))
        one = edges.join(roots, F.col("a") == F.col("x"), "left").select(F.coalesce("root", "a").alias("a"), "b")
        two = one.join(roots, F.col("b") == F.col("x"), "left").select("a", F.coalesce("root", "b").alias("b")).where("a <> b")
        last, edges = (edges, labels), checkpointed(two.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        labels = checkpointed(next_labels)
        discard(hung, *last)
    discard(edges)
    # a root of one round that hung on another later is there with both; only the last names count
    return None if labels is None else labels.unionByName(labels.select(F.col("component").alias("node"), "component")).distinct()


def _needed(n: str, m: str, percent: int) -> str:
    """The common shingles that sets of n and m need to link, in SQL."""
    return f"(({percent}L * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def _passes(n: str, i: str, m: str, j: str, percent: int) -> str:
    """Length and positional filters for sets of n and m whose first common shingle has places i and j, in SQL."""
    return f"100L * least({n}, {m}) >= {percent}L * greatest({n}, {m}) AND least({n} - {i}, {m} - {j}) >= {_needed(n, m, percent)}"


def _suffix_passes(x: str, y: str, percent: int) -> str:
    """Suffix filter, in SQL: shingles in one set only number the sets' own ones and the differences of the ranges at least."""
    apart = f"{x}alone + {y}alone + aggregate(zip_with({x}ranges, {y}ranges, (p, q) -> abs(p - q)), 0, (s, p) -> s + p)"
    return f"{apart} <= {x}n + {y}n - 2 * {_needed(f'{x}n', f'{y}n', percent)}"


def verified_links(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: the suffix filter on narrow rows, then each pair's sets are compared once."""
    side = lambda c: classes.select(F.col("cid").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("n", "alone", "ranges")])
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_suffix_passes("a_", "b_", percent)).select("a", "b", "a_n", "b_n")
    sets = lambda c: classes.select(F.col("cid").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    full = near.join(sets("a"), "a").join(sets("b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            x, y, n, m = (batch.column(i).to_pylist() for i in (4, 5, 2, 3))
            common = np.array([int(member(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)).sum()) for p, q in zip(x, y, strict=True)], np.int64)
            links = 100 * common >= percent * (np.array(n, np.int64) + np.array(m, np.int64) - common)
            yield batch.select(["a", "b"]).filter(pa.array(links))

    return full.select("a", "b", "a_n", "b_n", "a_tokens", "b_tokens").mapInArrow(compare, "a binary, b binary")


def _pairs(met: DataFrame, x: str, y: str) -> DataFrame:
    return met.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def class_components(classes: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) of classes that link with another, exactly; null if none does."""
    lists = classes.select("cid", "n", "alone", F.explode("prefix").alias("p")).select("cid", "n", "alone", "p.token", "p.pos")
    own_share = (F.col("alone") / F.col("n")).alias("share")
    heads = lists.groupBy("token").agg(F.min(F.struct(own_share, "cid", "n", "pos")).alias("h"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", F.col("h.cid").alias("head"), F.col("h.n").alias("head_n"), F.col("h.pos").alias("head_pos"))
    listed = checkpointed(lists.join(heads, "token").where("cid <> head"))
    tried = checkpointed(_pairs(listed.where(_passes("n", "pos", "head_n", "head_pos", percent)), "cid", "head"))
    stars = checkpointed(verified_links(tried, classes, percent))
    found = connected_components(stars)
    # a head has met its whole list, whatever came of it; the others are left
    left = listed.select("token", "cid", "n", "pos")
    named = left.withColumn("component", F.col("cid")) if found is None else left.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = checkpointed(named)
    each = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("s"))
    state = each.groupBy("token").agg(F.sum("s").alias("m"), F.max(F.struct("s", "component")).alias("top")).where("m > top.s").select("token", F.col("top.component").alias("largest"))
    active = named.join(state, "token").join(classes.select("cid", "alone", "ranges"), "cid").withColumn("out", F.col("component") != F.col("largest"))
    active = checkpointed(active.select("token", "cid", "n", "pos", "alone", "ranges", "component", "out"))
    # set sizes that may link with x whose first common shingle is this one, in bands of some six percent
    band = lambda size: f"cast(floor(16 * ln({size})) AS int)"
    sizes = active.where("out").withColumns({"low": F.expr(f"({percent}L * n + 99) div 100"), "high": F.expr(f"least({100 + percent}L * (n - pos) div {percent} - n, 100L * n div {percent})")}).where("low <= high")
    x = sizes.select("token", F.explode(F.expr(f"sequence({band('low')}, {band('high')})")).alias("band"), *[F.col(c).alias(f"x_{c}") for c in ("cid", "n", "pos", "alone", "ranges", "component")])
    y = active.select("token", F.expr(band("n")).alias("band"), *[F.col(c).alias(f"y_{c}") for c in ("cid", "n", "pos", "alone", "ranges", "component", "out")])
    apart = F.expr(f"x_component <> y_component AND (NOT y_out OR x_cid < y_cid) AND {_passes('x_n', 'x_pos', 'y_n', 'y_pos', percent)} AND {_suffix_passes('x_', 'y_', percent)}")
    met = x.join(y, (x["token"] == y["token"]) & (x["band"] == y["band"]) & apart)
    more = checkpointed(verified_links(_pairs(met, "x_cid", "y_cid").join(tried, ["a", "b"], "left_anti"), classes, percent))
    discard(listed, tried, named, active)
    return connected_components(stars.unionByName(more)) if more.limit(1).count() else found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document: id, key (a hash of id and text), n_shingles, component_id (smallest id of its
    near-duplicate class), and component (a name of the class; null without shingles)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1 to 100")
    width = shuffle_width(docs.sparkSession)
    batches, buckets = 4 * width, max(1, width // 2)
    every = checkpointed(sketches(docs, id_col, text_col, batches))
    classes = every.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.min("batch").alias("batch"))
    rows = docs.select(batch_of(F.col(id_col), F.col(text_col), batches=batches).alias("batch"), F.col(text_col).alias("body"))
    indexed = checkpointed(indexed_classes(rows, classes.select("batch", "digest"), size, percent, buckets))
    found = class_components(indexed.where("tokens IS NOT NULL"), percent)
    # classes alone are named by their own least id; others by that of their component
    sized = indexed.select(F.col("cid").alias("digest"), "n").join(classes.select("digest", "least"), "digest")
    if found is None:
        named = sized.select("digest", "n", F.col("digest").alias("component"), F.col("least").alias("component_id"))
    else:
        linked = checkpointed(found.withColumnRenamed("node", "digest").join(classes.select("digest", "least"), "digest"))
        names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
        named = sized.join(linked.join(names, "component").select("digest", "component", "component_id"), "digest", "left")
        named = named.select("digest", "n", F.coalesce("component", "digest").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    back = every.join(named, "digest", "left")
    return back.select("id", "key", F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each near-duplicate class, that with the smallest id; rows without words stay.

    Rows that are equal in id and text count as one and leave one row."""
    no_clash(docs, ["_row_key", "_kept_key"])
    near = near_duplicates(docs, id_col, text_col, size, percent)
    firsts = near.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")).select(F.col("first.key").alias("_kept_key"))
    kept = firsts.unionByName(near.where("component IS NULL").select(F.col("key").alias("_kept_key"))).distinct()
    keyed = docs.withColumn("_row_key", F.xxhash64(id_col, text_col))
    return keyed.join(kept, F.col("_row_key") == F.col("_kept_key"), "left_semi").dropDuplicates(["_row_key"]).drop("_row_key")
