"""Substring dedup, the Jaccard join, toxicity and packing against plain versions."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellisway.llm import jaccard_join as jj
from trellisway.llm import packing as pk
from trellisway.llm import toxicity as tx
from trellisway.llm.substring_dedup import substring_dedup


def corpus(rng, n=60):
    words = [f"w{k}é" for k in range(30)] + ["a", "b"]
    shared = rng.choices(words, k=90)
    rows = []
    for k in range(n):
        w = rng.choices(words, k=rng.randrange(0, 120))
        if k % 3 == 0:
            at, a = rng.randrange(len(w) + 1), rng.randrange(40)
            w[at:at] = shared[a : a + rng.randrange(30, 50)]
        rows.append((k, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[0][1]), (102, None), (103, ""), (104, " \n"), (None, rows[3][1]), (105, " ".join(shared * 3))]
    return rows


@pytest.mark.parametrize("window", [35, 5, 2])
def test_substring_dedup(spark, window):
    rows = corpus(random.Random(window))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"batch": F.lit(1), "hashes": F.lit("x"), "body": F.lit(None).cast("string")})
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    expected = Counter()
    for (d, t), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[d, t, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    out = substring_dedup(df, window=window, new_text=True)
    assert out.columns[: len(df.columns)] == df.columns
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.dedup_n_words, r.dedup_n_removed, r.dedup_kept_sha256) for r in got) == expected
    for r in got:
        assert sum(b - a for a, b in r.dedup_spans) == r.dedup_n_removed
        assert hashlib.sha256(b" ".join((r.dedup_text or "").encode().split())).hexdigest() == r.dedup_kept_sha256
        assert r.dedup_n_removed or r.dedup_text == r.text
    assert substring_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(df.withColumn("DEDUP_n_words", F.lit(1)))


def plain_components(rows, size=5, percent=80):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return Counter((d, len(s), smallest[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(rng):
    rows, k = [], 0
    for _ in range(8):
        base = [f"{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append((k, " ".join(w).replace("x", rng.choice("xX"))))
            k += 1
            if rng.random() < 0.3:
                base = w
    return [*rows, (500, None), (501, ""), (502, "one two"), (503, "ONE  two"), (503, "one two"), (None, rows[0][1]), (None, "alone here"), (504, "é " * 30), (505, "é " * 31)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = near_copies(random.Random(seed))
    if seed == 2:  # one group of which many pairs are about the threshold, and a chain
        rng = random.Random(7)
        base = [f"{rng.randrange(400)}" for _ in range(120)]
        for k in range(600, 660):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"y{rng.randrange(9)}"
            rows.append((k, " ".join(w)))
            base = w if k % 9 == 0 else base
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "batch": F.lit(2), "digest": F.lit("d")})
    got = Counter((r.id, r.n_shingles, r.component_id) for r in jj.near_duplicates(df).collect())
    assert got == plain_components(rows)


def test_components_of_chains(spark):
    rng = random.Random(5)
    links = [(a, a + 1) for a in range(0, 40) if a != 17] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)]
    rng.shuffle(links)
    df = spark.createDataFrame([(str(a).encode(), str(b).encode()) for a, b in links], "a binary, b binary")
    root = {x: x for link in links for x in link}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        root[find(a)] = find(b)
    groups, sought = defaultdict(set), defaultdict(set)
    for r in jj.connected_components(df).collect():
        groups[bytes(r.component)].add(int(r.node))
    for x in root:
        sought[find(x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, (v for v in sought.values() if len(v) > 1)))
    assert jj.connected_components(df.limit(0)) is None


def test_shingles_of_more_texts_than_fit_the_packed_sort():
    n = (1 << 20) + 5
    doc, _, _ = jj.shingle_sets([b"a"] * (n - 3) + [b"a b a b a b"] * 3, 2)
    assert np.array_equal(doc, np.concatenate([np.arange(n - 3), np.repeat(np.arange(n - 3, n), 2)]))


def test_one_of_each(spark):
    rows = near_copies(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_kept_", F.lit(1))
    kept = jj.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(str(r.doc_id) for r in kept.collect())
    classes = {c for d, n, c in plain_components(rows) if n and c is not None}
    assert got == sorted([*map(str, classes), "500", "501", "None"])
    assert jj.near_duplicates(df.limit(0)).count() == 0


def test_search_equals_all_paths():
    rng, gen = random.Random(9), np.random.default_rng(9)
    lm = tx.language_model(gen.integers(0, 50, (tx.K,) * 3) * (gen.random((tx.K,) * 3) < 0.1))
    for _ in range(120):
        token = "".join(rng.choice("abl1!3@.*#-|z") for _ in range(rng.randrange(1, 4)))
        token += rng.choice(["", "*", "aa", "*a", "##"])
        paths = {"": [((0, 0), 0.0)]}  # text -> its states with scores
        every = [("", 0, 0, 0.0)]
        for k in range(len(token)):
            step = []
            for text, a, b, s in every:
                for x, cost in tx.choices(token, k):
                    i = tx._ID[x] if x else 0
                    step.append((text + x, b, i, s + cost + float(lm[a, b, i])) if x else (text, a, b, s + cost))
            every = step
        paths = defaultdict(lambda: -np.inf)
        for text, a, b, s in every:
            paths[text] = max(paths[text], s + float(lm[a, b, 0]))
        best = sorted(((s, t) for t, s in paths.items()), key=lambda p: -p[0])
        got = tx.restore(token, lm)
        sought = [t for _, t in best if t][:3]
        assert np.allclose([paths[t] for t in got], [paths[t] for t in sought]), (token, got, sought)


def test_long_tokens_are_read_in_bounded_time():
    lm = tx.language_model(np.ones((tx.K,) * 3))
    began = time.perf_counter()
    for token in ("a" + "*" * 40 + "b", "a" + "#*" * 300 + "b", "a" + "#" * 5000 + "b", "1d10t" * 20_000, "x1" * 50_000):
        tx.readings(token, lm)
    tx.Restored(["i " * 30_000, "a" + "*" * 30_000 + "b"], lm, {})
    assert time.perf_counter() - began < 60


def test_words_inside_long_tokens():
    clean = "you are a stupid idiot and a pathetic moron the worthless scum is trash " * 40
    codes = np.array([tx._ID.get(c, 0) for c in clean])
    counts = np.zeros((tx.K,) * 3)
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    lm = tx.language_model(counts)
    for lead in (1, 40, 70, 101):
        assert any("1d10t" not in x and "idiot" in x for x in tx.readings("m" * lead + "1d10t" + "m" * 90, lm)), lead


def test_restoring_obfuscated_words():
    clean = "you are a stupid idiot and a pathetic moron the worthless scum is trash " * 40
    codes = np.array([tx._ID.get(c, 0) for c in clean])
    counts = np.zeros((tx.K,) * 3)
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    lm = tx.language_model(counts)
    for token, word in {"1d10t": "idiot", "$tup1d": "stupid", "m0r0n": "moron", "stuuupid": "stupid", "i.d.i.o.t": "idiot", "tr@sh": "trash", "p-a-t-h-e-t-i-c": "pathetic", "sc*m": "scum", "w0r7hl3ss": "worthless"}.items():
        assert word in tx.readings(token, lm), token
    known: dict = {}
    spaced = tx.Restored(["so i d i o t yes", None, "", "!!! 123", "idiot"], lm, known)
    assert "idiot" in known["idiot"]
    assert set(spaced.doc) == {0, 4}
    assert set(spaced.hashes[0][spaced.doc == 4]) & set(spaced.hashes[0][spaced.doc == 0])


def test_words_spelled_out_one_after_another():
    clean = "you are a stupid idiot and a pathetic moron the worthless scum is trash " * 40
    codes = np.array([tx._ID.get(c, 0) for c in clean])
    counts = np.zeros((tx.K,) * 3)
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    lm = tx.language_model(counts)
    hashes = lambda text: set(tx.Restored([text], lm, {}).hashes[0].tolist())
    for text in ("y o u i d i o t", "y.o.u.i.d.i.o.t", "y-o-u-1-d-1-0-t", "a s t u p i d i d i o t", "you-1d10t", " ".join("youare" * 20 + "youidiot" + "youare" * 20)):
        assert hashes("idiot") <= hashes(f"so {text} yes"), text
    assert hashes("stupid") <= hashes("a s t u p i d i d i o t")


def test_search_with_boundaries_equals_all_paths():
    rng, gen = random.Random(19), np.random.default_rng(19)
    lm = tx.language_model(gen.integers(0, 50, (tx.K,) * 3) * (gen.random((tx.K,) * 3) < 0.1))
    for _ in range(80):
        token = "".join(rng.choice("abl1.- ") for _ in range(rng.randrange(1, 7))) + rng.choice("ab3")
        every = [("", 0, 0, 0.0)]
        for k in range(len(token)):
            step = []
            for text, a, b, s in every:
                for x, cost in tx.choices(token, k, True):
                    if x == " " and b == 0:
                        continue
                    i = tx._ID.get(x, 0)
                    step.append((text + x, b, i, s + cost + float(lm[a, b, i])) if x else (text, a, b, s + cost))
            every = step
        paths = defaultdict(lambda: -np.inf)
        for text, a, b, s in every:
            paths[text] = max(paths[text], s + (float(lm[a, b, 0]) if b or not a else 0.0))
        sought = [t for _, t in sorted(((s, t) for t, s in paths.items()), key=lambda p: -p[0]) if t][:3]
        got = tx.restore(token, lm, apart=True)
        assert np.allclose([paths[t] for t in got], [paths[t] for t in sought]), (token, got, sought)


def test_every_sign_of_the_channel_makes_a_token_suspicious():
    clean = "you are a stupid idiot and a loser with an ass the worthless scum is trash él es añññejo " * 40
    codes = np.array([tx._ID.get(c, 0) for c in clean])
    counts = np.zeros((tx.K,) * 3)
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    lm = tx.language_model(counts)

    def words(text):
        return set(tx.Restored([text], lm, {}).hashes[0].tolist())

    hidden = {
        "idi07": "idiot", "1053r": "loser", "a$$": "ass", "5(um": "scum", '"$tupid"': "stupid", "idio7.": "idiot", "idi07!!": "idiot", "(idio7)": "idiot", "!diot,": "idiot", "idio*": "idiot",
        "id\u200biot": "idiot", "stu\u00adpid": "stupid", "los€r": "loser", "s¢um": "scum", "a§s": "ass", "a§§": "ass", "st\u00b5pid": "stupid", "£oser": "loser",
        "“idio7”": "idiot", "ééél": "él", "£ o s € r": "loser",
    }
    for token, word in hidden.items():
        assert words(word) <= words(f"so {token} yes"), token
    for token in ("“idiot”", "idiot!", "'idiot',", "¿idiot?", "idiot…", "\u200bidiot"):
        assert words(token) == words("idiot"), token
    for token in ("мир", "naïve", "não"):
        known: dict = {}
        tx.Restored([token], lm, known)
        assert not known, token


def plain_score(text, model):
    """The score of one text, word by word: strings and their weights in place of arrays."""
    weight = dict(zip(model["features"].tolist(), model["weights"].tolist(), strict=True))

    def best(word):
        w = tx.Words([word.encode()])
        if not len(w.start):
            return 0.0
        hashes = [tx.mix64(tx.spellings(w.data, w.start, w.end), 1)[0], *(tx._first_bytes(w, w.start, w.end, n)[0] for n in (4, 5))]
        return max(weight.get(int(h), 0.0) for h in hashes)

    tokens = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    found = []
    for token in tokens:
        kinds = [tx._kind(c) for c in token]
        lo = next((k for k, x in enumerate(kinds) if x != tx._PLAIN), len(kinds))
        hi = max((k + 1 for k, x in enumerate(kinds) if x not in (tx._PLAIN, tx._FINAL)), default=0)
        core, inner = token[lo:hi], kinds[lo:hi]
        if tx._LETTER not in inner:
            continue
        thrice = any(a == b == c and x == tx._LETTER for a, b, c, x in zip(core, core[1:], core[2:], inner[2:], strict=False))
        found += tx.readings(token, model["lm"]) if thrice or any(x != tx._LETTER for x in inner) else [core]
    for one, run in itertools.groupby(tokens, lambda w: len(w) == 1):
        run = "".join(run) if one else ""
        if len(run) >= 3:
            found += [x for part in dict.fromkeys((run, run[1:], run[:-1])) if tx._PIECES.search(part) for x in tx.restore(part, model["lm"])]
            found += tx.words_apart(" ".join(run), model["lm"])
    weights = [best(w) for w in found]
    return 1 / (1 + np.exp(-np.clip(np.array([max(weights, default=0.0), np.log1p(sum(weights)), 1]) @ model["fit"], -30, 30)))


def test_toxicity(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randrange(3, 8))) for _ in range(300)]
    bad, hidden = ["grumblefool", "snortling"], ["gr0mblef00l", "grumbl3fool", "s n o r t l i n g", "snooortling", "sn0rtl1ng", "grumble-fool"]
    rows, labels = [], []
    for k in range(700):
        w = rng.choices(words, k=40)
        toxic = k % 4 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(bad if rng.random() < 0.7 else hidden)
        rows.append((k, " ".join(w), "en" if toxic else "fr"))
        labels.append((k, int(toxic)))
    rows += [(9000, None, None), (9001, "", None), (None, "x", None), (9001, "", None)]
    labels += [(None, 1), (12345, 1), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.train(docs, marks)
    out = tx.score(docs, model, prefix="t_")
    assert out.columns == [*docs.columns, "t_held_out", "t_score", "t_predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.t_score <= 1 and r.t_predicted == int(r.t_score >= 0.5) for r in got)
    assert all(r.t_held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.t_predicted, r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 700 and r.t_held_out]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert len({r.t_score for r in got if r.doc_id in (9000, 9001)}) == 1
    assert model["fit"] is not None and all(abs(r.t_score - plain_score(r.text, model)) < 1e-9 for r in got)
    with pytest.raises(ValueError):
        tx.score(docs, {"fit": None})
    none = tx.train(docs, marks.limit(0))
    assert {r.score2 for r in tx.score(docs.drop("score"), none).select(F.col("score").alias("score2")).collect()} == {0.0}
    assert tx.score(docs.limit(0).drop("score"), none).count() == 0


def test_a_bounded_sample_keeps_the_odds_of_all_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "a plain text") for k in range(600)], "doc_id long, text string")
    labels = [(k, int(k % 10 == 0)) for k in range(600)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    used = [t for k, t in labels if zlib.crc32(str(k).encode()) % 5]
    monkeypatch.setattr(tx, "_logistic", lambda x, y: np.zeros(3))
    whole, cut = tx.train(docs, marks), tx.train(docs, marks, most_toxic=30, most_clean=45)
    assert whole["prior"] == cut["prior"] == sum(used) / len(used)
    assert np.allclose(whole["fit"], 0)
    toxic, clean = sum(used), len(used) - sum(used)
    assert np.allclose(cut["fit"], [0, 0, np.log(toxic / min(30, toxic)) - np.log(clean / 45)])


TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_packing_round_trip(spark):
    rng = random.Random(8)
    odd = ["It's A test, isn't it? 12.5% don't!? ...", "É́ é J̌ ǰ İstanbul ΣΑΣ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "x" * 900 + " … “quoted”. a b c", "́a .. b,c d.", None, "", " \n\t"]
    texts = [*odd, *[" ".join(rng.choices(["alpha", "Beta,", "gamma.", "déjà", "1st", "?"], k=rng.randrange(300))) for _ in range(60)], "long text " * 700]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "piece": F.lit("y")})
    pieces = pk.token_pieces(df, TOKENIZER, capacity=256, with_ids=True)
    got = pk.packed(pieces, 256).collect()
    expected = Counter()
    for (d, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        for n, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            expected[d, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.03 * -(-sum(r.length for r in got) // 256) + 1
    assert pk.packed(pk.token_pieces(df.limit(0), TOKENIZER)).count() == 0


def _fewest(items, capacity):
    """The least number of bins, by trying all ways."""
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
            go(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_least_number_of_bins():
    rng = random.Random(6)
    fixed_some = 0
    for _ in range(150):
        items = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))), reverse=True)
        fixed, left = pk.reduce_instance(dict(Counter(items)), 20)
        used = Counter()
        for bin_, n in fixed:
            assert sum(bin_) <= 20
            for x in bin_:
                used[x] += n
        assert used + Counter(left) == Counter(items)
        fixed_some += bool(fixed)
        assert sum(n for _, n in fixed) + _fewest(sorted(Counter(left).elements(), reverse=True), 20) == _fewest(items, 20)
        plan = pk.packing_plan(dict(Counter(items)), 20)
        assert Counter({k: 0 for k in set(items)}) + Counter({k: sum(hi - lo for j, lo, hi, *_ in plan if j == k) for k in set(items)}) == Counter(items)
    assert fixed_some > 100
