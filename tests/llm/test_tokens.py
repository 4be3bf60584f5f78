"""Encoding, decoding, alignment and collocations against the tokenizers themselves and plain versions."""

import hashlib
import random
import re
from collections import Counter
from itertools import accumulate
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from trellisway.llm import alignment, bpe, phrases
from trellisway.llm.queries import QUERIES

PIECE = public_tokenizers.path("piece_bpe_32k.model")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftext", "'s'll  it's\t\n\n x", "a" * 3000, " " * 700, "\x1c\x85\x00▁﻿",
    "nö \U0001f642\U0001f642 中文 १२ ½", "ababababab" * 400, "the same", "the same",
]


def odd_texts(n=300):
    rng = random.Random(4)
    signs = "abc '.stlen\n\t éßи中🙂1२<|>!?,;:\x1c\x85\x00▁"
    return [*ODD, *("".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(n))]


def docs(spark, texts, more=""):
    return spark.createDataFrame([(k, t, *(["x"] * bool(more))) for k, t in enumerate(texts)], f"doc_id long, text string{more}")


def test_merges_are_those_of_the_definition():
    """Against a search of all pairs for each merge, on words that grow with the trees, alone and side by side."""
    rng = random.Random(9)
    merges, ids = [], {(): 0}
    for k in range(120):
        a, b = rng.randrange(4 + k), rng.randrange(4 + k)
        merges.append((a, b, 4 + k))
    tree = bpe.MergeTree(merges)
    del ids

    def plain(word):
        word, rank = list(word), {}
        for k, (a, b, whole) in enumerate(merges):
            rank.setdefault((a, b), (k, whole))
        while found := min(((*rank[p], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in rank), key=lambda x: (x[0], x[2]), default=None):
            word[found[2] : found[2] + 2] = [found[1]]
        return word

    words = [[rng.randrange(4) for _ in range(n)] for n in [1, 2, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 18, 33, 64, 65, 66, 130] for _ in range(6)]
    want = [plain(w) for w in words]
    assert [tree(list(w)) for w in words] == want
    flat = np.concatenate([np.array(w, np.int64) for w in words])
    got = tree.forest(flat, np.array([len(w) for w in words]))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert bpe.MergeTree([])([1, 2]) == [1, 2] and tree.forest(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []


@pytest.mark.parametrize("special", [True, False])
def test_ids_are_those_of_the_library(spark, special):
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = not special
    texts = odd_texts()
    found = bpe.encoded(docs(spark, texts, ", Note string").repartition(3), BYTE, special=special)
    rows = {r.doc_id: r for r in bpe.decoded(found, BYTE).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (rows[k].bpe_ids, rows[k].bpe_n_tokens, rows[k].Note) == (ids, len(ids), "x"), repr(t)
        assert rows[k].bpe_text == library.decode(ids, skip_special_tokens=False) == (t or "")


def test_long_texts_and_forgotten_words(monkeypatch):
    library = Tokenizer.from_file(BYTE)
    monkeypatch.setattr(bpe, "_LONG", 64)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own, rng = bpe.ByteBpe(BYTE), random.Random(2)
    texts = ["".join(rng.choice(["ab", " cd", "  ", "<|endoftext|>", "\n", str(rng.randrange(999))]) for _ in range(400)) for _ in range(5)]
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [own.decode(x) for x in got] == texts and len(own.known) < 1000


def test_unknown_ids_clashes_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [64, 50256, 50257, -1, 1 << 40, None]), (2, []), (3, None), (4, [160])], "k long, bpe_ids array<long>")
    library = Tokenizer.from_file(BYTE)
    got = {r.k: r.bpe_text for r in bpe.decoded(rows, BYTE).collect()}
    assert got == {1: library.decode([64, 50256], skip_special_tokens=False), 2: "", 3: "", 4: library.decode([160], skip_special_tokens=False)}
    with pytest.raises(ValueError):
        bpe.encoded(rows.selectExpr("'' AS text", "1 AS BPE_ids"), BYTE)
    assert bpe.decoded(bpe.encoded(docs(spark, []), BYTE), BYTE).collect() == []


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")
def test_op11_is_the_library_on_the_smallest_tables(spark):
    library = Tokenizer.from_file(BYTE)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(tuple(r) for r in QUERIES["op11_byte_bpe"](spark, DATA).collect()) == sorted(want)


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, longest, least, most, covered):
    """By their definition, in plain Python."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    whole = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, w), a in whole.items():
        if any(100 * b >= covered * a for (x, v), b in whole.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    ranked = [(lang, [x for x in sorted(out) if x[0] == lang][:most]) for lang in {x[0] for x in out}]
    return sorted((lang, k, x[3].decode(), -x[2], x[4], x[5], total[lang], -x[1]) for lang, best in ranked for k, x in enumerate(best, 1))


def speech(seed, n):
    rng = random.Random(seed)
    words = [*"abcdefg", "É", "new", "York", "NEW", "york", "the", "\U0001f642", "word" * 30]
    sentence = lambda: rng.choice([" ", "  ", "\t"]).join(rng.choice(["new York city", "the a b", rng.choice(words), rng.choice(words)]) for _ in range(rng.randrange(9)))
    return [(rng.choice(["en", "en", "en", None, "und", "de"]), rng.choice([".", "\n", "!", ", ", "\x0b"]).join(sentence() for _ in range(rng.randrange(5)))) for _ in range(n)]


@pytest.mark.parametrize(("bits", "most"), [(64, 2000), (64, 5), (9, 2000)])
def test_collocations_are_those_of_the_definition(spark, monkeypatch, bits, most):
    """With fingerprints of nine bits nearly all stand for several phrases, which are told apart by their text."""
    monkeypatch.setattr(phrases, "_BATCH", 3000)
    rows = [*speech(6, 250), ("en", None), ("en", ""), ("fr", " .\n"), *[("en", "To be or not to be; To be")] * 40, ("long", "x y " * 3000)]
    df = spark.createDataFrame([(1, *r, "n") for r in rows], "phrase int, lang string, text string, Key string").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, longest=4, least=20, most=most, bits=bits).collect())
    assert got == plain_collocations(rows, 4, 20, most, 80) and len(got) > 10


def test_collocations_with_small_tables_blocks_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    monkeypatch.setattr(phrases, "BLOCK", 3)
    rows = speech(8, 120)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = plain_collocations(rows, 3, 10, 100, 50)
    for bits in (64, 5):
        assert sorted(tuple(r) for r in phrases.collocations(df, 3, 10, 100, 50, bits=bits).collect()) == want
    assert phrases.collocations(df.limit(0)).collect() == [] and phrases.collocations(df, least=10**6).collect() == []


# ---------------------------------------------------------------- alignment


@pytest.mark.parametrize("work", [1, 2, 3, 7, 1000])
def test_pieces_of_the_merge_path_give_what_the_whole_gives(work):
    rng = random.Random(work)
    for n in (1, 2, 5, 40):
        a, b = (np.array(sorted({*rng.sample(range(1, 2 * n), rng.randrange(n)), 2 * n})) for _ in range(2))
        i, j = alignment.merge_path(a, b, work)
        merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        assert (i + j).tolist() == [*range(0, len(merged), work), len(merged)]
        assert all(sum(side == 0 for _, side in merged[:d]) == x for d, x in zip((i + j).tolist(), i.tolist(), strict=True))
        found = alignment.links_and_groups(a, b, work)
        spans = lambda ends: list(zip([0, *ends.tolist()], ends.tolist(), strict=False))
        links = [(x, y) for x, (s, e) in enumerate(spans(a)) for y, (u, v) in enumerate(spans(b)) if s < v and u < e]
        assert sorted(zip(found[0].tolist(), found[1].tolist(), strict=True)) == links
        assert list(zip(found[2].tolist(), found[3].tolist(), strict=True)) == [(a.tolist().index(x), b.tolist().index(x)) for x in sorted({*a.tolist()} & {*b.tolist()})]


def plain_alignment(texts):
    """Token by token with the libraries; (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    a_library, b_library, signs = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE), bpe.byte_signs()
    a_library.encode_special_tokens = True
    b_bytes = lambda k: bytes([int(b_library.id_to_piece(k)[3:5], 16)]) if b_library.is_byte(k) else b_library.id_to_piece(k).replace("▁", " ").encode()
    out, linked, holding = [], [], Counter()
    for t in texts:
        data = f" {t or ''}".encode()
        a, b = a_library.encode(data.decode(), add_special_tokens=False).ids, b_library.encode(t or "")
        sides = [[bytes(signs[c] for c in a_library.id_to_token(k)) for k in a], [b_bytes(k) for k in b]]
        if not t or any(b"".join(x) != data for x in sides):
            a, b, sides = [], [], [[], []]
        ends = [list(accumulate(map(len, x))) for x in sides]
        spans = [list(zip([0, *e], e, strict=False)) for e in ends]
        links = [(a[x], b[y]) for x, (s, e) in enumerate(spans[0]) for y, (u, v) in enumerate(spans[1]) if s < v and u < e]
        cuts = sorted({*ends[0]} & {*ends[1]})
        side = lambda ids, e, low, high: ",".join(str(k) for k, x in zip(ids, e, strict=True) if low < x <= high)
        groups = ";".join(f"{side(a, ends[0], low, high)}|{side(b, ends[1], low, high)}" for low, high in zip([0, *cuts], cuts, strict=False))
        linked.append(links)
        holding.update(set(links))
        out.append((len(a), len(b), len(cuts), len(links), hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    best = {}
    for (x, _), n in holding.items():
        best[x] = max(n, best.get(x, 0))
    return [(*r[:4], sum(holding[k] == best[k[0]] for k in links), sum(holding[k] for k in links), r[4]) for r, links in zip(out, linked, strict=True)]


@pytest.mark.parametrize("sent", [1 << 21, 0])
def test_alignment_is_that_of_single_tokens(spark, monkeypatch, sent):
    monkeypatch.setattr(alignment, "MOST_SENT", sent)
    monkeypatch.setattr(alignment, "PIECE", 5)
    texts = [*odd_texts(150), *["The quick brown fox, naïvely"] * 30, "it's a ▁ sign", "x " * 400, "tail "]
    got = {r.doc_id: r for r in alignment.aligned(docs(spark, texts, ", N_a string").repartition(3), BYTE, PIECE).collect()}
    names = [f"align_{c}" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]
    assert [tuple(got[k][c] for c in names) for k in range(len(texts))] == plain_alignment(texts)
    assert got[0].N_a == "x" and "text" not in got[0]


def test_pieces_are_encoded_as_the_library_does(monkeypatch):
    library, own = SentencePieceProcessor(model_file=PIECE), alignment.PieceBpe(PIECE)
    texts = [t or "" for t in odd_texts(3000)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t) for t in texts]
        monkeypatch.setattr(bpe, "_LONG", 16)
        monkeypatch.setattr(bpe, "REMEMBERED", 40)


def test_alignment_of_no_rows_and_clashes(spark):
    assert alignment.aligned(docs(spark, []), BYTE, PIECE).collect() == []
    with pytest.raises(ValueError):
        alignment.aligned(spark.createDataFrame([("", 1)], "text string, Align_Row int"), BYTE, PIECE)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")
def test_op13_is_the_plain_version_on_the_smallest_tables(spark, tmp_path):
    rows = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 3000]
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows).write.parquet(folder)
    got = {r.doc_id: r for r in QUERIES["op13_tokenizer_alignment"](spark, folder.rsplit("/", 1)[0]).collect()}
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(got[r.doc_id][c] for c in names) for r in rows] == plain_alignment([r.text for r in rows])
