"""WARC round trips, nearest neighbours, and the pipeline's stages."""

import gzip
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_native import _plain_overlaps as plain_overlaps
from tests.llm.test_texts import plain_components
from trellisway.llm import neighbours as nn
from trellisway.llm import warc
from trellisway.llm.queries import read_back


@pytest.mark.parametrize("segment, chunk", [(1 << 18, 1 << 13), (97, 10), (1000, 3)])
def test_warc_round_trip(spark, segment, chunk):
    rng = random.Random(1)
    long = "".join(rng.choice("abc\r\né<>") for _ in range(3000))
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n0\r\n\r\n" * 3
    rows = [(5, "http://a/", long), (3, "http://b/\r\nX: y", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", tricky), (None, "n", long), (8, "u", tricky), (8, "u", tricky)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record_type": F.lit("x"), "digest": F.lit("y")})
    with pytest.raises(ValueError):
        warc.revisit_types(pages)
    typed = warc.revisit_types(pages, prefix="w_")
    assert typed.where("record_type = 'x' AND digest = 'y'").count() == len(rows)
    path = warc.archive_folder(spark)
    warc.write_archives(typed.select(F.col("page_id").cast("string").alias("key"), "url", F.col("html").alias("payload"), F.col("w_record_type").alias("record_type"), F.col("w_refers_to").cast("string").alias("refers_to")), path, segment, chunk, records_per_file=4)
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    body = {(None if i is None else str(i)): (h or "").encode() for i, _, h in rows}
    first = {"5": "3", "9": "3", "8": "7"}
    for r in got:
        assert r.stated_digest == hashlib.sha256(body[r.key]).hexdigest() and r.stated_bytes == len(body[r.key])
        assert r.refers_to == first.get(r.key) and r.record_type == ("revisit" if r.key in first else "response")
        if r.record_type == "response":
            assert bytes(r.payload) == body[r.key] and r.payload_digest == r.stated_digest and r.payload_bytes == r.stated_bytes
        else:
            assert r.payload is None and r.payload_digest is None
    assert Counter(r.key for r in got)["8"] == 2
    assert any("%0D%0A" in (r.url or "") for r in got) and any(r.url is None for r in got)
    # each record, and each end mark, is a gzip member
    for r in spark.read.format("binaryFile").load(path).collect():
        data, members = bytes(r.content), []
        while data:
            one = zlib.decompressobj(31)
            members.append(one.decompress(data))
            assert one.eof
            data = one.unused_data
        assert all(m.startswith(warc.VERSION) for m in members[::2]) and set(members[1::2]) <= {warc.END}


def test_records_without_ids(spark, tmp_path):
    make = lambda n: next(warc.records(str(n), "u", b"p%d" % n, "response", None, "<id>", 1000, 16, "d")).replace(b"WARC-Record-ID: <id>\r\n", b"")
    (tmp_path / "a.warc").write_bytes(b"".join(make(n) + warc.END for n in range(3)))
    got = warc.read_archives(spark, str(tmp_path), with_payload=True).collect()
    assert sorted((r.key, bytes(r.payload), r.complete) for r in got) == [(str(n), b"p%d" % n, True) for n in range(3)]


def test_broken_archives(spark, tmp_path):
    make = lambda n, body: list(warc.records(str(n), "u", body, "response", None, f"<r{n}>", 60, 16, "d"))
    a, b, c = make(1, b"x" * 300), make(2, b"y" * 300), make(3, b"z" * 20)
    kept = [*a[:2], *a[3:], *reversed(b), *[r.replace(b"10\r\nz", b"1x\r\nz") for r in c]]
    data = b"".join(r + warc.END for r in kept)
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(data[:200]) + gzip.compress(data[200:]))
    (tmp_path / "two.warc").write_bytes(b"".join(r + warc.END for r in make(4, b"plain"))[:-30])
    got = {r.key: r for r in warc.read_archives(spark, str(tmp_path), with_payload=True).collect()}
    assert got["1"].complete is False and got["1"].payload is None
    assert bytes(got["2"].payload) == b"y" * 300 and got["2"].complete
    assert got["3"].complete is False
    assert warc.dechunked(warc.chunked(b"abc" * 50, 7)) == b"abc" * 50
    assert warc.dechunked(b"3\r\nabc\r\n") is None and warc.dechunked(b"q\r\n") is None


def test_a_lost_record_is_not_reported_as_read(spark):
    schema = "key string, record_type string, refers_to string, stated_bytes long, stated_digest string, payload_bytes long, payload_digest string, complete boolean"
    rows = [("1", "response", None, 9, "x", 3, "d", True), ("2", "revisit", "1", 3, "d", None, None, None)]
    got = read_back(spark.createDataFrame(rows, schema)).collect()
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got] == [(1, 3, "d", None), (2, 3, "d", 1)]
    for complete in (False, None):
        with pytest.raises(Exception, match="not read back whole: 3"):
            read_back(spark.createDataFrame([("3", "response", None, 9, "x", None, None, complete)], schema)).collect()


@pytest.mark.parametrize("groups, block", [(16_384, 1_024), (40, 3)])
def test_neighbours_are_those_of_brute_force(spark, groups, block):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[100:130] = x[0]  # ties
    rows = [(int(k), [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(1000, None), (1010, []), (1020, [0.0] * 16), (1030, [float("nan")] * 16), (1040, [1.0] * 15 + [None]), (1050, [float("inf")] * 16), (None, rows[1][1]), (2000, [1.0, 2.0]), (2001, [1.0, 3.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"dim": F.lit(1), "code": F.lit("z"), "id": F.lit(3)})
    got = nn.nearest(df, F.col("vec_id") % 10 == 0, k=5, group_rows=groups, block_queries=block).collect()
    expected = []
    whole = [(k, np.array(v, np.float64)) for k, v in rows if k is not None and k < 300 and v] + [(2000, np.array([1.0, 2.0])), (2001, np.array([1.0, 3.0]))]
    for q, v in whole:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(np.add.accumulate((w - v) ** 2)[-1])), k) for k, w in whole if k != q and len(w) == len(v))[:5]
            expected += [(q, n, k, d) for n, (d, k) in enumerate(near, 1)]
    found, sought = {(r.query_id, r.rank, r.id): r.score for r in got}, {e[:3]: e[3] for e in expected}
    assert len(found) == len(sought)
    assert len(found.keys() & sought.keys()) >= 0.99 * len(sought)
    assert all(found[k] == sought[k] for k in found.keys() & sought.keys())
    assert nn.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("dim", [1, 7, 64, 65, 200])
def test_inner_products_from_packed_bits(dim):
    rng = np.random.default_rng(dim)
    for query in (rng.standard_normal(dim), np.zeros(dim), np.full(dim, -3.0), np.eye(dim)[0]):
        signs = rng.standard_normal((50, dim)) > 0
        codes = nn.bit_words(np.packbits(signs, axis=1))
        got, rounded = nn.bit_products(codes, np.bitwise_count(codes).sum(0, dtype=np.int64), query)
        assert np.abs(got - (signs * 2.0 - 1) @ query).max() <= rounded + 1e-9
        assert rounded <= dim * (query.max() - query.min()) / 510 + 1e-9


def plain_cut(rows, window=35):
    """The words that stay, of each text that keeps some or had none."""
    words = {d: (t or "").split() for d, t in rows}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        if len(gone) < len(w) or not w:
            out[d] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("aeioulmnrst", k=rng.randrange(3, 8))) for _ in range(400)]
    make = lambda n: rng.choices(vocabulary, k=n)
    passage, item = make(60), make(30)
    docs, labels = [], []
    for k in range(300):
        w = make(80)
        if k % 5 == 0:
            w[rng.randrange(80)] = "grumblefool"
        labels.append((k, 1, int(k % 5 == 0)))
        docs.append([k, " ".join(w)])
    docs[1][1] = docs[2][1] + " extra"  # near copies: 1 stays
    docs[3][1] += " " + " ".join(passage)
    docs[4][1] = " ".join(passage) + " " + docs[4][1]
    docs[6][1] += " " + " ".join(item)
    docs += [[900, None], [901, ""]]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, folder)
        assert out.columns == d.columns
        out.write.parquet(f"{folder}/{name}")
        before = [(r.doc_id, r.text) for r in kept.collect()]
        kept = spark.read.parquet(f"{folder}/{name}")
        after[name] = {r.doc_id: r.text for r in kept.collect()}
        # what a plain version of the stage makes of the same input
        if name == "jaccard_join":
            classes = {c for _, n, c in plain_components(before) if n}
            assert set(after[name]) == classes | {d for d, t in before if not (t or "").split()}
        elif name == "substring_dedup":
            assert after[name].keys() == plain_cut(before).keys()
            assert all((after[name][d] or "").split() == w for d, w in plain_cut(before).items())
        elif name == "decontamination":
            assert set(after[name]) == {d for d, _ in before} - {d for d, _ in plain_overlaps(before, [(1, " ".join(item))])}
    text = dict(docs)
    clean = {k for k, _ in docs if k >= 300 or k % 5}
    assert set(after["toxicity"]) == clean
    assert set(after["jaccard_join"]) == clean - {2}
    cut = after["substring_dedup"]
    assert set(cut) == clean - {2} and len(cut[3].split()) == len(cut[4].split()) == 80
    assert all(cut[k] == text[k] for k in cut if k not in (3, 4))
    assert set(after["decontamination"]) == clean - {2, 6}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
    assert {r.doc_id for r in packed} == set(after["decontamination"])
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == Counter(r.doc_id for r in packed)


def test_members_are_read_in_time_in_proportion_to_their_number():
    """Twice the members of a file take about twice the time, however much follows each of them."""

    def seconds(n):
        data = b"".join(warc.member(r) for k in range(n) for r in warc.records(str(k), "u", bytes(random.Random(k).randbytes(20_000)), "response", None, f"<r{k}>", 1 << 18, 1 << 13, "d"))
        began = time.process_time()
        assert sum(1 for _ in warc.parse(data)) == n
        return time.process_time() - began

    assert min(seconds(4000) for _ in range(2)) < 3.2 * max(0.05, min(seconds(2000) for _ in range(3)))
