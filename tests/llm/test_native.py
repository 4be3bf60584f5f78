"""Sharding, URL filters, licences and decontamination against plain versions on small, awkward tables."""

import hashlib
import itertools
import random
import zlib
from importlib import resources
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.compare import differs
from trellisway.llm import decontamination as dc
from trellisway.llm import licenses as lc
from trellisway.llm import queries
from trellisway.llm import sharding as sh
from trellisway.llm import url_filters as uf


def test_rendezvous_moves_rows_only_to_the_new_shard(spark):
    rows = spark.range(2000).withColumn("size", F.lit(1))
    out = sh.with_slots(sh.with_shards(rows, "id", {s: 1.0 for s in range(8)}, {s: 1.0 for s in range(9)}), "id", "shard", ["size"])
    got = out.collect()
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert 100 < sum(r.grown_shard == 8 for r in got) < 400
    by_shard = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) and 180 < len(v) < 320 for v in by_shard.values())
    again = sh.with_slots(sh.with_shards(rows, "id", {s: 1.0 for s in range(8)}), "id", "shard", ["size"], splits=3).collect()
    assert {(r.id, r.slot) for r in again} == {(r.id, r.slot) for r in got}


def test_weights_set_the_shares(spark):
    got = sh.with_shards(spark.range(4000), "id", {0: 1.0, 1: 3.0}).groupBy("shard").count().collect()
    assert 2800 < {r.shard: r["count"] for r in got}[1] < 3200


def test_shards_of_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), (5, 1), (5, 1)], "id long, size int")
    got = sh.with_slots(sh.with_shards(rows, "id", {0: 1.0}), "id", "shard", ["size"]).collect()
    assert sorted(r.slot for r in got) == [0, 1, 2, 3]
    assert sh.with_slots(sh.with_shards(rows.limit(0), "id", {0: 1.0}), "id", "shard", ["size"]).count() == 0
    with pytest.raises(ValueError):
        sh.with_shards(rows, "id", {})


@pytest.mark.parametrize("bound", [100_000, 0])
def test_url_filter_is_as_of(spark, bound):
    d = lambda n: date(2024, 1, n)
    entries = spark.createDataFrame(
        [("ads", "example.com", d(5), "add"), ("ads", "example.com", d(10), "remove"), ("ads", "example.com", d(20), "add"), ("ads", "example.com", d(20), "add"), ("bad", "x.example.com", d(1), "add"),
         ("bad", "tie.org", d(3), "add"), ("bad", "tie.org", d(3), "remove"), (None, None, None, None)], "list string, domain string, day date, action string",
    )
    assert [r[0] for r in spark.createDataFrame([("http://[2001:DB8::1]:80/x",), ("http://u@[::1]",), ("http://a.b:1/[c]",)], "u string").select(uf.host_of(F.col("u"))).collect()] == ["[2001:db8::1]", "[::1]", "a.b"]
    urls = {1: "http://example.com/a", 2: "https://User@x.Example.com:80/?q", 3: "ftp://notexample.com/", 4: None, 5: "no url", 6: "http://tie.org", 7: ""}
    captures = spark.createDataFrame([(k, u, d(n) if n else None) for k, u in urls.items() for n in (4, 5, 9, 10, 21, 0)], "page long, url string, day date")
    got = {(r.id, r.fetched): r.reasons for r in uf.url_filter(captures, entries, "page", "url", "day", broadcast_rows=bound).collect()}
    assert len(got) == 42
    assert [got[1, d(n)] for n in (4, 5, 9, 10, 21)] == [[], ["ads:example.com"], ["ads:example.com"], [], ["ads:example.com"]]
    assert got[2, d(5)] == ["ads:example.com", "bad:x.example.com"] and got[2, d(10)] == ["bad:x.example.com"]
    assert not any(v for (k, day), v in got.items() if k in (3, 4, 5, 6, 7) or day is None)
    assert not any(r.blocked for r in uf.url_filter(captures, entries.limit(0), "page", "url", "day").collect())


def test_licences(spark):
    mit = lc.TEXTS["MIT"]
    rows = [
        (1, mit), (2, mit.upper().replace("COPYRIGHT (C) <YEAR> <HOLDER>", "Copyright 2020 Someone and all").replace(",", " ,\n")), (3, mit + " and more"), (4, None), (5, ""), (6, "..."),
        (7, "text\nReleased under the MIT Licence!\nmore"), (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (None, "Licensed under Apache-2.0"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("id", F.lit(0))
    got = {(r.id, r.scope, r.license_id, r.n_units) for r in lc.license_scan(docs).collect()}
    assert got == {(1, "text", "MIT", 1), (2, "text", "MIT", 1), (7, "line", "MIT", 1), (7, "line", "CC-BY-NC-4.0", 2), (None, "line", "Apache-2.0", 1), (None, "text", "Apache-2.0", 1)}
    assert lc.license_scan(docs.limit(0)).count() == 0


def test_entire_licence_texts(spark):
    full = {k: (resources.files("trellisway.llm") / "license_texts" / f"{k}.txt").read_text() for k in ("Apache-2.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0")}
    rows = [(k, t) for k, t in full.items()]
    rows += [("Apache-2.0", full["Apache-2.0"].split("APPENDIX:")[0].replace("http://", "https://")), ("GPL-3.0", full["GPL-3.0"].split("How to Apply")[0].upper())]
    rows += [("MIT", lc.TEXTS["MIT"].replace("MIT License", title)) for title in ("", "The MIT License (MIT)")]
    rows += [(k, t.split("\n", 1)[1]) for k, t in lc.TEXTS.items() if k != "Unlicense"] + [("Unlicense", "The Unlicense\n\n" + lc.TEXTS["Unlicense"])]
    rows += [("MIT", lc.TEXTS["MIT"].replace("sublicense", "sub-licence").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")), ("GPL-3.0", full["GPL-3.0"].replace("sublicens", "sub-licens"))]
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r.id, r.license_id) for r in lc.license_scan(docs).where("scope = 'text'").collect()}
    assert got == {(n, k) for n, (k, _) in enumerate(rows)}


def test_the_masks_miss_nothing():
    for changed in itertools.combinations(range(dc.WINDOW), dc.CHANGES):
        assert any(not {at + o for o in mask} & set(changed) for mask in dc.MASKS for at in range(dc.WINDOW - mask[-1]))


def _plain_overlaps(docs, items):
    out = {}
    for i, item in items:
        v = (item or "").lower().split()
        for d, text in docs:
            w = (text or "").lower().split()
            n, kept = (13, 11) if len(v) >= 13 else (len(v), len(v))  # short items are held whole
            ends = [q for p in range(len(v) - n + 1) for q in range(len(w) - n + 1) if n and sum(a == b for a, b in zip(v[p : p + n], w[q : q + n], strict=True)) >= kept]
            if ends:
                out[d, i] = (min(ends), max(ends) + n)
    return out


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontamination_is_that_of_brute_force(spark, bound):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(10, 40)))) for k in range(12)] + [(20, None), (21, ""), (22, "w1 " * 12), (23, "w3"), (24, "W4 w5"), (25, "w4\tw5"), (26, " \n ")]
    docs = []
    for k in range(60):
        w = rng.choices(words, k=rng.randrange(0, 60))
        part = (items[k % 12][1].split())[rng.randrange(6) :]
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "changed"
        at = rng.randrange(len(w) + 1)
        docs.append((k, " \n".join(w[:at] + part + w[at:]).upper() if k % 3 else " ".join(w)))
    docs += [(103, "w1 " * 13), (104, "w1 " * 11), (105, "w3"), (106, "w5 w4"), (107, "w4 w5"), (100, None), (101, ""), (102, " ".join(words * 40) + " " + items[0][1] + " " + " ".join(words * 40))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit(0), "words": F.lit("x"), "seed": F.lit(1)})
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = _plain_overlaps(docs, items)
    assert len(expected) > 15
    got = {(r.id, r.item): (r.first_word, r.end_word) for r in dc.overlaps(d, b, broadcast_rows=bound).collect()}
    assert got == expected
    left = dc.decontaminated(d, b)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {k for k, _ in docs} - {k for k, _ in expected}
    assert dc.overlaps(d.limit(0), b).count() == 0 and dc.decontaminated(d, b.limit(0)).count() == len(docs)


@pytest.mark.parametrize("bound", [200_000, 0])
@pytest.mark.parametrize("chunk", [1, 512])
def test_short_items_are_held_whole(spark, bound, chunk):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choices("abc", k=k))) for k in range(1, 16)] + [(1, "a b")]  # an id may have two texts
    docs = [(k, " ".join(rng.choices("abc", k=rng.randrange(0, 80))) + " " + items[k % 15][1]) for k in range(40)]
    expected = {}
    for (doc, item), (lo, hi) in [x for row in items for x in _plain_overlaps(docs, [row]).items()]:
        a, b = expected.get((doc, item), (lo, hi))
        expected[doc, item] = (min(a, lo), max(b, hi))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item): (r.first_word, r.end_word) for r in dc.overlaps(d, b, broadcast_rows=bound, chunk_words=chunk).collect()}
    assert got == expected and {i for _, i in got} == set(range(1, 16))


def test_the_sql_finds_short_items_too(spark, tmp_path):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choices("abcd", k=k))) for k in range(16)] + [(20, None), (21, " ")]
    docs = [(k, " ".join(rng.choices("abcd", k=rng.randrange(0, 50)))) for k in range(30)] + [(90, None), (91, ""), (92, "A\nb")]
    for name, rows, schema in (("benchmark", items, "item_id long, text string"), ("documents", docs, "doc_id long, text string")):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert differs(spark, queries.op10_decontamination, queries.OP10_SQL, str(tmp_path)) is None


def test_seeds_are_shuffled_without_words(spark, capsys):
    text = " ".join(f"t{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dc.overlaps(docs, b, broadcast_rows=0).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nodes = capsys.readouterr().out.split("\n\n")
    dealt = [n for n in nodes if "Exchange" in n and "hashpartitioning(seed" in n]
    assert len(dealt) >= 2 and not any("words" in n or "near" in n or "body" in n for n in dealt)


def test_contamination_is_told_by_row(spark):
    text = " ".join(f"t{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text), (1, "clean"), (None, text), (None, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert sorted((str(r.id), r.first_word, r.end_word) for r in dc.overlaps(docs, b, broadcast_rows=0).collect()) == [("1", 0, 20), ("None", 0, 20)]
    assert sorted((str(r.doc_id), r.text) for r in dc.decontaminated(docs, b).collect()) == [("1", "clean"), ("None", "clean")]


def test_digests_of_the_catalogue():
    assert len({hashlib.sha256(lc.canonical_here(t).encode()).hexdigest() for t in lc.TEXTS.values()}) == len(lc.TEXTS)
    assert zlib.crc32(b"abc") == 891568578
