"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisway.llm.alignment import aligned
from trellisway.llm.bpe import decoded, encoded
from trellisway.llm.common import read
from trellisway.llm.decontamination import overlaps
from trellisway.llm.jaccard_join import near_duplicates
from trellisway.llm.licenses import known_texts, license_scan
from trellisway.llm.neighbours import nearest
from trellisway.llm.packing import packed, token_pieces
from trellisway.llm.phrases import collocations
from trellisway.llm.sharding import with_shards, with_slots
from trellisway.llm.substring_dedup import substring_dedup
from trellisway.llm.toxicity import score, train
from trellisway.llm.url_filters import host_of, url_filter
from trellisway.llm.warc import archive_folder, read_archives, revisit_types, write_archives


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return out.select("doc_id", F.col("dedup_n_words").alias("n_words"), F.col("dedup_n_removed").alias("n_removed"), F.col("dedup_kept_sha256").alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(0, len(w) - 34)) AS i FROM d WHERE len(w) >= 35
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i + 1 : i + 35], ' ')) AS n FROM starts
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM windows WHERE n > 1
), lost AS (
  SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, k: ks IS NULL OR NOT list_contains(ks, k - 1)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select("doc_id", (F.octet_length(body) + F.lit(16)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = with_shards(records, "doc_id", {s: 1.0 for s in range(40)}, grown={s: 1.0 for s in range(41)})
    return with_slots(placed, "doc_id", "shard", ties=["text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _crc_table() -> str:
    """The CRC-32 table of the reflected polynomial, by its rule."""
    table = list(range(256))
    for _ in range(8):
        table = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return f"[{', '.join(map(str, table))}]"


OP2_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS k, encode(coalesce(text, '')) AS b FROM documents
), crc AS (
  SELECT r, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(b)), lambda i: ('0x' || hex(b[i + 1 : i + 1]))::BIGINT)),
         lambda c, x: xor(c >> 8, {_crc_table()}[xor(c & 255, x) + 1]))) AS crc FROM d
), score AS (
  SELECT r, s, ('0x' || substr(md5(k || ':' || s), 1, 12))::BIGINT AS h FROM d, range(41) t(s)
), best AS (
  SELECT r, max(CASE WHEN s < 40 THEN h * 64 + s END) % 64 AS shard, max(h * 64 + s) % 64 AS grown_shard FROM score GROUP BY r
)
SELECT doc_id, octet_length(b) + 16 AS size, crc AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k || ':slot'), crc, octet_length(b)) - 1 AS slot, grown_shard::INT AS grown_shard
FROM d JOIN crc USING (r) JOIN best USING (r)
"""


def _hex(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 4), 16, 10).cast("int")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch day and no block list, so both are derived: the day from page_id, entries from the
    digests of the hosts (lists 'ads' and 'malware') and of their last two labels (list 'parked')."""
    start = F.lit("2023-01-01").cast("date")
    captures = read(spark, sf_dir, "pages").select("page_id", "url", F.date_add(start, F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int")).alias("fetched_on"))
    hosts = captures.select(host_of(F.col("url")).alias("domain")).where("domain IS NOT NULL")
    listed = hosts.distinct().withColumn("h", F.md5("domain")).withColumn("list", F.expr("CASE WHEN substr(h, 9, 1) < '4' THEN 'ads' WHEN substr(h, 9, 1) < '6' THEN 'malware' END"))
    parked = hosts.select(F.substring_index("domain", ".", -2).alias("domain")).distinct().withColumn("h", F.md5(F.concat("domain", F.lit("/parked")))).withColumn("list", F.expr("CASE WHEN substr(h, 9, 1) < '8' THEN 'parked' END"))
    dated = listed.unionByName(parked).where("list IS NOT NULL").select("list", "domain", _hex(F.col("h"), 1).alias("a"), _hex(F.col("h"), 5).alias("b"))
    entries = dated.select(
        "list", "domain", F.explode(F.array(F.struct(F.pmod("a", F.lit(730)).alias("n"), F.lit("add").alias("action")), F.struct(F.pmod("b", F.lit(730)).alias("n"), F.lit("remove").alias("action")))).alias("e")
    ).select("list", "domain", F.date_add(start, F.col("e.n")).alias("day"), "e.action")
    out = url_filter(captures, entries, "page_id", "url", "fetched_on")
    return out.select(F.col("id").alias("page_id"), "host", F.col("fetched").alias("fetched_on"), "blocked", F.concat_ws(",", "reasons").alias("reasons"))


OP4_SQL = r"""
WITH c AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#@\]]*\]|[^/?#:@]+)', 1)), '\.$', ''), '') AS host,
         DATE '2023-01-01' + ((page_id * 7919) % 730)::INT AS fetched_on
  FROM pages
), listed AS (
  SELECT CASE WHEN substr(md5(host), 9, 1) < '4' THEN 'ads' WHEN substr(md5(host), 9, 1) < '6' THEN 'malware' END AS list, host AS domain, md5(host) AS h
  FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)
  UNION ALL
  SELECT CASE WHEN substr(md5(domain || '/parked'), 9, 1) < '8' THEN 'parked' END, domain, md5(domain || '/parked')
  FROM (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM c WHERE host IS NOT NULL)
), entries AS (
  SELECT list, domain, DATE '2023-01-01' + (('0x' || substr(h, 1, 4))::INT % 730) AS day, 'add' AS action FROM listed WHERE list IS NOT NULL
  UNION ALL
  SELECT list, domain, DATE '2023-01-01' + (('0x' || substr(h, 5, 4))::INT % 730), 'remove' FROM listed WHERE list IS NOT NULL
), daily AS (
  SELECT list, domain, day, max(action) AS action FROM entries GROUP BY ALL
), met AS (
  SELECT c.page_id, e.list || ':' || e.domain AS reason
  FROM c JOIN daily e ON (c.host = e.domain OR ends_with(c.host, '.' || e.domain)) AND e.day <= c.fetched_on
  GROUP BY c.page_id, e.list, e.domain
  HAVING arg_max(e.action, e.day) = 'add'
)
SELECT page_id, host, fetched_on, count(reason) > 0 AS blocked, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons
FROM c LEFT JOIN met USING (page_id) GROUP BY page_id, host, fetched_on
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "scope", "license_id", "n_units")


#: Written out here and not taken from the operator, so that the SQL tells if one of its patterns is changed.
OP9_LINES = r"^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|©|<|\[|[0-9]{4}|by )|\(c\)|©|all rights reserved)[^\n]*$"
OP9_WORDS = """acknowledgement acknowledgment analogue analog analyse analyze artefact artifact authorisation authorization authorised authorized calibre caliber
cancelled canceled catalogue catalog categorise categorize centre center emphasised emphasized favour favor favourite favorite fulfil fulfill fulfilment fulfillment
initialise initialize judgement judgment labelling labeling labour labor licence license licenced licensed maximise maximize modelled modeled modelling modeling
offence offense optimise optimize organisation organization organise organize practise practice programme program realise realize recognise recognize
signalling signaling utilisation utilization whilst while wilful willful https http""".split()
OP9_PHRASES = [x.split("=") for x in "sub license=sublicense, sub licenses=sublicenses, sub licensed=sublicensed, sub licensing=sublicensing, non commercial=noncommercial, per cent=percent, copyright owner=copyright holder, copyright owners=copyright holders".split(", ")]


def _op9_digest(text: str) -> str:
    """The digest of a known text, word by word."""
    lines = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split("\n") if not re.search(OP9_LINES, x)]
    words = "".join(c if c >= "\x80" or c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in "\n".join(lines)).split(" ")
    same = dict(zip(OP9_WORDS[::2], OP9_WORDS[1::2], strict=True))
    plain = " ".join(same.get(w, w) for w in words if w)
    for a, b in OP9_PHRASES:
        plain = re.sub(rf"(?<![^ ]){a}(?![^ ])", b, plain)
    return hashlib.sha256(plain.encode()).hexdigest()


def _op9_sql() -> str:
    known = ", ".join(f"('{k}', '{d}')" for k, d in sorted({(k, _op9_digest(t)) for k, t in known_texts()}))
    spellings = ", ".join(f"'{a}': '{b}'" for a, b in zip(OP9_WORDS[::2], OP9_WORDS[1::2], strict=True))
    apart = "' ' || replace(array_to_string(list_transform(string_split(p, ' '), lambda w: coalesce(MAP {" + spellings + "}[w], w)), ' '), ' ', '  ') || ' '"
    for phrase in OP9_PHRASES:
        a, b = (f" {x.replace(' ', '  ')} " for x in phrase)
        apart = f"replace({apart}, '{a}', '{b}')"
    return rf"""
WITH known(license_id, digest) AS (VALUES {known}), units AS (
  SELECT doc_id, 'text' AS scope, text AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL
), plain AS (
  SELECT doc_id, scope, trim(regexp_replace(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '(?m){OP9_LINES}', '', 'g'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS p FROM units
), spelled AS (
  SELECT doc_id, scope, sha256(trim(replace({apart}, '  ', ' '), ' ')) AS digest FROM plain WHERE p <> ''
)
SELECT doc_id, scope, license_id, count(*) AS n_units FROM spelled JOIN known USING (digest) GROUP BY ALL
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "first_word", "end_word")


#: Of 13 words of which 11 stay, some 4 that stay are neighbours: an index of runs of 4 misses nothing either.
OP10_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM benchmark
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT item_id, v, j, array_to_string(v[j + 1 : j + 4], ' ') AS run FROM (SELECT item_id, v, unnest(range(0, len(v) - 3)) AS j FROM item WHERE len(v) >= 13)
), diagonals AS (
  SELECT DISTINCT doc_id, item_id, i - j AS diagonal
  FROM (SELECT doc_id, i, array_to_string(w[i + 1 : i + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(0, len(w) - 3)) AS i FROM doc WHERE len(w) >= 13)) JOIN runs USING (run)
), places AS (
  SELECT doc_id, item_id, v, w, diagonal, unnest(range(greatest(0, -diagonal), least(len(v), len(w) - diagonal) - 12)) AS a
  FROM diagonals JOIN item USING (item_id) JOIN doc USING (doc_id)
), brief AS (
  SELECT item_id, len(v) AS n, array_to_string(v, ' ') AS run FROM item WHERE len(v) BETWEEN 1 AND 12
), held AS (
  SELECT doc_id, item_id, i AS first_word, i + n AS end_word
  FROM (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM brief))) JOIN brief USING (n, run)
  UNION ALL
  SELECT doc_id, item_id, a + diagonal, a + diagonal + 13
  FROM places
  WHERE list_sum(list_transform(range(13), lambda k: (v[a + k + 1] = w[a + diagonal + k + 1])::INT)) >= 11
)
SELECT doc_id, item_id, min(first_word)::BIGINT AS first_word, max(end_word)::BIGINT AS end_word
FROM held
GROUP BY doc_id, item_id
"""


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return packed(pieces, 2048).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def read_back(records: DataFrame) -> DataFrame:
    """What was decoded of each record; a revisit has only what its header states. Fails if a record did not come back whole."""
    stated = F.col("record_type") == "revisit"
    lost = ~stated & ~F.coalesce("complete", F.lit(False))
    whole = lambda c: F.when(lost, F.raise_error(F.concat(F.lit("record not read back whole: "), F.coalesce("key", F.lit(""))))).otherwise(F.col(c))
    return records.select(
        F.col("key").cast("long").alias("page_id"), F.when(stated, F.col("stated_bytes")).otherwise(whole("payload_bytes")).alias("payload_bytes"), F.when(stated, F.col("stated_digest")).otherwise(whole("payload_digest")).alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    typed = revisit_types(pages).select(F.col("page_id").cast("string").alias("key"), "url", F.col("html").alias("payload"), "record_type", F.col("refers_to").cast("string").alias("refers_to"))
    path = archive_folder(spark)
    write_archives(typed, path)
    back = read_archives(spark, path)
    return read_back(back)


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT page_id, h, digest, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, digest AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, read(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), path, packed=True).drop("text")
    return decoded(ids, path).select("doc_id", F.col("bpe_n_tokens").alias("n_tokens"), F.sha2("bpe_ids", 256).alias("ids_sha256"), F.sha2(F.col("bpe_text").cast("binary"), 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"), longest=4, least=30, most=2000, covered=80)


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, m AS size, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 5) x(m) WHERE len(w) >= m)
), f AS (
  SELECT lang, size, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT f.lang, f.phrase, f.a, k, l.a AS l, r.a AS r, ((2000000::HUGEINT * f.a) // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) f
  JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.w[1 : k], ' ') JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.w[k + 1 :], ' ')
), low AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM f, range(2, 4) x(m) WHERE size > m))
  GROUP BY lang, phrase
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), prefix="")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_rendezvous_shards": op2_rendezvous_shards,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_url_filters": op4_url_filters,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_nearest": op8_nearest,
    "op9_license_scan": op9_license_scan,
    "op10_decontamination": op10_decontamination,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_collocations": op12_collocations,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_rendezvous_shards": OP2_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op4_url_filters": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op8_nearest": OP8_SQL,
    "op9_license_scan": _op9_sql(),
    "op10_decontamination": OP10_SQL,
    "op12_collocations": OP12_SQL,
}
