"""Edge streams and count series: reading and writing.

Edges are rows (eid, t, s, d[, bi]): t is the time in the data's own unit, (t, eid) the
order of arrival, bi whether the edge goes both ways. Ids are 64 bits, as 32 unsigned bits
don't fit an integer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellisway.functions.materialize import stored

TEXT_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("s", "d", "l", "t")])
COUNT_SCHEMA = "method string, type int, seed int, cp long, count double"


def read_edges(spark: SparkSession, path: str, directed: bool = False, format: str = "text") -> DataFrame:
    """(eid, s, d, t[, bi]) from space-separated lines `s d l t` (l is not used) or from Parquet; bi is false unless the data has it.

    eid is that of the data if it has one, else the place in the order of the files' names and of the rows in them, from 0
    on without gaps; then the rows are stored as a table while the plan is made. Lines that aren't numbers are no edges."""
    if format == "text":
        edges = spark.read.schema(TEXT_SCHEMA).option("sep", " ").csv(path)
    else:
        edges = spark.read.format(format).load(path)
    columns = ["s", "d", "t", *["bi"] * (directed and "bi" in edges.columns)]
    rows = edges.select("eid", *columns) if "eid" in edges.columns else numbered(edges.selectExpr(*columns, *PLACE).dropna(subset=["s", "d", "t"]))
    return rows.withColumn("bi", F.lit(False)) if directed and "bi" not in columns else rows


#: Where a row of a file source comes from: its file, and the part of it that a task reads in one go.
PLACE = ["_metadata.file_path AS _file", "_metadata.file_block_start AS _block"]


def numbered(rows: DataFrame, first: int = 0) -> DataFrame:
    """Adds eid to rows that have their PLACE, which goes: dense numbers from `first` on, in the order of files and rows.

    A part of a file is read by one task in its order, so parts are counted, the counts are summed up over the table of
    parts, and inside its part a row is numbered by its task. No row is sorted or moved but with its part's number. Where
    rows have the time of their file as _time too, that comes before its name."""
    place = [c for c in ("_time", "_file", "_block") if c in rows.columns]
    table = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    parts = table.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("begin"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(parts.select(*place, (before - F.col("begin") + first).alias("offset")))
    kept = [c for c in rows.columns if c not in place]
    return table.join(offsets, place).select((F.col("_row") + F.col("offset")).alias("eid"), *kept)


def read_edge_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """(s, d, t) and the place of each line `s d l t` of files that arrive in a folder, at most `files` a batch; jobs number
    them, in the order of the files' times of change and of the lines in them."""
    lines = spark.readStream.schema(TEXT_SCHEMA).option("sep", " ").option("maxFilesPerTrigger", files).csv(path)
    return lines.selectExpr("s", "d", "t", "_metadata.file_modification_time AS _time", *PLACE).dropna(subset=["s", "d", "t"])


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines `s d l t` with 0 for l, in order of arrival over the files' names if the edges have an eid."""
    rows = edges.orderBy("t", "eid") if "eid" in edges.columns else edges
    rows.select("s", "d", F.lit(0).alias("l"), "t").write.mode(mode).option("sep", " ").csv(path)


def write_counts(counts: DataFrame, path: str, mode: str = "append") -> None:
    """(method, type, seed, cp, count): one table for every series, a folder for each method and seed."""
    counts.select("method", "type", "seed", "cp", F.col("count").cast("double").alias("count")).write.mode(mode).partitionBy("method", "seed").parquet(path)


def read_counts(spark: SparkSession, path: str, method: str | None = None, type: int | None = None, seed: int | None = None) -> DataFrame:
    """Count series; the filters on method and seed skip folders."""
    rows = spark.read.schema(COUNT_SCHEMA).parquet(path)
    for name, value in (("method", method), ("type", type), ("seed", seed)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.select("method", "type", "seed", "cp", "count")


def copurchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought in one order, dated by the earlier line: undirected edges with many equal times. Stores tables, as copurchase_parts."""
    plain, odd = copurchase_parts(spark, sf_dir)
    return plain.unionByName(odd)


def copurchase_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """copurchase_edges in two parts. Edges of orders with no line beyond 7 and none more than 5 times are stored while the plan
    is made, with the lines of all other orders, of which the second part is made whenever it is read.

    Lines are read and shuffled once. A pair's place among the equal ones of its order, by (t, s, d), follows from what is
    known of its two lines: among those of its number by time and part, and by part alone. So no pair is sorted."""
    read = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS ok", "cast(l_linenumber AS long) AS line", "l_partkey AS part", "cast(datediff(cast(l_shipdate AS date), DATE '1995-01-01') AS long) AS t").where("ok IS NOT NULL AND line IS NOT NULL")
    by_part, by_time = Window.partitionBy("ok", "line").orderBy("part"), Window.partitionBy("ok", "line").orderBy("t", "part")
    lines = read.repartition("ok").withColumns({"n": F.count(F.lit(1)).over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "nth": F.row_number().over(by_part) - 1})
    # lines equal in time and part: how many are before them all, how many they are, and which of them this is
    lines = lines.withColumns({"before": F.rank().over(by_time) - 1, "equal": F.count(F.lit(1)).over(by_time.rangeBetween(Window.currentRow, Window.currentRow)), "at": F.row_number().over(by_time) - F.rank().over(by_time)})
    # at most 25 copies of a place then
    fits, order = F.expr("line < 8 AND n <= 5"), Window.partitionBy("ok")
    end = F.struct("line", "part", "n", "nth")
    lines = lines.withColumns({"ends": F.collect_list(F.when(fits, end)).over(order), "plain": F.min(fits).over(order)})
    none = F.array(F.lit(None).cast("struct<line: bigint, part: bigint, n: bigint, nth: int>"))
    met = lines.select(F.when(~F.col("plain"), F.col("ok")).alias("odd"), "ok", "line", "part", "t", "before", "equal", "at", F.explode(F.when(F.col("plain"), F.col("ends")).otherwise(none)).alias("end")).where("odd IS NOT NULL OR line < end.line")
    copy = F.expr("before * end.n + end.nth * equal + at + 1")
    found = stored(met.select(_place("line", "end.line", copy).alias("eid"), "t", F.col("part").alias("s"), F.col("end.part").alias("d"), "odd"))
    others = stored(found.where("odd IS NOT NULL").select(F.col("odd").alias("ok")).distinct())
    return found.where("odd IS NULL").drop("odd"), _odd_orders(stored(read.join(others, "ok", "left_semi")))


def _place(la: str, lb: str, copy: Column) -> Column:
    """Ids have digits for 32 copies and lines up to 7; a copy 0 is never there."""
    return ((F.col("ok") * 8 + F.col(la)) * 8 + F.col(lb)) * 32 + copy


def _odd_orders(read: DataFrame) -> DataFrame:
    """Edges of lines (ok, line, part, t): those beyond 32 copies or line 7 have dense numbers from 2^62 on. Stores tables."""
    # an order's lines come to one task once; all that follows stays there
    lines = read.repartition("ok")
    a, b = (lines.select("ok", F.col("line").alias(f"l{x}"), F.col("part").alias(x), F.col("t").alias(f"t_{x}")) for x in "sd")
    pairs = a.join(b, "ok").where("ls < ld").select("ok", F.col("ls").alias("la"), F.col("ld").alias("lb"), "s", "d", F.col("t_s").alias("t"))
    # line numbers repeat inside an order, so equal places are told apart by their own count
    numbered = pairs.withColumn("copy", F.row_number().over(Window.partitionBy("ok", "la", "lb").orderBy("t", "s", "d")))
    wide = "copy > 32 OR lb >= 8"
    counts = read.groupBy("ok", "line").agg(F.count(F.lit(1)).alias("n"))
    places = counts.withColumnRenamed("line", "la").join(counts.selectExpr("ok", "line AS lb", "n AS m"), "ok").where("la < lb")
    orders = places.groupBy("ok").agg(F.sum(F.expr("greatest(n * m - CASE WHEN lb < 8 THEN 32 ELSE 0 END, 0)")).alias("n")).where("n > 0").withColumn("chunk", F.floor(F.col("ok") / 4096))
    orders = stored(orders)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = orders.groupBy("chunk").agg(F.sum("n").alias("n")).select("chunk", before(Window.orderBy("chunk")).alias("chunk_base"))
    bases = orders.withColumn("base", before(Window.partitionBy("chunk").orderBy("ok"))).join(chunks, "chunk").select("ok", (F.col("base") + F.col("chunk_base")).alias("base"))
    # in the order that copies are numbered in, so that pairs are sorted once
    own = F.sum(F.expr(f"CASE WHEN {wide} THEN 1 ELSE 0 END")).over(Window.partitionBy("ok").orderBy("la", "lb", "t", "s", "d").rowsBetween(Window.unboundedPreceding, 0))
    eid = F.when(F.expr(wide), F.lit(1 << 62) + F.col("base") + F.col("own")).otherwise(_place("la", "lb", F.col("copy")))
    return numbered.withColumn("own", own).join(stored(bases), "ok", "left").select(eid.alias("eid"), "t", "s", "d")


def handoff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the user of each event to the user of the next: directed edges, both ways after a purchase."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    following = events.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("d"))
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(date_trunc('second', ts) AS timestamp_ntz))")
    return events.join(following, "event_id").select(F.col("event_id").alias("eid"), seconds.cast("long").alias("t"), F.col("user_id").alias("s"), "d", (F.col("event_type") == "purchase").alias("bi"))
