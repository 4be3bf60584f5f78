"""The files that stand for a stream: made by many tasks, read in order."""

import contextlib
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from trellisway.functions.materialize import shared_folder
from trellisway.plans import queries
from trellisway.sources import edges
from trellisway.streaming import batches


def test_files_are_read_in_turn(spark):
    """Whatever the order in which tasks end, files come by their times."""
    folder = batches.new_folder(spark, "turn")
    rows = spark.range(400).select(F.col("id").alias("eid"), F.col("id").alias("t"))
    for k in (3, 1, 2, 0):  # the oldest edges are written last
        rows.where(f"t div 100 = {k}").coalesce(1).write.parquet(f"{folder}/file={k}")
    files = [r[0] for r in spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.min("t").alias("t")).orderBy("t").select("p").collect()]
    queries._in_turn(spark, folder, files)
    times = spark.read.parquet(folder).groupBy("file").agg(F.min(F.col("_metadata.file_modification_time")).alias("at")).orderBy("at").collect()
    assert [r["file"] for r in times] == [0, 1, 2, 3]


def test_stand_in_is_made_by_many_tasks(spark):
    """No edge is put through one task, and each file holds one span of time."""
    edges = spark.range(1000).select("id", F.col("id").alias("eid"), F.col("id").alias("t"), F.lit(1).cast("long").alias("s"), F.lit(2).cast("long").alias("d")).drop("id")
    stream = queries._stream(spark, edges)
    assert stream.columns == ["eid", "t", "s", "d"]
    seen = []
    stream.writeStream.foreachBatch(lambda df, k: seen.append(tuple(df.agg(F.min("t"), F.max("t")).first()))).option("checkpointLocation", batches.new_folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == sorted(seen) and seen[0][0] == 0 and seen[-1][1] == 999 and len(seen) == 4


def test_files_of_a_batch_are_numbered_by_their_times(spark):
    """A batch may have several files: an older one comes first, whatever its name."""
    folder = batches.new_folder(spark, "lines")
    for k in range(3):
        spark.range(4 * k, 4 * k + 4).selectExpr("concat_ws(' ', id, id + 1, 0, id) AS value").coalesce(1).write.text(f"{folder}/{9 - k}")
    paths = [r[0] for r in spark.read.option("recursiveFileLookup", True).text(folder).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.min(F.split("value", " ")[3].cast("long")).alias("t")).orderBy("t").select("p").collect()]
    queries._in_turn(spark, folder, paths)
    seen = []
    number = lambda df, k: seen.append(sorted((r.eid, r.t) for r in edges.numbered(df).collect()))
    edges.read_edge_stream(spark, f"{folder}/*", files=3).writeStream.foreachBatch(number).option("checkpointLocation", batches.new_folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [[(k, k) for k in range(12)]]


def test_batches_of_lines_do_not_grow_in_number(spark, monkeypatch):
    """More files are larger batches."""
    ran = []
    monkeypatch.setattr(queries.deltas, "stream_exact_counts", lambda stream, spec, folder: stream.writeStream.foreachBatch(lambda df, k: ran.append(k)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    monkeypatch.setattr(queries.src, "write_edges", lambda df, path, mode: df.repartition(7).select("s", "d", F.lit(0), "t").write.mode(mode).option("sep", " ").csv(path))
    with contextlib.suppress(AnalysisException):  # no counts are written
        queries.stream_text_counts(spark, "/root/testdata/sf0.001")
    assert ran == [0, 1, 2]


def test_lines_go_once_they_are_numbered(spark):
    """Of what edges from text are made of, only tables stay that are read."""
    shared = Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    found = queries.co_from_text(spark, "/root/testdata/sf0.001")
    assert {p.name for p in set(shared.iterdir()) - before} == {f.rsplit("/", 2)[1] for f in found.inputFiles()}
    assert found.count() == edges.copurchase_edges(spark, "/root/testdata/sf0.001").count()
