"""Exact counts of a stream by what changes.

The graph of the last checkpoint that was given is kept as a log of changed pairs, from both ends and dealt to buckets by
node; edges are kept by step of time. A batch reads the steps that come into the window or leave it, and of the log the
buckets of the nodes of its own changes. A triangle is looked for only from pairs that change, over the spans of checkpoints
in which the numbers of its pairs are constant, and counted at the first of its changed pairs; what it adds to the count of
the last checkpoint is its product now less its product then. Every so many batches the log is summed up anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trellisway.functions.materialize import drop_folder, drop_parts, stored
from trellisway.operators.prepare import WindowSpec, checkpoints
from trellisway.operators.window import seen_from
from trellisway.streaming.batches import EDGE, keep_row, kept_row, run_in_order, write_part

_POINT = "cp_t long, cp_eid long, bucket long, triangles long"
_COUNT = "bucket long, cp_t long, cp_eid long, triangles long"
_LOG = "node long, other long, by long, bucket int, batch long"
BUCKETS = 64


def _bucket(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int")


def pair_changes(edges: DataFrame, points: DataFrame, spec: WindowSpec, last) -> DataFrame:
    """(s, d, k, by) with s > d: by how much the number of a pair changes at checkpoint k of `points` (cp, cp_t, cp_eid,
    bucket, from 1 on); `edges` are those that come after the checkpoint `last`, or leave after it."""
    if last is not None:
        before = [F.lit(v).cast("long").alias(k) for k, v in (("cp", 0), ("bucket", last.bucket), ("cp_t", last.cp_t), ("cp_eid", last.cp_eid))]
        points = points.unionByName(points.sparkSession.range(1).select(*before))
    rows = edges.select(F.greatest("s", "d").alias("s"), F.least("s", "d").alias("d"), F.struct("t", "eid").alias("arrival"))
    alive = seen_from(rows, edges, points, spec, "arrival", "arrival.t")
    come = F.struct(F.col("cp_from").alias("k"), F.lit(1).cast("long").alias("by"))
    gone = F.struct((F.col("cp_to") + 1).alias("k"), F.lit(-1).cast("long").alias("by"))
    each = alive.select("s", "d", F.explode(F.array(come, gone)).alias("x")).select("s", "d", "x.*")
    return each.where("k > 0").groupBy("s", "d", "k").agg(F.sum("by").alias("by")).where("by <> 0")


def changed_triangles(changes: DataFrame, around: DataFrame, last: int) -> DataFrame:
    """(k, by): by how much the weighted count of the triangles that hold a changed pair changes at checkpoints 1 to `last`,
    and at 0 how much they count before. changes: (s, d, k, by); around: (node, other, f) of all their nodes at 0."""
    pairs = changes.select("s", "d").distinct()
    begun = pairs.join(around.select(F.col("node").alias("s"), F.col("other").alias("d"), "f"), ["s", "d"]).select("s", "d", F.lit(0).cast("long").alias("k"), F.col("f").alias("by"))
    order = Window.partitionBy("s", "d").orderBy("k")
    upto = F.sum("by").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # k 0 holds what there was; later ones what changed
    spans = begun.unionByName(changes).select("s", "d", F.col("k").alias("k_from"), F.coalesce(F.lead("k").over(order) - 1, F.lit(last)).alias("k_to"), upto.alias("f")).where(f"f > 0 AND k_from <= {last}")
    spans = stored(spans)
    ends = F.array(F.struct(F.col("s").alias("node"), F.col("d").alias("other")), F.struct(F.col("d").alias("node"), F.col("s").alias("other")))
    both = lambda df, *more: df.select(F.explode(ends).alias("e"), *more).select("e.*", *more)
    same = around.join(both(pairs), ["node", "other"], "left_anti").select("node", "other", "f", F.lit(0).cast("long").alias("k_from"), F.lit(last).cast("long").alias("k_to"), F.lit(False).alias("changed"))
    sides = stored(same.unionByName(both(spans, "f", "k_from", "k_to").withColumn("changed", F.lit(True))))
    degree = sides.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: degree.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    asked = spans.join(of("s"), "s").join(of("d"), "d")
    turned = F.col("n_d") < F.col("n_s")
    asked = asked.select("s", "d", "f", "k_from", "k_to", F.when(turned, F.col("d")).otherwise(F.col("s")).alias("near"), F.when(turned, F.col("s")).otherwise(F.col("d")).alias("far"))
    side = lambda x, c: sides.select(F.col("node").alias(c), F.col("other").alias("z"), *[F.col(v).alias(f"{x}_{v}") for v in ("f", "k_from", "k_to", "changed")])
    # the pair itself counts the triangle unless a changed pair before it does
    first = lambda x, c: ~F.col(f"{x}_changed") | (F.struct("s", "d") < F.struct(F.greatest(F.col(c), F.col("z")), F.least(F.col(c), F.col("z"))))
    meet = lambda x: (F.col(f"{x}_k_from") <= F.col("k_to")) & (F.col(f"{x}_k_to") >= F.col("k_from"))
    one = asked.join(side("x", "near"), "near").where(meet("x") & first("x", "near"))
    two = one.join(side("y", "far"), ["far", "z"]).where(meet("y") & first("y", "far"))
    begin, end = F.greatest("k_from", "x_k_from", "y_k_from"), F.least("k_to", "x_k_to", "y_k_to")
    found = two.select(begin.alias("k_from"), end.alias("k_to"), (F.col("f") * F.col("x_f") * F.col("y_f")).alias("w")).where("k_from <= k_to")
    signed = F.array(F.struct(F.col("k_from").alias("k"), F.col("w").alias("by")), F.struct((F.col("k_to") + 1).alias("k"), (-F.col("w")).alias("by")))
    return found.select(F.explode(signed).alias("x")).groupBy("x.k").agg(F.sum("x.by").alias("by"))


def stream_exact_counts(stream: DataFrame, spec: WindowSpec, folder: str, late: int | None = None, sum_up_after: int = 32) -> StreamingQuery:
    """Starts a query that gives the weighted count at each checkpoint that a batch reaches, to `folder`/counts as (bucket,
    cp_t, cp_eid, triangles). Order and lateness are those of run_in_order; with `late` a checkpoint is given once nothing
    before it can come any more. The log of pairs is summed up after so many batches."""
    width, back = spec.step, spec.window

    def step(spark: SparkSession, edges: DataFrame, number: int) -> None:
        last = kept_row(spark, f"{folder}/point", _POINT, number)
        given = -1 if last is None else last.bucket
        write_part(edges.withColumns({"step": F.expr(f"t div {width}"), "batch": F.lit(number).cast("long")}), f"{folder}/edges", "step", "batch")
        points = stored(checkpoints(edges.where(F.expr(f"t div {width} > {given}")), width))
        newest = points.orderBy(F.desc("cp")).first()
        log = _log_of(spark, folder, number, sum_up_after)
        if newest is None:
            spark.createDataFrame([], _COUNT).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
            keep_row(spark, f"{folder}/point", _POINT, number, (-1, -1, -1, 0) if last is None else tuple(last))
            return
        if last is not None and last.bucket < 0:
            last = None
        kept = spark.read.schema(f"{EDGE}, step long, batch long").parquet(f"{folder}/edges").where(F.col("batch") <= number)
        come, gone = "true", "false"
        if last is not None:
            come = f"step >= {last.cp_t // width} AND struct(t, eid) > struct({last.cp_t}L, {last.cp_eid}L)"
            gone = f"step BETWEEN {(last.cp_t - back) // width} AND {(newest.cp_t - back) // width} AND t >= {last.cp_t - back} AND t < {newest.cp_t - back} AND struct(t, eid) <= struct({last.cp_t}L, {last.cp_eid}L)"
        scope = stored(kept.where(f"(({come}) AND struct(t, eid) <= struct({newest.cp_t}L, {newest.cp_eid}L)) OR ({gone})").select("eid", "t", "s", "d"))
        changes = stored(pair_changes(scope, points, spec, last))
        nodes = stored(changes.select(F.explode(F.array("s", "d")).alias("node")).distinct())
        asked = [r[0] for r in nodes.select(_bucket("node")).distinct().collect()]  # at most BUCKETS numbers
        around = stored(_around(log.where(F.col("bucket").isin(asked)), nodes) if log is not None else spark.createDataFrame([], "node long, other long, f long"))
        found = changed_triangles(changes, around, newest.cp)
        at = points.select(F.col("cp").alias("k")).unionByName(spark.range(1).select(F.lit(0).cast("long").alias("k"))).join(found, "k", "left")
        upto = F.sum(F.coalesce("by", F.lit(0).cast("long"))).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        sums = at.select(F.col("k").alias("cp"), upto.alias("now"))
        then = F.max(F.when(F.col("cp") == 0, F.col("now"))).over(Window.partitionBy())
        base = 0 if last is None else last.triangles
        counts = stored(sums.withColumn("triangles", F.col("now") - then + base).join(points, "cp").select("cp", "bucket", "cp_t", "cp_eid", "triangles"))
        counts.drop("cp").write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
        net = changes.groupBy("s", "d").agg(F.sum(F.when(F.col("k") <= newest.cp, F.col("by"))).alias("by")).where("by <> 0")
        ends = F.array(F.struct(F.col("s").alias("node"), F.col("d").alias("other")), F.struct(F.col("d").alias("node"), F.col("s").alias("other")))
        moved = net.select(F.explode(ends).alias("e"), "by").select("e.*", "by", _bucket("e.node").alias("bucket"), F.lit(number).cast("long").alias("batch"))
        write_part(moved, f"{folder}/pairs-{number // sum_up_after}", "bucket", "batch")
        keep_row(spark, f"{folder}/point", _POINT, number, (newest.cp_t, newest.cp_eid, newest.bucket, counts.where(F.col("cp") == newest.cp).first().triangles))
        if last is not None:  # a second run of this batch would still ask for what left since the checkpoint before
            drop_parts(spark, f"{folder}/edges", "step", (last.cp_t - back) // width)

    return run_in_order(stream, step, folder, late)


def _around(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, f) of these nodes."""
    return log.join(nodes, "node", "left_semi").groupBy("node", "other").agg(F.sum("by").alias("f")).where("f > 0")


def _log_of(spark: SparkSession, folder: str, number: int, sum_up_after: int) -> DataFrame | None:
    """What batches before this one have logged; once in a while the log before is summed up into a new one."""
    now, begins = number // sum_up_after, number % sum_up_after == 0
    read = lambda k: spark.read.schema(_LOG).parquet(f"{folder}/pairs-{k}").where(F.col("batch") < number)
    if not number:
        spark.createDataFrame([], _LOG).write.mode("overwrite").partitionBy("bucket", "batch").parquet(f"{folder}/pairs-0")
        return None
    if begins:
        whole = read(now - 1).groupBy("node", "other", "bucket").agg(F.sum("by").alias("by")).where("by <> 0")
        whole.withColumn("batch", F.lit(-1).cast("long")).select(*[c.split()[0] for c in _LOG.split(", ")]).write.mode("overwrite").partitionBy("bucket", "batch").parquet(f"{folder}/pairs-{now}")
    elif number % sum_up_after == 1:
        drop_folder(spark, f"{folder}/pairs-{now - 1}")
    return read(now)
