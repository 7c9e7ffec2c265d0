"""The chain of stages that an application waited for, from its event log (A10).

Reads job, stage and SQL execution lines of Spark event logs: the stage graph with each
stage's time, and the plan tree of each execution, whose nodes meet stages by their
metrics' accumulators. The plan tree nests to any depth, so it stays a VARIANT and is flattened
level by level. The longest path through the stage graph of an application of at most ``FOLDED``
stages whose parents have smaller ids, as Spark numbers them, is found in one pass over its stages by id;
for all others it is relaxed round by round until no total grows. A round is one join of edges with the current
totals and one map-side combined maximum per stage, over all applications at once, cut off in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.session import cut_lineage

_STAGE = T.StructType([T.StructField("Stage ID", T.LongType()), T.StructField("Stage Attempt ID", T.LongType()), T.StructField("Stage Name", T.StringType()),
                       T.StructField("Parent IDs", T.ArrayType(T.LongType())), T.StructField("Submission Time", T.LongType()),
                       T.StructField("Completion Time", T.LongType()), T.StructField("Accumulables", T.ArrayType(T.StructType([T.StructField("ID", T.LongType())])))])
SCHEMA = T.StructType([T.StructField("Event", T.StringType()), T.StructField("Stage Info", _STAGE), T.StructField("Job ID", T.LongType()),
                       T.StructField("Stage IDs", T.ArrayType(T.LongType())), T.StructField("executionId", T.LongType()),
                       T.StructField("sparkPlanInfo", T.VariantType())])
FOLDED = 256        # stages
_PATHS = "array<struct<stage_id:bigint,ms:bigint,total_ms:bigint,chain:array<bigint>>>"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Event-log JSON text (application, value) with the fields of stage, job and SQL execution lines; other lines keep nulls."""
    return lines.select("application", F.from_json(F.col(column), SCHEMA).alias("e")).select("application", "e.*")


def stages(events: DataFrame) -> DataFrame:
    """(application, stage_id, ms, parents, accumulators): each completed stage by its last attempt."""
    s = F.col("Stage Info")
    done = events.filter(F.col("Event") == "SparkListenerStageCompleted").select(
        "application", s["Stage ID"].alias("stage_id"), s["Stage Attempt ID"].alias("attempt"),
        (s["Completion Time"] - s["Submission Time"]).alias("ms"), s["Parent IDs"].alias("parents"), s["Accumulables"]["ID"].alias("accumulators"))
    return (done.filter("ms is not null").groupBy("application", "stage_id").agg(F.max_by(F.struct("ms", "parents", "accumulators"), "attempt").alias("x"))
            .select("application", "stage_id", "x.*"))


def jobs(events: DataFrame) -> DataFrame:
    """(application, stage_id, job_id): the first job that names a stage."""
    return (events.filter(F.col("Event") == "SparkListenerJobStart")
            .select("application", F.col("Job ID").alias("job_id"), F.explode("Stage IDs").alias("stage_id"))
            .groupBy("application", "stage_id").agg(F.min("job_id").alias("job_id")))


def plan_nodes(events: DataFrame) -> DataFrame:
    """(application, execution, path, depth, name, accumulators): every node of every plan tree; ``path`` is its place, as 0.1.0."""
    level = (events.filter(F.col("sparkPlanInfo").isNotNull() & F.col("Event").endswith("SQLExecutionStart"))
             .select("application", F.col("executionId").alias("execution"), F.lit("0").alias("path"), F.col("sparkPlanInfo").alias("node")))
    found, depth = None, 0
    while True:
        level = cut_lineage(level)
        if level.isEmpty():
            break
        # a metric without an id stays null and is left out
        ids = F.transform(F.variant_get("node", "$.metrics", "array<variant>"), lambda m: F.try_variant_get(m, "$.accumulatorId", "bigint"))
        here = level.select("application", "execution", "path", F.lit(depth).alias("depth"),
                            F.variant_get("node", "$.nodeName", "string").alias("name"), F.filter(ids, lambda x: x.isNotNull()).alias("accumulators"))
        found = here if found is None else found.unionByName(here)
        level = (level.select("application", "execution", "path", F.posexplode(F.variant_get("node", "$.children", "array<variant>")).alias("k", "node"))
                 .select("application", "execution", F.concat_ws(".", "path", F.col("k").cast("string")).alias("path"), "node"))
        depth += 1
    return found if found is not None else level.select("application", "execution", "path", F.lit(0).alias("depth"), F.lit("").alias("name"),
                                                        F.array().cast("array<long>").alias("accumulators"))


def stage_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(application, stage_id, plan_node): the plan node nearest the root among those that ran in a stage."""
    ran = found.select("application", "stage_id", F.explode("accumulators").alias("id"))
    has = nodes.select("application", "depth", "path", "name", F.explode("accumulators").alias("id"))
    return (ran.join(has, ["application", "id"]).groupBy("application", "stage_id")
            .agg(F.min(F.struct("depth", "path", "name")).alias("x")).select("application", "stage_id", F.col("x.name").alias("plan_node")))


def _folded(found: DataFrame) -> DataFrame:
    """``longest_paths`` of applications of few stages with smaller parents: a parent's path is known before its children's."""
    # without an application no stage is a parent
    parents = F.when(F.col("application").isNotNull(), F.col("parents"))
    each = found.groupBy("application").agg(F.sort_array(F.collect_list(F.struct("stage_id", "ms", parents.alias("parents")))).alias("stages"))
    ids = F.col("stages")["stage_id"]

    def step(paths, x):
        heads = F.filter(F.transform(x["parents"], lambda p: F.get(paths, (F.array_position(ids, p) - 1).cast("int"))), lambda h: h.isNotNull())
        best = F.array_max(F.transform(heads, lambda h: F.struct(h["total_ms"].alias("before"), (-h["stage_id"]).alias("p"), h["chain"].alias("up"))))
        return F.concat(paths, F.transform(F.array(best), lambda b: F.struct(
            x["stage_id"].alias("stage_id"), x["ms"].alias("ms"), (x["ms"] + F.coalesce(b["before"], F.lit(0))).alias("total_ms"),
            F.concat(F.coalesce(b["up"], F.array().cast("array<long>")), F.array(x["stage_id"])).alias("chain"))))

    return each.select("application", F.inline(F.aggregate("stages", F.array().cast(_PATHS), step)))


def _relaxed(found: DataFrame) -> DataFrame:
    """``longest_paths`` of any stage graphs, round by round."""
    found = cut_lineage(found)
    edges = cut_lineage(found.select("application", "stage_id", F.explode("parents").alias("parent")).filter("parent <> stage_id").distinct())
    best = cut_lineage(found.select("application", "stage_id", "ms", F.col("ms").alias("total_ms"), F.array("stage_id").alias("chain")))
    rounds = found.groupBy("application").count().agg(F.max("count")).first()[0] or 0        # a path is no longer; also ends on cyclic input
    grown = best.agg(F.sum("total_ms")).first()[0]
    for _ in range(rounds):
        heads = best.select("application", F.col("stage_id").alias("parent"), F.col("total_ms").alias("before"), F.col("chain").alias("up"))
        into = (edges.join(heads, ["application", "parent"]).filter(~F.array_contains("up", F.col("stage_id"))).groupBy("application", "stage_id")
                .agg(F.max(F.struct("before", (-F.col("parent")).alias("p"), "up")).alias("x")))
        best = cut_lineage(found.join(into, ["application", "stage_id"], "left").select(
            "application", "stage_id", "ms", (F.col("ms") + F.coalesce("x.before", F.lit(0))).alias("total_ms"),
            F.concat(F.coalesce("x.up", F.array().cast("array<long>")), F.array("stage_id")).alias("chain")))
        now = best.agg(F.sum("total_ms")).first()[0]
        if now == grown:
            break
        grown = now
    return best


def longest_paths(found: DataFrame) -> DataFrame:
    """(application, stage_id, ms, total_ms, chain): the slowest chain of parents that ends in each stage.

    Of equal parents the one with the smaller id. Parents that did not complete are left out.
    """
    found = cut_lineage(found.select("application", "stage_id", "ms", "parents"))
    ordered = F.coalesce(F.forall("parents", lambda p: p <= F.col("stage_id")), F.lit(True))
    others = cut_lineage(found.groupBy("application").agg(F.count(F.lit(1)).alias("n"), F.bool_and(ordered).alias("ordered"))
                         .filter((F.col("n") > FOLDED) | ~F.col("ordered")).select("application"))
    if others.isEmpty():
        return cut_lineage(_folded(found))
    # without an application all stages are alike
    same = F.col("f.application").eqNullSafe(F.col("o.application"))
    sides = found.alias("f"), others.alias("o")
    return cut_lineage(_folded(sides[0].join(sides[1], same, "left_anti"))).unionByName(_relaxed(sides[0].join(sides[1], same, "left_semi")))


def critical_path(events: DataFrame) -> DataFrame:
    """Per application the slowest chain of stages: (application, pos, stage_id, job_id, ms, finish_ms, plan_node).

    ``events`` as of ``parse``. Of equally slow chains that which ends in the smaller stage id.
    """
    found = cut_lineage(stages(events))
    paths = longest_paths(found)
    last = paths.groupBy("application").agg(F.max(F.struct("total_ms", (-F.col("stage_id")).alias("s"), "chain")).alias("x"))
    steps = last.select("application", F.posexplode("x.chain").alias("pos", "stage_id"))
    steps = cut_lineage(steps.join(paths.select("application", "stage_id", "ms", F.col("total_ms").alias("finish_ms")), ["application", "stage_id"]))
    on_path = found.join(steps.select("application", "stage_id"), ["application", "stage_id"], "left_semi")
    return (steps.join(jobs(events), ["application", "stage_id"], "left").join(stage_nodes(on_path, plan_nodes(events)), ["application", "stage_id"], "left")
            .select("application", "pos", "stage_id", "job_id", "ms", "finish_ms", "plan_node"))
