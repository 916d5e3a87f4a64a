"""Resumable per-article state from an event log: add, completed (cost) and failed (error) events with a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["law", "article_number", "article_suffix"]
SCHEMA = "law string, article_number int, article_suffix string, status string, cost_usd double, error string"


def load_state(spark, path: str) -> DataFrame:
    """The articles of a state file; an absent one is an empty state. The last row of a key wins."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.schema(f"articles array<struct<{SCHEMA.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>, total_cost double").json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)
    rows = raw.select(F.posexplode("articles").alias("pos", "a")).select("pos", "a.*")
    last = Window.partitionBy(*KEY).orderBy(F.desc("pos"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "pos")


def replay(events: DataFrame) -> DataFrame:
    """(seq, KEY, event, cost, error) -> one row per added key. Adding again changes nothing; events of keys not yet
    added are ignored; the last completion or failure sets status, cost of the last completion stays."""
    added = events.where("event = 'add'").groupBy(*KEY).agg(F.min("seq").alias("added"))
    after = events.where("event <> 'add'").join(added, KEY).where("seq > added")
    latest = after.groupBy(*KEY).agg(F.max_by("event", "seq").alias("status"), F.max_by("cost", F.when(F.col("event") == "completed", F.col("seq"))).alias("cost_usd"), F.max_by("error", F.when(F.col("event") == "failed", F.col("seq"))).alias("error"))
    return added.join(latest, KEY, "left").select(*KEY, F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("error", F.lit("")).alias("error"))


def total_cost(events: DataFrame) -> DataFrame:
    """The sum over completion events of added keys: completing twice counts twice."""
    added = events.where("event = 'add'").groupBy(*KEY).agg(F.min("seq").alias("added"))
    return events.where("event = 'completed'").join(added, KEY).where("seq > added").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"))


def pending(state: DataFrame) -> DataFrame:
    """Only status pending: failed articles are not tried again."""
    return state.where("status = 'pending'")


def register(state: DataFrame, keys: DataFrame) -> DataFrame:
    """state with a pending row for each unseen key."""
    new = keys.select(*KEY).dropDuplicates().join(state, KEY, "left_anti")
    return state.unionByName(new.select(*KEY, F.lit("pending").alias("status"), F.lit(0.0).alias("cost_usd"), F.lit("").alias("error")))


def summary(state: DataFrame, events: DataFrame) -> DataFrame:
    counts = state.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "pending")])
    return counts.join(F.broadcast(total_cost(events)))


def _range_of(c: Column, bounds: list) -> Column:
    """The number of the range that c falls in, by halving; nulls are in the first. A bound belongs to the range below."""

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c <= F.lit(bounds[mid]), half(lo, mid)).otherwise(half(mid + 1, hi))

    return F.when(c.isNull(), F.lit(0)).otherwise(half(0, len(bounds)))


def budget_reached(events: DataFrame, budget: float, partition: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Events with the running cost of completions by seq, and whether it exceeds the budget (strictly).

    With columns to partition by, each of their values has a budget of its own. Without, there is one for all events:
    they are cut into ranges of seq (as many as Spark shuffles into, if not given), each range adds up its own costs,
    and what the ranges before it cost comes on top. The driver holds a bound and a sum for each range; the sums of
    doubles may differ from a plain running sum in their last digits. seq must be unique, nulls come first, and a null
    cost is none."""
    cost = F.when(F.col("event") == "completed", F.coalesce(F.col("cost"), F.lit(0))).otherwise(F.lit(0))
    if partition:
        order = Window.partitionBy(*partition).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        return events.withColumn("running_cost", F.sum(cost).over(order)).withColumn("exceeded", F.col("running_cost") > budget)
    n = ranges or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = (events.agg(F.percentile_approx("seq", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None) or []
    bounds = sorted(set(bounds))
    ranged = events.withColumn("__range", _range_of(F.col("seq"), bounds))
    sums = dict(ranged.groupBy("__range").agg(F.sum(cost)).collect())
    before, total = [], 0
    for i in range(len(bounds) + 1):
        before.append(total)
        total = total + (sums.get(i) or 0)
    order = Window.partitionBy("__range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(cost).over(order)
    running = own + F.element_at(F.array(*[F.lit(x) for x in before]), F.col("__range") + 1)
    return ranged.withColumn("running_cost", running).drop("__range").withColumn("exceeded", F.col("running_cost") > budget)
