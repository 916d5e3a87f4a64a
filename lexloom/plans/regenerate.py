"""Generation with an evaluator's feedback: what fails is tried again, in rounds that shrink."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sinks.files import Files


def regenerate(spark: SparkSession, requests: DataFrame, generate: Callable[[DataFrame], DataFrame], evaluate: Callable[[DataFrame], DataFrame], root: str, rounds: int = 3, budget: float | None = None) -> DataFrame:
    """The last attempt at each request: its columns, round, those that generate adds, passed and feedback.

    generate gets requests with feedback (null in the first round) and returns them with what it made, cost among it if
    there is a budget; evaluate returns that with passed and feedback. Requests that passed are not touched again;
    those that failed go into the next round with what was said of them. It ends when none is left, after so many
    rounds, or when the rounds so far cost more than the budget. An absent verdict is a failure.

    Each round is kept below root as it ends, so a run that stopped goes on with the round that it was in: models are
    not asked twice for one attempt that was kept."""
    files, done = Files(spark, root), []
    frontier = requests.withColumn("feedback", F.lit(None).cast("string"))
    for n in range(1, rounds + 1):
        mark = f"{root}/round-{n}.json"
        if not files.exists(mark):
            tried = evaluate(generate(frontier)).withColumn("passed", F.coalesce("passed", F.lit(False))).withColumn("round", F.lit(n))
            folder = f"{root}/round-{n}-{uuid.uuid4().hex}"
            tried.write.parquet(folder)
            files.publish(json.dumps({"folder": folder, "schema": json.loads(tried.schema.json())}), mark)
        made = json.loads(files.read(mark))
        kept = spark.read.schema(StructType.fromJson(made["schema"])).parquet(made["folder"])
        done.append(kept)
        failed = kept.where(~F.col("passed"))
        if failed.isEmpty():
            break
        if budget is not None and sum(x.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0] for x in done) > budget:
            break
        frontier = failed.select(*requests.columns, "feedback")
    # passed in its round, or failed in the last one: one row a request, without a shuffle
    last = [x.where("passed") for x in done[:-1]] + done[-1:]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), last)


def round_report(last: DataFrame) -> DataFrame:
    """round, passed, failed: how many requests ended in each round."""
    return last.groupBy("round").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
