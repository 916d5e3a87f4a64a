"""Stages: skipped, stopped, gone on with, made anew."""

import pytest
from pyspark.sql import functions as F

from lexloom.plans.stages import Outcome, Pipeline, Stage, StageFailed, report


class Runs:
    """Three stages and one that needs a law, counting their runs."""

    def __init__(self, spark, root):
        self.ran, self.fail, self.spark = [], None, spark
        step = lambda name, f: lambda inputs, params: self._step(name, f, inputs, params)
        self.stages = [
            Stage("discover", step("discover", lambda i, p: spark.range(p.get("n", 10))), uses=("n",)),
            Stage("download", step("download", lambda i, p: i["discover"].withColumn("pdf", F.col("id") % 2 == 0)), ("discover",), metrics={"pdfs": F.count_if("pdf")}),
            Stage("extract", step("extract", lambda i, p: i["download"].where("pdf").select("id", F.lit("text").alias("text"))), ("download",)),
            Stage("digest", step("digest", lambda i, p: i["extract"].withColumn("law", F.lit(p["law"]))), ("extract",), requires="law"),
        ]
        self.pipeline = Pipeline(spark, root, self.stages)

    def _step(self, name, f, inputs, params):
        self.ran.append(name)
        if name == self.fail:
            raise RuntimeError("no disk")
        return f(inputs, params)

    def run(self, *args, **kwargs):
        self.ran.clear()
        return [(o.stage, o.status) for o in self.pipeline.run(*args, **kwargs)]


@pytest.fixture
def runs(spark, tmp_path):
    return Runs(spark, f"file://{tmp_path}/run")


def test_run_counts_and_notes(spark, runs):
    outcomes = runs.pipeline.run("a")
    assert [(o.stage, o.status, o.metrics.get("rows")) for o in outcomes] == [("discover", "done", 10), ("download", "done", 10), ("extract", "done", 5), ("digest", "noted", None)]
    assert outcomes[1].metrics["pdfs"] == 5 and "no law" in outcomes[3].note
    assert tuple(report(spark, outcomes).first()) == (3, 0, 1, 0, 0)
    assert runs.run("a", {"law": "OR"})[-1] == ("digest", "done") and runs.ran == ["digest"]
    assert {r.law for r in runs.pipeline.output("digest").collect()} == {"OR"}


def test_second_run_keeps_and_new_input_makes_anew(runs):
    runs.run("a")
    assert [s for _, s in runs.run("a")] == ["kept", "kept", "kept", "noted"] and runs.ran == []
    runs.run("b")
    assert runs.ran == ["discover", "download", "extract"]
    runs.run("a", {"n": 4})
    assert runs.ran == ["discover", "download", "extract"] and runs.pipeline.output("extract").count() == 2
    assert runs.run("a")[2] == ("extract", "kept")


def test_abort_and_resume(spark, runs):
    runs.fail = "extract"
    with pytest.raises(StageFailed, match="Step 'extract' failed: RuntimeError: no disk") as e:
        runs.run("a", {"law": "OR"})
    assert runs.ran == ["discover", "download", "extract"]
    assert tuple(report(spark, e.value.outcomes).first()) == (2, 0, 0, 1, 1)
    runs.fail = None
    assert [s for _, s in runs.run("a", {"law": "OR"})] == ["kept", "kept", "done", "done"] and runs.ran == ["extract", "digest"]


def test_failing_job_leaves_no_output(spark, tmp_path):
    bad = Stage("bad", lambda i, p: spark.range(5).select(F.raise_error(F.lit("broken row")).alias("x")))
    p = Pipeline(spark, str(tmp_path), [bad])
    with pytest.raises(StageFailed, match="broken row"):
        p.run()
    with pytest.raises(KeyError):
        p.output("bad")


def test_skip(runs):
    with pytest.raises(StageFailed, match="no output of stage discover"):
        runs.run("a", skip=("discover",))
    assert runs.ran == []
    runs.run("a")
    assert runs.run("b", skip=("discover", "download")) == [("discover", "skipped"), ("download", "skipped"), ("extract", "kept"), ("digest", "noted")]
    with pytest.raises(ValueError, match="no such stage"):
        runs.run(skip=("other",))


def test_new_version_runs_again(spark, tmp_path):
    make = lambda v, n: Pipeline(spark, f"file://{tmp_path}/x", [Stage("s", lambda i, p: spark.range(n), version=v)])
    assert [make(*a).run()[0].status for a in (("1", 3), ("1", 9), ("2", 9))] == ["done", "kept", "done"]
    assert make("2", 0).output("s").count() == 9


def test_order_is_checked(spark, tmp_path):
    s = lambda n, *needs: Stage(n, lambda i, p: spark.range(1), needs)
    for bad in ([s("a", "b"), s("b")], [s("a"), s("a")]):
        with pytest.raises(ValueError, match="stands twice or before"):
            Pipeline(spark, str(tmp_path), bad)
    assert tuple(report(spark, [Outcome("a", "kept")]).first()) == (0, 1, 0, 0, 0)
