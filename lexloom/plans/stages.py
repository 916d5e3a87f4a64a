"""Stages run one after the other: skipped, gone on with, or stopped at the first that fails."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sinks.files import Files


@dataclass(frozen=True)
class Stage:
    """run gets the outputs of the stages it needs, by name, and the parameters. version changes when run does what it
    did not do before; metrics are counted as rows are written. A stage that requires a parameter is left out, with a
    note, where there is none."""

    name: str
    run: Callable[[Mapping[str, DataFrame], Mapping], DataFrame]
    needs: tuple[str, ...] = ()
    version: str = "1"
    metrics: Mapping[str, Column] = field(default_factory=dict)
    requires: str | None = None
    uses: tuple[str, ...] = ()  # parameters that run reads


@dataclass
class Outcome:
    stage: str
    status: str  # done, kept (made before from the same input), skipped, noted or failed
    seconds: float = 0.0
    metrics: dict = field(default_factory=dict)
    note: str = ""


class StageFailed(RuntimeError):
    """A stage failed, and those after it did not run. outcomes: what became of each up to it."""

    def __init__(self, outcomes: list[Outcome]) -> None:
        super().__init__(f"Step '{outcomes[-1].stage}' failed: {outcomes[-1].note}")
        self.outcomes = outcomes


class Pipeline:
    """Stages with their outputs below a root folder.

    An output is a folder that nothing changes once it is written, and a small file that names it, published last. The
    file is found by a fingerprint of the stage, its parameters and what it was made from, so a run that was stopped
    goes on where it was, and new input or parameters make everything behind them anew."""

    def __init__(self, spark: SparkSession, root: str, stages: list[Stage]) -> None:
        seen: set[str] = set()
        for s in stages:
            if s.name in seen or not set(s.needs) <= seen:
                raise ValueError(f"stage {s.name} stands twice or before what it needs")
            seen.add(s.name)
        self._spark, self._root, self._stages, self._files = spark, root.rstrip("/"), stages, Files(spark, root)

    def _fingerprint(self, stage: Stage, sources: str, params: Mapping, made: Mapping[str, str]) -> str:
        used = {k: params.get(k) for k in (*stage.uses, *([stage.requires] if stage.requires else []))}
        parts = [stage.name, stage.version, used, [made[n] for n in stage.needs], None if stage.needs else sources]
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]

    def _manifest(self, stage: str, fingerprint: str) -> dict | None:
        path = f"{self._root}/{stage}/{fingerprint}.json"
        return json.loads(self._files.read(path)) if self._files.exists(path) else None

    def _newest(self, stage: str) -> tuple[str, dict] | None:
        found = [(n.removesuffix(".json"), self._manifest(stage, n.removesuffix(".json"))) for n in self._files.names(f"{self._root}/{stage}") if n.endswith(".json")]
        return max(found, key=lambda x: (x[1]["at"], x[0]), default=None)

    def output(self, stage: str, manifest: dict | None = None) -> DataFrame:
        """The newest output of a stage, or the one of a manifest."""
        if manifest is None:
            newest = self._newest(stage)
            if newest is None:
                raise KeyError(f"no output of stage {stage}")
            manifest = newest[1]
        return self._spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{self._root}/{stage}/{manifest['folder']}")

    def run(self, sources: str = "", params: Mapping | None = None, skip: tuple[str, ...] = ()) -> list[Outcome]:
        """Runs the stages in order. sources: what tells one input of the first stages from another, such as a listing
        or a snapshot's number. A skipped stage is not run; stages that need it get its newest output, and fail where
        there is none."""
        params = params or {}
        unknown = set(skip) - {s.name for s in self._stages}
        if unknown:
            raise ValueError(f"no such stage: {', '.join(sorted(unknown))}")
        outcomes: list[Outcome] = []
        made: dict[str, str] = {}
        manifests: dict[str, dict] = {}
        for s in self._stages:
            began = time.monotonic()
            if s.name in skip:
                newest = self._newest(s.name)
                if newest is not None:
                    made[s.name], manifests[s.name] = newest
                outcomes.append(Outcome(s.name, "skipped"))
                continue
            if s.requires and not params.get(s.requires):
                outcomes.append(Outcome(s.name, "noted", note=f"left out: no {s.requires} given"))
                continue
            try:
                missing = [n for n in s.needs if n not in made]
                if missing:
                    raise KeyError(f"no output of stage {', '.join(missing)}")
                fingerprint = self._fingerprint(s, sources, params, made)
                manifest = self._manifest(s.name, fingerprint)
                status = "kept"
                if manifest is None:
                    status, manifest = "done", self._write(s, params, {n: self.output(n, manifests[n]) for n in s.needs}, fingerprint)
            except Exception as e:
                note = f"{type(e).__name__}: {str(e).splitlines()[0][:300] if str(e) else ''}"
                outcomes.append(Outcome(s.name, "failed", time.monotonic() - began, note=note))
                raise StageFailed(outcomes) from e
            made[s.name], manifests[s.name] = fingerprint, manifest
            outcomes.append(Outcome(s.name, status, time.monotonic() - began, manifest["metrics"]))
        return outcomes

    def _write(self, stage: Stage, params: Mapping, needed: Mapping[str, DataFrame], fingerprint: str) -> dict:
        df = stage.run(needed, params)
        # counted while rows are written, without a pass of their own
        seen = Observation(f"{stage.name}-{uuid.uuid4().hex}")
        counts = [F.count("*").alias("rows"), *[c.alias(n) for n, c in stage.metrics.items()]]
        folder = uuid.uuid4().hex
        df.observe(seen, *counts).write.parquet(f"{self._root}/{stage.name}/{folder}")
        manifest = {"folder": folder, "schema": json.loads(df.schema.json()), "metrics": dict(seen.get), "at": time.time()}
        path = f"{self._root}/{stage.name}/{fingerprint}.json"
        if not self._files.publish(json.dumps(manifest, default=str), path):  # another run was first: its output stands
            return self._manifest(stage.name, fingerprint)
        return manifest


def report(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """(steps_run, steps_kept, steps_skipped, steps_failed, exit_status) of a run."""
    n = lambda *s: sum(o.status in s for o in outcomes)
    failed = n("failed")
    return spark.createDataFrame([(n("done"), n("kept"), n("skipped", "noted"), failed, int(failed > 0))], "steps_run int, steps_kept int, steps_skipped int, steps_failed int, exit_status int")
