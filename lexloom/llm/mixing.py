"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic); the cells' weights are raked, under the bound that no
probability exceeds 1, until the weighted tokens have the target shares of every source, language and topic as far as
there are tokens; documents are then sampled with probabilities in proportion.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import broadcast_if_small, columns_of, hash_unit, unused, written

#: Cells raked on the driver (a few numbers each); more are raked as tables.
DRIVER_CELLS = 200_000
ROUNDS, TOLERANCE = 100, 1e-6
#: Targets, where none are given, are the shares found, to this power, made to sum to 1.
TEMPERATURE = 0.7
DIMENSIONS = ("source", "lang", "topic")


def tempered(shares: Mapping[str, float], power: float = TEMPERATURE) -> dict[str, float]:
    total = sum(v**power for v in shares.values() if v > 0)
    return {k: (v**power / total if v > 0 else 0.0) for k, v in shares.items()}


def attainable(goal: np.ndarray, tokens: np.ndarray, total: float, limit: float) -> np.ndarray:
    """The goals, made to sum to 1, where none may ask for more than limit times the tokens that there are: those that
    do get just that, and what they leave goes to the others in proportion."""
    cap = tokens * limit / total
    goal = np.where(tokens > 0, goal, 0.0)
    full, factor = np.zeros(len(goal), bool), 1.0
    while True:
        rest = goal[~full].sum()
        if rest <= 0:
            return np.where(full, cap, 0.0)
        factor = (1 - cap[full].sum()) / rest
        now = full | ((goal > 0) & (goal * factor >= cap))
        if (now == full).all():
            return np.where(full, cap, goal * factor)
        full = now


def _limit(shares: list[float], keep: float | None) -> float:
    """The largest weight under which no probability exceeds 1, if each dimension's wanted values have these shares of
    all tokens: no more can be kept than there is of them."""
    return 1 / min([keep, *shares]) if keep else np.inf


def _settled(changes: list[float]) -> bool:
    """Whether the last round changed no margin, or eight rounds brought the margins no nearer: the targets of the
    dimensions then cannot all be met."""
    return changes[-1] < TOLERANCE or (len(changes) > 8 and changes[-1] > 0.9 * changes[-9])


def rake(cells: pd.DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float | None = None) -> np.ndarray:
    """Weights of the cells (columns: the dimensions, tokens) under which the tokens have the target shares, as far as
    weights of at most 1 / keep can attain them: min(1 / keep, the product of a factor for each value). Targets of
    values without tokens are left out and the rest scaled up; a dimension without targets keeps its weights."""
    tokens = cells["tokens"].to_numpy(float)
    total = tokens.sum()
    if total <= 0:
        return np.ones(len(cells))
    found = []
    for name, want in targets.items():
        code, values = pd.factorize(cells[name], use_na_sentinel=False)
        have = np.bincount(code, tokens, minlength=len(values))
        goal = np.array([want.get(v, 0.0) for v in values]) * (have > 0)
        if goal.sum() > 0:
            found.append((code, goal, have))
    limit = _limit([h[g > 0].sum() / total for _, g, h in found], keep)
    dims = [(code, attainable(goal, have, total, limit)) for code, goal, have in found]
    product, changes = np.ones(len(cells)), []
    for _ in range(ROUNDS):
        change = 0.0
        for code, goal in dims:
            now = np.bincount(code, np.minimum(limit, product) * tokens, minlength=len(goal))
            ratio = np.divide(goal * total, now, out=np.ones_like(goal), where=now > 0)
            change = max(change, float(np.abs(ratio - 1).max()))
            product *= ratio[code]
        if _settled(changes := [*changes, change]):
            break
    return np.minimum(limit, product)


def _attainable_frame(goals: DataFrame, total: float, limit: float) -> DataFrame:
    """attainable() over a table (value, goal, have); its rounds only read aggregates."""
    cap, factor, was = F.col("have") * F.lit(limit / total), 1.0, -1
    full = F.lit(False)
    while True:
        n, held, rest = goals.agg(F.count_if(full), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("goal")))).first()
        if n == was or not rest or rest <= 0:
            return goals.withColumn("goal", F.when(full, cap).otherwise(F.col("goal") * F.lit(factor)))
        factor, was = max(factor, (1 - held) / rest) if n else 1 / rest, n
        full = (F.col("goal") > 0) & (F.col("goal") * F.lit(factor) >= cap) if limit < np.inf else F.lit(False)


def rake_frame(cells: DataFrame, goals: Mapping[str, DataFrame], keep: float | None = None) -> DataFrame:
    """rake() for more cells than the driver takes, by the same rounds. goals holds a table (value, goal) for each
    dimension; no dimension is null. A round writes the values' factors only."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if total <= 0:
        return written(cells.withColumn("w", F.lit(1.0)), "raked")
    found, small, shares = {}, {}, []
    for name, goal in goals.items():
        have = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("have")).join(goal, [name], "left")
        start = written(have.select(name, "have", F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0))).otherwise(0.0).alias("goal")), "factors")
        n, asked, there = start.agg(F.count("*"), F.sum("goal"), F.sum(F.when(F.col("goal") > 0, F.col("have")))).first()
        if asked and asked > 0:
            found[name], small[name] = start, n <= 1_000_000
            shares.append(there / total)
    limit = _limit(shares, keep)
    factors = {d: written(_attainable_frame(f, total, limit).select(d, "goal", F.lit(1.0).alias("f")), "factors") for d, f in found.items()}

    def weighted() -> DataFrame:
        out = cells.withColumn("w", F.lit(1.0))
        for name, f in factors.items():
            f = f.select(name, F.col("f").alias("__f"))
            out = out.join(F.broadcast(f) if small[name] else f, [name]).withColumn("w", F.col("w") * F.col("__f")).drop("__f")
        return out.withColumn("w", F.least("w", F.lit(limit))) if limit < np.inf else out

    changes: list[float] = []
    for _ in range(ROUNDS):
        change = 0.0
        for name in factors:
            margin = weighted().groupBy(name).agg(F.sum(F.col("w") * F.col("tokens")).alias("now"))
            ratio = F.when(F.col("now") > 0, F.col("goal") * F.lit(total) / F.col("now")).otherwise(1.0)
            f = written(factors[name].join(margin, [name]).withColumn("ratio", ratio).select(name, "goal", (F.col("f") * F.col("ratio")).alias("f"), "ratio"), "factors")
            change, factors[name] = max(change, f.agg(F.max(F.abs(F.col("ratio") - 1))).first()[0]), f.select(name, "goal", "f")
        if _settled(changes := [*changes, change]):
            break
    return written(weighted(), "raked")


def goal_frames(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None) -> dict[str, DataFrame]:
    """The targets as tables; where none are given, the tempered shares of every value."""
    if targets is not None:
        return {d: cells.sparkSession.createDataFrame([(k, float(v)) for k, v in want.items()], f"{d} string, goal double") for d, want in targets.items()}
    out = {}
    for d in DIMENSIONS:
        powers = written(cells.groupBy(d).agg(F.sum("tokens").alias("t")).select(d, F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(TEMPERATURE))).otherwise(0.0).alias("goal")), "goals")
        total = powers.agg(F.sum("goal")).first()[0] or 1.0
        out[d] = powers.select(d, (F.col("goal") / F.lit(total)).alias("goal"))
    return out


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's form: its writing style where no classifier has set one."""
    return F.when(text.contains(" | "), "table").when(text.rlike(r"[#$%&*]{3}(\s|$)"), "noise").when(text.rlike(r"\p{Lu}{4,}!!"), "shout").when(F.length(text) < 400, "short").otherwise("prose")


#: Columns that mix adds.
OUTPUTS = ("n_tokens", "mix_topic", "weight", "probability", "sampled")


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, topic: Column | None = None, keep: float = 0.6, seed: int = 11, outputs: Sequence[str] = OUTPUTS) -> DataFrame:
    """docs with the columns `outputs`: tokens, topic, weight and probability, and whether each row is sampled.

    Tokens are words between white space. Null values of source or language form a value of their own (targets name it
    None; given as ""). A document's probability is its cell's weight times `keep`, so that sampled tokens are expected
    to have the target shares and to make up `keep` of all. As no document can be taken more than once, a value whose
    target asks for more tokens than it has is taken whole, and what it leaves goes to the other values in proportion;
    where the values with a target hold less than `keep` of all tokens, less is kept. A draw depends on doc_id, text and
    seed only, so repeated rows share one draw. Null and empty texts have no tokens and probability 0. An empty table
    stays empty. Columns of docs of any name pass unchanged, if `outputs` names none of them.
    """
    words = F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\S+"), F.lit(0)))
    own = {d: unused(f"__{d}", docs.columns) for d in DIMENSIONS}
    n, weight = unused("__n", docs.columns), unused("__w", docs.columns)
    values = {own[d]: F.coalesce(((topic if topic is not None else topic_of(F.col("text"))) if d == "topic" else F.col(d)).cast("string"), F.lit("")) for d in DIMENSIONS}
    found = docs.withColumns({n: words.cast("long"), **values})
    cells = written(found.groupBy(*[F.col(own[d]).alias(d) for d in DIMENSIONS]).agg(F.sum(n).alias("tokens")), "cells")
    if cells.count() <= DRIVER_CELLS:
        frame = cells.orderBy(*DIMENSIONS).toPandas()
        if targets is None:
            margins = {d: frame.groupby(d)["tokens"].sum() for d in DIMENSIONS}
            targets = {d: tempered((m / (m.sum() or 1)).to_dict()) for d, m in margins.items()}
        frame["w"] = rake(frame, targets, keep)
        kept_share = _kept(float((frame["w"] * frame["tokens"]).sum()), float(frame["tokens"].sum()), float(frame["w"].max()) if len(frame) else 0.0, keep)
        weights = docs.sparkSession.createDataFrame(frame[[*DIMENSIONS, "w"]], "source string, lang string, topic string, w double") if len(frame) else cells.select(*DIMENSIONS, F.lit(1.0).alias("w"))
        weights = F.broadcast(weights)
    else:
        raked = rake_frame(cells, goal_frames(cells, targets), keep)
        weighted, total, top = raked.agg(F.sum(F.col("w") * F.col("tokens")), F.sum("tokens"), F.max("w")).first()
        kept_share = _kept(weighted or 0.0, float(total or 0), top or 0.0, keep)
        weights = broadcast_if_small(raked.select(*DIMENSIONS, "w"))
    weights = weights.select(*[F.col(d).alias(own[d]) for d in DIMENSIONS], F.col("w").alias(weight))
    out = found.join(weights, list(own.values()), "left")
    p = F.when(F.col(n) > 0, F.least(F.lit(1.0), F.col(weight) * F.lit(kept_share))).otherwise(0.0)
    draw = hash_unit(*[F.col(c) for c in ("doc_id", "text") if c in docs.columns], F.lit(seed))
    added = (F.col(n), F.col(own["topic"]), F.col(weight), p, draw < p)
    return out.select(*columns_of(docs), *[c.alias(name) for c, name in zip(added, outputs, strict=True)])


def _kept(weighted: float, total: float, top: float, keep: float) -> float:
    """What turns weights into probabilities: `keep`, or less where the weights cannot keep that much."""
    return min(keep, 1 / top) if weighted > 0 and top > 0 and total > 0 else 0.0
