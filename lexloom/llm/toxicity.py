"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text (the windows of toxic documents that
hold character sequences rare in ordinary ones; the ordinary dictionary precedes it, so that only such sequences can
make a difference). A window is a word; its gain is how many bytes shorter the toxic
dictionary makes it. A document's score is a logistic function, fitted on other labelled rows, of its gains.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fit_on_executor, fraction, handing_back, hash_unit, kept, texts

#: Labelled rows of each class, and characters of a row, that the fit uses at most.
FIT_TOXIC, FIT_ORDINARY, FIT_CHARS = 2500, 5000, 30_000
ORDINARY_DICT, TOXIC_DICT = 48_000, 12_000
#: A sequence of GRAM characters, or up to STEM ones at the start of a word, is toxic if it is in MIN_SHARE of the toxic
#: rows, in MIN_ROWS of them, and MIN_RATIO times rarer in others.
GRAM, STEM, MIN_SHARE, MIN_ROWS, MIN_RATIO = 5, 10, 0.01, 5, 5.0
THRESHOLDS = (2, 3, 4, 5, 6)
LEVEL = 3
TAIL = b"\n== window of one word ==\n"
#: Windows whose gain a task remembers before it begins anew.
REMEMBERED = 150_000

_WORD = re.compile(r"[^\W\d_]+")


def windows(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _spread(docs: list[list[str]]) -> list[list[str]]:
    """One of each group of near copies, told by two least hashes of word pairs."""
    seen: set[tuple[int, int]] = set()
    out = []
    for ws in docs:
        pairs = {f"{a} {b}".encode() for a, b in zip(ws, ws[1:], strict=False)}
        keys = {(seed, min(xxhash.xxh3_64_intdigest(x, seed) for x in pairs)) for seed in (1, 2)} if pairs else set()
        if not keys & seen:
            out.append(ws)
        seen |= keys
    return out


def _train(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples, after the most frequent samples as far as it leaves room: from few bytes
    the training keeps little, from fewer it fails."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=16, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    frequent = b"".join(w for w, _ in sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0])))[: max(0, size - len(trained))]
    return frequent + trained


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = ()

    def gains(self):
        """A function from a window to its gain, with a memory of bounded size. A text that ends both dictionaries
        follows each window: zstandard stores what is too short to shrink, and finds no match in the last bytes."""
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=ORDINARY_DICT + TOXIC_DICT, write_content_size=False, write_dict_id=False, write_checksum=False)

        def compressor(d: bytes):
            z = zstandard.ZstdCompressionDict(d + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            z.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=z, compression_params=params).compress

        ordinary, toxic, memory = compressor(self.ordinary), compressor(self.ordinary + self.toxic), {}

        def gain(w: str) -> int:
            g = memory.get(w)
            if g is None:
                if len(memory) > REMEMBERED:
                    memory.clear()
                b = f" {w} ".encode() + TAIL
                memory[w] = g = len(ordinary(b)) - len(toxic(b))
            return g

        return gain

    def features(self, text: str | None, gain) -> np.ndarray:
        """Bias, largest gain, and for each threshold the log of the windows that reach it and their share."""
        found = Counter(windows(text)) if text else {}
        total, top, hits = 0, 0, dict.fromkeys(THRESHOLDS, 0)
        for w, n in found.items():
            g = gain(w)
            total += n
            if g >= THRESHOLDS[0]:
                top = max(top, g)
                for t in THRESHOLDS:
                    if g >= t:
                        hits[t] += min(n, 5)
        rates = [v for t in THRESHOLDS for v in (np.log1p(min(hits[t], 60)), min(1.0, 20 * hits[t] / total) if total else 0.0)]
        return np.array([1.0, min(top, 12) / 4, *rates])

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _grams(word: str) -> set[str]:
    w = f" {word} "
    return {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)} | {w[:n] for n in range(GRAM + 1, min(STEM, len(w)) + 1)}


def fit(rows: list[tuple[str, int, bool]], prior: float) -> ToxicityModel:
    """rows: (text, toxic, whether it trains dictionaries; else it calibrates). prior: the share of toxic rows."""
    word: dict[str, str] = {}  # each word is held once
    split = lambda toxic: _spread([[word.setdefault(w, w) for w in windows(t)] for t, y, d in rows if d and y == toxic])
    bad, good = split(1), split(0)
    of_bad, of_good = Counter(), Counter()
    for ws in bad:
        of_bad.update(set().union(*map(_grams, set(ws))))
    able = {g for g, n in of_bad.items() if n >= max(MIN_ROWS, MIN_SHARE * len(bad))}
    for ws in good:
        of_good.update(able & set().union(*map(_grams, set(ws))))
    rare = {g for g in able if of_bad[g] / max(1, len(bad)) >= MIN_RATIO * (of_good[g] + 0.5) / max(1, len(good))}
    marked = [w for ws in bad for w in ws if not rare.isdisjoint(_grams(w))]
    ordinary = _train([" ".join(ws[i : i + 12]).encode() for ws in good for i in range(0, len(ws), 12)][:60_000], ORDINARY_DICT)
    toxic = _train([f" {w} ".encode() for w in sorted(marked)], TOXIC_DICT)
    model = ToxicityModel(ordinary, toxic)
    calibrate = [(t, y) for t, y, d in rows if not d] or [(t, y) for t, y, _ in rows]
    gain = model.gains()
    y = np.array([v for _, v in calibrate], float)
    # The sample has more toxic rows than the table: weigh the bias back to the prior.
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    x = np.array([model.features(t, gain) for t, _ in calibrate]).reshape(-1, 2 + 2 * len(THRESHOLDS))
    w = _logistic(x, y)
    w[0] += shift
    model.weights = tuple(float(v) for v in w)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from at most FIT_TOXIC + FIT_ORDINARY labelled rows (doc_id, toxic) of docs with texts of at most
    FIT_CHARS characters, chosen by a hash of doc_id; rows with a null id, label or text teach nothing, and of a
    repeated label the larger counts. Without any labelled row every score is
    0.01."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, fraction(counts.get(1, 0), FIT_TOXIC)).otherwise(fraction(counts.get(0, 0), FIT_ORDINARY))
    picked = known.where(hash_unit("id") < share)
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), "id").where(F.length("text") <= FIT_CHARS)
    rows = rows.select("text", "toxic", (hash_unit("id", F.lit("part")) < 0.6).alias("trains"), F.xxhash64("id", "text").alias("o"))
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1) if counts else 0.01

    def fitted(frame):
        frame = frame.sort_values(["o", "text"])
        return fit([(t, int(y), bool(d)) for t, y, d in zip(frame["text"], frame["toxic"], frame["trains"], strict=True)], prior)

    return fit_on_executor(rows, fitted)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """docs' columns `keep` (default: doc_id), whatever their names, and `score` (0 to 1). Texts are scored whole; null
    and empty ones score as texts without a hit. Repeated rows each give a row; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]
    columns, names, ddl = kept(docs, keep)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        gain = m.gains()
        for b in batches:
            out = [m.score(m.features(t.decode("utf-8", "replace") if t else None, gain)) for t in texts(b, "__text")]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(out, pa.float64())], [*names, "__score"])

    frame = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    return frame.mapInArrow(handing_back(scores), f"{ddl}, __score double").toDF(*keep, score)
