"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ORDER bytes with escape probabilities (method C, with exclusion). The
counts are frozen after the fit, so every code length is worked out once: a table over (context, byte) per language.
A text's exact code length is then a sum of table entries, and the shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import broadcast_if_small, fit_on_executor, handing_back, hash_unit, kept, texts, written

ORDER = 3
#: Rows that the fit uses at most, over all languages, and characters of a row.
FIT_ROWS, FIT_CHARS = 8000, 10_000
#: Contexts, over all orders, that stay in the trees; the rarest go first.
MAX_CONTEXTS = 20_000
#: Bytes of a text coded, and sample texts counted, at once.
RUN, TEXTS_AT_ONCE = 1 << 20, 200
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """The frozen counts; the tables of code lengths are worked out where they are used."""

    names: list[str]
    code: np.ndarray  # byte -> symbol; 0 stands for every byte never learnt
    symbols: int
    index: list[np.ndarray]  # order -> sorted contexts, packed in base `symbols`
    counts: list[list[tuple[np.ndarray, np.ndarray]]]  # language, order -> (context, symbol) packed, and their number

    @cached_property
    def base(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum([len(x) for x in self.index])))

    @cached_property
    def bits(self) -> np.ndarray:
        """(context * symbols + symbol, language) -> code length in nats."""
        k, base = self.symbols, self.base
        bits = np.empty((base[-1], k, len(self.names)), np.float32)
        for lang, per in enumerate(self.counts):
            lower = np.full((1, k), 1.0 / k)
            for order, contexts in enumerate(self.index):
                c = np.zeros((len(contexts), k))
                packed, n = per[order]
                row = np.searchsorted(contexts, packed // k)
                ok = (row < len(contexts)) & (contexts[np.minimum(row, len(contexts) - 1)] == packed // k) if len(contexts) else np.zeros(len(packed), bool)
                c[row[ok], packed[ok] % k] = n[ok]
                up = lower if order == 0 else lower[np.searchsorted(self.index[order - 1], contexts % k ** (order - 1))]
                total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                left = np.where(c > 0, 0.0, up)
                mass = left.sum(1, keepdims=True)
                escape = np.divide(kinds, total + kinds, out=np.ones_like(total), where=total > 0)
                escape = np.where(mass > 0, escape, 0.0)
                p = np.where(c > 0, (1 - escape) * c / np.maximum(total, 1), escape * left / np.where(mass > 0, mass, 1))
                bits[base[order] : base[order + 1], :, lang] = -np.log(np.maximum(p, 1e-12))
                lower = p
        return bits.reshape(-1, len(self.names))

    @cached_property
    def context(self) -> np.ndarray:
        """The longest context of the tree for each ORDER last symbols, packed."""
        k = self.symbols
        context = np.zeros(k**ORDER, np.int64)
        last = np.arange(k**ORDER)
        for order in range(1, ORDER + 1):
            c, index = last % k**order, self.index[order]
            row = np.searchsorted(index, c)
            hit = (row < len(index)) & (index[np.minimum(row, len(index) - 1)] == c) if len(index) else np.zeros(len(c), bool)
            context[hit] = self.base[order] + row[hit]
        return context

    def lengths(self, text: bytes) -> np.ndarray:
        """Code length of the whole text for each language."""
        k = self.symbols
        total = np.zeros(len(self.names))
        tail = np.zeros(ORDER, np.int64)
        for lo in range(0, len(text), RUN):
            s = np.concatenate((tail, self.code[np.frombuffer(text[lo : lo + RUN], np.uint8)].astype(np.int64)))
            packed = (s[:-3] * k + s[1:-2]) * k + s[2:-1]
            rows, n = np.unique(self.context[packed] * k + s[3:], return_counts=True) if len(packed) > 20_000 else (self.context[packed] * k + s[3:], None)
            total += self.bits[rows].sum(0, dtype=np.float64) if n is None else n @ self.bits[rows].astype(np.float64)
            tail = s[-ORDER:]
        return total


def fit_counts(samples: dict[str, list[bytes]]) -> LanguageModel:
    """The frozen model of each language's sample texts."""
    names = sorted(name for name, docs in samples.items() if docs)
    if not names:
        return LanguageModel([], np.zeros(256, np.uint8), 1, [np.zeros(1, np.int64)] + [np.zeros(0, np.int64)] * ORDER, [])
    seen = np.zeros(256, bool)
    for docs in samples.values():
        for t in docs:
            seen[np.frombuffer(t, np.uint8)] = True
    code = np.zeros(256, np.uint8)
    code[seen] = np.minimum(np.arange(1, seen.sum() + 1), 255)
    k = int(code.max()) + 1
    # Counts of (context, symbol) for each order, packed as numbers in base k.
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for name in names:
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for lo in range(0, len(samples[name]), TEXTS_AT_ONCE):
            runs = [np.concatenate((np.zeros(ORDER, np.int64), code[np.frombuffer(t, np.uint8)].astype(np.int64))) for t in samples[name][lo : lo + TEXTS_AT_ONCE]]
            s = np.concatenate(runs)
            at = np.flatnonzero(np.concatenate([np.arange(len(r)) >= ORDER for r in runs]))
            packed = s.copy()
            for order in range(ORDER + 1):
                if order:
                    packed += np.concatenate((np.zeros(order, np.int64), s[:-order])) * k**order
                parts[order].append(np.unique(packed[at], return_counts=True))
        per = []
        for found in parts:
            grams_of, inv = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            per.append((grams_of, np.bincount(inv, np.concatenate([n for _, n in found])).astype(np.int64)))
        grams.append(per)
    # The contexts of each order that any language has, the most frequent up to the bound.
    freq = []
    for order in range(1, ORDER + 1):
        c = np.concatenate([g[order][0] // k for g in grams])
        u, inv = np.unique(c, return_inverse=True)
        freq.append((u, np.bincount(inv, np.concatenate([g[order][1] for g in grams]))))
    counts = np.concatenate([n for _, n in freq])
    least = np.sort(counts)[-MAX_CONTEXTS] if len(counts) > MAX_CONTEXTS else 2
    index: list[np.ndarray] = [np.zeros(1, np.int64)]  # order -> sorted contexts
    for u, n in freq:
        parent = index[-1]
        # A context stays only if its suffix, one byte shorter, does.
        suffix = u % k ** (len(index) - 1)
        index.append(u[(n >= least) & np.isin(suffix, parent)])
    return LanguageModel(names, code, k, index, grams)


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Learns from docs (doc_id, text, lang): FIT_ROWS rows, shared by the languages, chosen by a hash, and of a
    longer text FIT_CHARS characters from a place chosen by a hash. Rows with a null text or lang teach nothing; from an empty table nothing is learnt. Of the trees'
    contexts those seen once, and all but the MAX_CONTEXTS most frequent, are left out: texts then take more bits there,
    in every language alike."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND length(text) > 0")
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = FIT_ROWS / max(1, counts.count())
    share = broadcast_if_small(counts.select("lang", F.least(F.lit(1.0), F.lit(each) / F.col("n")).alias("share")))
    start = F.pmod(F.xxhash64("text", "id"), F.greatest(F.length("text") - FIT_CHARS, F.lit(0)) + 1) + 1
    picked = rows.join(share, "lang").where(hash_unit("id", "text") < F.col("share")).select("lang", F.col("text").substr(start.cast("int"), F.lit(FIT_CHARS)).alias("text"))

    def fitted(frame):
        return fit_counts({lang: sorted(t.encode() for t in part["text"]) for lang, part in frame.groupby("lang")})

    return fit_on_executor(picked, fitted)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, outputs: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """docs' columns `keep` (default: doc_id), whatever their names, and `outputs`: the language, the score (the chosen
    language's probability, all being equally likely before) and the bits a byte. Null texts, texts without a letter,
    and all texts if no language was learnt are `und` with score 0. Texts are coded whole. Repeated rows each give a
    row; an empty table gives an empty result; of tied languages the first by name wins."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]
    columns, names, ddl = kept(docs, keep)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            letters = b.column(len(keep) + 1).to_pylist()
            pred, score, per = [], [], []
            for text, letter in zip(texts(b, "__text"), letters, strict=True):
                if not text or not letter or not m.names:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    per.append(None)
                    continue
                n = m.lengths(text)
                best = int(np.argmin(n))
                pred.append(m.names[best])
                score.append(float(1 / np.exp(np.clip(n[best] - n, -700, 0)).sum()))
                per.append(float(n[best] / np.log(2) / len(text)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(per, pa.float64())], [*names, "__pred", "__score", "__per"])

    text = F.col("text").cast("string")
    frame = docs.select(*columns, text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    return frame.mapInArrow(handing_back(scores), f"{ddl}, __pred string, __score double, __per double").toDF(*keep, *outputs)
