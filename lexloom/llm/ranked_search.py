"""Ranked lexical search, impact-ordered and score-at-a-time.

A block of documents is an index of its own: the postings of each query term, grouped by exact impact, highest first.
For an item the groups of all its terms are processed in falling order of impact. What a document can still gain is at
most the sum of the terms' next impacts, so the search stops once that bound leaves few documents that could be among
the best k, and completes the scores of those few from the documents' own terms."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import columns_of, handing_back, slices, texts, written

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Postings that a task indexes at once, and the item terms that one pass over the documents searches for. Both only
#: bound memory: results are the same at any size.
BLOCK_POSTINGS, PASS_TERMS = 2_000_000, 250_000
#: Documents whose scores may be completed without the rest of the postings, for each of the k wanted.
COMPLETE = 4
#: Each level of impacts reaches down to this share of the one before.
LEVEL = 0.6
_IMPACT_BITS = 36  # an impact stays below 1000 * ln(2 N + 2) * 1,000,000, under 2^36 for any N below 2^63


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text, A-Z lower-cased; none of null. Bytes of other letters all belong to terms."""
    return _TERM.findall(text.lower()) if text else []


class BlockIndex:
    """The postings of one block of documents.

    ids: document ids; doc, term, impact: the postings, by document."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        self.ids, self._term, self._impact = ids, term, impact
        self._doc_at = np.searchsorted(doc, np.arange(len(ids) + 1))
        order = np.argsort((term.astype(np.int64) << _IMPACT_BITS) | ((1 << _IMPACT_BITS) - 1 - impact), kind="stable")
        self._docs, self._impacts = doc[order], impact[order]
        self._term_at = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.postings_read = 0

    def _complete(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of some documents for the terms marked in wanted."""
        lengths = self._doc_at[docs + 1] - self._doc_at[docs]
        at = np.repeat(self._doc_at[docs] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        gains = np.where(wanted[self._term[at]], self._impact[at], 0)
        sums = np.concatenate(([0], np.cumsum(gains)))
        ends = np.cumsum(lengths)
        return sums[ends] - sums[ends - lengths]

    def search(self, terms: np.ndarray, wanted: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold the block's best k for the terms, but for documents that score below floor or
        nothing. wanted marks the same terms."""
        lo, hi = self._term_at[terms], self._term_at[terms + 1]
        held = hi > lo
        at, hi = lo[held].copy(), hi[held]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        gained = np.zeros(len(self.ids), np.int64)
        level = float(self._impacts[at].max())
        while True:
            level *= LEVEL
            for i in np.flatnonzero(self._impacts[np.minimum(at, hi - 1)] >= level):
                a = at[i]
                # whole groups of equal impact: all of this term's impacts from the level up
                end = a + np.searchsorted(-self._impacts[a : hi[i]], -math.ceil(level), side="right")
                gained[self._docs[a:end]] += self._impacts[a:end]  # a term names a document once
                self.postings_read += end - a
                at[i] = end
            open_ = at < hi
            bound = int(self._impacts[at[open_]].sum())
            if bound and level < 1:
                continue
            kth = int(np.partition(gained, len(gained) - k)[len(gained) - k]) if len(gained) >= k else 0
            least = max(kth, floor, 1)
            docs = np.flatnonzero(gained + bound >= least)
            if not bound:
                return docs, gained[docs]
            if len(docs) <= COMPLETE * k:
                scores = self._complete(docs, wanted)
                return docs[scores > 0], scores[scores > 0]


def _best(ids: np.ndarray, none: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the best k: highest score, then smallest id, rows without an id last."""
    return np.lexsort((ids, none, -scores))[:k]


def _counts(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """(id, n, terms, tfs) of each row: all its terms with repeats, and those of the vocabulary with their counts."""
    id_, text = columns_of(docs, [id_col, text_col])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for b in slices(batches):
            n, terms, tfs = [], [], []
            for t in texts(b):
                found = terms_of(t)
                n.append(len(found))
                own = sorted((number[w], c) for w, c in Counter(found).items() if w in number)
                terms.append([x for x, _ in own])
                tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "n", "terms", "tfs"])

    return docs.select(id_.cast("long").alias("id"), text.alias("text")).mapInArrow(handing_back(count), "id long, n long, terms array<int>, tfs array<long>")


def _document_counts(counts: DataFrame, n_terms: int) -> np.ndarray:
    """How many rows hold each term: counted by task, then summed."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["term", "rows"])

    rows = counts.select("terms").mapInArrow(tally, "term int, rows long").groupBy("term").agg(F.sum("rows").alias("rows")).toPandas()
    df = np.zeros(n_terms, np.int64)
    df[rows["term"].to_numpy()] = rows["rows"].to_numpy()
    return df


def _search_blocks(counts: DataFrame, searched, weights: np.ndarray, n_docs: int, all_terms: int, k: int) -> DataFrame:
    """(item, score, id) of each task's best k of each item."""
    n_terms = len(weights)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        have, postings = [], 0
        for b in slices(batches):
            have.append(b)
            postings += len(b.column(2).flatten())
            if postings >= BLOCK_POSTINGS:
                yield have
                have, postings = [], 0
        if have:
            yield have

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = searched.value
        best: dict = {}
        for block in blocks(batches):
            t = pa.Table.from_batches(block)
            id_, n = t.column(0).combine_chunks(), t.column(1).to_numpy()
            lists = t.column(2).combine_chunks()
            term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = t.column(3).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy(zero_copy_only=False))
            # whole numbers of any size: n * N may pass 64 bits
            m = np.array([50 + 50 * int(x) * n_docs // all_terms for x in n], np.int64)
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            none = id_.is_null().to_numpy(zero_copy_only=False)
            ids = id_.fill_null(0).to_numpy(zero_copy_only=False)
            index = BlockIndex(ids, doc, term, impact, n_terms)
            wanted = np.zeros(n_terms, bool)
            for i, terms in enumerate(items):
                had = best.get(i)
                floor = int(had[2].min()) if had is not None and len(had[2]) == k else 0
                wanted[terms] = True
                docs, scores = index.search(terms, wanted, k, floor)
                wanted[terms] = False
                if len(docs):
                    own = ids[docs], none[docs], scores
                    own = own if had is None else tuple(np.concatenate(p) for p in zip(had, own, strict=True))
                    top = _best(*own, k)
                    best[i] = tuple(x[top] for x in own)
        for i, (ids, none, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(scores), pa.array(ids, mask=none)], ["item", "score", "id"])

    return counts.mapInArrow(handing_back(search), "item int, score long, id long")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best rows of docs that score above 0, ranks from 1.

    Every row of docs is a document of its own, also where ids repeat; rows without an id come after the others of
    their score. Items that share an item_id are one item with the terms of all; an item without terms finds nothing.
    Null and empty texts hold no terms; empty tables give an empty result; other columns are left out. Items are
    searched in passes of some PASS_TERMS terms, each over all documents; a pass's items, not documents, are what the
    driver and each task hold. A single item is never split."""
    spark = docs.sparkSession
    item, text = columns_of(items, [item_col, text_col])
    kind = items.schema[item_col].dataType

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, w) for i, t in enumerate(texts(b)) for w in dict.fromkeys(terms_of(t))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([w for _, w in rows], pa.binary())], ["item", "term"])

    pairs = written(items.select(item.alias("item"), text.alias("text")).mapInArrow(distinct, f"item {kind.simpleString()}, term binary").distinct(), "item-terms")
    passes = max(1, -(-pairs.count() // PASS_TERMS))
    found = None
    for part in range(passes):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == part).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()
        number = {w: i for i, w in enumerate(sorted({bytes(w) for r in own for w in r["terms"]}))}
        searched = [np.array(sorted(number[bytes(w)] for w in r["terms"]), np.int64) for r in own]
        counts = written(_counts(docs, id_col, text_col, spark.sparkContext.broadcast(number)), "term-counts")
        n_docs, all_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _document_counts(counts, len(number))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        if not own or not all_terms:
            continue
        hits = _search_blocks(counts.where("size(terms) > 0"), spark.sparkContext.broadcast(searched), weights, n_docs, all_terms, k)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(own)], f"item int, name {kind.simpleString()}")
        hits = hits.join(F.broadcast(names), "item").select(F.col("name").alias("item"), "score", "id")  # a pass's items
        found = hits if found is None else found.unionAll(hits)
    if found is None:
        return spark.createDataFrame([], f"`{item_col}` {kind.simpleString()}, rank int, `{id_col}` long, score long")
    found = written(found, "ranked-hits")
    order = (F.desc("score"), F.asc_nulls_last("id"))
    # an item has k hits a task: the best of each salt first, so that no task sees them all
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(32)))
    near = salted.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("r") <= k)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return top.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
