"""N-gram Jaccard join by T-occurrence search.

Candidate blocks come from prefix postings (every linked pair shares a shingle among the n - ceil(t n) + 1 first ones
in one global order); inside a block an inverted index is searched by DivideSkip: short lists are merged by
counting, long ones probed by binary search, and the overlap decides. Postings are reduced to chains of neighbours in
size, never to pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import broadcast_if_small, handing_back, longs, slices, texts, written
from .components import connected_components
from .shingles import shingle_set, signature

#: Shingles in the lowest REGION of the hash space are counted over all documents; prefixes prefer the rare ones there.
#: Those of FREQUENT_FROM or more sets come last, by their number; of more than MAX_FREQUENT (9 bytes each) only the most
#: frequent do. A filter tells the others that several sets have, by one byte each up to FILTER_BYTES, after which it
#: fills up. The order decides how much is compared, never what links.
REGION, FREQUENT_FROM, MAX_FREQUENT, FILTER_BYTES = 0.36, 5, 3_000_000, 1 << 26
#: Bytes of a block of the filter, in which a shingle sets two bits; blocks that one task fills.
FILTER_BLOCK, FILTER_SLICE = 64, 4096
_EDGE = int(REGION * (1 << 30))  # of the region, in the first 30 bits of a hash
#: Sets that are compared first in a block; all are searched after that, but for the largest component's.
LEADERS = 8
#: For each value of a byte, which of its bits are set.
_BITS = (np.arange(1 << LEADERS)[:, None] >> np.arange(LEADERS)) & 1
#: Lists are merged by counting where documents' numbers are at most so many times their entries, else by sorting; and
#: long ones are merged too where they have at most so many entries for each document to probe.
COUNTED_FROM, PROBE_COST = 4, 16
#: Shingles that one task holds at once; a larger block is dealt out as pairs of chunks.
BLOCK_SHINGLES = 6_000_000


def _need(n: int, percent: int) -> int:
    return -(-n * percent // 100)


class Filter:
    """Which shingles of the region two or more sets have: for all those added, and a few others by chance."""

    def __init__(self, shingles: int) -> None:
        self.blocks = max(1, min(shingles, FILTER_BYTES) // FILTER_BLOCK)
        self.bits = np.zeros(self.blocks * FILTER_BLOCK, np.uint8)

    def _block(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(34)) * np.uint64(self.blocks) // np.uint64(_EDGE)).astype(np.int64)

    @staticmethod
    def _spots(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        two = [((h >> np.uint64(9 * i)) & np.uint64(511)).astype(np.int64) for i in range(2)]
        return [(bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8)) for bit in two]

    def fill(self, found: DataFrame) -> Filter:
        """Adds the hashes h of a table; a slice of the filter is one task's, and the driver lays them end to end."""
        block = f"shiftrightunsigned(h, 34) * {self.blocks}L div {_EDGE}"

        def bits(key: tuple, table: pa.Table) -> pa.Table:
            h = table["h"].to_numpy().astype(np.int64).view(np.uint64)
            at, out = (self._block(h) - key[0].as_py() * FILTER_SLICE) * FILTER_BLOCK, np.zeros(FILTER_SLICE * FILTER_BLOCK, np.uint8)
            for byte, bit in self._spots(h):
                np.bitwise_or.at(out, at + byte, bit)
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

        made = Filter(0)
        made.blocks, made.bits = self.blocks, self.bits.copy()
        for row in found.select("h", F.expr(f"({block}) div {FILTER_SLICE}").alias("slice")).groupBy("slice").applyInArrow(bits, "slice long, bits binary").toLocalIterator():
            lo = row["slice"] * FILTER_SLICE * FILTER_BLOCK
            made.bits[lo : lo + FILTER_SLICE * FILTER_BLOCK] = np.frombuffer(row["bits"], np.uint8)[: len(made.bits) - lo]
        return made

    def holds(self, h: np.ndarray) -> np.ndarray:
        at, out = self._block(h) * FILTER_BLOCK, np.ones(len(h), bool)
        for byte, bit in self._spots(h):
            out &= (self.bits[at + byte] & bit) > 0
        return out


def _order_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, Filter]:
    """The most frequent shingles, sorted; the level of each: its number of sets, up to 255; and a filter of the others
    that several sets have."""
    edge = np.uint64(int(REGION * (1 << 64)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in slices(batches):
            new = []
            for t in texts(b):
                h = shingle_set(t, k)
                if len(h) and (sig := signature(h)) not in done:
                    done.add(sig)
                    new.append(h[: np.searchsorted(h, edge)])
            if new:
                h, c = np.unique(np.concatenate(new), return_counts=True)
                yield pa.RecordBatch.from_arrays([longs(h), pa.array(c.astype(np.int64))], ["h", "c"])

    found = docs.select("text").mapInArrow(handing_back(counts), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    found = written(found.select("h", F.least("c", F.lit(255)).cast("short").alias("c")), "counts", 1000)
    least, total = 256, 0  # the least level of the frequent ones; those below FREQUENT_FROM go to the filter in any case
    for row in found.groupBy("c").count().orderBy(F.desc("c")).collect():  # at most 254 rows
        if row["c"] < FREQUENT_FROM or total + row["count"] > MAX_FREQUENT:
            break
        least, total = row["c"], total + row["count"]
    top = found.where(F.col("c") >= least).toArrow()
    h = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    seldom = found.where(F.col("c") < least)
    return h[order], top.column("c").to_numpy().astype(np.uint8)[order], Filter(seldom.count()).fill(seldom)


def _prefix(h: np.ndarray, p: int, frequent: tuple[np.ndarray, np.ndarray, Filter]) -> np.ndarray:
    """The first p shingles of a sorted set: the rare ones of the region, those of the filter, those beyond the region,
    then the frequent ones by level; each by hash. What is beyond may be frequent, so it comes after what few sets have."""
    keys, levels, seldom = frequent
    low = h[: np.searchsorted(h, np.uint64(int(REGION * (1 << 64))))]
    level = np.where(seldom.holds(low), 1, 0)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
        level = np.where(keys[at] == low, levels[at], level)
    front = low[level == 0][:p]
    for more in (low[level == 1], h[len(low) :]):
        if len(front) < p:
            front = np.concatenate((front, more[: p - len(front)]))
    if len(front) < p:
        last, level = low[level > 1], level[level > 1]
        front = np.concatenate((front, last[np.lexsort((last, level))][: p - len(front)]))
    return front


def _postings(batches: Iterator[pa.RecordBatch], frequent: tuple[np.ndarray, np.ndarray, Filter], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Member rows (doc set) of each document, and the postings of each new set of this task."""
    done: set[int] = set()
    names = ["k", "sig", "n", "doc", "member"]
    for b in slices(batches):
        ids = b.column(0).to_pylist()
        ks, sigs, ns = [], [], []
        msig, mn = [], []
        for text in texts(b):
            h = shingle_set(text, k)
            n, sig = len(h), signature(h)
            msig.append(sig if n else None)
            mn.append(n)
            if not n or sig in done:
                continue
            done.add(sig)
            p = n - _need(n, percent) + 1
            ks.append(_prefix(h, p, frequent))
            sigs.append(np.full(p, sig, np.uint64))
            ns.append(np.full(p, n, np.int32))
        spread = [(i or 0) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for i in ids]
        yield pa.RecordBatch.from_arrays(
            [longs(np.array(spread, np.uint64)), pa.array([None if s is None else s - (s >> 63 << 64) for s in msig], pa.int64()), pa.array(mn, pa.int32()), pa.array(ids, pa.int64()), pa.array([True] * len(ids))], names
        )
        if ks:
            m = sum(map(len, ks))
            yield pa.RecordBatch.from_arrays([longs(np.concatenate(ks)), longs(np.concatenate(sigs)), pa.array(np.concatenate(ns)), pa.nulls(m, pa.int64()), pa.array(np.zeros(m, bool))], names)


def _chains(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From postings sorted by shingle, size and set: an edge between neighbours whose sizes allow a link. Any two
    linked sets of a list are joined by such edges. Member rows pass through."""
    last = None
    names = ["a", "b", "n", "doc", "member"]
    for batch in batches:
        member = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
        if member.any():
            m = batch.filter(pa.array(member))
            yield pa.RecordBatch.from_arrays([m.column(1), pa.nulls(len(m), pa.int64()), m.column(2), m.column(3), m.column(4)], names)
        if member.all():
            continue
        p = batch.filter(pa.array(~member))
        cols = [p.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if last is not None:
            cols = [np.concatenate(([x], c)) for x, c in zip(last, cols, strict=True)]
        k, s, n = cols
        last = k[-1], s[-1], n[-1]
        on = (k[1:] == k[:-1]) & (s[1:] != s[:-1]) & (n[:-1].astype(np.int64) * 100 >= n[1:].astype(np.int64) * percent)
        if on.any():
            pairs = np.unique(np.stack((np.minimum(s[:-1][on], s[1:][on]), np.maximum(s[:-1][on], s[1:][on])), 1), axis=0)
            m = len(pairs)
            yield pa.RecordBatch.from_arrays([longs(pairs[:, 0]), longs(pairs[:, 1]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(np.zeros(m, bool))], names)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def _merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of sorted lists, in order, with their number of occurrences."""
    flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
    if not len(flat) or int(flat.max()) > COUNTED_FROM * len(flat):
        return np.unique(flat, return_counts=True)
    hits = np.bincount(flat)
    docs = np.flatnonzero(hits)
    return docs, hits[docs]


def divide_skip(lists: list[np.ndarray], need: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that are in at least `need` of the sorted lists, with their exact number of lists. The longest lists,
    fewer than `need`, are left out of the merge and probed for the documents that can still reach it, or merged too
    where those are so many that probes would take longer."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < need or need < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    skip = min(need - 1, int(need / (0.0085 * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
    docs, hits = _merge(short)
    keep = hits >= need - skip
    docs, hits = docs[keep], hits[keep]
    entries = np.cumsum([len(x) for x in long[::-1]])[::-1]  # of a list and those after it
    for i, x in enumerate(long):
        if not len(docs):
            break
        if entries[i] <= PROBE_COST * len(docs) * (len(long) - i):
            found, more = _merge(long[i:])
            at = np.minimum(np.searchsorted(found, docs), len(found) - 1)
            hits = hits + np.where(found[at] == docs, more[at], 0)
            able = hits >= need
            return docs[able], hits[able]
        at = np.minimum(np.searchsorted(x, docs.astype(x.dtype, copy=False)), len(x) - 1)
        hits = hits + (x[at] == docs)
        able = hits + (len(long) - i - 1) >= need
        docs, hits = docs[able], hits[able]
    return docs, hits


def _numbered(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sets' tokens as numbers from 0, one set after the other, and for each number whether several sets have it.
    Empties the list."""
    flat = np.concatenate(sets)
    sets.clear()
    order = np.argsort(flat, kind="stable").astype(np.int32)
    ordered = flat[order]
    del flat
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    del ordered
    number = np.cumsum(first, dtype=np.int32)
    number -= 1
    out = np.empty(len(order), np.int32)
    out[order] = number
    return out, np.diff(np.append(np.flatnonzero(first), len(first))) > 1


def local_links(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set its component's least index, links being a Jaccard similarity of percent or more. The list of sets
    is emptied, as a block's hashes and their numbers need not be held together."""
    m, uf = len(sets), _Union(len(sets))
    sizes = [len(s) for s in sets]
    linked = lambda both, i, j: 100 * both >= percent * (sizes[i] + sizes[j] - both)
    flat, many = _numbered(sets)
    ends = np.cumsum(sizes)
    # Tokens of one set alone cannot add to an overlap, and a set with too few others links with nothing.
    shared = [x[many[x]] for x in (flat[e - n : e] for e, n in zip(ends, sizes, strict=True))]
    del flat
    need = [_need(n, percent) for n in sizes]
    able = [i for i in range(m) if len(shared[i]) >= need[i]]

    def search(i: int, lists: list[np.ndarray]) -> bool:
        joined = False
        docs, hits = divide_skip(lists, need[i])
        for j, both in zip(docs.tolist(), hits.tolist(), strict=True):
            if j != i and linked(both, i, j):
                uf.join(i, j)
                joined = True
        return joined

    # Most copies of one text link to its first, so a few leaders settle them: a bit of a token tells which leaders have it.
    leaders: list[int] = []
    has = np.zeros(len(many), np.uint8)
    oldest = 0
    for i in able:
        mine = has[shared[i]]
        joined = False
        for slot, both in enumerate(np.bincount(mine, minlength=1 << LEADERS) @ _BITS if leaders else ()):
            if slot < len(leaders) and both >= need[i] and linked(int(both), i, leaders[slot]):
                uf.join(i, leaders[slot])
                joined = True
        if joined:
            continue
        if len(leaders) < LEADERS:
            leaders.append(i)
        else:
            has[shared[leaders[oldest]]] &= np.uint8(255 - (1 << oldest))
            leaders[oldest] = i
        has[shared[i]] |= np.uint8(1 << oldest)
        oldest = (oldest + 1) % LEADERS
    roots = np.array([uf.find(i) for i in able])
    kinds, sizes_of = np.unique(roots, return_counts=True)
    if len(kinds) <= 1:
        return [uf.find(i) for i in range(m)]
    # Every other link has an end outside the largest component.
    doc_of = np.repeat(np.array(able, np.int32), [len(shared[i]) for i in able])
    of_able = np.concatenate([shared[i] for i in able])
    order = np.argsort(of_able, kind="stable")
    doc_of, bounds = doc_of[order], np.searchsorted(of_able[order], np.arange(len(many) + 1, dtype=np.int32))
    del of_able, order
    largest = kinds[np.argmax(sizes_of)]
    for i, root in zip(able, roots.tolist(), strict=True):
        if root != largest:
            search(i, [doc_of[bounds[t] : bounds[t + 1]] for t in shared[i].tolist()])
    return [uf.find(i) for i in range(m)]


def _search_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (task, sig, n, hashes) sorted by task, n, sig; gives (a, b) edges from each set to its component's first."""
    key, sigs, sets = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            root = local_links(sets, percent)
            a = [(sigs[i], sigs[r]) for i, r in enumerate(root) if i != r]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in a], pa.int64()), pa.array([y for _, y in a], pa.int64())], ["a", "b"])

    for b in batches:
        for task, sig, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
            if task != key:
                yield from close()
                key, sigs, sets = task, [], []
            if not sigs or sigs[-1] != sig:  # a set that came twice
                sigs.append(sig)
                sets.append(np.frombuffer(raw.as_buffer(), np.uint64))
    yield from close()


def _tasks(blocks: DataFrame, percent: int) -> tuple[DataFrame, bool]:
    """Adds the tasks of each set: its block, or for blocks of more than BLOCK_SHINGLES shingles the pairs of chunks,
    by size, in which a link can be. Second: whether there is such a block."""
    size = blocks.groupBy("blk").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).where("sets > 1")
    blocks = blocks.join(size, "blk")
    small = blocks.where(F.col("total") <= BLOCK_SHINGLES).select("sig", "n", "doc", F.array("blk").alias("tasks"))
    big = blocks.where(F.col("total") > BLOCK_SHINGLES)
    if big.isEmpty():
        return small, False
    order = Window.partitionBy("blk").orderBy("n", "sig").rowsBetween(Window.unboundedPreceding, 0)
    big = written(big.withColumn("chunk", F.floor(2 * F.sum("n").over(order) / F.lit(BLOCK_SHINGLES))), "chunks")
    chunk = big.groupBy("blk", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = chunk.select("blk", F.col("chunk").alias("i"), F.col("hi")), chunk.select("blk", F.col("chunk").alias("j"), F.col("lo"))
    pairs = x.join(y, "blk").where(f"i <= j AND lo * {percent} <= hi * 100").select("blk", "i", "j", F.xxhash64("blk", "i", "j").alias("task"))
    per = pairs.select("blk", F.col("i").alias("chunk"), "task").unionAll(pairs.select("blk", F.col("j").alias("chunk"), "task"))
    per = per.groupBy("blk", "chunk").agg(F.collect_set("task").alias("tasks"))
    return small.unionByName(big.join(per, ["blk", "chunk"]).select("sig", "n", "doc", "tasks")), True


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least id reachable by links, itself included).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct k-word shingles.
    Null, empty and blank texts have an empty set and link with nothing. Rows that repeat an id each give a row; a row
    with a null id is linked through its text's other rows only and keeps a null id. Other columns are ignored; an
    empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(_order_shingles(docs, k))
    posted = docs.mapInArrow(handing_back(lambda it: _postings(it, frequent.value, k, percent)), "k long, sig long, n int, doc long, member boolean")
    chained = posted.repartition("k").sortWithinPartitions("k", "n", "sig").mapInArrow(handing_back(lambda it: _chains(it, percent)), "a long, b long, n int, doc long, member boolean")
    found = written(chained, "chains")
    members = found.where("member").select(F.col("a").alias("sig"), "n", "doc")
    sets = written(members.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc").alias("doc"), F.first("n").alias("n")), "sets")
    blocks = connected_components(found.where("NOT member").select("a", "b")).select(F.col("node").alias("sig"), F.col("comp").alias("blk"))
    tasks, split = _tasks(written(blocks.join(sets.where("doc IS NOT NULL"), "sig"), "blocks"), percent)
    tasks = written(tasks.select(F.col("doc").alias("id"), "sig", "tasks"), "tasks")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sigs, out = b.column(1).to_pylist(), []
            for i, text in enumerate(texts(b)):
                h = shingle_set(text, k)
                if len(h) and signature(h) == sigs[i] & (1 << 64) - 1:  # another row may have the same id
                    out.append((i, h.tobytes(), len(h)))
            rows = pa.array([i for i, _, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(2).take(rows), b.column(1).take(rows), pa.array([n for *_, n in out], pa.int32()), pa.array([h for _, h, _ in out], pa.binary())], ["tasks", "sig", "n", "h"])

    picked = docs.join(broadcast_if_small(tasks), "id").select("text", "sig", "tasks").mapInArrow(handing_back(hashes), "tasks array<long>, sig long, n int, h binary")
    picked = picked.select(F.explode("tasks").alias("task"), "sig", "n", "h").repartition("task").sortWithinPartitions("task", "n", "sig")
    edges = written(picked.mapInArrow(handing_back(lambda it: _search_blocks(it, percent)), "a long, b long"), "links", 1000)
    # Without split blocks the edges are whole stars already.
    roots = connected_components(edges) if split else edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).distinct()
    roots = written(roots, "roots")
    classes = sets.join(roots, sets["sig"] == roots["node"], "left").select("sig", "doc", F.coalesce("comp", "sig").alias("root"))
    classes = written(classes.join(classes.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select("sig", "component_id"), "classes")
    return members.join(broadcast_if_small(classes), "sig", "left").select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
