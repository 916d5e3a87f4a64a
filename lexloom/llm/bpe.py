"""Byte-level BPE encoding and decoding.

Spark higher-order functions fold the ranked merges over the byte array of a word, looking ranks up in a literal map.
A task codes its texts as numbers of words and hands on the bytes of the words it meets first, so each distinct word is
folded once a task, or once for the corpus where a bounded dictionary holds it; numpy then puts ids and pieces together.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import handing_back, hash_unit, small_batches, texts, written

#: Words, and bytes of each, of the dictionary that all tasks share: it only saves folds, so the words are taken from
#: the texts of a hash share of the documents; results never depend on it.
DICTIONARY_WORDS, DICTIONARY_BYTES, DICTIONARY_SHARE = 500_000, 40, 0.2
#: The fold takes time with the square of a word's length; longer words merge over a heap instead.
FOLD_BYTES = 400
#: Buckets of the literal rank map; a power of two.
BUCKETS = 1 << 16
#: Bits of a token id, and of a place in a word; "no merge" among ranks.
BITS = 20
NO_RANK = MASK = (1 << BITS) - 1
#: Words that a task remembers before it begins anew; characters split, and words put together, at once.
REMEMBERED, CHARS_AT_ONCE, TOKENS_AT_ONCE, WORDS_AT_ONCE = 250_000, 1 << 20, 200_000, 20_000
#: Rows of an Arrow batch where texts come in: whole texts are read, and ids and bytes of all of them are handed on.
TEXTS_AT_ONCE = 500
#: Rows, and bytes of codes, of a batch between the steps of a task.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _long(x: int):
    return F.lit(x).cast("long")


class RankMap:
    """Ranks of all pairs of tokens that merge, as one literal: buckets of left << 2 * BITS | right << BITS | rank.

    The literal comes by a session variable of the rank file's digest: set from a query it is one block of bytes, which
    plans neither print nor take apart when they are sent to tasks, and it is folded into them like any other literal."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        if max(ranks.values()) >= NO_RANK:
            raise ValueError(f"token ids must be below {NO_RANK}")
        self.name = "lexloom_ranks_" + hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()[:16]
        table: list[list[int]] = [[] for _ in range(BUCKETS)]
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    table[((a << 9) ^ (a >> 3) ^ b) & (BUCKETS - 1)].append((a << 2 * BITS) | (b << BITS) | rank)
        two = [ranks.get(bytes([a, b]), NO_RANK) for a in range(256) for b in range(256)]
        kinds = {"byte": ([ranks[bytes([i])] for i in range(256)], "ARRAY<BIGINT>"), "bytes": (two, "ARRAY<BIGINT>"), "table": (table, "ARRAY<ARRAY<BIGINT>>")}
        for kind, (values, ddl) in kinds.items():
            spark.sql(f"DECLARE OR REPLACE VARIABLE {self.name}_{kind} {ddl}")
            spark.sql(f"SET VAR {self.name}_{kind} = (SELECT from_json(:json, '{ddl}'))", {"json": json.dumps(values, separators=(",", ":"))})
        self.of_byte, self.of_bytes, self.table = (F.expr(f"session.{self.name}_{kind}") for kind in kinds)

    def rank(self, a, b):
        """The rank of two neighbouring tokens (longs); NO_RANK if they don't merge, null if one is null."""
        at = F.shiftleft(a, 9).bitwiseXOR(F.shiftright(a, 3)).bitwiseXOR(b).bitwiseAND(_long(BUCKETS - 1)).cast("int")
        key = F.shiftleft(a, BITS).bitwiseOR(b)
        found = F.get(F.filter(F.get(self.table, at), lambda v: F.shiftright(v, BITS) == key), F.lit(0)).bitwiseAND(_long(MASK))
        return F.when(key.isNotNull(), F.coalesce(found, _long(NO_RANK)))


def _let(value, body):
    """body(value), value being worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(word_bytes, ranks: RankMap):
    """Token ids of a word, given its bytes as an array of ints: each step of the fold merges the leftmost pair of the
    least rank; a step that finds no pair leaves the word as it is. A token is one long: the rank of the pair that it
    opens, the place of its first byte, its id; so the least element is the pair to merge, and no two are equal."""
    token = lambda x: x.bitwiseAND(_long(MASK))
    no, place, below = _long(NO_RANK), _long(MASK << BITS), _long((1 << 2 * BITS) - 1)
    placed = F.transform(word_bytes, lambda b, i: F.shiftleft(i.cast("long"), BITS).bitwiseOR(F.get(ranks.of_byte, b)))
    pairs = F.zip_with(word_bytes, F.slice(word_bytes, 2, F.size(word_bytes)), lambda a, b: F.shiftleft(F.coalesce(F.get(ranks.of_bytes, a * 256 + b), no), 2 * BITS))
    start = F.zip_with(placed, pairs, lambda x, y: x.bitwiseOR(y))

    def step(t, _):
        def merge(least):
            rank = F.shiftright(least, 2 * BITS)

            def beside(x):  # the pair becomes one token, whose id is the rank; it and the token before get new ranks
                now = F.shiftleft(F.coalesce(ranks.rank(rank, token(x["after"])), no), 2 * BITS).bitwiseOR(least.bitwiseAND(place)).bitwiseOR(rank)
                before = F.shiftleft(ranks.rank(token(x["before"]), rank), 2 * BITS).bitwiseOR(x["before"].bitwiseAND(below))
                put = lambda y: F.transform(F.array_remove(t, x["right"]), lambda e: F.when(e == least, y["now"]).when(e == x["before"], y["before"]).otherwise(e))
                return _let(F.struct(now.alias("now"), before.alias("before")), put)

            around = lambda at: _let(F.struct(F.get(t, at - 2).alias("before"), F.get(t, at).alias("right"), F.get(t, at + 1).alias("after")), beside)
            return F.when(rank == no, t).otherwise(_let(F.array_position(t, least).cast("int"), around))

        return _let(F.array_min(t), merge)

    steps = F.when(F.size(word_bytes) > 1, F.sequence(F.lit(2), F.size(word_bytes))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.aggregate(steps, start, step), lambda x: token(x).cast("int"))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a very long word, in time n log n."""
    n = len(word)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        for a, b in ((prev[i], i), (i, nxt[i])):
            if a >= 0 and b < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


_CUT = regex.compile(r"(?<=\S) (?=\S)")


def split_runs(text: str, pattern) -> Iterator[list[str]]:
    """All matches of the pattern, of some CHARS_AT_ONCE characters at a time: no match goes across a single space
    between other characters, so long texts are cut there."""
    lo = 0
    while len(text) - lo > CHARS_AT_ONCE:
        cut = _CUT.search(text, lo + CHARS_AT_ONCE)
        if cut is None:
            break
        yield pattern.findall(text, lo, cut.start())
        lo = cut.start()
    yield pattern.findall(text, lo)


def _byte_lists(words: list[bytes]) -> pa.ListArray:
    """Each word as an array of ints."""
    ends = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int32)))


def frequent_words(docs: DataFrame, pattern: str, most: int = DICTIONARY_WORDS, remembered: int = REMEMBERED) -> DataFrame:
    """(word, c): the `most` most frequent words of DICTIONARY_BYTES bytes at most of texts (text)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = regex.compile(pattern), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = iter(seen.items())
            while part := list(islice(rows, WORDS_AT_ONCE)):
                part = [(x, c) for w, c in part if len(x := w.encode()) <= DICTIONARY_BYTES]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], ["word", "c"])
            seen.clear()

        for b in batches:
            for text in texts(b):
                for words in split_runs((text or b"").decode("utf-8", "replace"), split):
                    seen.update(words)
                if len(seen) > remembered:
                    yield from flush()
        yield from flush()

    found = docs.mapInArrow(handing_back(counts), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return found.where("c > 1").orderBy(F.desc("c"), "word").limit(most)


def _dictionary(docs: DataFrame, pattern: str, ranks: RankMap, most: int, remembered: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The frequent words, where the ids of each start, and all ids."""

    def with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _byte_lists(b.column(0).to_pylist())], ["word", "bytes"])

    sample = docs.where(hash_unit("text") < DICTIONARY_SHARE)
    parts = docs.sparkSession.sparkContext.defaultParallelism * 2
    rows = frequent_words(sample, pattern, most, remembered).select("word").repartition(parts).mapInArrow(handing_back(with_bytes), "word binary, bytes array<int>")
    with small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        got = rows.select("word", fold_merges(F.col("bytes"), ranks).alias("ids")).toArrow().combine_chunks()
    if not len(got):
        return pa.array([], pa.binary()), np.zeros(1, np.int64), np.empty(0, np.int32)
    ids = got.column("ids").chunk(0)
    return got.column("word").chunk(0), _row_ends(ids), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of each, one after the other."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return flat[np.repeat(start - before, length) + np.arange(total)] if total else flat[:0]


def _row_ends(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


class _Ids:
    """Ids of coded words: those of the dictionary, then those that a task met."""

    def __init__(self, starts: np.ndarray, flat: np.ndarray):
        self.fixed = len(starts) - 1, len(flat)
        self.starts, self.flat = starts.copy(), flat.astype(np.uint32)
        self.reset()

    def reset(self) -> None:
        self.n, self.used = self.fixed

    def add(self, ends: np.ndarray, ids: np.ndarray) -> None:
        n, used = self.n + len(ends) - 1, self.used + len(ids)
        if n + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros(max(n + 1, len(self.starts)), np.int64)))
        if used > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(used, len(self.flat)), np.uint32)))
        self.starts[self.n + 1 : n + 1] = self.used + ends[1:]
        self.flat[self.used : used] = ids
        self.n, self.used = n, used

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each word has."""
        start = self.starts[codes]
        length = self.starts[codes + 1] - start
        return _gather(self.flat, start, length), length


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", dictionary: int = DICTIONARY_WORDS, remembered: int = REMEMBERED) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary).

    A null or empty text has no tokens; bytes that are no UTF-8 count as U+FFFD. Repeated rows and null ids each give their row; other columns are ignored;
    an empty table gives an empty result. Texts are encoded whole, whatever their length. dictionary and remembered, the
    words that tasks share and that one keeps, trade memory for folds and leave the result as it is.
    """
    spark: SparkSession = docs.sparkSession
    ranks = read_ranks(rank_path)
    literal = RankMap(spark, ranks)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words, starts, flat = _dictionary(rows.select("text"), pattern, literal, dictionary, remembered)
    known, tables = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast((starts, flat, ranks))
    del words, starts, flat

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text as codes of its words, with the bytes of the words that this task meets first."""
        split = regex.compile(pattern)
        own, new = [], []

        class Codes(dict):
            def __missing__(self, word: str) -> int:
                own.append(word)
                new.append(word.encode())
                self[word] = got = len(self)
                return got

        code_of = Codes((w.as_py().decode(), i) for i, w in enumerate(known.value))
        fixed = len(code_of)
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids, codes, new, reset = zip(*out, strict=True)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in new]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), _byte_lists([w for x in new for w in x]))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.binary()), lists, pa.array(reset)], ["doc_id", "codes", "new", "reset"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                parts = [np.fromiter(map(code_of.__getitem__, run), np.int32, len(run)).tobytes() for run in split_runs((text or b"").decode("utf-8", "replace"), split)]
                full = len(code_of) - fixed > remembered
                if full:
                    for w in own:
                        del code_of[w]
                    own.clear()
                out.append((doc, b"".join(parts), new.copy(), full))
                held += len(out[-1][1]) + 8 * sum(map(len, new))
                new.clear()
                if len(out) >= ROWS_AT_ONCE or held >= BYTES_AT_ONCE:
                    yield flush()
                    held = 0
        if out:
            yield flush()

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, flat, ranks = tables.value
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        piece_len = np.array([len(x) for x in pieces], np.int64)
        piece_at, piece_bytes = np.cumsum(piece_len) - piece_len, np.frombuffer(b"".join(pieces), np.uint8)
        ids = _Ids(starts, flat)

        def decode(x: np.ndarray) -> np.ndarray:
            return _gather(piece_bytes, piece_at[x], piece_len[x])

        for b in batches:
            new, resets = b.column(2), b.column(3).to_pylist()
            # Rows come in the order of the step before, so a word's ids come with the first row that has it.
            row_of_word, out, pending, size, given = _row_ends(new), [], [], 0, 0

            def close() -> None:
                if not pending:
                    return
                x, length = ids.of(np.concatenate(pending))
                ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum([len(c) for c in pending])))]
                decoded = decode(x)
                at = np.concatenate(([0], np.cumsum(piece_len[x])))[ends].tolist()
                raw, text, ends = x.astype("<u4").tobytes(), decoded.tobytes(), ends.tolist()
                out.extend((ends[i + 1] - ends[i], raw[4 * ends[i] : 4 * ends[i + 1]], text[at[i] : at[i + 1]]) for i in range(len(pending)))
                pending.clear()

            flat_new = new.flatten()
            word_ends, word_ids = _row_ends(flat_new) if len(flat_new) else np.zeros(1, np.int64), flat_new.flatten().to_numpy(zero_copy_only=False)
            for i, raw in enumerate(b.column(1)):
                lo, hi = row_of_word[i], row_of_word[i + 1]
                if hi > lo:
                    ends, x = word_ends[lo : hi + 1] - word_ends[lo], word_ids[word_ends[lo] : word_ends[hi]]
                    if (x < 0).any():  # words that are too long for the fold came as they were
                        each = [x[s:e] for s, e in zip(ends, ends[1:], strict=False)]
                        each = [np.array(heap_merges(w[1:].astype(np.uint8).tobytes(), ranks), np.int64) if w[0] < 0 else w for w in each]
                        ends, x = np.concatenate(([0], np.cumsum([len(w) for w in each]))), np.concatenate(each)
                    ids.add(ends, x)
                codes = np.frombuffer(raw.as_buffer(), np.int32)
                if len(codes) > TOKENS_AT_ONCE:
                    close()
                    runs = [ids.of(codes[j : j + TOKENS_AT_ONCE])[0] for j in range(0, len(codes), TOKENS_AT_ONCE)]
                    out.append((sum(map(len, runs)), b"".join(x.astype("<u4").tobytes() for x in runs), b"".join(decode(x).tobytes() for x in runs)))
                else:
                    pending.append(codes)
                    size += len(codes)
                if resets[i] or size > TOKENS_AT_ONCE:
                    close()
                    size = 0
                if resets[i]:
                    ids.reset()
                if i == len(new) - 1:
                    close()
                if out and not pending:
                    cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(given, len(out)), *cols], ["doc_id", "n_tokens", "ids", "decoded"])
                    given += len(out)
                    out.clear()

    coded = rows.mapInArrow(handing_back(code), "doc_id long, codes binary, new array<array<int>>, reset boolean")
    folded = F.transform("new", lambda w: F.when(F.size(w) > FOLD_BYTES, F.concat(F.array(F.lit(-1)), w)).otherwise(fold_merges(w, literal)))
    return coded.select("doc_id", "codes", folded.alias("new"), "reset").mapInArrow(handing_back(put_together), "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """Of what encode() returns, the digests, written, so that whole texts, ids and bytes come in small Arrow batches."""
    rows = encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return written(rows, "token-digests", TEXTS_AT_ONCE)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
