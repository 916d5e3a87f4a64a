"""A keyed table in buckets, overwritten by whole snapshots.

A snapshot is one small file that names the folder of every bucket. A write makes new folders for the buckets it
touches, then publishes the next snapshot; readers take the highest one, so they see a write whole or not at all, and a
writer that dies leaves nothing that a reader finds. Two writers at once cannot both publish a number: the later one
starts over from what the earlier one left."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from .files import Files

LAYER_KEY = ["law", "article", "suffix", "layer"]
LAYERS = "law string, article int, suffix string, layer string, content string"


class Conflict(RuntimeError):
    """Other writers published first, more often than a write is tried again."""


class Snapshots:
    """The table of one root folder. key: columns that name a row; nulls are values like others."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], schema: str, buckets: int = 64) -> None:
        self._spark, self._root, self._key, self._files = spark, root.rstrip("/"), key, Files(spark, root)
        self._schema = StructType.fromDDL(schema)
        self._buckets = buckets

    def version(self) -> int:
        """The number of the newest snapshot; 0 before the first."""
        return max((int(n) for n in self._files.names(f"{self._root}/snapshots") if n.isdigit()), default=0)

    def _state(self, version: int) -> dict:
        if not version:
            return {"buckets": self._buckets, "folders": {}}
        return json.loads(self._files.read(f"{self._root}/snapshots/{version:012d}"))

    def _load(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(*[f"{self._root}/{x}" for x in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, the newest if none is named. It stays readable while others write, until vacuum."""
        return self._load(sorted(self._state(self.version() if version is None else version)["folders"].values()))

    def overwrite(self, changes: DataFrame, order: str | None = None, attempts: int = 5) -> int:
        """Puts rows in place of those with their keys, the one of the highest order where changes hold several (nulls
        are lowest; without an order, or in a tie, the greatest row). Writing the same changes again changes nothing.
        The number of the snapshot."""
        names = self._schema.names
        rank = [F.col(order)] if order else []
        newest = changes.groupBy(*self._key).agg(F.max_by(F.struct(*names), F.struct(*rank, *[n for n in names if n not in self._key])).alias("row")).select("row.*")
        folder = f"data/{uuid.uuid4().hex}"
        for attempt in range(attempts):
            version = self.version()
            state = self._state(version)
            bucket = F.pmod(F.xxhash64(*self._key), F.lit(state["buckets"])).cast("int")
            staged = newest.withColumn("__bucket", bucket)
            touched = [r[0] for r in staged.select("__bucket").distinct().collect()]  # at most as many as there are buckets
            old = self._load([state["folders"][str(b)] for b in sorted(touched) if str(b) in state["folders"]])
            same = F.lit(True)
            for k in self._key:
                same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
            kept = old.alias("o").join(newest.select(*self._key).alias("n"), same, "left_anti").select(*names)
            target = f"{folder}-{attempt}"
            whole = kept.unionByName(newest).withColumn("__bucket", bucket).repartition(max(1, min(len(touched), state["buckets"])), "__bucket")
            whole.write.partitionBy("__bucket").parquet(f"{self._root}/{target}")
            folders = state["folders"] | {str(b): f"{target}/__bucket={b}" for b in touched}
            if self._files.publish(json.dumps({"buckets": state["buckets"], "folders": folders}), f"{self._root}/snapshots/{version + 1:012d}"):
                return version + 1
            self._files.delete(f"{self._root}/{target}")
        raise Conflict(f"{attempts} snapshots of {self._root} were published by others meanwhile")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the newest snapshots, and folders that no kept one names, those of dead writers with them.
        Only while nobody writes. The folders deleted."""
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        named = {f.split("/")[1] for v in kept for f in self._state(v)["folders"].values()}
        gone = [n for n in self._files.names(f"{self._root}/data") if n not in named]
        for n in gone:
            self._files.delete(f"{self._root}/data/{n}")
        for n in self._files.names(f"{self._root}/snapshots"):
            if n.isdigit() and int(n) not in kept:
                self._files.delete(f"{self._root}/snapshots/{n}")
        return gone


def layer_store(spark: SparkSession, root: str, buckets: int = 64) -> Snapshots:
    """Layer texts by law, article, suffix and layer."""
    return Snapshots(spark, root, LAYER_KEY, LAYERS, buckets)


def normal_keys(rows: DataFrame) -> DataFrame:
    """Layer rows under the keys of the store: law in lower case, an absent suffix empty."""
    return rows.withColumns({"law": F.lower("law"), "suffix": F.coalesce("suffix", F.lit(""))})


def write_layers(store: Snapshots, changes: DataFrame, order: str | None = None, root: str = "content") -> DataFrame:
    """Overwrites layers and reports each: LAYER_KEY, chars, message, is_error (always false).

    chars counts the code points of the text written; a null text is written empty. Of several changes of a layer the
    last by order is the one written and reported."""
    rows = normal_keys(changes).withColumn("content", F.coalesce("content", F.lit("")))
    version = store.overwrite(rows, order)
    path = F.concat(T.article_path(root, F.col("law"), F.col("article"), F.col("suffix")), F.lit("/"), "layer", F.lit(".md"))
    written = store.read(version).join(rows.select(*LAYER_KEY).distinct(), LAYER_KEY, "left_semi")
    chars = F.char_length("content").cast("long")
    return written.select(*LAYER_KEY, chars.alias("chars"), F.concat(F.lit("Written "), chars.cast("string"), F.lit(" chars to "), path).alias("message"), F.lit(False).alias("is_error"))


def read_layers(store: Snapshots, requests: DataFrame) -> DataFrame:
    """requests (LAYER_KEY) with content and is_error; an absent layer is an error row that names its file."""
    found = normal_keys(requests).join(store.read(), LAYER_KEY, "left")
    return found.withColumn("is_error", F.col("content").isNull()).withColumn("content", F.coalesce("content", F.concat("layer", F.lit(".md not found"))))
