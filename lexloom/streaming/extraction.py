"""Texts of new documents only: a stream over a folder of files, its checkpoint, and outputs by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import density, join_pages
from ..sinks.files import Files

TEXTS = "doc string, pages long, text string, chars_per_page double, low_density boolean"


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page, by pymupdf; none of what it cannot read."""
    import fitz

    try:
        with fitz.open(stream=content, filetype="pdf") as pdf:
            return [p.get_text() for p in pdf]
    except (RuntimeError, ValueError):
        return []


def page_rows(files: DataFrame, read: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, content) -> doc, page, text; doc is the file's name without its ending. A file that read fails on has no
    page."""

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    found = read(bytes(content))
                except Exception:  # one broken file must not end the run
                    found = []
                rows += [(path.rpartition("/")[2].rpartition(".")[0], i + 1, t) for i, t in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc", "page", "text"])

    return files.select("path", "content").mapInPandas(pages, "doc string, page int, text string")


def extracted(spark: SparkSession, out: str) -> DataFrame:
    """TEXTS of all batches; a document that came twice counts as it came first."""
    if not any(n.startswith("batch=") for n in Files(spark, out).names(out)):
        return spark.createDataFrame([], TEXTS)
    rows = spark.read.schema(TEXTS + ", batch long").parquet(out)
    names = [c.split()[0] for c in TEXTS.split(", ")]
    return rows.groupBy("doc").agg(F.min_by(F.struct(*names[1:]), "batch").alias("r")).select("doc", "r.*")


def extract_new(spark: SparkSession, root: str, out: str, checkpoint: str, read: Callable[[bytes], list[str]] = pdf_pages, glob: str = "*.pdf", files_a_batch: int = 200) -> dict[str, int]:
    """Extracts the files below root that no run before has seen, and returns how many documents were processed and how
    many skipped, as out had them already.

    A batch is written as a folder of its number, in place of what a dead run left of it, and its files count as seen
    only after that."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(root)
    counts = {"processed": 0, "skipped": 0}

    def take(batch: DataFrame, number: int) -> None:
        had = Files(spark, out)
        done = [f"{out}/{n}" for n in had.names(out) if n.startswith("batch=") and n != f"batch={number}"]
        named = batch.withColumn("doc", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
        fresh = named
        if done:
            fresh = named.join(spark.read.schema(TEXTS).parquet(*done).select("doc"), "doc", "left_anti")
        texts = density(join_pages(page_rows(fresh, read)))
        texts.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in TEXTS.split(", ")]).write.mode("overwrite").parquet(f"{out}/batch={number}")
        new = fresh.count()
        counts["processed"] += new
        counts["skipped"] += named.count() - new

    query = files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()
    return counts
