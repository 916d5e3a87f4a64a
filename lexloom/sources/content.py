"""Scans: content trees, inventories, state, RPC answers and binary documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import LAWS
from ..operators.inventory import LAYER
from .tree import read_tree, yaml_json

ARTICLE = f"law string, article int, article_suffix string, title string, sr_number string, absatz_count int, fedlex_url string, lexfind_id int, lexfind_url string, in_force_since string, layers map<string,{LAYER}>"
CONCEPT = "type string, slug string, title string, provisions array<string>, confidence string, author_status string, tags array<string>, last_generated string, quality_score double"
CONTESTED = "type string, slug string, title string, question string, provisions array<string>, positions array<map<string,string>>, author_status string, tags array<string>, last_generated string"


def yaml_to_json(c: Column) -> Column:
    """YAML text as JSON, dates as ISO text; null where it is malformed or no mapping. Marked as costly, so that plans
    run it once."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(yaml_json)

    return convert.asNondeterministic()(c)


def scan_records(spark: SparkSession, root: str, file: str = "meta.yaml", schema: str = ARTICLE) -> DataFrame:
    """law_dir, art_dir, path and the record (null if malformed) of each file of that name under root."""
    named = read_tree(spark, root, file, yaml_json)
    if named is None:
        raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file).text(root, wholetext=True)
        named = raw.select(F.col("_metadata.file_path").alias("path"), yaml_to_json(F.col("value")).alias("value"))
    parts = F.split("path", "/")
    named = named.select(F.element_at(parts, -3).alias("law_dir"), F.element_at(parts, -2).alias("art_dir"), "path", "value")
    return named.where(~F.col("law_dir").startswith(".")).withColumn("record", F.from_json("value", schema)).drop("value")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """law_dir, art_dir, file of every Markdown and YAML file below root."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,yaml}").format("binaryFile").load(root)
    parts = F.split("path", "/")
    return raw.select(F.element_at(parts, -3).alias("law_dir"), F.element_at(parts, -2).alias("art_dir"), F.element_at(parts, -1).alias("file"))


def list_directories(spark: SparkSession, root: str) -> DataFrame:
    """law_dir, art_dir of all directories, with those that hold no file, which no file scan shows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*/*"))
    rows = [(s.getPath().getParent().getName(), s.getPath().getName()) for s in found or [] if s.isDirectory()]
    return spark.createDataFrame(rows, "law_dir string, art_dir string")


def look_up(requests: DataFrame, records: DataFrame, key: list[str], value: str) -> DataFrame:
    """requests with content and is_error: an absent record is an error row, never a failure."""
    out = requests.join(records.select(*key, F.col(value).alias("content")), key, "left")
    return out.withColumn("is_error", F.col("content").isNull()).withColumn("content", F.coalesce("content", F.lit("not found")))


def read_article_lists(spark: SparkSession, path: str) -> DataFrame:
    """law, sr_number, number, suffix, raw, title of an inventory file."""
    entry = "struct<sr_number:string,article_count:int,articles:array<struct<number:int,suffix:string,raw:string,title:string>>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("law", "e")).select("law", "e.sr_number", F.explode("e.articles").alias("a")).select("law", "sr_number", "a.*")


def sse_data(body: Column) -> Column:
    """The JSON of the first line that starts with `data: `; an answer without one fails with its first 200 characters."""
    line = F.get(F.filter(F.split(body, "\n"), lambda x: x.startswith("data: ")), 0)
    return F.coalesce(F.substring(line, 7, 1 << 30), F.raise_error(F.concat(F.lit("no data in answer: "), F.substring(body, 1, 200))))


def rpc_text(body: Column) -> Column:
    """The text items of an RPC answer, one a line; an RPC error fails."""
    got = F.from_json(sse_data(body), "struct<result:struct<content:array<struct<type:string,text:string>>>,error:struct<code:int,message:string>>")
    texts = F.transform(F.filter(F.coalesce(got["result"]["content"], F.array().cast("array<struct<type:string,text:string>>")), lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit("")))
    return F.when(got["error"].isNotNull(), F.raise_error(F.concat(F.lit("RPC error: "), got["error"]["message"]))).otherwise(F.array_join(texts, "\n"))


def fetch_texts(requests: DataFrame, fetch: Callable[[dict], str], concurrency: int = 2, attempts: int = 5, wait: Callable[[float], None] | None = None) -> DataFrame:
    """requests with text: as many partitions as may fetch at once, each request tried up to `attempts` times with
    waits of 2, 5, 8, 11 seconds; what fails in the end has an empty text."""
    names, schema = requests.columns, requests.schema.simpleString()[7:-1].replace(":", " ")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                text = ""
                for attempt in range(attempts):
                    try:
                        text = fetch(row)
                        break
                    except Exception:  # a failed request must not end the job
                        if attempt < attempts - 1:
                            (wait or time.sleep)(2 + 3 * attempt)
                out.append(text)
            yield frame[names].assign(text=out)

    return requests.repartition(concurrency).mapInPandas(run, f"{schema}, text string")


def read_pdf_pages(spark: SparkSession, root: str) -> DataFrame:
    """doc, page, text of PDFs, by pymupdf where it is installed; an unreadable file gives no page."""

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with fitz.open(stream=content, filetype="pdf") as pdf:
                        rows += [(path, i + 1, p.get_text()) for i, p in enumerate(pdf)]
                except (RuntimeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["doc", "page", "text"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(root).select("path", "content").mapInPandas(pages, "doc string, page int, text string")


def rpc_caller(base: str, tool: str, argument: str, timeout: float = 120.0) -> Callable[[str], str]:
    """A function that asks a service for one value: posts a JSON-RPC call of the tool and returns the body. It raises
    on an HTTP error; what the body holds is rpc_text's to say. It can be sent to executors."""

    def ask(value: str) -> str:
        from urllib.request import Request, urlopen

        call = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": {argument: value}}}
        headers = {"Content-Type": "application/json", "Accept": "application/json, text/event-stream"}
        with urlopen(Request(base, json.dumps(call).encode(), headers), timeout=timeout) as answer:
            return answer.read().decode()

    return ask


def seed_affairs(spark: SparkSession, seeds: dict[str, list[str]]) -> DataFrame:
    """(law, affair_id) of the affairs to start from. Every law needs some, and ids are digits; else it is an error."""
    missing = sorted(set(LAWS) - {law for law, ids in seeds.items() if ids})
    bad = sorted(f"{law}: {i!r}" for law, ids in seeds.items() for i in ids if not (i.isascii() and i.isdigit()))
    unknown = sorted(set(seeds) - set(LAWS))
    if missing or bad or unknown:
        raise ValueError(f"laws without an affair: {missing}; no ids: {bad}; unknown laws: {unknown}")
    return spark.createDataFrame([(law, i) for law, ids in seeds.items() for i in dict.fromkeys(ids)], "law string, affair_id string")
