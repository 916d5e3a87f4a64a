"""Article lists of all laws from a service, by a data source: one partition for a group of laws, answers kept as they
come, so that a run that stopped goes on where it was."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.constants import LAWS, laws
from ..operators.inventory import parse_article_lists
from ..sinks.files import Files, new_folder
from .content import read_article_lists, rpc_text

ANSWERS = "law string, body string, error string, attempts int"
ARTICLES = "law string, sr_number string, number int, suffix string, raw string, title string"


class UnknownLaw(ValueError):
    """A law that the corpus does not have."""


def check_laws(wanted: list[str]) -> list[str]:
    """The laws themselves; one that is not known is an error, before anything is asked."""
    for law in wanted:
        if law not in LAWS:
            raise UnknownLaw(f"Unknown law: {law}")
    return list(dict.fromkeys(wanted))


class _Group(InputPartition):
    def __init__(self, names: list[str]) -> None:
        super().__init__(names)
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, names: list[str], group: int, attempts: int, wait: float, ask: Callable[[str], str]) -> None:
        self._names, self._group, self._attempts, self._wait, self._ask = names, group, attempts, wait, ask

    def partitions(self) -> list[_Group]:
        return [_Group(self._names[i : i + self._group]) for i in range(0, len(self._names), self._group)]

    def read(self, partition: _Group) -> Iterator[tuple]:
        for law in partition.names:
            body = error = None
            for attempt in range(1, self._attempts + 1):
                try:
                    body, error = self._ask(law), None
                    break
                except Exception as e:  # what one law does must not end the others
                    error = f"{type(e).__name__}: {e}"
                    if attempt < self._attempts and self._wait:
                        time.sleep(self._wait * attempt)
            yield law, body, error, attempt


def answers(spark: SparkSession, ask: Callable[[str], str], wanted: list[str] | None = None, group: int = 1, attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """(law, body, error, attempts): the answer of `ask` for each law, or the error of its last attempt. A partition
    asks for `group` laws, one after the other; ask runs on executors and is sent there."""
    names = check_laws(list(LAWS) if wanted is None else wanted)
    if not names:
        return spark.createDataFrame([], ANSWERS)

    class ArticleAnswers(DataSource):
        @classmethod
        def name(cls) -> str:
            return "article_answers"

        def schema(self) -> str:
            return ANSWERS

        def reader(self, schema) -> DataSourceReader:
            return _Reader(names, group, attempts, wait, ask)

    spark.dataSource.register(ArticleAnswers)
    return spark.read.format("article_answers").load()


def parse_answers(got: DataFrame) -> DataFrame:
    """(law, text, error) of answers: the text of an RPC body, or what was wrong with it. An answer that is no RPC
    answer is the error of its law alone."""
    line = F.get(F.filter(F.split("body", "\n"), lambda x: x.startswith("data: ")), 0)
    shape = F.from_json(F.substring(line, 7, 1 << 30), "struct<error:struct<code:int,message:string>,result:struct<content:array<struct<type:string,text:string>>>>")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(line.isNull(), F.concat(F.lit("no data in answer: "), F.coalesce(F.substring("body", 1, 200), F.lit("")))).when(shape["error"].isNotNull(), F.concat(F.lit("RPC error: "), F.coalesce(shape["error"]["message"], F.lit("")))).when(shape["result"].isNull(), F.lit("no result in answer"))
    found = got.withColumn("__error", error)
    return found.select("law", F.when(F.col("__error").isNull(), rpc_text(F.col("body"))).alias("text"), F.col("__error").alias("error"))


def fetch_article_lists(spark: SparkSession, ask: Callable[[str], str], path: str, wanted: list[str] | None = None, group: int = 1, attempts: int = 3, wait: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(articles, failed) of the laws wanted, all by default: ARTICLES sorted within a law, and (law, error).

    Answers are kept below path, one folder a law; laws that are there are not asked again, so the same call goes on
    after a stop or with the laws that failed. An unknown law is an error and asks nothing."""
    names = check_laws(list(LAWS) if wanted is None else wanted)
    files = Files(spark, path)
    had = {n.removeprefix("law=") for n in files.names(path)}
    rest = [n for n in names if n not in had]
    failed = spark.createDataFrame([], "law string, error string")
    if rest:
        # asked once: what came in is kept before anything is made of it
        folder = new_folder(spark, "answers")
        answers(spark, ask, rest, group, attempts, wait).write.parquet(folder)
        parsed = parse_answers(spark.read.schema(ANSWERS).parquet(folder))
        parsed.where("error IS NULL").select("law", "text").write.partitionBy("law").mode("append").parquet(path)
        failed = parsed.where("error IS NOT NULL").select("law", "error")
    return article_lists(spark, path, names), failed


def article_lists(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """ARTICLES of the answers kept below path."""
    names = check_laws(list(LAWS) if wanted is None else wanted)
    try:
        kept = spark.read.schema("text string, law string").parquet(path).where(F.col("law").isin(names))
    except AnalysisException:
        return spark.createDataFrame([], ARTICLES)
    lists = parse_article_lists(kept.select("law", "text"))
    return lists.join(F.broadcast(laws(spark).select("law", "sr_number")), "law").select("law", "sr_number", "number", "suffix", "raw", "title")


def cached_article_lists(spark: SparkSession, cache: str, ask: Callable[[str], str], path: str, **options) -> tuple[DataFrame, DataFrame]:
    """What an inventory file holds, where there is one; else fetch_article_lists."""
    if Files(spark, cache).exists(cache):
        return read_article_lists(spark, cache).select(*[c.split()[0] for c in ARTICLES.split(", ")]), spark.createDataFrame([], "law string, error string")
    return fetch_article_lists(spark, ask, path, **options)
