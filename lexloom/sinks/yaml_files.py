"""Files of a tree, one a row: YAML records and texts, written by data sources with a two-phase commit."""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions import text as T
from .files import open_store


def _entries(c: Column, kind: DataType) -> Column:
    """c with maps as arrays of entries, as Python gets a map's keys in no certain order."""
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_entries(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _entries(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), _entries(e["value"], kind.valueType).alias("value")))
    return c


def plain(value, kind: DataType):
    """A value made by _entries as YAML's own kinds: fields and keys keep their order, nulls go at every depth."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return {f.name: plain(value[f.name], f.dataType) for f in kind.fields if value[f.name] is not None}
    if isinstance(kind, MapType):
        return {e["key"]: plain(e["value"], kind.valueType) for e in value if e["value"] is not None}
    return [plain(x, kind.elementType) for x in value] if isinstance(kind, ArrayType) else value


def to_yaml(value, kind: DataType) -> str:
    """A value made by _entries as block YAML; other letters than ASCII stand as they are."""
    import yaml

    dump = lambda by: yaml.dump(plain(value, kind), Dumper=by, default_flow_style=False, allow_unicode=True, sort_keys=False)
    text = dump(getattr(yaml, "CDumper", yaml.Dumper))
    # libyaml is the faster, but escapes what lies beyond 16 bits
    return dump(yaml.Dumper) if "\\U" in text else text


def yaml_text(records: DataFrame, record: str = "record", output: str = "yaml") -> DataFrame:
    """records with the YAML of a struct column; null for null."""
    kind = records.schema[record].dataType
    dump = F.udf(lambda r: None if r is None else to_yaml(r, kind), "string")
    return records.withColumn(output, dump(_entries(F.col(record), kind)))


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: its folder and the number of its files."""

    folder: str
    files: int


class _TreeWriter(DataSourceWriter):
    """Writes a file for each row; row_file gives its names below the root, and its text or None for no file.

    A task stages its files by number, with a list of their paths. Where a staging folder is given, commit moves none and
    notes the tasks' folders for _write_tree."""

    def __init__(self, path: str, staging: str | None = None) -> None:
        self._path, self._noted = path.rstrip("/"), staging is not None
        self._staging = staging or f"{self._path}/.staging-{uuid.uuid4().hex}"

    def row_file(self, row: Row) -> tuple[list[str], str | None]:
        raise NotImplementedError

    def write(self, rows: Iterator[Row]) -> Staged:
        store, top = open_store(f"{self._staging}/{uuid.uuid4().hex}")
        made: dict[str, None] = {}
        for r in rows:
            names, text = self.row_file(r)
            if text is None:
                continue
            for name in names:
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"no name of a directory or file: {name!r}")
            path = "/".join(names)
            if path in made:
                raise ValueError(f"two records for {path}")
            if not made:
                # not in a staging folder that is gone: a task that is stopped may come here after clear
                store.create_dir(top, recursive=not self._noted)
            with store.open_output_stream(f"{top}/{len(made)}") as out:
                out.write(text.encode())
            made[path] = None
        if made:
            with store.open_output_stream(f"{top}/paths") as out:
                out.write(json.dumps(list(made)).encode())
        return Staged(top, len(made))

    def place(self, folder: str) -> None:
        """Moves the files that a task has staged into place; when tried again, it goes on from where it was."""
        from pyarrow import fs

        store, top = open_store(self._path)
        with store.open_input_stream(f"{folder}/paths") as listed:
            paths = json.loads(listed.read())
        for i, path in enumerate(paths):
            source, target = f"{folder}/{i}", posixpath.join(top, path)
            store.create_dir(posixpath.dirname(target), recursive=True)
            try:
                store.move(source, target)
            except OSError:
                if [x.type for x in store.get_file_info([source, target])] != [fs.FileType.NotFound, fs.FileType.File]:
                    raise

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves the files of tasks that succeeded into place; nothing of other attempts is seen by anyone."""
        folders = [m.folder for m in messages if m is not None and m.files]
        if self._noted:
            store, top = open_store(self._staging)
            with store.open_output_stream(f"{top}/folders") as out:
                out.write(json.dumps(folders).encode())
            return
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(self.place, folders))
        self.clear()

    def begin(self) -> None:
        """Makes the staging folder."""
        store, top = open_store(self._staging)
        store.create_dir(top, recursive=True)

    def noted(self) -> list[str]:
        """The folders of tasks that succeeded, as commit has noted them."""
        store, top = open_store(self._staging)
        with store.open_input_stream(f"{top}/folders") as listed:
            return json.loads(listed.read())

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs

        store, top = open_store(self._staging)
        for wait in (0.1, 0.5, 2, None):
            try:
                if store.get_file_info(top).type == fs.FileType.Directory:
                    store.delete_dir(top)
                return
            except OSError:  # a task that is being stopped has written meanwhile
                if wait is None:
                    raise
                time.sleep(wait)


class _YamlWriter(_TreeWriter):
    def __init__(self, path: str, file: str, kind: DataType, staging: str | None = None) -> None:
        super().__init__(path, staging)
        self._file, self._kind = file, kind

    def row_file(self, row: Row) -> tuple[list[str], str | None]:
        return [row["law_dir"], row["art_dir"], self._file], None if row["record"] is None else to_yaml(row["record"], self._kind)


class _TextWriter(_TreeWriter):
    def row_file(self, row: Row) -> tuple[list[str], str | None]:
        return (row["path"] or "").split("/"), row["text"]


class YamlTree(DataSource):
    """Format `yaml_tree`: rows (law_dir, art_dir, record) as files path/law_dir/art_dir/file, meta.yaml by default.

    Option record is the JSON of the record's type, where maps have become arrays of entries (see write_records).
    A record's file is replaced whole; other files stay. A null record writes nothing. Files appear when all tasks have
    succeeded; a job that fails leaves none. Only mode append."""

    @classmethod
    def name(cls) -> str:
        return "yaml_tree"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("yaml_tree replaces single records: write it in mode append")
        if not {"law_dir", "art_dir", "record"} <= set(schema.names):
            raise ValueError("yaml_tree needs the columns law_dir, art_dir and record")
        kind = StructType.fromJson(json.loads(self.options["record"])) if "record" in self.options else schema["record"].dataType
        return _YamlWriter(self.options["path"], self.options.get("file", "meta.yaml"), kind, self.options.get("staging"))


class TextTree(DataSource):
    """Format `text_tree`: rows (path, text) as files below the root, as YamlTree does it. A null text writes nothing;
    a path that leaves the root, or names what is hidden, fails the job."""

    @classmethod
    def name(cls) -> str:
        return "text_tree"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("text_tree replaces single files: write it in mode append")
        if not {"path", "text"} <= set(schema.names):
            raise ValueError("text_tree needs the columns path and text")
        return _TextWriter(self.options["path"], self.options.get("staging"))


def _write_tree(rows: DataFrame, key: list[str], source: type[DataSource], root: str, **options: str) -> None:
    """Writes files in two jobs: tasks stage them, and when all have succeeded, tasks move them into place."""
    spark = rows.sparkSession
    spark.dataSource.register(source)
    staging = f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    writer = _TreeWriter(root, staging)
    # the rows of a key meet in one task, which finds out if there are two; a number, as plans would bring small texts
    # together in one task, though a file takes its time however small it is
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
    try:
        writer.begin()
        dealt.write.format(source.name()).options(staging=staging, **options).mode("append").save(root)
        if folders := writer.noted():
            spark.sparkContext.parallelize(folders, len(folders)).foreach(writer.place)
    finally:
        writer.clear()


def write_texts(rows: DataFrame, root: str) -> None:
    """Writes (path, text) below root; two texts for one path fail the job."""
    _write_tree(rows.select("path", "text"), ["path"], TextTree, root)


def write_layer_files(layers: DataFrame, root: str) -> None:
    """Writes (law, article, suffix, layer, content) as Markdown files of their articles."""
    directory = F.concat_ws("/", F.lower("law"), T.dir_name(F.col("article"), F.col("suffix")))
    write_texts(layers.select(F.concat(directory, F.lit("/"), "layer", F.lit(".md")).alias("path"), F.col("content").alias("text")), root)


def write_cantonal(laws: DataFrame, root: str) -> None:
    """Writes cantonal laws (the fields of choice.CANTONAL but article_count, which is counted here) as files named
    canton-kv.json and so on, by law_key; fields that are null are left out."""
    whole = laws.withColumn("article_count", F.coalesce(F.size("articles"), F.lit(0)))
    fields = [c for c in ("canton", "law_key", "sr_number", "language", "title", "lexfind_id", "source", "fetched_at", "article_count", "articles", "article_texts") if c in whole.columns]
    name = F.concat(F.lower("canton"), F.lit("-"), F.lower("law_key"), F.lit(".json"))
    write_texts(whole.select(name.alias("path"), F.to_json(F.struct(*fields), {"pretty": "true"}).alias("text")), root)


def write_article_documents(articles: DataFrame, root: str) -> None:
    """Writes (law, sr_number, number, suffix, raw, title) as one readable JSON file a law, with its articles in order
    and their number."""
    entry = F.struct("number", "suffix", "raw", "title")
    lists = articles.groupBy("law").agg(F.first("sr_number", ignorenulls=True).alias("sr_number"), F.count("*").alias("article_count"), F.array_sort(F.collect_list(entry)).alias("articles"))
    document = F.to_json(F.create_map(F.col("law"), F.struct("sr_number", "article_count", "articles")), {"pretty": "true"})
    write_texts(lists.select(F.concat(F.lower("law"), F.lit(".json")).alias("path"), document.alias("text")), root)


def write_records(records: DataFrame, root: str, file: str = "meta.yaml") -> None:
    """Writes (law_dir, art_dir, record) below root; two records for one directory fail the job."""
    kind = records.schema["record"].dataType
    rows = records.select("law_dir", "art_dir", _entries(F.col("record"), kind).alias("record"))
    _write_tree(rows, ["law_dir", "art_dir"], YamlTree, root, file=file, record=kind.json())
