"""Trees of many small files, listed and read within tasks: Spark's readers hold the list of all files on the driver."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.files import open_store

BATCH_FILES, BATCH_CHARS = 2000, 8_000_000
#: What Java's URIs quote in a path.
QUOTED = re.compile(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=/@\x80-\U0010ffff]|[\x80-\x9f\s]")


def yaml_json(text: str | None) -> str | None:
    """YAML text as JSON, dates as ISO text; None where it is malformed or no mapping."""
    import yaml

    try:
        got = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if text else None
        return json.dumps(got, default=str) if isinstance(got, dict) else None
    except yaml.YAMLError:
        return None


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a name."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))


def _children(store, folder: str) -> Iterator[tuple[str, bool]]:
    """Path of each name in a folder that is not hidden, and whether it is a folder."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):  # one by one, where pyarrow holds all
        with os.scandir(folder) as found:
            for e in found:
                if not _hidden(e.name):
                    yield e.path, e.is_dir()
    else:
        for i in store.get_file_info(fs.FileSelector(folder)):
            if not _hidden(i.base_name):
                yield i.path, i.type == fs.FileType.Directory


def _files(store, folder: str, file: str) -> Iterator[str]:
    """Paths of the files of that name at any depth."""
    for path, is_folder in _children(store, folder):
        if is_folder:
            yield from _files(store, path, file)
        elif path.rpartition("/")[2] == file:
            yield path


def read_tree(spark: SparkSession, root: str, file: str, convert: Callable[[str], str | None]) -> DataFrame | None:
    """path (quoted as Spark shows it), and value by convert (None if the bytes are no UTF-8), of each file of that name at any depth under root;
    empty files are left out, as Spark's readers do. The first two levels of folders are dealt out, and what is below is
    listed where it is read. None where only Spark's readers can do it: root or file is a pattern, or pyarrow can't open
    the file system."""
    import pyarrow as pa
    from pyarrow import fs

    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    uri, shown = path.toString().rstrip("/"), path.toUri().toString().rstrip("/").replace("file:///", "file:/", 1)
    try:
        store, top = open_store(uri)
        if re.search(r"[*?\[\]{}\\]", file) or store.get_file_info(top).type != fs.FileType.Directory:
            return None
    except (OSError, pa.ArrowException):
        return None

    def batches(rows: Iterator[tuple], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for row in rows:
            held.append(row)
            chars += len(row[0]) + (len(row[1] or "") if kinds[1] == pa.string() else 0)
            if len(held) >= BATCH_FILES or chars > BATCH_CHARS:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                held, chars = [], 0
        if held:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    def rows_of(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool]]:
        for batch in found:
            yield from zip(batch.column("path").to_pylist(), batch.column("is_folder").to_pylist())

    def level(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = open_store(uri)[0]

        def rows() -> Iterator[tuple[str, bool]]:
            for path, is_folder in rows_of(found):
                if not is_folder:
                    yield path, False
                else:
                    yield from ((p, is_f) for p, is_f in _children(store, path) if is_f or p.rpartition("/")[2] == file)

        return batches(rows(), ["path", "is_folder"], [pa.string(), pa.bool_()])

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(uri)

        def rows() -> Iterator[tuple[str, str | None]]:
            for path, is_folder in rows_of(found):
                for p in _files(store, path, file) if is_folder else [path]:
                    with store.open_input_stream(p) as stream:
                        data = stream.read()
                    if data:
                        try:
                            value = convert(data.decode())
                        except UnicodeDecodeError:
                            value = None
                        yield shown + QUOTED.sub(lambda m: quote(m[0], safe=""), p[len(top) :]), value

        return batches(rows(), ["path", "value"], [pa.string(), pa.string()])

    # a number of partitions, as plans would otherwise bring names, which are few bytes, together in one task
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.range(0, 1, 1, 1).select(F.lit(top).alias("path"), F.lit(True).alias("is_folder"))
    for _ in range(2):
        listed = listed.mapInArrow(level, "path string, is_folder boolean").repartition(n, "path")
    return listed.mapInArrow(read, "path string, value string")
