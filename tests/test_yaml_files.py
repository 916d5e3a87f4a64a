"""YAML records written in two phases and read back."""

import os

import pytest
import yaml
from pyspark.sql import functions as F

from lexloom.sinks.yaml_files import write_records, yaml_text
from lexloom.sources.content import ARTICLE, CONCEPT, CONTESTED, scan_records

LAYER = ("2026-03-17", 2, 0.5, None, None, None, 3)


def _articles(spark, n=12):
    rows = [("or" if i % 2 else "bv", f"art-{i:03d}", ("OR" if i % 2 else "BV", i, "", f"Titel: «{i}» # no comment", "220", 1, "https://x/#art_1", None, "", "2026-01-01", {"summary": LAYER, "caselaw": LAYER} if i % 3 else {})) for i in range(1, n + 1)]
    record = ", ".join(f"{f.split(' ', 1)[0]}:{f.split(' ', 1)[1]}" for f in [x.strip() for x in _split(ARTICLE)])
    return spark.createDataFrame(rows, f"law_dir string, art_dir string, record struct<{record}>")


def _split(ddl):
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc"))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_round_trip(spark, tmp_path, scheme):
    df = _articles(spark)
    write_records(df, f"{scheme}{tmp_path}")
    assert _files(tmp_path) == sorted(f"{r.law_dir}/{r.art_dir}/meta.yaml" for r in df.collect())
    back = scan_records(spark, str(tmp_path)).select("law_dir", "art_dir", "record")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_nulls_dropped_and_order_kept(spark, tmp_path):
    write_records(_articles(spark, 1), str(tmp_path))
    text = (tmp_path / "or/art-001/meta.yaml").read_text()
    assert "lexfind_id" not in text and "trigger" not in text and "«1»" in text
    got = yaml.safe_load(text)
    assert list(got) == ["law", "article", "article_suffix", "title", "sr_number", "absatz_count", "fedlex_url", "lexfind_url", "in_force_since", "layers"]
    assert list(got["layers"]["summary"]) == ["last_generated", "version", "quality_score", "new_decisions_count"]
    assert got["layers"]["summary"]["last_generated"] == "2026-03-17"  # a string, not a date


def test_record_replaced_others_stay(spark, tmp_path):
    write_records(_articles(spark, 3), str(tmp_path))
    (tmp_path / "or/art-001/summary.md").write_text("x")
    (tmp_path / "bv/art-002/meta.yaml").unlink()
    write_records(_articles(spark, 1).withColumn("record", F.col("record").withField("title", F.lit("neu"))), str(tmp_path))
    assert _files(tmp_path) == ["or/art-001/meta.yaml", "or/art-001/summary.md", "or/art-003/meta.yaml"]
    assert yaml.safe_load((tmp_path / "or/art-001/meta.yaml").read_text())["title"] == "neu"


@pytest.mark.parametrize("bad", ["", "../x", ".git", None])
def test_failed_task_leaves_no_file(spark, tmp_path, bad):
    rows = _articles(spark).unionByName(_articles(spark, 1).withColumn("art_dir", F.lit(bad).cast("string")))
    with pytest.raises(Exception, match="no name of a directory"):
        write_records(rows, str(tmp_path))
    assert _files(tmp_path) == [] and not [x for x in os.listdir(tmp_path) if x.startswith(".staging")]


def test_two_records_fail_and_null_record_writes_nothing(spark, tmp_path):
    df = _articles(spark, 2)
    with pytest.raises(Exception, match="two records"):
        write_records(df.unionAll(df), str(tmp_path))
    write_records(df.withColumn("record", F.when(F.col("law_dir") == "or", F.col("record"))), str(tmp_path))
    write_records(df.limit(0), str(tmp_path))
    assert _files(tmp_path) == ["or/art-001/meta.yaml"]
    with pytest.raises(Exception, match="append"):
        df.write.format("yaml_tree").mode("overwrite").save(str(tmp_path))


def test_concepts_and_contested(spark, tmp_path):
    concept = '{"type":"concept","slug":"s","title":"T","provisions":["or/art-041"],"confidence":"settled","author_status":"draft","tags":[],"last_generated":""}'
    contested = '{"type":"contested","slug":"s","title":"T","question":"Q?","provisions":[],"positions":[{"label":"a","summary":"b"}],"author_status":"contested","tags":["x"],"last_generated":""}'
    for text, ddl, file in ((concept, CONCEPT, "concept.yaml"), (contested, CONTESTED, "contested.yaml")):
        df = spark.createDataFrame([(text,)], "j string").select(F.lit("concepts").alias("law_dir"), F.lit("s").alias("art_dir"), F.from_json("j", ddl).alias("record"))
        write_records(df, str(tmp_path), file)
        assert scan_records(spark, str(tmp_path), file, ddl).first().record == df.first().record
        text = (tmp_path / f"concepts/s/{file}").read_text()
        assert yaml_text(df).first().yaml == text and list(yaml.safe_load(text)) == [n for n in df.schema["record"].dataType.names if n != "quality_score"]
        assert file == "concept.yaml" or "- label: a\n  summary: b\n" in text


def test_libyaml_writes_what_python_writes(monkeypatch):
    """Records are dumped by libyaml, letters of any plane standing as they are."""
    import yaml
    from pyspark.sql.types import StructType

    from lexloom.sinks.yaml_files import to_yaml

    kind, used = StructType().add("t", "string"), []
    real = yaml.dump
    monkeypatch.setattr(yaml, "dump", lambda *a, **k: used.append(k["Dumper"]) or real(*a, **k))
    for t in ("Übergang", "x: y # z", "\U0001f600 smile", "null", "2026-01-01", "é" * 200, " a\tb "):
        assert to_yaml({"t": t}, kind) == real({"t": t}, default_flow_style=False, allow_unicode=True, sort_keys=False)
    assert not yaml.__with_libyaml__ or used.count(yaml.CDumper) == 7


def test_tasks_list_the_tree(spark, tmp_path):
    """A scan's plan holds no list of files, and finds what Spark's own reader finds, by the same paths."""
    from lexloom.sources.content import yaml_to_json

    kept = ["or/art-001/meta.yaml", "or/art 2%20ü#\u00a0[]/meta.yaml", "a/b/c/d/meta.yaml", "meta.yaml", "or/meta.yaml", "_x=1/a/meta.yaml", "or/empty/meta.yaml", "or/none/other.yaml", "or/bad/meta.yaml", "or/list/meta.yaml"]
    for name in [*kept, ".git/a/meta.yaml", "_tmp/a/meta.yaml", "or/.hidden/meta.yaml", "or/_x/meta.yaml", "or/art-001/x.meta.yaml", "or/art-001/.meta.yaml.crc"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("a: [" if "/bad/" in name else "- 1\n" if "/list/" in name else "" if "/empty/" in name else f"title: '{name}'\n")
    (tmp_path / "or/nothing").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "a")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.yaml").text(str(tmp_path), wholetext=True)
    wanted = raw.select(F.col("_metadata.file_path").alias("path"), F.get_json_object(yaml_to_json(F.col("value")), "$.title").alias("title"))
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}", f"{tmp_path}/"):
        got = scan_records(spark, root)
        assert got.inputFiles() == []
        assert sorted(map(str, got.select("path", "record.title").collect())) == sorted(map(str, wanted.collect()))
        assert {(r.law_dir, r.art_dir) for r in got.collect()} >= {("or", "art-001"), ("c", "d"), ("_x=1", "a")}
    assert scan_records(spark, str(tmp_path), "{meta,other}.yaml").where("art_dir = 'none'").count() == 1  # a pattern is Spark's to read
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_records(spark, f"{tmp_path}/absent")


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "or/art-001").mkdir(parents=True)
    (tmp_path / "or/art-001/meta.yaml").write_bytes(b"title: \xff\n")
    assert [(r.art_dir, r.record) for r in scan_records(spark, str(tmp_path)).collect()] == [("art-001", None)]


def test_files_are_staged_and_then_moved_by_tasks(spark, tmp_path):
    """With a staging folder, commit moves nothing; a move goes on where it was stopped, and fails if a file is lost."""
    from lexloom.sinks.yaml_files import _TextWriter

    writer = _TextWriter(str(tmp_path), f"{tmp_path}/.staging-x")
    writer.begin()
    staged = writer.write(iter([{"path": f"or/art-{i}/a.md", "text": str(i)} for i in range(4)] + [{"path": "no", "text": None}]))
    writer.commit([staged, None, writer.write(iter([]))])
    assert staged.files == 4 and writer.noted() == [staged.folder] and not (tmp_path / "or").exists()
    (tmp_path / "or/art-0").mkdir(parents=True)
    os.rename(f"{staged.folder}/0", tmp_path / "or/art-0/a.md")
    writer.place(staged.folder)
    writer.place(staged.folder)
    writer.clear()
    assert [(tmp_path / f"or/art-{i}/a.md").read_text() for i in range(4)] == list("0123") and os.listdir(tmp_path) == ["or"]
    with pytest.raises(OSError):  # a task that outlives its job makes no staging folder anew
        writer.write(iter([{"path": "or/late.md", "text": "x"}]))
    assert os.listdir(tmp_path) == ["or"]
    writer.begin()
    staged = writer.write(iter([{"path": "or/lost.md", "text": "x"}]))
    os.remove(f"{staged.folder}/0")
    with pytest.raises(OSError):
        writer.place(staged.folder)


def test_small_records_are_written_by_many_tasks(spark, tmp_path):
    """Plans brought small records together in one task, however many files they are."""
    done = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many-tasks", "")
    try:
        write_records(_articles(spark, 40), str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s: done.getStageInfo(s) for j in done.getJobIdsForGroup("many-tasks") for s in done.getJobInfo(j).stageIds}
    ran = [i.numCompletedTasks for i in stages.values() if i and i.numCompletedTasks]  # none of a stage that was skipped
    assert ran == [4] * 3  # dealing out, staging and moving
    assert len(_files(tmp_path)) == 40 and not [x for x in os.listdir(tmp_path) if x.startswith(".")]
