"""Streams that stop and go on: states of articles, texts of new files."""

import random

import pytest

from lexloom.operators import state as batch
from lexloom.sinks.snapshots import Snapshots
from lexloom.streaming import extraction as X
from lexloom.streaming import state as S


def _events(spark, rng, start, n):
    rows = []
    for seq in range(start, start + n):
        kind = rng.choice(["add", "completed", "failed", "completed"])
        rows.append((seq, rng.choice(["OR", "BV"]), rng.randrange(1, 8), rng.choice(["", "a"]), kind, rng.choice([1.0, 2.5, None]) if kind == "completed" else None, "why" if kind == "failed" else None))
    return spark.createDataFrame(rows, S.EVENTS)


def _states(df):
    return sorted((r.law, r.article_number, r.article_suffix, r.status, r.cost_usd, r.error) for r in df.collect())


def test_stop_and_restart_equals_replay(spark, tmp_path, monkeypatch):
    rng, source = random.Random(4), f"{tmp_path}/events"
    table = S.state_table(spark, f"file://{tmp_path}/table", buckets=3)
    follow = lambda: S.follow(spark, source, table, f"{tmp_path}/checkpoint", files_a_batch=1)
    _events(spark, rng, 0, 40).coalesce(1).write.mode("append").parquet(source)
    follow()
    overwrite, deaths = Snapshots.overwrite, []

    def dies(self, *args):
        number = overwrite(self, *args)
        if not deaths:  # after the table, before the checkpoint
            deaths.append(number)
            raise RuntimeError("lost")
        return number

    monkeypatch.setattr(Snapshots, "overwrite", dies)
    _events(spark, rng, 40, 40).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        follow()
    _events(spark, rng, 80, 40).coalesce(1).write.mode("append").parquet(source)
    follow()
    everything = spark.read.schema(S.EVENTS).parquet(source)
    assert _states(table.read()) == _states(batch.replay(everything)) and len(_states(table.read())) > 10
    one = S.saved_summary(table).first()
    assert one.total == table.read().count() and abs(one.total_cost - batch.total_cost(everything).first()[0]) < 1e-9
    version = table.version()
    follow()  # nothing new
    assert table.version() == version


def test_advance():
    import pandas as pd

    frame = lambda *rows: pd.DataFrame(rows, columns=["seq", "event", "cost", "error"])
    assert S.advance(S._NEW, frame((1, "completed", 2.0, None))) == (None, 0.0, "", 0.0, 1)
    after = S.advance(S._NEW, frame((3, "failed", None, None), (1, "add", None, None), (2, "completed", None, None), (2, "completed", 9.0, None)))
    assert after == ("failed", 0.0, "", 0.0, 3)
    assert S.advance(after, frame((3, "completed", 5.0, None), (4, "completed", 5.0, None))) == ("completed", 5.0, "", 5.0, 4)


def test_second_run_reads_only_new_files(spark, tmp_path):
    root, out, check, log = (tmp_path / x for x in ("in", "out", "check", "log"))
    (root / "sub").mkdir(parents=True)
    log.mkdir()

    def read(content):
        text = content.decode()
        (log / f"{text.split()[0]}-{len(list(log.iterdir()))}").touch()
        if text.startswith("bad"):
            raise ValueError("no pdf")
        return text.split("|")

    run = lambda: X.extract_new(spark, str(root), f"file://{out}", str(check), read, files_a_batch=2)
    for name in ("a", "b", "sub/c", "bad"):
        (root / f"{name}.pdf").write_text(f"{name.split('/')[-1]} Bundes-\nrecht|7\nzwei {'x' * 3000}")
    (root / "note.txt").write_text("no")
    assert run() == {"processed": 4, "skipped": 0}
    got = {r.doc: r for r in X.extracted(spark, f"file://{out}").collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].text == f"[Page 1]\na Bundesrecht\n\n[Page 2]\nzwei {'x' * 3000}" and got["a"].pages == 2 and not got["a"].low_density
    before = sorted(p.name for p in log.iterdir())
    (root / "d.pdf").write_text("d eins")
    (root / "sub" / "a.pdf").write_text("a again")  # another file of a name that is done
    assert run() == {"processed": 1, "skipped": 1}
    assert {p.name.split("-")[0] for p in log.iterdir()} - {n.split("-")[0] for n in before} == {"d"} and len(list(log.iterdir())) == len(before) + 1
    assert run() == {"processed": 0, "skipped": 0}
    rows = {r.doc: r.low_density for r in X.extracted(spark, f"file://{out}").collect()}
    assert rows == {"a": False, "b": False, "c": False, "d": True}


def test_batch_of_a_dead_run_is_written_again(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "in", f"file://{tmp_path}/out"
    root.mkdir()
    (root / "a.pdf").write_text("a")
    run = lambda: X.extract_new(spark, str(root), out, str(tmp_path / "check"), lambda c: [c.decode()])
    names, died = X.Files.names, []

    def once(self, folder):
        if not died:
            died.append(1)
            raise RuntimeError("lost")
        return names(self, folder)

    monkeypatch.setattr(X.Files, "names", once)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.undo()
    assert X.extracted(spark, out).count() == 0
    assert run() == {"processed": 1, "skipped": 0} and [r.text for r in X.extracted(spark, out).collect()] == ["[Page 1]\na"]
