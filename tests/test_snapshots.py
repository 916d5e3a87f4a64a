"""Layers overwritten by snapshots: last write wins, replays, dead and rival writers."""

import pytest

from lexloom.sinks import snapshots as S
from lexloom.sinks.files import Files

SCHEMA = "law string, article int, suffix string, layer string, content string, seq long"


@pytest.fixture
def store(spark, tmp_path):
    return S.layer_store(spark, f"file://{tmp_path}/layers", buckets=4)


def _rows(spark, *rows):
    return spark.createDataFrame([(law, n, s, layer, text, seq) for law, n, s, layer, text, seq in rows], SCHEMA)


def _state(df):
    return sorted((r.law, r.article, r.suffix, r.layer, r.content) for r in df.collect())


def test_write_reports_and_reads(spark, store):
    report = S.write_layers(store, _rows(spark, ("OR", 41, None, "summary", "Haftung 𝒳", 1), ("BV", 8, "a", "doctrine", None, 1)), "seq").orderBy("law")
    assert [(r.message, r.chars, r.is_error) for r in report.collect()] == [("Written 0 chars to content/bv/art-008a/doctrine.md", 0, False), ("Written 9 chars to content/or/art-041/summary.md", 9, False)]
    asked = spark.createDataFrame([("OR", 41, "", "summary"), ("OR", 41, "", "caselaw")], "law string, article int, suffix string, layer string")
    assert [(r.content, r.is_error) for r in S.read_layers(store, asked).orderBy("layer").collect()] == [("caselaw.md not found", True), ("Haftung 𝒳", False)]


def test_last_write_wins_and_replay_changes_nothing(spark, store):
    first = [("or", i, "", "summary", f"one {i}", 1) for i in range(30)]
    changes = _rows(spark, ("or", 3, "", "summary", "old", 5), ("or", 3, "", "summary", "new", 6), ("or", 3, "", "summary", "none", None), ("or", 99, "", "summary", "added", 1))
    S.write_layers(store, _rows(spark, *first), "seq")
    assert S.write_layers(store, changes, "seq").count() == 2
    once = _state(store.read())
    S.write_layers(store, changes, "seq")
    assert _state(store.read()) == once and len(once) == 31
    assert {r[4] for r in once if r[1] in (3, 99)} == {"new", "added"}
    assert len(_state(store.read(1))) == 30  # the snapshot before is still there


def test_only_touched_buckets_are_rewritten(spark, store):
    S.write_layers(store, _rows(spark, *[("or", i, "", "summary", "x", 1) for i in range(50)]))
    before = store._state(1)["folders"]
    S.write_layers(store, _rows(spark, ("or", 7, "", "summary", "y", 1)))
    after = store._state(2)["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(after) == 4


def test_killed_write_leaves_the_old_table(spark, store, monkeypatch):
    S.write_layers(store, _rows(spark, ("or", 1, "", "summary", "old", 1)))

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Files, "publish", die)
    with pytest.raises(KeyboardInterrupt):
        S.write_layers(store, _rows(spark, ("or", 1, "", "summary", "new", 1)))
    monkeypatch.undo()
    assert _state(store.read()) == [("or", 1, "", "summary", "old")]
    assert len(store.vacuum()) == 1 and _state(store.read()) == [("or", 1, "", "summary", "old")]


def test_rival_writer_is_not_lost(spark, store, monkeypatch):
    S.write_layers(store, _rows(spark, ("or", 1, "", "summary", "a", 1)))
    publish, done = Files.publish, []

    def rival(self, text, path):
        if not done:
            done.append(1)
            S.write_layers(store, _rows(spark, ("or", 2, "", "summary", "b", 1)))
        return publish(self, text, path)

    monkeypatch.setattr(Files, "publish", rival)
    S.write_layers(store, _rows(spark, ("or", 3, "", "summary", "c", 1)))
    assert [r[1] for r in _state(store.read())] == [1, 2, 3] and store.version() == 3
    monkeypatch.setattr(Files, "publish", lambda *_: False)
    with pytest.raises(S.Conflict):
        S.write_layers(store, _rows(spark, ("or", 4, "", "summary", "d", 1)))


def test_vacuum_keeps_what_is_named(spark, store):
    for i in range(4):
        S.write_layers(store, _rows(spark, ("or", i, "", "summary", str(i), 1)))
    store.vacuum(keep=1)
    assert [r[1] for r in _state(store.read())] == [0, 1, 2, 3] and store.version() == 4


def test_empty_store_and_empty_changes(spark, store):
    assert store.read().count() == 0 and store.version() == 0
    assert S.write_layers(store, _rows(spark)).count() == 0
    S.write_layers(store, _rows(spark, ("or", 1, "", "summary", "x", 1)))
    assert S.write_layers(store, _rows(spark)).count() == 0 and store.read().count() == 1
