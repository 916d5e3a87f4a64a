"""Article lists of all laws, from a stub of the service."""

import json

import pytest

from lexloom.functions.constants import LAWS
from lexloom.sources import article_source as A


def _body(text):
    return "event: message\ndata: " + json.dumps({"result": {"content": [{"type": "text", "text": text}]}})


def _lists(law):
    return _body(f"{law}\n- Art. 2 Zweck\n- Art. 1\n- Art. 3 – 5 Bereich")


def test_all_laws(spark, tmp_path):
    got, failed = A.fetch_article_lists(spark, _lists, f"file://{tmp_path}/kept", wait=0)
    rows = got.collect()
    assert {r.law for r in rows} == set(LAWS) and len(rows) == 2 * len(LAWS) and failed.count() == 0
    assert [(r.sr_number, r.raw, r.title) for r in rows if r.law == "OR"] == [("220", "1", None), ("220", "2", "Zweck")]


def test_unknown_law_is_an_error_and_asks_nothing(spark, tmp_path):
    log = tmp_path / "asked"

    def ask(law):
        log.write_text(law)
        return _lists(law)

    for f in (lambda: A.fetch_article_lists(spark, ask, f"file://{tmp_path}/k", ["OR", "XYZ"]), lambda: A.answers(spark, ask, ["or"]), lambda: A.article_lists(spark, f"file://{tmp_path}/k", ["XYZ"])):
        with pytest.raises(A.UnknownLaw, match="Unknown law"):
            f()
    assert not log.exists()


def test_bad_laws_do_not_stop_others_and_a_second_run_asks_only_them(spark, tmp_path):
    asked, kept = tmp_path / "asked", f"file://{tmp_path}/kept"
    asked.mkdir()

    def ask(law):
        (asked / f"{law}-{len(list(asked.iterdir()))}").touch()
        if law == "BV":
            raise OSError("no route")
        return {"ZGB": "event: x", "ZPO": 'data: {"error": {"code": 1, "message": "broken"}}', "OR": "data: {}"}.get(law) or _lists(law)

    got, failed = A.fetch_article_lists(spark, ask, kept, group=3, attempts=2, wait=0)
    errors = {r.law: r.error for r in failed.collect()}
    assert set(errors) == {"BV", "ZGB", "ZPO", "OR"} and errors["BV"] == "OSError: no route" and errors["ZPO"] == "RPC error: broken"
    assert errors["ZGB"].startswith("no data") and errors["OR"] == "no result in answer"
    assert {r.law for r in got.collect()} == set(LAWS) - set(errors)
    assert sum(x.name.startswith("BV-") for x in asked.iterdir()) == 2  # tried again
    before = {x.name for x in asked.iterdir()}
    again = tmp_path / "again"
    again.mkdir()

    def mended(law):
        (again / law).touch()
        return _lists(law)

    got, failed = A.fetch_article_lists(spark, mended, kept, wait=0)
    assert {x.name for x in again.iterdir()} == set(errors) and {x.name for x in asked.iterdir()} == before
    assert {r.law for r in got.collect()} == set(LAWS) and failed.count() == 0
    got, _ = A.fetch_article_lists(spark, ask, kept)  # nothing is left to ask
    assert got.count() == 2 * len(LAWS) and {x.name for x in asked.iterdir()} == before


def test_a_partition_for_a_group(spark):
    for group, parts in ((1, 9), (4, 3), (20, 1)):
        assert A.answers(spark, _lists, group=group).rdd.getNumPartitions() == parts
    assert A.answers(spark, _lists, []).count() == 0


def test_cache(spark, tmp_path):
    cache = tmp_path / "lists.json"
    got, _ = A.cached_article_lists(spark, f"file://{cache}", _lists, f"file://{tmp_path}/kept", wanted=["OR"], wait=0)
    assert got.count() == 2
    cache.write_text(json.dumps({"OR": {"sr_number": "220", "article_count": 1, "articles": [{"number": 41, "suffix": "", "raw": "41"}]}}))
    got, failed = A.cached_article_lists(spark, f"file://{cache}", _lists, f"file://{tmp_path}/kept")
    assert [tuple(r) for r in got.collect()] == [("OR", "220", 41, "", "41", None)] and failed.count() == 0
