"""File actions: nothing is overwritten, a run acts once, and a repeated task recognises its own work."""

import os

import pytest

from twinweave.operators import actions
from twinweave.operators.actions import _act, _identity


def _files(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(f"content of {n}")


def _plan(spark, root, names, destination, action="Move"):
    rows = spark.createDataFrame([(str(root / n), i) for i, n in enumerate(names)], "file_path string, seq long")
    return actions.flat_plan(rows, str(destination), action)


def _held(folder):
    return {n: (folder / n).read_text() for n in sorted(os.listdir(folder))}


@pytest.mark.parametrize("action", ["Move", "Copy", "Recycle"])
def test_equal_names_are_all_kept(spark, tmp_path, action):
    names = ["s1/x.jpg", "s2/x.jpg", "s3/x (1).jpg", "s4/y.jpg"]
    _files(tmp_path, *names, "out/x.jpg")
    done = actions.execute(_plan(spark, tmp_path, names, tmp_path / "out", action), dry_run=False)
    assert actions.fold(done).first()["succeeded"] == 4
    assert sorted(_held(tmp_path / "out").values()) == sorted(f"content of {n}" for n in [*names, "out/x.jpg"])
    assert _held(tmp_path / "out")["x.jpg"] == "content of out/x.jpg"
    assert [(tmp_path / n).exists() for n in names] == [action == "Copy"] * 4


def test_reading_the_result_again_acts_no_more(spark, tmp_path):
    _files(tmp_path, "a/x.jpg", "b/x.jpg")
    done = actions.execute(_plan(spark, tmp_path, ["a/x.jpg", "b/x.jpg"], tmp_path / "out"), dry_run=False)
    first, held = sorted(done.collect()), _held(tmp_path / "out")
    _files(tmp_path, "a/x.jpg")  # a new file of the old name stays where it is
    assert sorted(done.collect()) == first and _held(tmp_path / "out") == held
    assert (tmp_path / "a/x.jpg").exists() and actions.succeeded_paths(done).count() == 2


def test_a_dry_run_touches_nothing(spark, tmp_path):
    _files(tmp_path, "a/x.jpg", "b/x.jpg")
    rows = actions.execute(_plan(spark, tmp_path, ["a/x.jpg", "b/x.jpg", "gone.jpg"], tmp_path / "out")).collect()
    assert sorted((os.path.basename(r["target"]), r["ok"]) for r in rows) == [("gone.jpg", False), ("x (1).jpg", True), ("x.jpg", True)]
    assert not (tmp_path / "out").exists()


def test_given_targets_are_never_overwritten_or_shared(spark, tmp_path):
    _files(tmp_path, "a/x.jpg", "b/x.jpg", "c/z.jpg", "out/z.jpg")
    out = str(tmp_path / "out")
    rows = [("Move", str(tmp_path / p), f"{out}/{t}") for p, t in (("a/x.jpg", "x.jpg"), ("b/x.jpg", "x.jpg"), ("c/z.jpg", "z.jpg"))]
    done = actions.execute(spark.createDataFrame(rows, "action string, file_path string, target string"), dry_run=False).collect()
    assert not any(r["ok"] for r in done)
    assert _held(tmp_path / "out") == {"z.jpg": "content of out/z.jpg"} and (tmp_path / "a/x.jpg").exists() and (tmp_path / "c/z.jpg").exists()


@pytest.mark.parametrize("action", ["Move", "Copy", "Delete"])
@pytest.mark.parametrize("linked", [True, False])
def test_a_repeated_task_recognises_its_work(tmp_path, monkeypatch, action, linked):
    if not linked:
        monkeypatch.setattr(actions, "_link", lambda a, b: False)
    _files(tmp_path, "a.jpg")
    source, target = str(tmp_path / "a.jpg"), None if action == "Delete" else str(tmp_path / "out" / "a.jpg")
    was = _identity(source)
    for _ in range(3):
        _act(action, source, target, was)
    assert (tmp_path / "a.jpg").exists() == (action == "Copy")
    if target:
        assert _held(tmp_path / "out") == {"a.jpg": "content of a.jpg"}


def test_an_attempt_that_died_between_link_and_removal(tmp_path):
    _files(tmp_path, "a.jpg")
    os.makedirs(tmp_path / "out")
    was = _identity(str(tmp_path / "a.jpg"))
    os.link(tmp_path / "a.jpg", tmp_path / "out" / "a.jpg")
    _act("Move", str(tmp_path / "a.jpg"), str(tmp_path / "out" / "a.jpg"), was)
    assert not (tmp_path / "a.jpg").exists() and _held(tmp_path / "out") == {"a.jpg": "content of a.jpg"}


def test_grouped_plans_run(spark, tmp_path):
    _files(tmp_path, "a/x.jpg", "b/x.jpg", "c/x.jpg")
    rows = spark.createDataFrame([(str(tmp_path / p), i, n) for i, (p, n) in enumerate((("a/x.jpg", "Group 1"), ("b/x.jpg", "Group 1"), ("c/x.jpg", "...")))], "file_path string, seq long, name string")
    done = actions.execute(actions.grouped_plan(rows, str(tmp_path / "out")), dry_run=False)
    assert sorted(r["error"] or "" for r in done.collect()) == ["", "", "no folder name"]
    assert sorted(_held(tmp_path / "out" / "Group 1").values()) == ["content of a/x.jpg", "content of b/x.jpg"]


def test_deletion(spark, tmp_path):
    _files(tmp_path, "a.jpg", "b/a.jpg", "trash/a.jpg")
    rows = spark.createDataFrame([(str(tmp_path / "a.jpg"), 0), (str(tmp_path / "b/a.jpg"), 1)], "file_path string, seq long")
    assert actions.fold(actions.execute(actions.delete_plan(rows.where("seq = 1"), trash=str(tmp_path / "trash")), dry_run=False)).first()["succeeded"] == 1
    assert _held(tmp_path / "trash") == {"a (1).jpg": "content of b/a.jpg", "a.jpg": "content of trash/a.jpg"}
    assert actions.fold(actions.execute(actions.delete_plan(rows, permanent=True), dry_run=False)).first()["failed"] == 1
    assert not (tmp_path / "a.jpg").exists()
