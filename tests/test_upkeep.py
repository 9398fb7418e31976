"""Selections by their log, groups kept by removals, measured progress, names and white space."""

import random
import time

import pytest
from pyspark.sql import functions as F

from twinweave.config import Settings
from twinweave.functions import paths
from twinweave.operators import groups, progress, selection
from twinweave.operators import selection_log as sl
from twinweave.operators.group_state import GroupState
from twinweave.plans.finder import DuplicateFinder
from tests.test_finder import items

MEMBERS = "group_id long, member_pos int, item_idx long, file_path string, file_size long, pixels long, created_at timestamp, modified_at timestamp, is_selected boolean"


def members(spark, seed=1, count=12):
    rng = random.Random(seed)
    stamp = lambda: rng.choice([None, *(f"2024-01-0{d} 00:00:00" for d in range(1, 5))])
    rows = [(g, p, 100 * g + p, f"/{g}/{p}.png", rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 6]), stamp(), stamp(), rng.random() < 0.5) for g in range(count) for p in range(rng.randint(1, 5))]
    return spark.createDataFrame(rows, MEMBERS.replace("timestamp", "string")).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "modified_at")})


def marks(frame):
    return {r["item_idx"]: r["is_selected"] for r in frame.collect()}


def test_folded_log_equals_a_replay(spark):
    rng = random.Random(3)
    start = members(spark).persist()
    for _ in range(4):
        log, replay = None, start
        for seq in range(rng.randint(1, 7)):
            shown = start.where(F.col("group_id").isin(rng.sample(range(12), rng.randint(0, 8)))).select("group_id")
            kind = rng.choice((sl.APPLY, sl.TOGGLE, sl.TOGGLE, sl.CLEAR))
            strategy = rng.choice([*selection.STRATEGIES, "KeepAll", "KeepNone"]) if kind == sl.APPLY else None
            rows = sl.event(seq, shown, kind, strategy)
            log = rows if log is None else log.unionByName(rows)
            if kind == sl.TOGGLE:
                replay = selection.toggle_groups(replay, shown)
            else:
                replay = selection.apply_to_groups(replay, strategy or "KeepAll", shown)
            # what a replay holds is cut off from its past
            replay = spark.createDataFrame([tuple(r) for r in replay.select(*start.columns).collect()], start.schema)
        got = sl.folded(start, log)
        assert marks(got) == marks(replay) and got.columns == start.columns
        assert marks(sl.folded(start, log.unionByName(log))) == marks(replay)  # repeated rows
    assert marks(sl.folded(start, log.limit(0))) == marks(start)


def test_every_strategy_by_the_log(spark):
    start = members(spark, seed=9)
    for strategy in (*selection.STRATEGIES, "KeepAll", "KeepNone"):
        assert marks(sl.folded(start, sl.event(1, start, sl.APPLY, strategy))) == marks(selection.apply_strategy(start, strategy)), strategy
    for bad in ((1, start, "apply"), (1, start, "toggle", "KeepAll"), (1, start, "apply", "KeepBest"), (1, start, "flip")):
        with pytest.raises(ValueError, match="no such event"):
            sl.event(*bad)


def test_removals_in_any_batching_equal_one(spark, tmp_path):
    start = members(spark, seed=4, count=20).where("group_id <> 3 or member_pos = 0")
    held = [r["file_path"] for r in start.collect()]
    rng = random.Random(5)
    gone = rng.sample(held, len(held) // 3)
    table = lambda xs: spark.createDataFrame([(x,) for x in xs], "file_path string")
    want = {r["item_idx"]: r["item_count"] for r in groups.remove_members(start, table(gone)).collect()}
    touched = {p.split("/")[1] for p in gone}
    sizes = {r["group_id"]: r["count"] for r in start.groupBy("group_id").count().collect()}
    want |= {r["item_idx"]: 1 for r in start.collect() if sizes[r["group_id"]] == 1 and str(r["group_id"]) not in touched}  # no removal, no upkeep
    for k, batches in enumerate(([gone], [gone[::3], gone[1::3], gone[2::3]], [gone[:1], gone[:4], gone, gone])):
        state = GroupState(spark, str(tmp_path / str(k)))
        state.begin(start)
        done = [state.remove(table([*b, "/none.png", b[0].upper().replace("PNG", "PNG"), None])) for b in batches]
        now = {r["item_idx"]: r["item_count"] for r in state.members().collect()}
        assert now == want
        assert sum(d.dissolved for d in done) == 20 - len({i // 100 for i in want})
        counts = state.live_counts(77).first()
        assert counts["duplicate_items"] == sum(1 for n in want.values() if n > 1) and counts["total_items"] == 77
        assert state.remove(table(gone)).version is None  # a repeated batch
    assert done[0].touched == 1 and spark.read.parquet(f"{state.folder}/version=1/rows").select("group_id").distinct().count() <= 1
    with pytest.raises(ValueError, match="already"):
        state.begin(start)


def test_only_visible_groups_are_kept_up(spark, tmp_path):
    state = GroupState(spark, str(tmp_path / "s"))
    start = members(spark, seed=4, count=6)
    state.begin(start)
    everything = start.select("file_path")
    done = state.remove(everything, visible=start.where("group_id = 2").select("group_id"))
    assert (done.touched, done.dissolved) == (1, 1) and {r["group_id"] for r in state.members().collect()} == {0, 1, 3, 4, 5}


def test_shares_of_jobs():
    assert progress.share_of([]) == 0 and progress.share_of([(False, 0, 0)]) == 0
    assert progress.share_of([(True, 4, 4), (False, 1, 2)]) == 0.5 + 0.125
    seen = [progress.share_of([(True, 1, 1)] * k + [(False, i, 4)]) for k in range(6) for i in range(4)]
    assert seen == sorted(seen) and seen[-1] < 1


def test_progress_follows_the_work(spark):
    @F.udf("array<float>")
    def slow(v):
        time.sleep(0.05)
        return v

    told = []
    finder = DuplicateFinder(spark, Settings(threshold=0.9), progress=lambda step, share: told.append((step, share)), tag="measured")
    finder.analyse(items(spark, 80).repartition(16).withColumn("features", slow("features")))
    shares = [s for _, s in told]
    assert shares == sorted(shares) and shares[-1] == 1.0
    inner = [s for step, s in told if step == "similarity"]
    assert len({round(s, 3) for s in inner}) > 4 and 0.3 < max(inner) < 0.7
    assert [x for x in dict.fromkeys(step for step, _ in told)] == ["similarity", "clustering", "statistics", "done"]


def test_names_are_trimmed_of_unicode_white_space(spark):
    names = [" Holiday ", "　 x\u0085", "a b", "​z", " CON ", "tab\t", "x\n"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(paths.sanitised_name("n").alias("s"), paths.is_valid_name("n").alias("v")).collect()
    assert [r["s"] for r in rows] == ["Holiday", "x", "a b", "​z", "CON_", "tab", "x"]
    assert [r["v"] for r in rows] == [True, True, True, True, False, True, True]
    edit = lambda old, new: spark.createDataFrame([(old, new)], "o string, w string").select(paths.renamed("o", "w")).first()[0]
    assert edit("Group 1", "　 ") == "Group 1" and edit("Group 1", " Best ") == "Best"
    for blank in ("   ", ""):
        with pytest.raises(Exception, match="blank"):
            spark.createDataFrame([(blank,)], "n string").select(paths.sanitised_name("n")).collect()


def test_a_fresh_view_is_one_sort_and_equals_its_steps(spark):
    rng = random.Random(8)
    found = spark.createDataFrame([(g, f"Group {rng.randrange(9)}", rng.randrange(1, 5), rng.choice([1.0, 0.9, 0.8])) for g in range(60)], "group_id long, name string, item_count long, average_similarity double")
    for filter_by in ("All", "Exact", "Similar"):
        for sort_by in ("Similarity", "ImageCount", "Name"):
            steps = groups.sorted_groups(groups.filtered(groups.base_order(found), filter_by), sort_by)
            key = lambda f: [r["group_id"] for r in f.orderBy("group_rank").collect()]
            assert key(groups.shown(found, filter_by, sort_by)) == key(steps)
