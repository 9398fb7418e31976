"""A log of what was done to selections, and the selection that it leads to.

An event concerns the groups that were shown when it happened, and stands as one row for each of them: (seq, group_id,
kind, strategy). ``apply`` (by a strategy) and ``clear`` are absolute: whatever was before them in a group does not
count. ``toggle`` selects all members of a group, or none if all are selected. So a group's selection follows from its
last absolute event and the number of toggles after it; the log is folded by two small aggregates, and no event is
replayed. Members are read once: each group's kept member is a minimum, so a very large group is neither sorted nor
gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.operators.selection import STRATEGIES

APPLY, TOGGLE, CLEAR = "apply", "toggle", "clear"


def event(seq: int, shown: DataFrame, kind: str, strategy: str | None = None) -> DataFrame:
    """The rows of one event on the groups shown; with a later ``seq`` it comes later."""
    if kind not in (APPLY, TOGGLE, CLEAR) or (kind == APPLY) != (strategy is not None) or strategy not in (None, "KeepAll", "KeepNone", *STRATEGIES):
        raise ValueError(f"no such event: {kind} {strategy}")
    return shown.select("group_id").distinct().select(F.lit(seq).cast("long").alias("seq"), "group_id", F.lit(kind).alias("kind"), F.lit(strategy).cast("string").alias("strategy"))


def outcomes(log: DataFrame) -> DataFrame:
    """(group_id, rule, toggles): the strategy of the last absolute event (KeepAll for clear, null for none) and how often the group was toggled since. Repeated rows of an event count once."""
    rows = log.dropDuplicates(["seq", "group_id"])
    absolute = rows.where(F.col("kind") != TOGGLE).groupBy("group_id").agg(F.max("seq").alias("since"), F.max_by(F.coalesce("strategy", F.lit("KeepAll")), "seq").alias("rule"))
    toggles = rows.where(F.col("kind") == TOGGLE).select("group_id", "seq").join(absolute.select("group_id", "since"), "group_id", "left")
    after = toggles.where("since is null or seq > since").groupBy("group_id").agg(F.count(F.lit(1)).alias("toggles"))
    return absolute.select("group_id", "rule").join(after, "group_id", "full").select("group_id", "rule", F.coalesce("toggles", F.lit(0)).alias("toggles"))


def _order(rule: Column) -> list[Column]:
    """Numbers by which a group's kept member comes first, by the group's rule; what is missing comes where the strategy's sort puts it."""
    out = []
    for place in (0, 2):
        missing, value = F.lit(0), F.lit(None).cast("long")
        for name, keys in STRATEGIES.items():
            down, column = keys[place] is F.desc, keys[place + 1]
            number = F.unix_micros(F.col(column).cast("timestamp")) if column.endswith("_at") else F.col(column).cast("long")
            # falling orders have nulls at their end, rising ones at their beginning
            missing = F.when(rule == name, F.when(number.isNull() == F.lit(down), 1).otherwise(0)).otherwise(missing)
            value = F.when(rule == name, -number if down else number).otherwise(value)
        out += [missing, value]
    return out


def folded(members: DataFrame, log: DataFrame) -> DataFrame:
    """The members with ``is_selected`` as the log leaves it; groups without events stay as they are."""
    columns = members.columns
    ruled = members.join(outcomes(log), "group_id", "left")
    rule, strategies = F.col("rule"), [*STRATEGIES]
    kept = ruled.where(rule.isin(strategies)).groupBy("group_id").agg(F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_order(rule))], F.col("member_pos").alias("pos"))).alias("kept"))
    whole = members.groupBy("group_id").agg(F.bool_and("is_selected").alias("whole"))
    rows = ruled.join(kept.select("group_id", F.col("kept.pos").alias("kept_pos")), "group_id", "left").join(whole, "group_id", "left")
    base = F.when(rule.isNull(), F.col("is_selected")).when(rule.isin(strategies), F.col("member_pos") != F.col("kept_pos")).otherwise(rule == "KeepNone")
    # after an absolute event all are selected only by KeepNone
    first = ~F.when(rule.isNull(), F.col("whole")).otherwise(rule == "KeepNone")
    toggles = F.coalesce("toggles", F.lit(0))
    out = F.when(toggles == 0, base).when(toggles % 2 == 1, first).otherwise(~first)
    return rows.withColumn("is_selected", out).select(*columns)
