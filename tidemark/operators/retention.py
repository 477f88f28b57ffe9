"""Retention: which snapshots of each group a keep policy keeps.

Rules run one after the other over each group, newest first. A rule keeps the first open snapshot of each new period until it has
kept its number of periods; later open snapshots of a kept period go. Periods that an earlier rule has kept don't count again.
Protected snapshots never use up a rule's number.

Only few snapshots can be kept at all: since longer periods are made of whole hours, what a rule keeps is the newest open snapshot of its
hour, or one of the newest that the rule for the last ones asks for. The others of an hour go and change nothing for the rest. So snapshots
are first thinned by group and hour, and the rules run over what is left, which is bounded by the hours of a group and not by its
snapshots; a group that holds a large share of all rows is dealt out by hour.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Keep:
    """Numbers to keep by rule; rules run in the order of the fields. None or 0 turns a rule off."""

    last: int | None = None
    hourly: int | None = None
    daily: int | None = None
    weekly: int | None = None
    monthly: int | None = None
    yearly: int | None = None

    def rules(self) -> list[tuple[str, int]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self) if getattr(self, f.name)]

    def keeps_something(self) -> bool:
        return bool(self.rules())


def period(rule: str, time: Column) -> Column:
    """A number for the period of an epoch time in UTC; weeks are ISO weeks, and last has a period for each snapshot."""
    day = F.floor(time / 86400).cast("long")
    date = F.date_from_unix_date(day.cast("int"))
    return {
        "last": time,
        "hourly": F.floor(time / 3600).cast("long"),
        "daily": day,
        "weekly": F.floor((day + 3) / 7).cast("long"),  # day 0 was a Thursday
        "monthly": F.year(date).cast("long") * 12 + F.month(date),
        "yearly": F.year(date).cast("long"),
    }[rule]


def plan(snapshots: DataFrame, keep: Keep, group: tuple[str, ...] = ("type", "id"), time: str = "time", finished: str = "finished", protected: str = "protected") -> DataFrame:
    """Adds mark: keep, remove, protected or keep-partial for each snapshot.

    Without any rule everything is kept. Of unfinished snapshots only the newest of a group stays (keep-partial), others go.
    Equal times in a group are one period of every rule, ordered as they come.
    """
    shield = F.coalesce(F.col(protected), F.lit(False))
    if not keep.keeps_something():
        return snapshots.withColumn("mark", F.when(shield, "protected").otherwise("keep"))
    done = F.coalesce(F.col(finished), F.lit(False))
    down = F.col(time).desc()
    out = snapshots.withColumn("_hour", period("hourly", F.col(time))).withColumn("_able", done & ~shield)
    place = F.row_number().over(Window.partitionBy(*group, "_hour").orderBy(down))
    among = F.dense_rank().over(Window.partitionBy(*group, "_hour", "_able").orderBy(down))  # equal times are one period
    out = out.withColumn("_runs", (place == 1) | (F.col("_able") & (among <= max(1, keep.last or 0))))
    out = out.withColumn("_part", F.when(~F.col("_runs"), F.col("_hour")))  # null: those that the rules run over, together
    of = (*group, "_part")
    newest = Window.partitionBy(*of).orderBy(down)
    out = out.withColumn("mark", F.when(~done, F.when(F.col("_runs") & (F.row_number().over(newest) == 1), "keep-partial").otherwise("remove")))
    for rule, count in keep.rules():
        out = out.withColumn("_period", period(rule, F.col(time)))
        inside = Window.partitionBy(*of, "_period").orderBy(down)  # one sort for both
        used = F.max(F.col("mark") == "keep").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.withColumn("_open", F.col("_runs") & F.col("mark").isNull() & ~shield & ~F.coalesce(used, F.lit(False)))
        out = out.withColumn("_first", F.col("_open") & (F.sum(F.col("_open").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) == 1))
        out = out.withColumn("_kept", F.sum(F.col("_first").cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
        chosen = F.when(F.col("_first"), "keep").otherwise("remove")
        out = out.withColumn("mark", F.when(F.col("_open") & (F.col("_kept") <= count), chosen).otherwise(F.col("mark")))
    mark = F.when(shield, "protected").otherwise(F.coalesce("mark", F.lit("remove")))
    return out.withColumn("mark", mark).drop("_period", "_open", "_first", "_kept", "_hour", "_able", "_runs", "_part")


def first_per_period(rows: DataFrame, group: tuple[str, ...], time: str, rule: str, count: int) -> DataFrame:
    """The newest row of each of the newest count periods of each group."""
    pid = period(rule, F.col(time))
    newest = rows.withColumn("_p", pid).withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_p").orderBy(F.col(time).desc()))).where("_rn = 1")
    return newest.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(time).desc()))).where(F.col("_k") <= count).drop("_p", "_rn", "_k")


def marks_with_counter(rows: DataFrame, rule: str, count: int, group: tuple[str, ...] = ("type", "id"), time: str = "time") -> DataFrame:
    """A simulator's view of one rule: adds mark and kept, the number of periods kept so far; knows neither protected nor unfinished rows."""
    newest = Window.partitionBy(*group).orderBy(F.col(time).desc())
    out = rows.withColumn("_p", period(rule, F.col(time)))
    out = out.withColumn("_first", (F.row_number().over(Window.partitionBy(*group, "_p").orderBy(F.col(time).desc())) == 1).cast("int"))
    out = out.withColumn("kept", F.sum("_first").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    mark = F.when(F.col("kept") > count, "remove").when(F.col("_first") == 1, "keep").otherwise("remove")
    return out.withColumn("mark", mark).withColumn("kept", F.least("kept", F.lit(count)).cast("long")).drop("_p", "_first")


def summary(planned: DataFrame, group: tuple[str, ...] = ("type", "id")) -> DataFrame:
    """Counts of a plan by group."""
    return planned.groupBy(*group).agg(F.count("*").alias("snapshots"), F.count_if(F.col("mark") == "remove").alias("removed"), F.count_if(F.col("mark") == "protected").alias("protected"), F.count_if(F.col("mark").isin("keep", "keep-partial")).alias("kept"))
