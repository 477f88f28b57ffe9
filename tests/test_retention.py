"""Retention plans against lists written by hand."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest

from tidemark.operators.retention import Keep, plan

SHORT = ["2019-12-02 11:59", "2019-12-03 11:59", "2019-12-04 11:59", "2019-12-04 12:59"]
HOURS = ["2019-12-02 09:39", "2019-12-02 09:49", "2019-12-02 09:59", "2019-12-02 10:39", "2019-12-02 10:49", "2019-12-02 10:59"]
LONG = ["2018-11-15 11:59", "2019-11-15 11:59", "2019-11-20 11:59", "2019-11-21 11:59", "2019-11-22 11:59", "2019-11-29 11:59", "2019-12-01 11:59", "2019-12-02 11:59", "2019-12-04 11:59"]


def at(text: str) -> int:
    return int(datetime.strptime(text, "%Y-%m-%d %H:%M").replace(tzinfo=timezone.utc).timestamp())


def removed(spark, times, keep, protected=(), unfinished=()):
    rows = [("host", "a", at(t), t not in unfinished, t in protected) for t in times]
    out = plan(spark.createDataFrame(rows, "type string, id string, time long, finished boolean, protected boolean"), keep).collect()
    by_time = {r["time"]: r["mark"] for r in out}
    assert len(by_time) == len(times)
    return [t for t in times if by_time[at(t)] == "remove"]


@pytest.mark.parametrize(
    "keep, gone",
    [
        (Keep(last=4), []), (Keep(last=3), SHORT[:1]), (Keep(last=2), SHORT[:2]), (Keep(last=1), SHORT[:3]), (Keep(last=0), []),
        (Keep(last=2, daily=2), []), (Keep(daily=3), SHORT[2:3]), (Keep(daily=2), [SHORT[0], SHORT[2]]), (Keep(weekly=5), SHORT[:3]),
        (Keep(daily=1, weekly=1), SHORT[:3]), (Keep(monthly=5), SHORT[:3]), (Keep(yearly=5), SHORT[:3]),
    ],
)
def test_short(spark, keep, gone):
    assert removed(spark, SHORT, keep) == gone


def test_hours(spark):
    assert removed(spark, HOURS, Keep(hourly=2)) == [HOURS[0], HOURS[1], HOURS[3], HOURS[4]]
    assert removed(spark, HOURS, Keep(hourly=1)) == HOURS[:5]


@pytest.mark.parametrize(
    "keep, kept",
    [
        (Keep(daily=1), LONG[-1:]), (Keep(last=1, daily=1), LONG[-2:]), (Keep(daily=1, weekly=1), [LONG[-3], LONG[-1]]),
        (Keep(daily=1, weekly=1, monthly=1), [LONG[4], LONG[-3], LONG[-1]]), (Keep(monthly=1, yearly=1), [LONG[0], LONG[-1]]),
    ],
)
def test_long(spark, keep, kept):
    assert [t for t in LONG if t not in removed(spark, LONG, keep)] == kept


def test_protected_uses_no_number(spark):
    times = ["2020-01-01 10:19", "2020-01-01 10:29", "2020-01-01 10:39", "2020-01-01 10:49"]
    assert removed(spark, times, Keep(last=1), protected={times[0], times[3]}) == times[1:2]


def test_unfinished(spark):
    assert removed(spark, SHORT, Keep(last=1), unfinished={SHORT[3]}) == SHORT[:2]
    assert removed(spark, SHORT, Keep(last=1), unfinished={SHORT[1]}) == SHORT[:3]
    assert removed(spark, SHORT, Keep(last=9), unfinished=set(SHORT)) == SHORT[:3]


def test_null_flags_and_empty(spark):
    schema = "type string, id string, time long, finished boolean, protected boolean"
    assert plan(spark.createDataFrame([], schema), Keep(last=1)).count() == 0
    out = plan(spark.createDataFrame([("vm", "1", 5, None, None), ("vm", "1", 4, True, None)], schema), Keep(last=1)).collect()
    assert {r["time"]: r["mark"] for r in out} == {5: "keep-partial", 4: "keep"}


@pytest.mark.parametrize("seed", range(6))
def test_against_the_rules_one_by_one(spark, seed):
    """Random groups, many of them dense within hours, against a plain loop over each group."""
    import random
    from datetime import timedelta

    rng = random.Random(seed)
    keep = Keep(**{f: rng.randrange(0, 4) for f in ("last", "hourly", "daily", "weekly", "monthly", "yearly")})
    start = datetime(2019, 12, 20, tzinfo=timezone.utc)
    rows = []
    for g in range(25):
        step = rng.choice([300, 4000, 90000, 900000])
        times = {int((start + timedelta(seconds=rng.randrange(step * 25))).timestamp()) for _ in range(rng.randrange(1, 25))}
        rows += [("vm", str(g), t, rng.random() > 0.15, rng.random() < 0.15) for t in times]

    def names(rule, t):
        d = datetime.fromtimestamp(t, timezone.utc)
        return {"last": t, "hourly": d.strftime("%Y%m%d%H"), "daily": d.strftime("%Y%m%d"), "weekly": d.isocalendar()[:2], "monthly": d.strftime("%Y%m"), "yearly": d.year}[rule]

    want = {}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: -r[2])
        mark: dict[int, str] = {}
        for i, (_, _, t, finished, _) in enumerate(own):
            if not finished:
                mark[t] = "keep-partial" if i == 0 else "remove"
        for rule, n in keep.rules():
            used = {names(rule, t) for t, m in mark.items() if m == "keep"}
            taken: list = []
            for _, _, t, _, protected in own:
                p = names(rule, t)
                if t in mark or protected or p in used:
                    continue
                if p not in taken:
                    if len(taken) >= n:
                        break
                    taken.append(p)
                    mark[t] = "keep"
                else:
                    mark[t] = "remove"
        for _, _, t, _, protected in own:
            want[g, t] = "protected" if protected else mark.get(t, "remove") if keep.rules() else "keep"
    out = plan(spark.createDataFrame(rows, "type string, id string, time long, finished boolean, protected boolean"), keep)
    assert {(r["id"], r["time"]): r["mark"] for r in out.collect()} == want


def test_equal_times_are_one_period_of_the_last_rule(spark):
    rows = [("vm", "1", 100, True, False)] * 3 + [("vm", "1", 50, True, False)]
    out = plan(spark.createDataFrame(rows, "type string, id string, time long, finished boolean, protected boolean"), Keep(last=3)).collect()
    assert sorted((r["time"], r["mark"]) for r in out) == [(50, "keep"), (100, "keep"), (100, "remove"), (100, "remove")]
