"""Traffic rules by longest network prefix, rates by rule, and the routing of notifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import in_duration
from ..functions.scalar import address_bits, network_bits, once

#: Severities in order.
SEVERITIES = ("info", "notice", "warning", "error")


def active_rules(rules: list[dict], now: Column) -> list[tuple[int, dict, Column]]:
    """(number, rule, whether it holds at now) of rules with optional timeframes; any of them is enough."""
    return [(i, r, reduce(Column.__or__, [in_duration(now, t) for t in r["timeframes"]]) if r.get("timeframes") else F.lit(True)) for i, r in enumerate(rules)]


def longest_prefix(peers: DataFrame, rules: list[dict], ip: str = "ip", now: str = "now") -> DataFrame:
    """Adds rule and match_len: the rule in force with the longest network that holds the peer's address; the first of equal ones.

    Rules are few and given as a list, so they become one expression and no join; their networks are worked out first, and each row's address and hour once.
    """
    networks = [(i, cidr) for i, rule in enumerate(rules) for cidr in rule["networks"]]
    given = peers.sparkSession.createDataFrame(networks, "rule int, network string").coalesce(1)
    known = given.select("rule", *network_bits(F.col("network"))).toDF("rule", "prefix", "family").where("prefix IS NOT NULL").collect()

    def best(peer: Column) -> Column:
        options = [F.lit(None).cast("struct<match_len: int, place: int, rule: string>")]
        for i, rule, on in active_rules(rules, peer["now"]):
            for prefix, family in [(n["prefix"], n["family"]) for n in known if n["rule"] == i]:
                inside = (F.length(peer["bits"]) == family) & F.startswith(peer["bits"], F.lit(prefix)) & on
                options.append(F.when(inside, F.struct(F.lit(len(prefix)).alias("match_len"), F.lit(-i).alias("place"), F.lit(rule["name"]).alias("rule"))))
        return F.array_max(F.array(*options))

    peer = F.struct(address_bits(F.col(ip)).alias("bits"), F.col(now).alias("now"))
    return peers.withColumn("_best", once(peer, best)).withColumn("rule", F.col("_best.rule")).withColumn("match_len", F.col("_best.match_len")).drop("_best")


def longest_prefix_join(peers: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """The same for any number of networks (rule, network), IPv4 and IPv6: one equi-join for each address and prefix length in use."""
    prefix, family = network_bits(F.col("network"))
    nets = networks.select("rule", prefix.alias("base"), family.alias("family")).where("base IS NOT NULL")
    lengths = nets.select(F.collect_set(F.struct("family", F.length("base").alias("length"))).alias("lengths"))  # 33 and 129 at most
    each = peers.withColumn("_a", address_bits(F.col(ip))).join(F.broadcast(lengths)).withColumn("l", F.explode("lengths")).where(F.col("l.family") == F.length("_a"))
    keyed = each.select(ip, F.col("l.family").alias("family"), F.left("_a", F.col("l.length")).alias("base"))
    hit = keyed.join(nets, ["base", "family"])
    best = hit.groupBy(ip).agg(F.max(F.struct(F.length("base").alias("length"), "rule")).alias("b"))
    return peers.join(best, ip, "left").select(*peers.columns, F.col("b.rule").alias("rule"), F.col("b.length").alias("match_len"))


def rule_rates(rules: DataFrame, rates: DataFrame) -> DataFrame:
    """Rules with their current rates, 0 without any."""
    return rules.join(rates, "rule", "left").select(*rules.columns, F.coalesce("rate_in", F.lit(0)).alias("rate_in"), F.coalesce("rate_out", F.lit(0)).alias("rate_out"))


def matches(matcher: dict) -> Column:
    """Whether a notification row meets a matcher: severities, a field exactly or by a regular expression, and hours; all or any, or not."""
    tests = []
    if "severity" in matcher:
        tests.append(F.col("severity").isin(*matcher["severity"]))
    for field, values in matcher.get("exact", {}).items():
        tests.append(F.coalesce(F.col(field).isin(*values), F.lit(False)))
    for field, pattern in matcher.get("regex", {}).items():
        tests.append(F.coalesce(F.col(field).rlike(pattern), F.lit(False)))
    for hours in matcher.get("calendar", []):
        tests.append(in_duration(F.col("time"), hours))
    both = Column.__or__ if matcher.get("mode") == "any" else Column.__and__
    out = reduce(both, tests) if tests else F.lit(True)
    return ~out if matcher.get("invert") else out


def route(notifications: DataFrame, matchers: list[dict], key: str) -> DataFrame:
    """(key, target): every target of every enabled matcher that a notification meets, once each."""
    hits = F.array_distinct(F.flatten(F.array(*[F.when(matches(m), F.array(*[F.lit(t) for t in m["targets"]])).otherwise(F.array().cast("array<string>")) for m in matchers if not m.get("disable")])))
    return notifications.select(key, F.explode(hits).alias("target"))


def oldest_first(notifications: DataFrame, time: str, key: str) -> DataFrame:
    """The order in which a queue is drained."""
    return notifications.withColumn("turn", F.row_number().over(Window.partitionBy(F.floor(F.col(time) / 86400)).orderBy(time, key)))
