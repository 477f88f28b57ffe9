"""Operators on small literal inputs."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar, scalar
from tidemark.operators import access, chunking, chunkstore, diffing, hierarchy, listing, network, rangejoin, syncing, tapes, timeseries


def test_chunker_is_the_same_for_whole_and_parts():
    data = b"".join(i.to_bytes(4, "little") for i in range(1 << 16))
    ends = chunking.cuts(data, 1 << 12)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= 1 << 14 and sizes[:-1].min() >= 1 << 10
    # what follows a cut doesn't depend on what was before it
    assert [e - ends[2] for e in ends[3:]] == chunking.cuts(data[ends[2] :], 1 << 12)
    assert chunking.cuts(b"", 1024) == []
    with pytest.raises(ValueError):
        chunking.cuts(b"x", 1000)


def test_chunks_survive_an_insertion():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    other = data[:70_000] + b"inserted" + data[70_000:]

    def digests(d):
        ends = chunking.cuts(d, 2048)
        return {hashlib.sha256(d[a:b]).digest() for a, b in zip([0, *ends], ends)}

    a, b = digests(data), digests(other)
    assert len(a - b) <= 4


def test_blobs():
    for data in (b"", b"x", b"abc" * 1000, bytes(range(256))):
        assert chunking.decode_blob(chunking.encode_blob(data), hashlib.sha256(data).hexdigest()) == data
    blob = bytearray(chunking.encode_blob(b"abc" * 100))
    blob[-1] ^= 1
    with pytest.raises(ValueError):
        chunking.decode_blob(bytes(blob))
    with pytest.raises(ValueError):
        chunking.decode_blob(chunking.encode_blob(b"a"), "0")


def test_varints(spark):
    values = [0, 1, 126, 127, 128, (1 << 12) - 1, (1 << 20) - 1, (1 << 50) - 1, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    rows = df.select("v", chunking.varint(F.col("v")).alias("h"), chunking.varint_value(chunking.varint(F.col("v"))).alias("b")).collect()
    assert all(r["v"] == r["b"] for r in rows)

    def want(v):
        out = b""
        while v >= 128:
            out, v = out + bytes([v % 128 + 128]), v // 128
        return (out + bytes([v])).hex().upper()

    assert [r["h"] for r in rows] == [want(v) for v in values]
    assert df.limit(0).select(chunking.signed_varint(F.col("v"))).count() == 0


def test_signature_leaves_out_unprotected():
    a, b = '{"files": [1], "unprotected": {"notes": "x"}, "type": "vm"}', '{"type": "vm", "files": [1], "unprotected": {}, "signature": "s"}'
    assert chunking.signature(a, b"key") == chunking.signature(b, b"key") != chunking.signature(a, b"other")


def test_insert_keeps_the_smaller_plain_chunk(spark):
    s = spark.createDataFrame([("a", 10, False), ("b", 5, True), ("c", 0, False)], "digest string, size long, encrypted boolean")
    n = spark.createDataFrame([("a", 4, False, 1), ("a", 12, False, 2), ("b", 1, False, 3), ("c", 7, True, 4), ("d", 9, False, 5)], "digest string, size long, encrypted boolean, seq long")
    out = {r["digest"]: (r["size"], r["duplicate"]) for r in chunkstore.insert(s, n).collect()}
    assert out == {"a": (4, True), "b": (5, True), "c": (7, True), "d": (9, False)}


def test_group_filters(spark):
    ids = spark.createDataFrame([("vm", f"vm/{i}"[3:]) for i in range(101, 110)], "type string, id string")
    pick = lambda *f: [r["id"] for r in ids.where(listing.apply_filters(list(f))).orderBy("id").collect()]
    assert len(pick()) == 9
    assert pick("regex:10[1-3]") == ["101", "102", "103"]
    assert pick("exclude:regex:10[1-3]", "exclude:group:vm/109") == ["104", "105", "106", "107", "108"]
    assert pick("exclude:regex:102", "include:regex:10[1-3]") == pick("include:regex:10[1-3]", "exclude:regex:102") == ["101", "103"]
    with pytest.raises(ValueError):
        listing.apply_filters(["size:1"])


def test_roles(spark):
    rules = access.text_rules(["acl:1:/:a:Audit", "acl:1:/datastore/s:a:DatastoreReader", "acl:0:/datastore/s/x:a:NoAccess", "acl:1:/datastore/t:a:NoAccess,DatastoreBackup", "acl:1:/datastore:@g:Admin", "broken"], spark)
    probe = spark.createDataFrame([("a", p.split("/")[1:] if p != "/" else []) for p in ("/", "/datastore", "/datastore/s", "/datastore/s/x", "/datastore/s/x/y", "/datastore/t/z")], "user string, path array<string>")
    got = {"/" + "/".join(r["path"]): set() for r in probe.collect()}
    for r in access.roles(rules, probe).collect():
        got["/" + "/".join(r["path"])].add(r["role"])
    assert got == {"/": {"Audit"}, "/datastore": {"Audit"}, "/datastore/s": {"DatastoreReader"}, "/datastore/s/x": {"NoAccess"}, "/datastore/s/x/y": {"DatastoreReader"}, "/datastore/t/z": {"NoAccess"}}


def test_inserted_roles(spark):
    rows = [(["d"], "a", False, "Audit", True, 1), (["d"], "a", False, "NoAccess", True, 2), (["d"], "a", False, "Admin", True, 3), (["e"], "a", False, "Audit", True, 1), (["e"], "a", False, "NoAccess", True, 2)]
    out = access.node_rules(spark.createDataFrame(rows, "path array<string>, ugid string, is_group boolean, role string, propagate boolean, n int"), "n")
    assert {(r["path"][0], r["role"]) for r in out.collect()} == {("d", "Admin"), ("e", "NoAccess")}


def test_longest_prefix(spark):
    rules = [{"name": "r1", "networks": ["192.168.2.0/24"], "timeframes": ["mon..wed 8-12", "wed..fri 10-18"]}, {"name": "r2", "networks": ["192.168.2.35/32", "127.0.0.0/8"], "timeframes": ["18-22"]}, {"name": "all", "networks": ["0.0.0.0/0"]}]
    day = 4 * 86400  # a Monday
    peers = [("192.168.2.55", day + 9 * 3600), ("192.168.2.55", day + 13 * 3600), ("192.168.2.35", day + 19 * 3600), ("::ffff:127.0.0.1", day + 20 * 3600), ("nothing", day)]
    out = network.longest_prefix(spark.createDataFrame(peers, "ip string, now long"), rules).collect()
    assert [r["rule"] for r in out] == ["r1", "all", "r2", "r2", None]


def test_statistics(spark):
    xy = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(range(5), range(-4, 5, 2))] + [("h", 1.0, v) for v in (1.0, 2.0, 3.0, 4.0)], "k string, x double, y double")
    out = {r["k"]: r for r in timeseries.moments(xy, "k", "x", "y").collect()}
    assert (out["g"]["alpha"], out["g"]["beta"]) == (-4.0, 2.0) and out["h"]["variance"] == 1.25 and out["h"]["beta"] is None


def test_forecast(spark):
    rows = [("few", i, 0.1 * i) for i in range(6)] + [("line", 10 * i, 0.1 * i) for i in range(8)] + [("level", i, 0.5) for i in range(9)]
    out = {r["k"]: r["full_at"] for r in timeseries.full_at(spark.createDataFrame(rows, "k string, t long, u double"), "k", "t", "u").collect()}
    assert out["few"] is None and out["level"] == 0 and abs(out["line"] - 100) <= 1


def test_media_expiry(spark):
    row = spark.createDataFrame([(0, 120), (120, None)], "start long, next long")
    got = [r["e"] for r in row.select(tapes.expiry(F.lit("120"), F.lit("120"), F.col("start"), F.col("next")).alias("e")).collect()]
    assert got == [240, 360]
    never = row.select(tapes.expiry(F.lit("continue"), F.lit("60"), F.col("start"), F.lit(None).cast("long")).alias("e")).first()["e"]
    assert never == tapes.NEVER


def test_media_sets(spark):
    m = spark.createDataFrame([("s", i, f"t{i}", "p", 100) for i in range(3)] + [("u", 1, "t9", "p", 50)] + [("v", 0, "t7", "q", 7), ("w", 0, "t8", "q", 7)], "set_uuid string, seq_nr int, label string, pool string, set_ctime long")
    sets = tapes.media_sets(m)
    got = {r["set_uuid"]: (r["labels"], r["incomplete"], r["start"]) for r in sets.collect()}
    assert got["s"] == ("t0,t1,t2", False, 100) and got["u"] == (",t9", True, None)
    assert {r["pool"]: r["set_uuid"] for r in tapes.latest_sets(sets).collect()} == {"p": "s"}  # two sets of q began at once


def test_indented_lists(spark):
    levels = [0, 1, 2, 2, 1, 3, 0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(levels)], "g int, n long, level long")
    out = hierarchy.indented_parents(df, "g", "n", "level").orderBy("n").collect()
    assert [r["parent"] for r in out][:5] == [None, 0, 1, 1, 0] and [r["ok"] for r in out] == [True] * 5 + [False, True]


def test_excluded_directories_hide_what_is_below(spark):
    e = spark.createDataFrame([("/", "a", False), ("/a", "x1", True), ("/", "b", False), ("/b", "x2", True)], "parent string, name string, leaf boolean")
    assert [r["path"] for r in hierarchy.find(e, "x", "^/a$").collect()] == ["/b/x2"]


@pytest.mark.parametrize("glob, path, hit", [("*.txt", "/a/b.txt", True), ("/a/*", "/a/b", True), ("/a/*", "/a/b/c", False), ("**/c", "/a/b/c", True), ("[!b]?", "/xy", True), ("[!b]?", "/by", False)])
def test_globs(spark, glob, path, hit):
    got = hierarchy.select_patterns(spark.createDataFrame([(path,)], "p string"), "p", ["!" + glob]).first()["included"]
    assert got is not hit


def test_overlaps_meet_once(spark):
    a = spark.createDataFrame([(1, 0, 100), (1, 100, 130), (1, 500, 900)], "k int, s long, e long")
    b = spark.createDataFrame([(1, 50, 120), (1, 130, 140), (1, 0, 1000)], "k int, cs long, ce long")
    plain = {(r["s"], r["cs"]) for r in rangejoin.overlap_join(a, b, ["k"], ("s", "e"), ("cs", "ce"), 32).collect()}
    assert plain == {(0, 50), (0, 0), (100, 50), (100, 0), (500, 0)}
    rows = rangejoin.overlap_join(a, b, ["k"], ("s", "e"), ("cs", "ce"), 32, touching=True).collect()
    assert len(rows) == len({(r["s"], r["cs"]) for r in rows}) and (100, 130) in {(r["s"], r["cs"]) for r in rows}


def test_comparison_quirks(spark):
    a = spark.createDataFrame([("same", 1, 1, "x"), ("size", 1, 1, "x"), ("time", 1, 1, "x"), ("gone", 1, 1, None)], "path string, size long, mtime long, content string")
    b = spark.createDataFrame([("same", 1, 1, "x"), ("size", 2, 1, "y"), ("time", 1, 2, "x"), ("new", 1, 1, None)], "path string, size long, mtime long, content string")
    state = lambda df: {r["path"]: r["state"] for r in df.collect()}
    assert state(diffing.compare(a, b, ["path"], ["mtime"])) == {"same": "same", "size": "same", "time": "modified", "gone": "deleted", "new": "added"}
    assert state(diffing.compare(a, b, ["path"], ["mtime"], content="content", mtime="mtime")) == {"same": "same", "size": "modified", "time": "same", "gone": "deleted", "new": "added"}


@pytest.mark.parametrize("text, after, want", [("daily", 0, 86400), ("hourly", 3599, 3600), ("sat 02:00", 0, 2 * 86400 + 7200), ("2-29 00:00", 0, 789 * 86400), ("2-30 00:00", 0, None), ("mon,wed..fri 8..10:00/30", 86400, 86400 + 8 * 3600)])
def test_calendar(spark, text, after, want):
    got = spark.createDataFrame([(after,)], "t long").select(calendar.next_event(F.col("t"), text).alias("n")).first()["n"]
    assert got == want


@pytest.mark.parametrize("text", ["25:00", "mon..xyz", "13-1", "*:99"])
def test_bad_calendar(text):
    with pytest.raises(ValueError):
        calendar.parse(text)


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("::ffff:1.0.0.0",), (None,), ("",)], "a string")
    assert [r[0] for r in df.select(scalar.ipv4(F.col("a"))).collect()] == [16909060, None, 1 << 24, None, None]


def test_deep_trees(spark):
    """A chain of 120 directories, and one excluded in the middle."""
    rows, path = [], ""
    for i in range(120):
        rows.append((path or "/", f"d{i}", i == 119))
        path += f"/d{i}"
    e = spark.createDataFrame(rows, "parent string, name string, leaf boolean")
    assert sorted(r["level"] for r in hierarchy.dump(e).collect()) == list(range(1, 121))
    assert sorted(r["level"] for r in hierarchy.dump(e, "/d0/d1").collect()) == list(range(1, 119))
    assert hierarchy.find(e, "d11.$", "/d115$").count() == 5 and hierarchy.find(e, ".", "/d0$", "/d0/d1").count() == 118


def test_deep_indentation(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(60)] + [(1, 60, 30)], "g int, n long, level long")
    out = {r["n"]: r for r in hierarchy.indented_parents(df, "g", "n", "level").collect()}
    assert all(out[i]["parent"] == i - 1 and out[i]["ok"] for i in range(1, 60)) and out[60]["parent"] == 29 and out[0]["parent"] is None


def test_addresses_of_both_families(spark):
    texts = ["1.2.3.4", "::ffff:1.2.3.4", "::1", "2001:DB8::8:0:1", "1:2:3:4:5:6:7:8", "::", "fe80::", "1::2::3", "12345::", ":1::2", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::8", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "a string").select(scalar.address_bits(F.col("a"))).collect()]
    import ipaddress

    def want(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return None
        a = getattr(a, "ipv4_mapped", None) or a
        return format(int(a), f"0{a.max_prefixlen}b")

    assert got == [want(t) for t in texts]
    rules = [{"name": "six", "networks": ["2001:db8::/33"]}, {"name": "all6", "networks": ["::/0"]}, {"name": "all4", "networks": ["0.0.0.0/0"]}]
    peers = [("2001:db8::1", 0), ("2001:db8:8000::1", 0), ("10.0.0.1", 0), ("::ffff:10.0.0.1", 0)]
    out = network.longest_prefix(spark.createDataFrame(peers, "ip string, now long"), rules).collect()
    assert [(r["rule"], r["match_len"]) for r in out] == [("six", 33), ("all6", 0), ("all4", 0), ("all4", 0)]


def test_offsets_by_stretches(spark):
    rows = [(s, i, (i * 7 + s) % 13 + 1) for s in range(3) for i in range(200)]
    e = spark.createDataFrame(rows, "sid long, n long, size long")
    for stretch in (None, F.floor(F.col("n") / 50), F.lit(0)):
        out = chunkstore.with_offsets(e, "sid", ("n",), stretch=stretch).orderBy("sid", "n").collect()
        at = {}
        for r in out:
            assert (r["pos"], r["start_off"]) == (r["n"], at.get(r["sid"], 0)) and r["end_off"] == r["start_off"] + r["size"]
            at[r["sid"]] = r["end_off"]


def test_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"long" * 40):
        got = spark.createDataFrame([("héllo",), ("",)], "m string").select(chunking.hmac_sha256(key, F.col("m"))).collect()
        assert [r[0] for r in got] == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in ("héllo", "")]


def test_runs_of_known_chunks_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(chunkstore, "STRETCH", 4)
    rng = np.random.default_rng(5)
    rows = [(s, i, f"d{rng.integers(0, 12)}") for s in range(3) for i in range(40)] + [(3, 0, "d1"), (4, 0, "new")]
    got = chunkstore.known_runs(spark.createDataFrame(rows, "sid long, pos long, digest string"), spark.createDataFrame([("d1",), ("d1",)], "digest string"), "sid", "pos", 3).collect()
    want, run, place, before = {}, 0, 0, set()
    for s, i, d in rows:
        if not i:
            run, place, before = 0, 0, set()
        if d == "d1" or d in before:
            want[s, i] = True, run, place // 3
            place += 1
        else:
            want[s, i] = False, None, None
            run, place = run + 1, 0
        before.add(d)
    assert {(r.sid, r.pos): (r.known, r.run, r.batch) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("last", [None, 0, 1, 3, 200])
def test_transfers_by_group(spark, last):
    remote = [(g, t * 10) for g, n in (("a", 100), ("b", 2), ("c", 5), ("d", 4)) for t in range(n)]
    synced = {"a": 300, "b": 500, "c": 0}
    df = spark.createDataFrame(remote, "id string, time long")
    got = syncing.transfer_plan(df, spark.createDataFrame(list(synced.items()), "id string, time long"), ["id"], "time", last)
    assert got.columns == ["id", "time", "action"]
    want = {}
    for g in "abcd":
        times, skipped = [t for x, t in remote if x == g], False
        for k, t in enumerate(times):
            old = t < synced.get(g, -1)
            over = last is not None and len(times) - k > last and not skipped
            want[g, t] = "skip-synced" if old else "skip-last" if over else "transfer"
            skipped = old
    assert {(r.id, r.time): r.action for r in got.collect()} == want


def test_sessions_end_after_just_the_gap(spark, tmp_path):
    """As the query's SQL has it: exactly six hours later is a new session, and an event without a time is one of its own."""
    import duckdb

    from tidemark.plans import extensions

    times = {1: [0, 21599, 43199, 64798], 2: [5, 21604, 21605, 43205], 3: [None, 10, None, 10], None: [7, None, 21607]}
    rows = ", ".join(f"({'NULL' if u is None else u}, {'NULL' if t is None else f'make_timestamp({1704067200 + t}500000)'})" for u, ts in times.items() for t in ts)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT CAST(u AS BIGINT) AS user_id, t AS ts FROM (VALUES {rows}) v(u, t)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    got = extensions.ext_session_window(spark, str(tmp_path))
    want = con.sql(extensions.ORACLE["ext_session_window"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)
    assert got.where("user_id = 1").count() == 2 and got.where("user_id = 3").count() == 3


def test_rules_are_worked_out_once(spark, tmp_path):
    """The plan keeps its size where a filter on the rule is pushed down: it held 800000 characters and thousands of regular expressions a row."""
    import duckdb

    from tidemark.plans import flows

    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT CASE WHEN i % 10 > 0 THEN i END AS event_id, make_timestamp(1704067200000000 + i * 3599000000) AS ts, i * 37 AS user_id,
        'view' AS event_type, CAST(i AS DOUBLE) AS value FROM range(400) r(i)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = flows.current_traffic(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(flows.ORACLE["current_traffic"]).fetchall())
    rules = [{"name": "six", "networks": ["2001:db8::/33", "bad"]}, {"name": "all6", "networks": ["::/0"]}, {"name": "day", "networks": ["10.0.0.0/8"], "timeframes": ["8-12"]}]
    peers = spark.range(1).select(F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("ip"), (F.col("id") + 9 * 3600).alias("now"))
    named = network.longest_prefix(peers, rules).where("rule IS NOT NULL")
    assert [(r["rule"], r["match_len"]) for r in named.collect()] == [("day", 8)]
    assert network.longest_prefix(peers, []).first()["rule"] is None
    for df in (got, named):
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20000
