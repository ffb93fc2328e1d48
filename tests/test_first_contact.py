"""Folders and machines of which little is known, what the gate remembers, ties, and groups that one task could not hold."""

import random
import re
import time
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from replimerge.functions import paths, vectors
from replimerge.operators import audit, batches, brake, diff, ignore, ordered, retention, transfer
from replimerge.schema import EMPTY, ENTRY
from replimerge.sources import inventory
from replimerge.streaming.run import brake_stream, gate_state, read_stream, waiting

TB = 10**12


def entry(path, version, size=1, deleted=False, kind="file", stamp=1):
    return (path, kind, size, 5, stamp, False, "a" * 64, EMPTY, version, deleted, "n1", "h")


def incoming(spark, rows):
    """``rows``: folder, batch, ordinal, source, entry."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRY.fields)
    return spark.createDataFrame([(f, b, o, s, i, *e) for i, (f, b, o, s, e) in enumerate(rows)], f"folder string, batch string, ordinal int, source string, position int, {fields}")


def nothing(spark):
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRY.fields)
    return spark.createDataFrame([], f"folder string, {fields}")


def test_a_first_announcement_is_judged(spark):
    s = spark.createDataFrame([("f", "n", 1, 0, 0, TB), ("g", "n", 1, 0, 0, 5)], "folder string, node string, adds long, mods long, dels long, bytes long")
    got = {r.folder: (r.tracked, r.held) for r in brake.sender_precheck(s, s.limit(0).withColumn("announced_tracked", F.lit(0))).collect()}
    assert got == {"f": (0, True), "g": (0, False)}


def test_nothing_is_lost_without_side_tables(spark):
    e = spark.createDataFrame([("f", "n", "p", 3, "x")], "folder string, node string, path string, seq long, hash string")
    none = e.limit(0)
    pending = none.select("folder", "node", "path", F.lit("add").alias("step"), F.lit(1).alias("announced_seq_of"), F.lit("h").alias("announced_hash"))
    assert [r.seq for r in batches.unannounced(e, pending, none.withColumn("announced_seq", F.lit(0))).collect()] == [3]
    told = e.select("folder", "node", F.lit(3).alias("announced_seq"))
    acks = none.select("folder", "node", F.lit("p").alias("peer"), F.lit(1).alias("ack"))
    members = spark.createDataFrame([("f", "n"), ("f", "m")], "folder string, node string")
    assert [(r.peer, r.seq) for r in batches.catch_up(e, pending, acks, told, members).collect()] == [("m", 3)]
    reports = spark.createDataFrame([("f", "n", "m", 1, 7)], "folder string, node string, peer string, arrival long, watermark long")
    assert [(r.ack, r.resend) for r in batches.replace_ack(reports, told.limit(0)).collect()] == [(7, False)]
    s = spark.createDataFrame([("f", "b", 1, 0, 0, TB, 0)], "folder string, batch string, adds long, mods long, dels long, bytes long, tracked long")
    rules = spark.createDataFrame([("g", 1, 1, 1)], "folder string, hold_count long, hold_pct long, hold_size long")
    assert [r.would_pass for r in brake.rules_recheck(s, rules).collect()] == [False]
    live = spark.createDataFrame([("f", "n", "p", "file", 1, False)], "folder string, node string, path string, kind string, size long, deleted boolean")
    held = spark.createDataFrame([("g", "n", "b")], "folder string, node string, batch string")
    who = held.select("folder", "node")
    status = {r.folder: (r.files, r.held, r.paused) for r in retention.folder_status(live, who.limit(0), held, who, who.limit(0).withColumn("reason", F.lit("")), who.limit(0)).collect()}
    assert status == {"f": (1, 0, False), "g": (0, 1, True)}


def test_gate_of_a_folder_without_records(spark, tmp_path):
    rows = [("new", "b1", 1, "n1", entry("p", {"a": 1}, size=TB)), ("new", "b2", 2, "n2", entry("q", {"a": 1}, size=5))]
    none = nothing(spark)
    brake_stream(read_stream(spark, incoming(spark, rows)), none, f"{tmp_path}/g", none, none, none)
    got = {r.batch: (r.adds, r.tracked, r.held) for r in gate_state(spark, f"{tmp_path}/g", "verdict").collect()}
    assert got == {"b1": (1, 0, True), "b2": (1, 0, False)}
    assert [(r.batch, r.path, r.size) for r in gate_state(spark, f"{tmp_path}/g", "held").collect()] == [("b1", "p", TB)]


def test_gate_remembers(spark, tmp_path):
    """Accepted versions are wanted already, held ones are joined, frozen ones come back when their folder goes on."""
    none, out = nothing(spark), f"{tmp_path}/g"
    folder = none.select("folder")
    paused = spark.createDataFrame([("z",)], "folder string")
    pending = spark.createDataFrame([("z", "s"), ("z", "u")], "folder string, path string")
    big = entry("p", {"a": 1}, size=TB)
    first = [
        ("f", "b1", 1, "n1", entry("q", {"a": 1})), ("f", "b2", 2, "n2", entry("q", {"a": 1})), ("f", "b2", 2, "n2", entry("r", {"a": 1}, size=TB)), ("f", "b3", 3, "n3", entry("r", {"a": 2})), ("f", "b3", 3, "n3", entry("q", {"a": 2})),
        ("z", "c1", 1, "n1", entry("s", {"a": 1}, size=TB)), ("z", "c1", 1, "n1", entry("t", {"a": 1})), ("z", "c2", 2, "n1", entry("s", {"a": 2}, size=7)), ("z", "c3", 3, "n2", entry("u", {"b": 1}, size=TB)), ("h", "d1", 1, "n1", big),
    ]
    source = f"{tmp_path}/in"
    incoming(spark, first).coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema(incoming(spark, []).schema).parquet(source)
    brake_stream(read(), none, out, none, pending, paused)
    part = lambda p: sorted((r.folder, r.batch, r.path, r.ordinal) for r in gate_state(spark, out, p).collect())
    assert part("want") == [("f", "b1", "q", 1), ("f", "b3", "q", 3), ("z", "c1", "t", 1)]
    assert part("held") == [("f", "b2", "r", 2), ("f", "b2", "r", 3), ("h", "d1", "p", 1)]
    assert part("deferred") == [("z", "c1", "s", 1), ("z", "c2", "s", 2), ("z", "c3", "u", 3)]
    said = {r.batch: (r.joined, r.already_wanted, r.frozen, r.held) for r in gate_state(spark, out, "verdict").collect()}
    assert said["b2"] == (0, 1, 0, True) and said["b3"] == (1, 0, 0, False) and said["c1"] == (0, 0, 1, False)

    def same(rows):
        return sorted(map(str, rows.drop("held_at").collect()))

    before = {p: same(gate_state(spark, out, p)) for p in ("want", "held", "deferred", "verdict")}
    offsets = sorted((tmp_path / "g" / "checkpoint" / "commits").glob("*"))
    for f in offsets:  # the commit is lost: the micro-batch runs again
        f.unlink()
    brake_stream(read(), none, out, none, pending, paused)
    assert {p: same(gate_state(spark, out, p)) for p in before} == before

    # The folder goes on: of each path and source the last frozen entry is judged, batch by batch.
    incoming(spark, [("f", "b4", 1, "n4", entry("q", {"a": 1}))]).coalesce(1).write.mode("append").parquet(source)
    brake_stream(read(), none, out, none, pending, folder)
    new = lambda p: sorted((r.folder, r.batch, r.path) for r in gate_state(spark, out, p).where("micro_batch = 1").collect())
    assert new("released") == [("z", None, "s"), ("z", None, "u")]
    assert new("want") == [("z", "c2", "s")] and new("held") == [("z", "c3", "u")]
    assert waiting(spark, out).count() == 0


def test_moves_to_the_trash_are_no_wants(spark):
    rows = incoming(spark, [("f", "b", 1, "n", entry("p", {"a": 1}))]).drop("ordinal")
    none = nothing(spark)
    held = none.select("folder", "path", "version", "stamp").withColumns({"arrival": F.lit(1), "batch": F.lit("x")})
    for trash, route in ((False, "already wanted"), (True, "kept")):
        wants = rows.select("folder", "path", "version").withColumn("to_trash", F.lit(trash))
        assert [r.route for r in brake.route_batch(rows, none, held, wants, none, none).collect()] == [route]


def test_ties_have_one_winner(spark):
    rows = [("f", "k", f"v{i}", False, 1) for i in range(20)]
    schema = "folder string, k string, v string, removed boolean, at long"
    table = spark.createDataFrame([("f", "k", "old")], "folder string, k string, v string")
    won = set()
    for seed in range(4):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        won |= {r.v for r in inventory.upsert(table, spark.createDataFrame(mixed, schema).repartition(3), ["folder", "k"]).collect()}
    assert len(won) == 1


def test_records_of_alike_batches_differ(spark):
    schema = "folder string, source string, batch string, recorded_at long, entries array<struct<path:string,seq:long>>"
    rows = [("f", "a|b", "c", 1, []), ("f", "a", "b|c", 1, []), ("f", None, "a", 1, []), ("f", "a", None, 1, []), ("f", "a", "x", 1, [("p", 1)]), ("f", "a", "x", 1, [("p", 2)])]
    heads, _ = inventory.history_rows(spark.createDataFrame(rows, schema))
    assert heads.select("record").distinct().count() == len(rows)


def test_first_rule_behind_a_byte_order_mark(spark):
    df = spark.createDataFrame([("f", "a.log", "file"), ("f", "]", "file"), ("f", "-q", "file"), ("f", "b", "file")], "folder string, path string, kind string")
    rules = ignore.compile_rules(["\ufeff*.log\r", r"[\]x]", r"[a\-c]q"], defaults=False)
    got = {r.path: r.ignored_by for r in ignore.apply_ignore_rules(df, rules).collect()}
    assert got == {"a.log": "line 1", "]": "line 2", "-q": "line 3", "b": None}
    assert ignore.rule_fault(b"[\\]", False) == "malformed" and ignore.rule_fault("\ufeff*.log\r".encode(), True) is None


def test_hold_takes_null_versions(spark):
    schema = "folder string, batch string, path string, version map<string,bigint>, stamp long, arrival long"
    held = spark.createDataFrame([("f", "b", "p", None, 1, 1), ("f", "b", "q", {"a": 1}, 1, 2)], schema)
    late = spark.createDataFrame([("f", "b", "p", {"a": 1}, 2, 1), ("f", "b", "q", None, 2, 2)], schema.replace("arrival", "at"))
    assert {(r.path, r.arrival) for r in brake.hold(held, late).where("stored").collect()} == {("p", 3), ("q", 2)}


def test_numbers_in_ranges_of_names(spark):
    """One folder with nearly all rows, numbered by strings, in more tasks than one."""
    names = [f"d{i % 7}/x{i * 7919 % 3001:05d}" for i in range(3000)]
    df = spark.createDataFrame([("big", p) for p in names] + [("small", "b"), ("small", "a"), (None, "z")], "folder string, path string").repartition(6)
    got = {(r.folder, r.path): r.n for r in ordered.row_number(df, ["folder"], ["path"], "n", most=50).collect()}
    want = {("big", p): i + 1 for i, p in enumerate(sorted(names))} | {("small", "a"): 1, ("small", "b"): 2, (None, "z"): 1}
    assert got == want


@pytest.mark.parametrize("span", [25, 64, 1000])
def test_cuts_in_spans_against_a_loop(spark, span):
    rng = random.Random(span)
    rows = [(k, i, rng.choice([1, 1, 3, 9])) for k in ("a", "b", None) for i in range({"a": 500, "b": 1, None: 77}[k])]

    def following(p, v):
        used = np.append(0, np.cumsum(v))
        room = np.searchsorted(used, used[:-1] + 20, "right") - 1
        return np.minimum(np.maximum(np.arange(len(p)) + 1, np.minimum(np.arange(len(p)) + 12, room)), len(p))

    df = spark.createDataFrame([("x" if k is None else k, i, v) for k, i, v in rows], "k string, i long, v long").repartition(5)
    got = {(r.k, r.i): (r.cut_no, r.cut_at) for r in ordered.greedy_cuts(df, ["k"], "i", "v", following, span, 12).collect()}
    want, state = {}, {}
    for k, i, v in rows:
        k = "x" if k is None else k
        no, at, n, used = state.get(k, (0, 0, 0, 0))
        if n and (n == 12 or used + v > 20):
            no, at, n, used = no + 1, i, 0, 0
        state[k] = (no, at, n + 1, used + v)
        want[k, i] = (no, at)
    assert got == want


def test_frontier_of_many_versions(spark):
    rng = random.Random(4)
    chain = [("f", "chain", {"a": i + 1}) for i in range(3000)]
    wide = [("f", "wide", {n: rng.randint(1, 9) for n in sorted(rng.sample("abcd", 2))}) for _ in range(400)] + [("g", None, {"a": 1}), ("g", None, {"a": 2})]
    df = spark.createDataFrame(chain + wide, "folder string, path string, version map<string,bigint>")
    below = lambda v, w: v != w and all(c <= w.get(n, 0) for n, c in v.items())
    want = sorted([("f", "chain", {"a": 3000}), ("g", None, {"a": 2})] + [r for r in wide[:400] if not any(below(r[2], s[2]) for s in wide[:400])], key=str)
    assert sorted(((r.folder, r.path, dict(sorted(r.version.items()))) for r in vectors.frontier(df, ["folder", "path"]).collect()), key=str) == want


def test_resurrections_against_pairs(spark):
    rng = random.Random(8)
    rows = [(f"p{rng.randrange(40)}", f"n{i % 3}", {n: c for n in "abc" if (c := rng.randint(0, 2))}, rng.random() < 0.4, "file") for i in range(160)]
    df = spark.createDataFrame([("f", *r) for r in rows], "folder string, path string, node string, version map<string,bigint>, deleted boolean, kind string")
    over = lambda v, w: all(c <= w.get(n, 0) for n, c in v.items())
    dead = {p for p, _, d, gone, _ in rows if gone and all(over(w, d) for q, _, w, _, _ in rows if q == p)}
    alive = {p for p, _, _, gone, _ in rows if not gone}
    got = {r.path for r in audit.resurrections(df).collect()}
    assert got == dead & alive and got
    one = sorted(got)[0]
    key = vectors.vv_key(F.col("version"))
    discarded = df.where((F.col("path") == one) & F.col("deleted")).select("folder", "path", key.alias("vv_key"))
    assert {r.path for r in audit.resurrections(df, discarded=discarded).collect()} == got - {one}


def test_later_edits_are_no_loss(spark):
    adopted = spark.createDataFrame([("f", "n", "p", "h1", 5), ("f", "n", "q", "h2", 5)], "folder string, node string, path string, hash string, adopted_ns long")
    edits = spark.createDataFrame([("f", "n", "p", 6), ("f", "n", "q", 5)], "folder string, node string, path string, edited_ns long")
    assert {r.hash for r in audit.lost_content(adopted, adopted.limit(0), adopted.limit(0), edits).collect()} == {"h2"}


def test_slots_with_many_peers(spark):
    """Sixty peers with lists of their own, names with commas and signs: what one loop over all wants would start."""
    rng = random.Random(11)
    peers = [f"n{i},={i}" for i in range(60)]
    rank = {p: i % 3 for i, p in enumerate(peers)}
    tiers = ["lan", "direct", "relay"]
    wants = [(f, f"p{i:05d}", rng.sample(peers, rng.randint(1, 9))) for f in ("f", "g") for i in range(1500)]
    df = spark.createDataFrame([(f, p, s, tiers[rank[s]], True) for f, p, ss in wants for s in ss], "folder string, path string, source string, tier string, allowed boolean")
    for busy in ({}, {peers[0]: 4, peers[3]: 4, peers[6]: 3}):
        running = spark.createDataFrame([("f", k, v) for k, v in busy.items()], "folder string, source string, n int")
        got = sorted((r.folder, r.path, r.source) for r in transfer.plan_fetches(df, running).collect())
        want = []
        for f in ("f", "g"):
            own = sorted((sorted((rank[s], s) for s in ss), p) for g, p, ss in wants if g == f)
            own.sort(key=lambda x: (x[0][0], x[1]))
            want += [(f, p, s) for p, s in transfer.greedy_slots([(p, [s for _, s in l_]) for l_, p in own], 4, 16, busy if f == "f" else {})]
        assert got == sorted(want)
    few = df.where("source in ('n0,=0', 'n1,=1')")
    assert transfer.plan_fetches(few).count() == sum(min(4, few.where((F.col("folder") == f) & (F.col("source") == s)).count()) for f, s in product("fg", peers[:2]))


def test_tables_of_many_machines(spark):
    before = spark.createDataFrame([("f", "a", "p", 1, 2), ("f", "b", "p", 1, 2)], "folder string, node string, path string, requested_ns long, stored_ns long")
    after = before.where("node = 'a'")
    assert {(r.node, r.action) for r in diff.shim_delta(before, after).collect()} == {("a", "keep"), ("b", "remove")}
    looks = spark.createDataFrame([("f", "a", "p", 10**12, 0), ("f", "b", "p", 10**12, 3 * 10**9)], "folder string, node string, path string, ctime_ns long, looked_ns long")
    assert not any(r.settled for r in diff.two_looks(looks).collect())


def test_long_names_keep_their_extension(spark):
    df = spark.createDataFrame([("a" * 300 + ".txt",), (".rc",)], "n string")
    got = [r[0] for r in df.select(paths.tagged_name(F.col("n"), F.lit("~1"), F.lit(False))).collect()]
    assert got == ["a" * 249 + "~1.txt", ".rc~1"]


def test_windows_live_and_after_a_restart(spark, tmp_path):
    """Windows of a busy key, by files in order, with a restart between: those of the batch operator that the watermark has passed."""
    from replimerge.streaming import events

    rng = random.Random(2)
    rows, at = [], 10**12
    for _ in range(400):
        at += rng.choice([0, 0, 200_000, 900_000, 1_700_000, 2_000_000, 5_000_000])
        rows += [("f", "n", at)] * rng.choice([1, 1, 3])
    schema = "folder string, node string, at_us long"
    want = {tuple(r) for r in batches.batch_windows(spark.createDataFrame(rows, schema)).collect()}
    source, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        for i in range(0, len(half), 97):
            part = half[i : i + 97]
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        c = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_micros("at_us"))
        q = events.batch_window_stream(c).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    mark = (max(t for *_, t in rows) // 1000 - 10_000) * 1000
    assert len(got) == len(set(got)) and set(got) == {w for w in want if w[3] <= mark} and len(got) > 0.8 * len(want)


def test_log_is_compacted_under_a_stream(spark, tmp_path):
    from replimerge.sources import changelog
    from replimerge.streaming.run import schema_of

    schema = "folder string, k string, v long, removed boolean, at long"
    rng = random.Random(6)
    parts = [[(f"f{rng.randrange(3)}", f"k{rng.randrange(12)}", rng.randrange(99), rng.random() < 0.3, rng.randrange(3)) for _ in range(20)] for _ in range(6)]
    full = schema_of(spark.createDataFrame([], schema))
    a, b, keys = f"{tmp_path}/a", f"{tmp_path}/b", ["folder", "k"]
    state = lambda d, **m: sorted(map(tuple, changelog.read(spark, d, full, keys, **m).collect()))
    assert state(a) == [] and changelog.compact(spark, a, full, keys).version == -1
    pinned = None
    for n, rows in enumerate(parts):
        df = spark.createDataFrame(rows if n != 4 else [r for r in rows if r[0] == "f1"], schema)
        for d in (a, b):
            changelog.append(df, d, n)
        if n in (1, 2, 3, 4):
            before = state(a)
            now = changelog.compact(spark, a, full, keys)
            assert state(a) == before == state(b)
            pinned = pinned or (now, before)
            changelog.append(df, a, n)  # the micro-batch runs again
        assert state(a) == state(b)
    m = changelog.current(spark, a)
    assert m.version == 3 and m.folders["f1"][0] == 3 and m.folders["f0"][0] == 2 and changelog.compact(spark, b, full, keys).version == 0
    later = {r for r in changelog.read(spark, a, full, keys, manifest=pinned[0]).collect()}
    assert later == {r for r in changelog.read(spark, b, full, keys).collect()}
    changelog.vacuum(spark, a, keep=1)
    assert changelog.manifests(spark, a) == [3] and state(a) == state(b)
    with pytest.raises(Exception, match="exist"):
        from replimerge.sources.shared import publish

        publish(spark, f"{a}/manifest/3", "[]")


def test_half_written_changes_do_not_count(spark, tmp_path):
    from replimerge.sources import changelog
    from replimerge.streaming.run import schema_of

    df = spark.createDataFrame([("f", "k", 1, False, 1)], "folder string, k string, v long, removed boolean, at long")
    changelog.append(df, str(tmp_path), 0)
    changelog.append(df.withColumn("v", F.lit(2).cast("long")), str(tmp_path), 1)
    (tmp_path / "changes" / "batch_id=1" / "_SUCCESS").unlink()
    changelog.compact(spark, str(tmp_path), schema_of(df), ["folder", "k"])
    (tmp_path / "changes" / "batch_id=1" / "_SUCCESS").touch()
    assert [r.v for r in changelog.read(spark, str(tmp_path), schema_of(df), ["folder", "k"]).collect()] == [2]


def test_rows_of_every_state_table(spark):
    from replimerge.sources import tables

    good = {"path": "a/b", "hash": "a" * 64, "id": "f" * 32, "host": "h-1", "count": 3, "time": -5, "flag": False, "text": "x", "vector": {"n": 1}}
    bad = {"path": "a//b", "hash": "A" * 64, "id": "", "host": "H!", "count": -1, "vector": {"n": 0}}
    fixes = {"size": 0, "peer": "e" * 32, "announced_seq": 3, "announced_hash": "a" * 64, "seq_high": 4, "held_reason": None, "decision": "accepted", "denied_at": None, "disk_name": "other"}
    for name, table in tables.TABLES.items():
        base = {f.name: fixes.get(f.name, good.get(f.rule, f.rule.split("|")[0])) for f in table.fields}
        base |= {"last_seq": 9} if "last_seq" in base else {}
        rows, want = [base], {}
        number = next((f.name for f in table.fields if f.name in table.key and f.rule in ("count", "text", "path", "id")), table.key[0])
        for f in table.fields:
            wrong = {**base, f.name: bad.get(f.rule, "other")} if f.rule not in ("time", "flag", "text") else None
            if wrong:
                rows.append(wrong)
                want[f"{f.name}: not {f.rule}"] = 1
            if not f.optional:
                rows.append({**base, f.name: None})
                want[f"{f.name}: null"] = 1
        schema = tables.table_schema(name)
        df = spark.createDataFrame([tuple(r[f.name] for f in table.fields) for r in rows], schema)
        sound, rejected = tables.split_rows(df, name)
        assert sound.count() == 1 and sound.schema == schema, name
        assert {r.fault: r.n for r in rejected.groupBy("fault").agg(F.count("*").alias("n")).collect()} == want, name
        twice = tables.split_rows(spark.createDataFrame([tuple(base[f.name] for f in table.fields)] * 2, schema), name)
        assert twice[0].count() == 0 and {r.fault for r in twice[1].collect()} == {"a repeated key"} and number
        assert tables.split_rows(df.limit(0), name)[0].count() == 0


@pytest.mark.parametrize(
    ("name", "change", "reason"),
    [
        ("entries", {"deleted": True, "size": 3}, "a tombstone with content"), ("entries", {"kind": "dir", "size": 3}, "a directory with content"), ("entries", {"kind": "symlink", "mtime_ns": 3}, "a link or directory with exec or mtime"),
        ("batches", {"decision": "held", "held_reason": None}, "a decision and reason that do not fit"), ("batches", {"seq_low": 9}, "an empty range"), ("held_items", {"state": "denied"}, "a denial without its time, or a time without one"),
        ("received_ranges", {"seq_low": 4}, "an empty range"), ("folder_state", {"announced_seq": 12}, "announced beyond the last"), ("pending", {"announced_hash": None}, "a half announced record"), ("disk_names", {"disk_name": "b"}, "a name that is the path's own"), ("acks", {"peer": "f" * 32}, "an ack of its own"),
    ],
)
def test_rules_across_columns(spark, name, change, reason):
    from replimerge.sources import tables

    good = {"path": "a/b", "hash": "a" * 64, "id": "f" * 32, "host": "h-1", "count": 3, "time": 0, "flag": False, "text": "x", "vector": {"n": 1}}
    fixes = {"peer": "e" * 32, "seq_high": 4, "held_reason": None, "decision": "accepted", "denied_at": None, "last_seq": 9, "disk_name": "other"}
    row = {f.name: fixes.get(f.name, good.get(f.rule, f.rule.split("|")[0])) for f in tables.TABLES[name].fields} | change
    df = spark.createDataFrame([tuple(row.values())], tables.table_schema(name))
    assert [r.fault for r in tables.split_rows(df, name)[1].collect()] == [reason]
    assert [r.fault for r in tables.split_rows(df.withColumn("folder", F.lit("short")), name, hex_ids=True)[1].collect()] == ["folder: not id"] if "folder" in df.columns else True


def test_listing_has_all_kinds(spark, tmp_path):
    from replimerge.sources import listing

    root = tmp_path / "tree"
    (root / "a" / "b" / "c").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "a" / ".hidden").write_text("")
    (root / "a" / "b" / "_x").write_text("12345")
    (root / "a" / "b" / "c" / "run").write_text("#!")
    (root / "a" / "b" / "c" / "run").chmod(0o755)
    (root / "link").symlink_to("a/b")
    (root / "broken").symlink_to("nowhere")
    got = {r.path: r for r in listing.list_tree(spark, str(root)).collect()}
    kinds = {"a": "dir", "a/b": "dir", "a/b/c": "dir", "empty": "dir", "a/.hidden": "file", "a/b/_x": "file", "a/b/c/run": "file", "link": "symlink", "broken": "symlink"}
    assert {p: r.kind for p, r in got.items()} == kinds and not any(r.fault for r in got.values())
    assert got["a/b/_x"].size == 5 and got["a/.hidden"].size == 0 and got["link"].target == "a/b"
    assert got["a/b/c/run"].exec and not got["a/b/_x"].exec
    assert got["a/b/_x"].mtime_ns == (root / "a" / "b" / "_x").stat().st_mtime_ns and got["a"].ctime_ns
    assert listing.list_tree(spark, str(root / "empty")).count() == 0
    assert {r.path for r in listing.list_tree(spark, f"file://{root}/a").collect()} == {"b", "b/c", ".hidden", "b/_x", "b/c/run"}
    with pytest.raises(Exception, match="nowhere"):
        listing.list_tree(spark, str(tmp_path / "nowhere"))


def versions(spark, rows):
    """``rows``: folder, node, entry."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRY.fields)
    return spark.createDataFrame([(f, n, *e) for f, n, e in rows], f"folder string, node string, {fields}")


def test_copies_audit_shuffles_each_version_once(spark):
    """Copies where they were made, in a displaced directory, with a text that is no digest, and edited ones; all versions go through one shuffle, and the losers are made once though the entries are a union."""
    own = lambda path, node, stamp, text, kind="file": ("f", node, (path, kind, 1, 0, stamp, False, text, EMPTY, {node: 1}, False, node, node))
    copy = lambda path, text: ("f", "n3", (path, "file", 1, 0, 9, False, text, EMPTY, {"n3": 1}, False, "n3", "n3"))
    tag, a, b = ".conflict-19700101-000000-n1", "a" * 64, "b" * 64
    real = [own("d", "n1", 1, EMPTY, "dir"), own("d", "n2", 2, b), own("d/x", "n1", 1, a), own("d/x", "n2", 2, b), own("y", "n1", 1, "no digest"), own("y", "n2", 2, b), own("z", "n1", 1, a), own("z", "n2", 2, a)]
    copies = [copy(f"d{tag}/x{tag}", a), copy(f"y{tag}", "no digest"), copy(f"z{tag}", a), copy(f"d/x{tag}", b)]
    entries = versions(spark, real).unionByName(versions(spark, copies))
    audited = lambda *x: sorted((r.path, r.hash) for r in audit.unexplained_conflicts(entries, *x).collect())
    assert audited() == [(f"d/x{tag}", b), (f"z{tag}", a)]
    edited = spark.createDataFrame([("f", f"d/x{tag}"), ("f", f"z{tag}")], "folder string, path string")
    assert audited(edited) == [(f"z{tag}", a)]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = audit.unexplained_conflicts(versions(spark, real).unionByName(versions(spark, copies[1:])))
        assert len(found.collect()) == 2
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len([x for x in plan.splitlines() if re.search(r"[-+] Exchange hashpartitioning", x)]) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_gate_shuffles_a_row_once_and_keeps_no_shuffle(spark, tmp_path):
    """A row with its entry is shuffled once whatever is held and wanted; equal paths of two batches keep their own answers; no shuffle file outlives the run."""
    rows = [("f", b, 1, "n1", entry(p, {"a": v}, stamp=v)) for b, p, v in (("b1", "p", 1), ("b2", "p", 3), ("b1", "q", 1), ("b1", "r", 2), ("b2", "s", 1))]
    offered, none = incoming(spark, rows), nothing(spark)
    vectors = lambda rows: spark.createDataFrame(rows, "folder string, path string, version map<string,bigint>")
    held = vectors([("f", "p", {"a": 2}), ("f", "r", {"a": 2}), ("f", "r", {"a": 1})]).withColumns({"arrival": F.coalesce(F.element_at("version", "a"), F.lit(0)), "batch": F.concat(F.lit("h"), F.element_at("version", "a"))})
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        routed = brake.route_batch(offered.drop("ordinal"), none, held, vectors([("f", "q", {"a": 1}), ("f", "s", {"b": 1})]), none.limit(0), none.limit(0))
        assert {(r.batch, r.path): (r.route, r.held_batch) for r in routed.collect()} == {("b1", "p"): ("kept", None), ("b2", "p"): ("joined", "h2"), ("b1", "q"): ("already wanted", None), ("b1", "r"): ("joined", "h1"), ("b2", "s"): ("kept", None)}
        plan = routed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        exchanges = [x for x in plan.splitlines() if re.search(r"[-+] Exchange hashpartitioning", x)]
        assert len(exchanges) <= 5  # rows, entries, vectors, what is wanted, what is held
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {b for b in str(blocks.getAllBlocks().mkString(",")).split(",") if "shuffle" in b}
    stream, before = read_stream(spark, offered), files()
    brake_stream(stream, none, f"{tmp_path}/g", none, none, none)
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before
    assert gate_state(spark, f"{tmp_path}/g", "want").count() == 5


def test_brake_query_stages_what_the_gate_reads(spark, sf, tmp_path, monkeypatch):
    """The rows on offer are staged with the gate's columns only, and what the gate compares them with has no more than the comparison needs, with the same winners."""
    from replimerge.operators.merge import classify_batch
    from replimerge.plans import stream_queries  # noqa: F401  (registers its queries)
    from replimerge.plans.queries import QUERIES, _two
    from replimerge.sources import shared

    monkeypatch.setattr(shared, "_inner", [str(tmp_path)])
    assert QUERIES["stream_brake"](spark, sf).count() > 0
    (staged,) = tmp_path.glob("staged-*")
    assert set(spark.read.parquet(str(staged)).columns) == {"folder", "batch", "ordinal", "position", *ENTRY.fieldNames()}
    assert not list(tmp_path.glob("scratch-*"))
    from replimerge.functions.entries import for_comparison

    a, b = _two(spark, sf)
    b = b.withColumn("stamp", F.when(F.col("k") % 2 == 0, 0).otherwise(F.col("stamp")))
    judged = lambda own: sorted(tuple(r) for r in classify_batch(a, own).select("folder", "path", "decision", F.coalesce("mode", F.lit("")), "incoming_wins").collect())
    assert judged(for_comparison(b)) == judged(b)
    assert for_comparison(b).where("size is not null or author_host is not null").isEmpty()
