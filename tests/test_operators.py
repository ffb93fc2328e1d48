import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from replimerge.functions import paths, vectors
from replimerge.operators import audit, batches, brake, diff, ignore, merge, ordered, peers, retention, transfer
from replimerge.plans.fixtures import fixture, with_version
from replimerge.schema import EMPTY
from replimerge.sources import inventory
from replimerge.streaming import events
from replimerge.streaming.run import drain, read_stream, schema_of


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def test_brake_thresholds(spark):
    cases = [(50, 1000, False), (50, 200, True), (49, 100, False), (51, 201, True), (50, 201, False), (50, 0, False)]
    df = spark.createDataFrame([(i, m, 0, 0, t) for i, (m, t, _) in enumerate(cases)], "i int, mods long, dels long, bytes long, tracked long")
    got = {r.i: r.held for r in brake.evaluate_brake(df).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_brake_size_is_strict_and_comes_second(spark):
    limit = 20 << 30
    df = spark.createDataFrame([(1, 0, 0, limit, 10), (2, 0, 0, limit + 1, 10), (3, 60, 0, limit + 1, 100)], "i int, mods long, dels long, bytes long, tracked long")
    got = {r.i: r.reason for r in brake.evaluate_brake(df).collect()}
    assert got[1] is None and got[2].startswith("would write ") and got[3] == "would delete or modify 60 of 100 tracked files (60%)"


def test_conflict_names(spark):
    ns = int(datetime(2026, 9, 22, 14, 30, 5, tzinfo=timezone.utc).timestamp()) * 10**9
    cases = [
        ("report.xlsx", "file", ns, "laptop", "report.conflict-20260922-143005-laptop.xlsx"),
        ("a/b/archive.tar.gz", "file", ns, "pi", "a/b/archive.tar.conflict-20260922-143005-pi.gz"),
        (".bashrc", "file", ns, "pi", ".bashrc.conflict-20260922-143005-pi"),
        ("photos.old", "dir", 0, "pi", "photos.old.conflict-19700101-000000-pi"),
        ("x", "file", -1, "", "x.conflict-19691231-235959-07000000"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "path string, kind string, ns long, host string")
    named = df.select("path", paths.conflict_copy_name(F.col("path"), F.col("kind"), F.col("ns"), F.col("host"), F.lit("0700000000")).alias("n"))
    assert {r.path: r.n for r in named.collect()} == {c[0]: c[4] for c in cases}


def test_long_conflict_name_is_cut_at_a_character(spark):
    df = one(spark, path="d/" + "é" * 126 + ".txt")
    name = df.select(paths.conflict_copy_name(F.col("path"), F.lit("file"), F.lit(0), F.lit("pi"), F.lit("n")).alias("n")).first().n
    tail = name.removeprefix("d/")
    assert len(tail.encode()) <= 255 and tail.endswith(".conflict-19700101-000000-pi.txt") and tail.startswith("é" * 100)


def test_vector_laws(spark):
    rnd = random.Random(3)
    vs = [{n: c for n in "abc" if (c := rnd.randint(0, 2))} for _ in range(40)]
    df = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(vs) for j, b in enumerate(vs)], "i int, j int, a map<string,bigint>, b map<string,bigint>")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", vectors.vv_compare(a, b).alias("r"), vectors.vv_merge(a, b).alias("m"), vectors.vv_dominates(a, b).alias("d")).collect():
        more, less = any(r.a.get(n, 0) > r.b.get(n, 0) for n in "abc"), any(r.b.get(n, 0) > r.a.get(n, 0) for n in "abc")
        assert r.r == {(1, 1): "concurrent", (1, 0): "dominates", (0, 1): "dominated", (0, 0): "equal"}[(int(more), int(less))]
        assert r.m == {n: c for n in "abc" if (c := max(r.a.get(n, 0), r.b.get(n, 0)))} and r.d == (more and not less)


def test_increment_saturates(spark):
    df = spark.createDataFrame([({"a": (1 << 63) - 1},), ({"b": 1},)], "v map<string,bigint>")
    got = [r.v for r in df.select(vectors.vv_increment(F.col("v"), F.lit("a")).alias("v")).collect()]
    assert got == [{"a": (1 << 63) - 1}, {"b": 1, "a": 1}]


def test_merge_is_independent_of_order_and_partitioning(spark, sf):
    r = with_version(fixture(spark, sf, "replicas"))
    want = {(x.folder, x.path): x for x in merge.merge_replicas(r).collect()}
    got = {(x.folder, x.path): x for x in merge.merge_replicas(r.orderBy(F.rand(4)).repartition(7)).collect()}
    assert got == want


def test_windows_against_a_loop(spark):
    rnd = random.Random(1)
    rows = [(f"f{rnd.randint(0, 2)}", "n", rnd.randint(0, 60) * 500_000) for _ in range(300)]
    want = []
    for f in {r[0] for r in rows}:
        times, opened, last, n = sorted(t for g, _, t in rows if g == f), None, 0, 0
        for t in times:
            if opened is not None and t >= min(opened + 10_000_000, last + 2_000_000):
                want.append((f, "n", opened, min(opened + 10_000_000, last + 2_000_000), n))
                opened = None
            if opened is None:
                opened, n = t, 0
            last, n = t, n + 1
        want.append((f, "n", opened, min(opened + 10_000_000, last + 2_000_000), n))
    df = spark.createDataFrame(rows, "folder string, node string, at_us long")
    assert sorted(map(tuple, batches.batch_windows(df).collect())) == sorted(want)
    assert sorted(map(tuple, batches.batch_windows(df, span_us=25_000_000).collect())) == sorted(want)


def test_window_stream_gives_the_closed_windows(spark, sf):
    c = fixture(spark, sf, "changes").select("folder", "node", F.timestamp_micros("at_us").alias("ts"), "at_us")
    live = {tuple(r) for r in drain(events.batch_window_stream(read_stream(spark, c))).collect()}
    batch = {tuple(r) for r in batches.batch_windows(c).collect()}
    assert live and live <= batch and len(live) > 0.9 * len(batch)


def test_split_against_a_loop(spark):
    rnd = random.Random(2)
    rows = [(f"f{i % 3}", "n", "p" * rnd.randint(1, 60), i) for i in range(600)]
    df = spark.createDataFrame(rows, "folder string, source string, path string, seq long")
    for most, room in ((10, 10**9), (7, 1500), (3, 200)):
        want = {}
        for f in ("f0", "f1", "f2"):
            no = n = used = 0
            for _, _, p, seq in [r for r in rows if r[0] == f]:
                c = len(p) + 256
                if n and (n == most or used + c > room):
                    no, n, used = no + 1, 0, 0
                n, used = n + 1, used + c
                want[seq] = no
        for span in (40, 1_000_000):
            assert {r.seq: r.batch_no for r in batches.split_batches(df, most, room, span).collect()} == want


def test_split_of_a_folder_in_pieces(spark):
    """The batches of a folder that is cut into pieces are those of one loop over it."""
    rows = [("big", "n", "p" * (i % 61), i) for i in range(4000)] + [(f"f{i}", "n", "p", i) for i in range(50)]
    df = spark.createDataFrame(rows, "folder string, source string, path string, seq long").repartition(7)
    got = {(r.folder, r.seq): r.batch_no for r in batches.split_batches(df, 9, 2_600, 64).collect()}
    no = n = used = 0
    for _, _, p, seq in rows[:4000]:
        c = len(p) + 256
        if n and (n == 9 or used + c > 2_600):
            no, n, used = no + 1, 0, 0
        n, used = n + 1, used + c
        assert got["big", seq] == no
    assert len(got) == len(rows) and all(v == 0 for (f, _), v in got.items() if f != "big")


@pytest.mark.parametrize("most_rows", [100, ordered.ROWS])
def test_running_sums_in_ranges(spark, most_rows):
    """One folder with nearly all rows, ties, nulls and a far outlier: the sums of one window over the folder."""
    rnd = random.Random(7)
    rows = [("big" if i % 50 else f"f{i % 7}", rnd.choice([None, 10**15, rnd.randint(0, 300)]), i, rnd.choice([None, 1, 5])) for i in range(5000)]
    df = spark.createDataFrame(rows, "folder string, at long, path long, size long").repartition(5)
    got = ordered.running(df, ["folder"], ["at", "path"], F.col("size"), "before", "total", most=most_rows).collect()
    want = {}
    for f in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == f), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total, before = sum(r[3] or 0 for r in own), 0
        for r in own:
            want[r[2]] = (before, total)
            before += r[3] or 0
    assert {r.path: (r.before, r.total) for r in got} == want
    most = ordered.running(df, ["folder"], ["at", "path"], F.col("size"), "most", fold="max", most=most_rows)
    seen = {}
    for r in sorted(most.collect(), key=lambda r: (r.folder, r.at is not None, r.at or 0, r.path)):
        assert r.most == seen.get(r.folder)
        seen[r.folder] = max((x for x in (seen.get(r.folder), r.size) if x is not None), default=None)
    assert ordered.row_number(df.limit(0), ["folder"], ["at", "path"], "n").count() == 0


def test_denied_come_last_undated_ones_first(spark):
    rows = [("f", "b0", 4, "held", None), ("f", "b1", 1, "denied", -5), ("f", "b2", 2, "denied", None), ("f", "b3", None, "held", None), ("f", "b4", 3, "denied", 2**62)]
    df = spark.createDataFrame(rows, "folder string, batch string, arrival long, state string, denied_at long")
    got = brake.return_denied(df).orderBy("arrival").collect()
    assert [r.batch for r in got] == ["b3", "b0", "b2", "b1", "b4"] and {r.state for r in got} == {"held"}


def test_watermark_waits_for_a_gap(spark):
    df = spark.createDataFrame([("f", "n", "p", 0, 3), ("f", "n", "p", 5, 9), ("f", "n", "p", 2, 4), ("f", "n", "q", 1, 2)], "folder string, node string, peer string, seq_low long, seq_high long")
    assert {r.peer: (r.watermark, r.has_gap) for r in batches.contiguous_watermark(df).collect()} == {"p": (4, True), "q": (0, True)}


def test_slots_against_the_whole_loop(spark):
    rnd = random.Random(5)
    tiers = {"a": "lan", "b": "direct", "c": "relay", "d": "lan"}
    rank = {"lan": 0, "direct": 1, "relay": 2}
    wants = [("f", f"p{i:04d}", rnd.sample(sorted(tiers), rnd.randint(1, 4))) for i in range(1000)]
    rows = [(f, p, s, tiers[s], True) for f, p, ss in wants for s in ss]
    listed = sorted((sorted((rank[tiers[s]], s) for s in ss), p) for _, p, ss in wants)
    for busy in ({}, {"a": 3, "b": 4}):
        order = sorted(listed, key=lambda x: (x[0][0], x[1]))
        want = transfer.greedy_slots([(p, [s for _, s in l_]) for l_, p in order], 4, 16, busy)
        running = spark.createDataFrame([("f", k, v) for k, v in busy.items()], "folder string, source string, n int")
        df = spark.createDataFrame(rows, "folder string, path string, source string, tier string, allowed boolean")
        got = [(r.path, r.source) for r in transfer.plan_fetches(df, running).collect()]
        assert sorted(got) == sorted(want)


def test_ignore_rules(spark):
    rules = ignore.compile_rules(["build/", "!.DS_Store", "*.log", "!keep.log", "/only.txt", "a/**/z", "[", "# no", ""])
    cases = {
        ("d/x.swp", "file"): "default", ("d/.DS_Store", "file"): None, ("build", "dir"): "line 1", ("build", "file"): None, ("build/.DS_Store", "file"): "line 1",
        ("e/x.log", "file"): "line 3", ("keep.log", "file"): None, ("only.txt", "file"): "line 5", ("d/only.txt", "file"): None, ("a/z", "file"): "line 6", ("a/b/c/z", "file"): "line 6", ("plain", "file"): None, ("d/._x", "file"): "default",
    }
    df = spark.createDataFrame([("f", p, k) for p, k in cases], "folder string, path string, kind string")
    assert {(r.path, r.kind): r.ignored_by for r in ignore.apply_ignore_rules(df, rules).collect()} == cases


def test_names_and_cases(spark):
    df = spark.createDataFrame([("f", "é", False), ("f", "é", False), ("f", "Dir/a", False), ("f", "dir/b", False), ("f", "gone", True), ("f", "GONE", False)], "folder string, path string, deleted boolean")
    got = {r.folded for r in merge.case_collisions(df).collect()}
    assert got == {"é", "dir"}
    disk = df.select("folder", F.col("path").alias("disk_path"))
    named = paths.coinciding_names(paths.normalise_names(disk))
    assert {r.disk_path: (r.differs, r.coincides) for r in named.collect()}["é"] == (True, True)


def test_tiers(spark):
    cases = {"10.1.2.3": "lan", "172.15.0.1": "direct", "172.31.0.1": "lan", "::ffff:192.168.0.1": "lan", "169.254.9.9": "lan", "8.8.8.8": "direct", "fe80::1": "lan", "FEBF::2": "lan", "fec0::1": "direct", "2001:db8::1": "direct", None: "relay"}
    df = spark.createDataFrame([(k,) for k in cases], "direct_addr string")
    assert {r.direct_addr: r.tier for r in peers.classify_tier(df).collect()} == cases


def test_trash_numbers_after_earlier_ones(spark):
    day = 86_400 * 10**9
    df = spark.createDataFrame([("f", "a/x.tar.gz", "file", day, 1), ("f", "a/x.tar.gz", "file", day + 1, 2), ("f", "d.old", "dir", day, 3), ("f", "d.old", "dir", day, 4)], "folder string, path string, kind string, trashed_at_ns long, arrival long")
    taken = spark.createDataFrame([("f", "1970-01-02", "d.old", 2)], "folder string, day string, path string, n long")
    got = {r.arrival: r.trashed_path for r in retention.trash_places(df, taken).collect()}
    assert got == {1: "1970-01-02/a/x.tar.gz", 2: "1970-01-02/a/x.tar~1.gz", 3: "1970-01-02/d.old~2", 4: "1970-01-02/d.old~3"}


def test_prune_against_a_loop(spark):
    rnd = random.Random(6)
    rows = [("f", f"t{i:03d}", rnd.randint(0, 50) * 86_400 * 10**9, rnd.randint(1, 9)) for i in range(200)]
    now, left, want = 50 * 86_400 * 10**9, sum(r[3] for r in rows), set()
    for _, p, at, size in sorted(rows, key=lambda r: (r[2], r[1])):
        if now - at > 30 * 86_400 * 10**9 or left > 300:
            want.add(p)
            left -= size
    df = spark.createDataFrame(rows, "folder string, trashed_path string, trashed_at_ns long, size long")
    assert {r.trashed_path for r in retention.prune_trash(df, F.lit(now), size=300).where("prune").collect()} == want


def test_revert_keeps_a_directory_with_live_children(spark):
    own = spark.createDataFrame([("f", "d", "dir", EMPTY, 0, False, False), ("f", "d/x", "file", "a", 1, False, False), ("f", "e", "dir", EMPTY, 0, False, False)], "folder string, path string, kind string, hash string, mtime_ns long, exec boolean, deleted boolean")
    pending = spark.createDataFrame([("f", "d", None, None, None, None, None), ("f", "e", None, None, None, None, None)], "folder string, path string, announced_kind string, announced_hash string, announced_mtime_ns long, announced_exec boolean, announced_deleted boolean")
    assert {r.path: r.action for r in brake.revert_plan(pending, own).collect()} == {"d": "keep directory", "e": "trash"}


def test_diff_guards_and_empty_tables(spark, sf):
    e = with_version(fixture(spark, sf, "parts_index"))
    none = fixture(spark, sf, "parts_scan").limit(0)
    live = e.where("not deleted").count()
    assert diff.snapshot_diff(e, none).where("change = 'delete'").count() == live
    assert diff.snapshot_diff(e, none, sound=e.select("folder", "node").limit(0)).where("change = 'delete'").count() == 0
    assert diff.snapshot_diff(e.limit(0), none).count() == 0


def test_invalid_paths(spark):
    cases = {"a": None, "": "empty", "/a": "absolute", "a/": "trailing slash", "a//b": "empty component", "a/./b": "dot", "..": "dot dot", "x" * 256: "long component", ".replimerge/x": "reserved", "a\0b": "nul", "é" * 127 + "/b": None, "é" * 128: "long component"}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.reason for r in paths.validate_paths(df).collect()} == cases


def test_inventory_reads_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("hello")
    (tmp_path / "y").write_text("z")
    got = {r.path: r.size for r in inventory.read_inventory(spark, str(tmp_path)).collect()}
    assert got == {"d/x.txt": 5, "y": 1}


def test_changes_of_a_batch_replace_their_own(spark, tmp_path):
    rows = spark.createDataFrame([("f", "a", 1, False, 1), ("f", "b", 2, False, 1)], "folder string, k string, v long, removed boolean, at long")
    d, state = str(tmp_path / "t"), lambda d: sorted((r.k, r.v) for r in inventory.read_state(spark, d, schema_of(rows), ["folder", "k"]).collect())
    inventory.write_changes(rows.withColumn("v", F.lit(9)), d, 7)
    inventory.write_changes(rows, d, 7)
    assert state(d) == [("a", 1), ("b", 2)]
    inventory.write_changes(rows.where("k = 'a'").withColumn("removed", F.lit(True)), d, 8)
    assert state(d) == [("b", 2)]
    inventory.compact(spark, d, f"{d}2", schema_of(rows), ["folder", "k"])
    inventory.write_changes(rows.withColumn("v", F.lit(5)), f"{d}2", 9)
    assert state(f"{d}2") == [("a", 5), ("b", 5)]


def test_stored_version_is_compared_with_the_stored_one(spark):
    held = spark.createDataFrame([("f", "b", "p", {"a": 2}, 1, 1)], "folder string, batch string, path string, version map<string,bigint>, stamp long, arrival long")
    late = spark.createDataFrame([("f", "b", "p", {"b": 1}, 2, 1), ("f", "b", "p", {"b": 2}, 3, 2), ("f", "b", "q", {"b": 1}, 3, 3), ("f", "b", "q", {"b": 1, "c": 1}, 3, 4)], "folder string, batch string, path string, version map<string,bigint>, stamp long, at long")
    assert {(r.path, r.arrival) for r in brake.hold(held, late).where("stored").collect()} == {("p", 1), ("q", 5)}


def test_rule_faults_and_the_compiler_agree(spark):
    lines = [b"*.log", b"[", b"[]", b"[!]", b"[z-a]", b"[]a]", b"!", b"#[", b"", b"x\\", b"\xff", b"\xef\xbb\xbf*.txt\r", b"y" * (1 << 21) + b"["]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines, 1)], "folder string, line_no long, bytes binary").withColumn("line_no", F.when(F.col("line_no") == 12, 1).otherwise(F.col("line_no")))
    got = {(r.line_no, r.reason) for r in ignore.invalid_rules(df).collect()}
    assert got == {(2, "malformed"), (3, "malformed"), (4, "malformed"), (5, "malformed"), (10, "malformed"), (11, "not UTF-8"), (13, "malformed")}
    rules = ignore.compile_rules(["[z-a]", "[]a]x", "[!b-d]y", "[+-9]z"], defaults=False)
    cases = {"]x": "line 2", "ax": "line 2", "ay": "line 3", "cy": None, "5z": "line 4", "q/z": None}
    paths_ = spark.createDataFrame([("f", p, "file") for p in cases], "folder string, path string, kind string")
    assert {r.path: r.ignored_by for r in ignore.apply_ignore_rules(paths_, rules).collect()} == cases


def test_copies_map_back_along_displaced_directories(spark):
    copies = spark.createDataFrame([("f", "d.conflict-1/e.conflict-2/x.conflict-3",), ("f", "y.conflict-4",)], "folder string, path string")
    displaced = spark.createDataFrame([("f", "d.conflict-1", "d"), ("f", "d.conflict-1/e.conflict-2", "d.conflict-1/e")], "folder string, copy string, path string")
    got = {(r.path[0], r.place) for r in audit.places_made(copies, displaced).collect()}
    assert got == {("d", "d.conflict-1/e.conflict-2/x.conflict-3"), ("d", "d.conflict-1/e/x.conflict-3"), ("d", "d/e/x.conflict-3"), ("y", "y.conflict-4")}


def test_common_directory(spark):
    cases = [(["a/b/c", "a/b/d"], "a/b"), (["a/b/c", "a/b"], "a"), (["a/b", "a-c/d"], None), (["x/y/z"], "x/y"), (["q"], None)]
    rows = [(i, p) for i, (ps, _) in enumerate(cases) for p in ps]
    g = spark.createDataFrame(rows, "i int, path string").groupBy("i").agg(brake.common_directory(F.min("path"), F.max("path")).alias("d"))
    assert {r.i: r.d for r in g.collect()} == {i: d for i, (_, d) in enumerate(cases)}


def test_first_difference(spark):
    a = spark.range(3)
    assert inventory.first_difference({"x": a, "y": a}, {"x": spark.range(3), "y": spark.range(4)}) == "y"
    assert inventory.first_difference({"x": a}, {"x": spark.range(3).repartition(2)}) is None


def test_history_is_appended(spark, tmp_path):
    b = spark.createDataFrame([("f", "n", "b1", 1, [("p", 1), ("q", 2)])], "folder string, source string, batch string, recorded_at long, entries array<struct<path:string,seq:long>>")
    inventory.append_history(b, str(tmp_path))
    inventory.append_history(b.withColumn("recorded_at", F.lit(2)), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/batches").count() == 2
    assert spark.read.parquet(f"{tmp_path}/batch_entries").where("position = 1 and path = 'q'").count() == 2


def test_ancestor_joins_are_equi_joins(spark, sf):
    e, o = fixture(spark, sf, "parts_index"), fixture(spark, sf, "parts_scan")
    plan = diff.covered_by_skip(e, o.where("state = 'skipped'"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
