from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.operators import folds
from veilgrid.operators import sessions as S
from veilgrid.operators import ordered
from veilgrid.operators.ordered import fold_by_bucket, widest_bucket
from veilgrid.session import shared_folder
from veilgrid.streaming import jobs, keyed

START = datetime(2024, 1, 1)


def plain(fold, rows):
    """The fold one row at a time."""
    state, out = None, []
    for row in rows:
        state, result = fold.step(state, row)
        out.append(result)
    return out


def _cases(rng):
    steps = [(rng.randint(1, 6),) for _ in range(rng.randint(1, 12))]
    times = sorted(rng.choices(range(0, 400), k=rng.randint(1, 25)))
    events = [(rng.choice(["send", "send", "end", "tab_closed"]), rng.randint(0, 2), rng.randint(0, 1)) for _ in range(10)]
    return (
        (folds.StepSequence(), steps, [None, *range(6)]),
        (folds.FixedWindowRate(3, 60), [(t + 400,) for t in times], [None, *({"start": s, "count": c} for s, c in ((300, 2), (399, 9), (380, 1)))]),
        (folds.ContextBinding(), events, [None, *({"tab": t, "frame": f} for t in range(3) for f in range(2))]),
    )


def _followed(fold, state, rows):
    for row in rows:
        state, _ = fold.step(state, row)
    return state


def test_summaries_equal_steps():
    """A summary of any bucket takes any reachable state where the single steps take it."""
    rng = random.Random(1)
    for _ in range(400):
        for fold, rows, states in _cases(rng):
            for state in states:
                assert (fold.advance(state, fold.summary(rows)) or 0) == (_followed(fold, state, rows) or 0)


def test_summaries_compose():
    """Summaries of parts, composed in any grouping, do what the rows do one by one."""
    rng = random.Random(2)
    for _ in range(400):
        for fold, rows, states in _cases(rng):
            cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(3))})
            parts = [fold.summary(rows[a:b]) for a, b in zip(cuts, cuts[1:])]
            while len(parts) > 1:
                i = rng.randrange(len(parts) - 1)
                parts[i:i + 2] = [fold.compose(parts[i], parts[i + 1])]
            for state in states:
                assert (fold.advance(state, parts[0]) or 0) == (_followed(fold, state, rows) or 0)


def test_summaries_stay_small_whatever_the_rows():
    rng, sizes = random.Random(3), {}
    for n in (300, 30_000):
        times = np.cumsum([rng.choice([1, 2, 5, 30]) for _ in range(n)]).tolist()
        inputs = (
            (folds.StepSequence(), [(rng.randint(1, 20),) for _ in range(n)]), (folds.FixedWindowRate(20, 60), [(t,) for t in times]),
            (folds.ContextBinding(), [(rng.choice(["send", "end", "tab_closed"]), rng.randint(0, 5), 0) for _ in range(n)]))
        for fold, rows in inputs:
            whole = None
            for i in range(0, n, 50):
                part = fold.summary(rows[i:i + 50])
                whole = part if whole is None else fold.compose(whole, part)
            sizes.setdefault(type(fold).__name__, []).append(sum(len(v) for v in whole.values() if isinstance(v, list)))
    assert all(large <= max(small, 60) for small, large in sizes.values()), sizes


def test_a_key_of_many_buckets_never_meets_in_one_task(spark, monkeypatch):
    """100,000 buckets of one key: no task composes or carries more than a fan of them."""
    n = 100_000
    df = spark.range(n).selectExpr("'hot' as client", "id * 7000000 as at_us", "cast(id as int) as n").repartition(8)
    got, state = S.rate_limit(df, "client", "at_us", slice_width=7_000_000, limit=5)
    assert got.where("n % 9 = request_no - 1 and window_start = (n - n % 9) * 7000000L and allowed = (request_no <= 5)").count() == n
    assert [tuple(r.state) for r in state.collect()] == [((n - 1) // 9 * 9 * 7_000_000, (n - 1) % 9 + 1)]
    monkeypatch.setattr(ordered, "FAN", 2)
    got, _ = S.rate_limit(df.where("n < 300"), "client", "at_us", slice_width=7_000_000)
    assert got.where("n % 9 = request_no - 1").count() == 300


def test_a_minute_with_all_sessions_is_spread(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id as session_id", "timestamp_ntz'2024-01-01 00:00:10' as ts", "1L as vault_epoch").repartition(8)
    rows = S.concurrency(df, warn_at=20)
    assert rows.where("change = 1").selectExpr("max(active)", "count(distinct active)", "sum(int(over_limit))").first() == (4000, 4000, 3980)
    assert rows.where("change = -1").selectExpr("min(active)").first() == (0,)
    held, cut = [], ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df, name: held.append(cut(df, name)) or held[-1])
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        assert S.concurrency(df).where("change = 1").selectExpr("max(active)").first() == (4000,)
    finally:
        spark.conf.set(merging, "true")
    assert held[0].where("change = 1").groupBy("_part").count().count() > 2


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_hot_key_is_cut_without_a_trace(spark, width):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}", i, rng.randint(1, 5), 2**60 + i) for i in range(800)]
    df = spark.createDataFrame(rows, "session_id string, arrival bigint, step_number int, big bigint")
    got, state = S.step_acceptance(df, block=width)
    by_arrival = {r.arrival: (r.accepted, r.expected_step, r.continuity_break) for r in got.collect()}
    assert {r.big for r in got.select("big").collect()} == {r[3] for r in rows}
    keys = {r[0] for r in rows}
    for key in keys:
        mine = [r for r in rows if r[0] == key]
        assert [by_arrival[r[1]] for r in mine] == plain(folds.StepSequence(), [(r[2],) for r in mine])
    assert {r.session_id for r in state.collect()} == keys


def test_rate_limit_cases(spark):
    rows = [("a", i * 1_000_000) for i in range(21)] + [("b", 0), ("b", 60_000_000), ("b", 60_000_001)]
    df = spark.createDataFrame(rows, "client string, at bigint")
    got, _ = S.rate_limit(df, "client", "at", slice_width=5_000_000)
    a = sorted((r.at, r.allowed) for r in got.where("client = 'a'").collect())
    assert [ok for _, ok in a] == [True] * 20 + [False]
    assert [(r.window_start, r.request_no) for r in got.where("client = 'b'").orderBy("at").collect()] == [
        (0, 1), (0, 2), (60_000_001, 1)]


def test_context_cases(spark):
    log = [("send", 1, 0), ("send", 2, 0), ("send", 1, 0), ("tab_closed", 2, 0), ("send", 1, 0), ("tab_closed", 1, 0), ("send", 2, 0), ("end", 9, 0), ("send", 3, 1)]
    df = spark.createDataFrame([("s", START + timedelta(hours=9 * i), *e) for i, e in enumerate(log)],
                               "session_id string, ts timestamp_ntz, event string, tab_id int, frame_id int")
    got = [r.verdict for r in S.context_binding(df).orderBy("ts").collect()]
    assert got == ["bound", "rejected", "ok", "ignored", "ok", "released", "bound", "released", "bound"]


def test_expiry_is_strict(spark):
    minutes = [0, 30, 61, 61, 100]
    df = spark.createDataFrame([("s", START + timedelta(hours=23, minutes=m), i) for i, m in enumerate(minutes)],
                               "session_id string, ts timestamp_ntz, n int")
    got = S.expiry_epochs(df, order=("n",)).orderBy("n").collect()
    assert [r.vault_epoch for r in got] == [1, 1, 2, 2, 3]
    now = F.expr("timestamp_ntz'2024-01-02 00:40:00'") + F.expr("interval 30 minutes")
    assert not S.expired_sessions(df, now).first().expired


def test_frames_and_errors_cross_buckets(spark):
    hashes = ["A", "A", "B", "", "", "A", "A"]
    df = spark.createDataFrame([("s", START + timedelta(hours=11 * i), h, f"e{i}", i % 2 == 1) for i, h in enumerate(hashes)],
                               "session_id string, ts timestamp_ntz, content_hash string, error string, succeeded boolean")
    assert [r.skipped for r in S.unchanged_frames(df).orderBy("ts").collect()] == [False, True, False, False, False, False, True]
    assert [r.last_action_error for r in S.previous_errors(df).orderBy("ts").collect()] == [None, "e0", None, "e2", None, "e4", None]


def test_the_first_limit_ends_a_task(spark):
    rows = [("late", n, n != 23) for n in range(1, 25) for _ in range(3)] + [("early", n, n != 3) for n in range(1, 25) for _ in range(3)]
    rows += [("at", n, n != 20) for n in range(1, 23) for _ in range(3)] + [("short", 1, False), ("short", 2, True)]
    got = {r.session_id: (r.failed_step, r.n_steps, r.outcome) for r in S.task_limits(
        spark.createDataFrame(rows, "session_id string, step_number int, succeeded boolean")).collect()}
    assert got == {"late": (None, 20, "max_steps_exceeded"), "early": (3, 3, "max_retries_exceeded"), "at": (20, 20, "max_retries_exceeded"),
                   "short": (None, 2, None)}


def test_history_text(spark):
    df = spark.createDataFrame([("s", 1, "go", "click", "el-1", True), ("s", 2, "on", "wait", None, True), ("s", 9, "no", "click", "x", False),
                                ("t", 3, "no", "click", "x", False)],
                               "session_id string, step_number int, instruction string, action_type string, target_element_id string, accepted boolean")
    got = {r.session_id: r.history for r in S.session_history(df, block=1).collect()}
    assert got["s"] == "Previous steps taken:\nStep 1: Intended to 'go'. Executed action: click on el-1\nStep 2: Intended to 'on'. Executed action: wait on None\n"
    assert got["t"] == "No previous steps in this session."


def test_widest_bucket(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)], "k string, n int")
    widths = {"all": F.lit(0), "ten": F.floor(F.col("n") / 10), "one": F.col("n")}
    assert widest_bucket(df, ["k"], widths, 10) == "ten"
    assert widest_bucket(df, ["k"], widths, 0) is None


def _arriving(spark, df):
    """The stream of all files each time that one more ``part`` of ``df`` is there."""
    path = shared_folder(spark, "in")
    for (part,) in sorted(df.select("part").distinct().collect()):
        df.where(f"part = {part}").drop("part").repartition(3).write.mode("append").parquet(path)
        yield spark.readStream.schema(df.drop("part").schema).parquet(path)


def _streamed(spark, df, start):
    """Rows that a job writes which is run to its end and restarted on each part."""
    folder = shared_folder(spark, "out")
    for stream in _arriving(spark, df):
        start(stream, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def test_stream_of_frames_equals_batch(spark):
    rng = random.Random(5)
    rows = [(f"s{rng.randint(0, 2)}" if i % 31 else None, START + timedelta(minutes=i), 2**60 + i if i % 7 else None, i, rng.choice(["A", "B", "", None]), i // 40) for i in range(160)]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp_ntz, big bigint, n int, content_hash string, part int")
    got = _streamed(spark, df, lambda s, f: jobs.stream_frames(s, f, order=("n",)))
    want = S.unchanged_frames(df, order=("n",)).drop("part")
    assert got.columns == want.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_stream_of_steps_equals_batch(spark):
    rng = random.Random(6)
    rows = [(f"s{i % 3}", i, rng.randint(1, 4) + i // 60, i // 50) for i in range(150)]
    df = spark.createDataFrame(rows, "session_id string, arrival bigint, step_number int, part int")
    got = _streamed(spark, df, jobs.stream_steps)
    want, _ = S.step_acceptance(df.drop("part"))
    assert got.columns == want.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("late", [None, "1 minute"])
def test_stream_of_requests_equals_batch(spark, late):
    rng, at, rows = random.Random(7), 0, []
    for i in range(400):
        at += rng.choice([0, 1, 1_000_000, 9_000_000, 59_000_000 if i % 50 == 0 else 5])
        rows.append(("hot" if rng.random() < 0.7 else f"c{rng.randint(0, 4)}", at, i, i // 150))
    df = spark.createDataFrame(rows, "client string, at_us bigint, n int, part int")
    got = _streamed(spark, df, lambda s, f: jobs.stream_rate_limit(s, "client", "at_us", f, order=("n",), late=late))
    want, _ = S.rate_limit(df.drop("part"), "client", "at_us", order=("n",))
    assert got.columns == want.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def _minutes(spark, rows):
    return spark.createDataFrame([(k, START + timedelta(minutes=m), p) for k, m, p in rows], "session_id string, ts timestamp, part int")


def test_stream_of_sessions_loses_no_access(spark):
    """Accesses that come late are rows of their own; the others make the lives of the batch."""
    rng = random.Random(8)
    rows = [(f"s{rng.randint(0, 3)}", i * 7 + rng.choice([0, 0, 0, -25, -300]), i // 40) for i in range(160)]
    df = _minutes(spark, rows)
    got = _streamed(spark, df, lambda s, f: jobs.stream_sessions(s, f, late="30 minutes"))
    late = got.where("outcome = 'late'")
    upto = {p: max((m for _, m, q in rows if q < p), default=-10**6) - 30 for p in range(5)}
    behind = [(k, m) for k, m, p in rows if m < upto[p]]
    start = int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert sorted((r.session_id, (r.opened - start) // 60_000_000) for r in late.collect()) == sorted(behind) != []
    ontime = _minutes(spark, [(k, m, p) for k, m, p in rows if m >= upto[p]])
    epochs = S.expiry_epochs(ontime.withColumn("ts", F.col("ts").cast("timestamp_ntz")), order=("part",)).groupBy("session_id", "vault_epoch").agg(
        F.unix_micros(F.min("ts").cast("timestamp")).alias("opened"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last_access"), F.count("*").alias("n_accesses"))
    closed = epochs.where(f"last_access + 1800000000 < {start + upto[4] * 60_000_000}").drop("vault_epoch")
    assert sorted(map(tuple, got.where("outcome = 'closed'").drop("outcome").collect())) == sorted(map(tuple, closed.collect())) != []


def test_a_gap_of_the_ttl_keeps_a_session_open(spark):
    rows = [("a", 0, 0), ("a", 30, 0), ("b", 0, 0), ("b", 31, 0), ("z", 600, 1)]
    got = _streamed(spark, _minutes(spark, rows), lambda s, f: jobs.stream_sessions(s, f, late="0 seconds"))
    assert sorted((r.session_id, r.n_accesses, r.outcome) for r in got.collect()) == [("a", 2, "closed"), ("b", 1, "closed"), ("b", 1, "closed")]


def test_streams_leave_the_session_as_it_was(spark):
    before = spark.conf.get(jobs.STATE_STORE, None)
    df = spark.createDataFrame([("s", 1, 1, 0)], "session_id string, arrival bigint, step_number int, part int")
    assert _streamed(spark, df, jobs.stream_steps).first().accepted and spark.conf.get(jobs.STATE_STORE, None) == before


@pytest.fixture
def one_bucket(monkeypatch):
    """All keys in one bucket: a processor is called once per micro-batch, not once per key."""
    monkeypatch.setattr(keyed, "BUCKETS", 1)


def test_keys_of_a_bucket_are_followed_apart(spark, one_bucket):
    rng = random.Random(9)
    keys = [None, "", "=", "a", "b"]
    rows = [(rng.choice(keys), START + timedelta(minutes=i), i, rng.choice(["A", "B", "", None]), i // 50) for i in range(150)]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp_ntz, n int, content_hash string, part int")
    got = _streamed(spark, df, lambda s, f: jobs.stream_frames(s, f, order=("n",)))
    want = S.unchanged_frames(df, order=("n",)).drop("part")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert got.count() == 150


def test_requests_of_a_bucket_expire_by_key(spark, one_bucket):
    rng, at, rows = random.Random(10), 0, []
    for i in range(300):
        at += rng.choice([0, 1, 4_000_000, 70_000_000 if i % 40 == 0 else 5])
        rows.append((rng.choice(["a", "b", None]), at, i, i // 75))
    df = spark.createDataFrame(rows, "client string, at_us bigint, n int, part int")
    got = _streamed(spark, df, lambda s, f: jobs.stream_rate_limit(s, "client", "at_us", f, order=("n",), late="1 second"))
    want, _ = S.rate_limit(df.drop("part"), "client", "at_us", order=("n",))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_sessions_of_a_bucket_close_by_key(spark, one_bucket):
    """A bucket's timer closes what has expired of each session; the rest stays open and goes on in later parts."""
    rows = [(7, 0, 0), (7, 100, 0), (None, 90, 0), (8, 5, 0), (7, 120, 1), (None, 200, 1), (8, 110, 1), (8, 3, 1), (9, 900, 2)]
    df = _minutes(spark, []).withColumn("session_id", F.col("session_id").cast("bigint")).unionByName(
        spark.createDataFrame([(k, START + timedelta(minutes=m), p) for k, m, p in rows], "session_id bigint, ts timestamp, part int"))
    got = _streamed(spark, df, lambda s, f: jobs.stream_sessions(s, f, late="10 minutes"))
    assert dict(got.dtypes)["session_id"] == "bigint"
    assert sorted(((r.session_id or 0), r.n_accesses, r.outcome) for r in got.collect()) == [
        (0, 1, "closed"), (0, 1, "closed"), (7, 1, "closed"), (7, 2, "closed"), (8, 1, "closed"), (8, 1, "closed"), (8, 1, "late")]


def test_fold_keeps_states_of_quiet_keys(spark):
    df = spark.createDataFrame([("a", 0, 1)], "session_id string, arrival bigint, step_number int")
    _, first = S.step_acceptance(df)
    _, second = S.step_acceptance(df.withColumn("session_id", F.lit("b")), initial=first)
    assert {r.session_id for r in second.collect()} == {"a", "b"}


def test_fold_accepts_an_empty_input(spark):
    df = spark.createDataFrame([], "session_id string, b bigint, step_number int")
    rows, state = fold_by_bucket(df, ["session_id"], "b", ["b"], ["step_number"], folds.StepSequence(), S.STEP_OUTPUT)
    assert rows.count() == 0 and state.count() == 0
