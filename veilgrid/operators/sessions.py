"""Session logs: sequences, limits, expiry, concurrency, outcomes and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import values as V
from veilgrid.operators import folds
from veilgrid.operators.ordered import fold_by_bucket, lag_by_bucket, running_sum, running_sum_by_bucket

STEP_OUTPUT = "accepted boolean, expected_step int, continuity_break boolean"
RATE_OUTPUT = "window_start bigint, request_no bigint, allowed boolean"
BINDING_OUTPUT = "verdict string"


def slice_of(ts: str, unit: str = "hour") -> Column:
    """Time bucket for ordered operators: narrow enough that the busiest key's slice fits a task.

    ``ordered.widest_bucket`` measures which unit does; sparse logs run better on a wide one.
    """
    return F.date_trunc(unit, F.col(ts))


def slice_number(ts: str, unit: str = "hour") -> Column:
    """The same slices as whole numbers, by the calendar of the session's time zone."""
    day = F.datediff(F.col(ts), F.lit("1970-01-01"))
    hour, minute = day * 24 + F.hour(ts), (day * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return {"day": day, "hour": hour, "minute": minute}[unit].cast("long")


def step_acceptance(
    steps: DataFrame, arrival: str = "arrival", block: int = 200_000, initial: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Verdict per arriving step, and the last accepted step of each session as state."""
    rows = steps.withColumn("_bucket", F.floor(F.col(arrival) / block).cast("bigint"))
    out, state = fold_by_bucket(
        rows, ["session_id"], "_bucket", [arrival], ["step_number"], folds.StepSequence(), STEP_OUTPUT, initial)
    return out.drop("_bucket"), state


def rate_limit(
    requests: DataFrame, key: str, time: str, order: tuple[str, ...] = (), limit: int = V.RATE_LIMIT,
    window: int = V.RATE_WINDOW_SECONDS * 1_000_000, slice_width: int = 600_000_000,
    initial: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verdict per request; ``time`` is in whole microseconds and so are the widths."""
    rows = requests.withColumn("_bucket", F.floor(F.col(time) / slice_width).cast("bigint"))
    out, state = fold_by_bucket(
        rows, [key], "_bucket", [time, *order], [time], folds.FixedWindowRate(limit, window), RATE_OUTPUT, initial)
    return out.drop("_bucket"), state


def aligned_rate_limit(requests: DataFrame, key: str, ts: str, limit: int = V.RATE_LIMIT) -> DataFrame:
    """Approximate limit on clock-aligned windows: one partial aggregation, no order."""
    return requests.groupBy(key, F.window(ts, f"{V.RATE_WINDOW_SECONDS} seconds").alias("_w")).agg(
        F.count("*").alias("n_requests")
    ).select(key, F.col("_w.start").alias("window_start"), "n_requests",
             F.greatest(F.col("n_requests") - limit, F.lit(0)).alias("n_over"))


def context_binding(
    messages: DataFrame, ts: str = "ts", order: tuple[str, ...] = (), unit: str = "hour"
) -> DataFrame:
    """Verdict per message: session_id, event (send, end, tab_closed), tab_id, frame_id."""
    rows = messages.withColumn("_bucket", slice_number(ts, unit))
    out, _ = fold_by_bucket(
        rows, ["session_id"], "_bucket", [ts, *order], ["event", "tab_id", "frame_id"], folds.ContextBinding(),
        BINDING_OUTPUT)
    return out.drop("_bucket")


def unchanged_frames(frames: DataFrame, ts: str = "ts", order: tuple[str, ...] = (), unit: str = "hour") -> DataFrame:
    """``skipped``: the content hash is that of the session's previous frame and not blank."""
    rows = frames.withColumn("_bucket", slice_of(ts, unit))
    lagged = lag_by_bucket(rows, ["session_id"], "_bucket", [ts, *order], ["content_hash"], "_prev")
    return lagged.withColumn(
        "skipped", F.expr("coalesce(content_hash <> '' and _prev.content_hash = content_hash, false)")
    ).drop("_prev", "_bucket")


def expiry_epochs(
    accesses: DataFrame, ts: str = "ts", order: tuple[str, ...] = (), ttl: int = V.SESSION_TTL_SECONDS,
    unit: str = "hour",
) -> DataFrame:
    """``vault_epoch`` per access: an idle gap over the TTL starts the next one."""
    rows = accesses.withColumn("_bucket", slice_of(ts, unit))
    lagged = lag_by_bucket(rows, ["session_id"], "_bucket", [ts, *order], [ts], "_prev")
    starts = lagged.withColumn("_new", F.expr(
        f"cast(_prev is null or {ts} - _prev.{ts} > interval {ttl} seconds as int)"))
    return running_sum_by_bucket(
        starts, ["session_id"], "_bucket", [ts, *order], "_new", "vault_epoch").drop("_prev", "_new", "_bucket")


def expired_sessions(accesses: DataFrame, now: Column, ts: str = "ts", ttl: int = V.SESSION_TTL_SECONDS) -> DataFrame:
    """Last access per session as of ``now`` and whether its vault has expired."""
    last = accesses.where(F.col(ts) <= now).groupBy("session_id").agg(F.max(ts).alias("last_access"))
    return last.withColumn("expired", now - F.col("last_access") > F.expr(f"interval {ttl} seconds"))


def active_sessions(accesses: DataFrame, now: Column, ts: str = "ts", warn_at: int = V.SESSION_WARNING) -> DataFrame:
    """One row: live sessions as of ``now``, and whether the next one would raise the warning."""
    live = expired_sessions(accesses, now, ts).where("not expired")
    return live.agg(F.count("*").alias("n_active")).withColumn("warn", F.col("n_active") >= warn_at)


def concurrency(
    epochs: DataFrame, ts: str = "ts", ttl: int = V.SESSION_TTL_SECONDS, warn_at: int = V.SESSION_WARNING,
) -> DataFrame:
    """Live vaults after every opening and closing; a vault closes once its TTL has passed.

    The sweep over time runs in ranges of it, see ``ordered.running_sum``; sessions that all change in one minute are
    as many ranges as others.
    """
    spans = epochs.groupBy("session_id", "vault_epoch").agg(F.min(ts).alias("opened"), F.max(ts).alias("last"))
    changes = spans.select("session_id", "vault_epoch", F.inline(F.array(
        F.struct(F.col("opened").alias("changed_at"), F.lit(0).alias("side"), F.lit(1).alias("change")),
        F.struct((F.col("last") + F.expr(f"interval {ttl} seconds")).alias("changed_at"), F.lit(1).alias("side"), F.lit(-1).alias("change")),
    )))
    total = running_sum(changes, ["changed_at", "side", "session_id", "vault_epoch"], "change", "active")
    return total.withColumn("over_limit", F.expr(f"change = 1 and active > {warn_at}")).drop("side")


def server_steps(attempts: DataFrame, ts: str = "ts", order: tuple[str, ...] = (), unit: str = "hour") -> DataFrame:
    """``request_step`` of each attempt: successful calls of the session so far plus one."""
    rows = attempts.withColumn("_bucket", slice_of(ts, unit)).withColumn("_ok", F.expr("cast(succeeded as int)"))
    counted = running_sum_by_bucket(rows, ["session_id"], "_bucket", [ts, *order], "_ok", "_done")
    return counted.withColumn("request_step", F.col("_done") - F.col("_ok") + 1).drop("_bucket", "_ok", "_done")


def previous_errors(attempts: DataFrame, ts: str = "ts", order: tuple[str, ...] = (), unit: str = "hour") -> DataFrame:
    """``last_action_error``: error of the attempt before, null after a success."""
    rows = attempts.withColumn("_bucket", slice_of(ts, unit))
    rows = rows.withColumn("_error", F.expr("if(succeeded, null, error)"))
    lagged = lag_by_bucket(rows, ["session_id"], "_bucket", [ts, *order], ["_error"], "_prev")
    return lagged.withColumn("last_action_error", F.col("_prev._error")).drop("_prev", "_bucket", "_error")


def task_limits(attempts: DataFrame, max_retries: int = V.MAX_RETRIES, max_steps: int = V.MAX_STEPS) -> DataFrame:
    """Outcome per session by the limit that it reached first: a step that failed too often, or the number of steps.

    A task ends there: ``n_steps`` counts up to that step, and a failure after the last allowed step does not count.
    """
    steps = attempts.groupBy("session_id", "step_number").agg(
        F.sum(F.expr("cast(not succeeded as int)")).alias("n_failed"))
    failed = steps.where(F.col("n_failed") >= max_retries).groupBy("session_id").agg(F.min("step_number").alias("_failed"))
    upto = steps.join(failed, "session_id", "left").groupBy("session_id").agg(
        F.first("_failed").alias("_failed"),
        F.count(F.when(F.col("_failed").isNull() | (F.col("step_number") <= F.col("_failed")), 1)).alias("_upto"))
    counts = upto.withColumn("failed_step", F.expr(f"if(_upto <= {max_steps}, _failed, null)")).withColumn(
        "n_steps", F.least("_upto", F.lit(max_steps)))
    return counts.withColumn("outcome", F.expr(
        f"case when failed_step is not null then 'max_retries_exceeded'"
        f" when n_steps >= {max_steps} then 'max_steps_exceeded' end")).drop("_failed", "_upto")


def outcomes(ends: DataFrame, ts: str = "ts") -> DataFrame:
    """Sessions per end reason; a session counts once, with its last reason."""
    last = ends.groupBy("session_id").agg(F.max_by("reason", ts).alias("reason"))
    return last.groupBy("reason").agg(F.count("*").alias("n_sessions"))


def audit_gaps(requests: DataFrame, audit: DataFrame) -> DataFrame:
    """Requests without exactly one audit event, and audit events without a request."""
    asked = requests.groupBy("session_id", "step_number").agg(F.count("*").alias("n_requests"))
    logged = audit.groupBy("session_id", "step_number").agg(F.count("*").alias("n_events"))
    both = asked.join(logged, ["session_id", "step_number"], "full_outer").fillna(0, ["n_requests", "n_events"])
    return both.where("n_requests <> n_events")


def session_history(steps: DataFrame, order: str = "step_number", block: int = 1000) -> DataFrame:
    """History text of each session from its accepted steps, put together block by block.

    Lines meet in blocks of consecutive steps first, so a very long session is written by
    many tasks and only its finished blocks come together.
    """
    line = F.expr(
        "concat('Step ', step_number, ': Intended to \\'', instruction, '\\'. Executed action: ', action_type,"
        " ' on ', coalesce(target_element_id, 'None'), '\\n')"
    )

    def told(rows: DataFrame, key: list, order_by: Column, text: Column, name: str) -> DataFrame:
        parts = F.transform(F.sort_array(F.collect_list(F.struct(order_by.alias("o"), text.alias("t")))), lambda s: s["t"])
        return rows.groupBy(*key).agg(F.array_join(parts, "").alias(name))

    lines = steps.where("accepted").withColumn("_block", F.floor(F.col(order) / block))
    blocks = told(lines, ["session_id", "_block"], F.col(order), line, "_part")
    texts = told(blocks, ["session_id"], F.col("_block"), F.col("_part"), "_text")
    everyone = steps.groupBy("session_id").agg(F.lit(True).alias("_any"))
    return everyone.join(texts, "session_id", "left").select(
        "session_id", F.coalesce(F.concat(F.lit(V.HISTORY_HEADER), "_text"), F.lit(V.NO_HISTORY)).alias("history"))
