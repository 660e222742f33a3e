"""Structured Streaming jobs that give the same rows as the batch operators.

Row-wise work is a plain stream. Ordered state per key is a processor of ``keyed`` on the engine's own state store, with its
timers and expiry; a restarted job goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from veilgrid.functions import values as V
from veilgrid.operators.text import redact_text
from veilgrid.streaming import keyed

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(writer, once: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_redaction(texts: DataFrame, key: str, folder: str, once: bool = True) -> StreamingQuery:
    """Redact texts as they arrive; clean and held rows go to folders ``outcome=clean`` and ``outcome=held``."""
    rows = redact_text(texts, key).drop("text").withColumn("outcome", F.expr("if(residual = 0, 'clean', 'held')"))
    writer = rows.writeStream.format("parquet").partitionBy("outcome").option(
        "checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows")
    return _start(writer, once)


def stream_audit(records: DataFrame, folder: str, once: bool = True) -> StreamingQuery:
    """Append audit records as JSON lines."""
    writer = records.writeStream.format("json").outputMode("append").option(
        "checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows")
    return _start(writer, once)


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The store that keyed state needs, for queries that start within; the session's own setting is left as it was."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def _key_text(rows: DataFrame, key: str) -> Column:
    """The key as text that a null and other values do not share; states are kept by it."""
    text = F.hex(key) if isinstance(rows.schema[key].dataType, T.BinaryType) else F.col(key).cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit(""))


def _key_value(kind: T.DataType) -> Column:
    """The key of ``kind`` (no array, map or struct) that ``_key_text`` was made from."""
    text = F.expr(f"if({keyed.KEY} = '', null, substr({keyed.KEY}, 2))")
    return F.unhex(text) if isinstance(kind, T.BinaryType) else text.cast(kind)


def _keyed(rows: DataFrame, processor: StatefulProcessor, schema: T.StructType | str, mode: str) -> DataFrame:
    dealt = rows.withColumn(keyed.BUCKET, F.pmod(F.xxhash64(keyed.KEY), F.lit(keyed.BUCKETS)))
    return dealt.groupBy(keyed.BUCKET).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def _written(out: DataFrame, folder: str, once: bool, split: str | None = None) -> StreamingQuery:
    writer = out.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows")
    with _state_store(out.sparkSession):
        return _start(writer.partitionBy(split) if split else writer, once)


def _ordered(rows: DataFrame, key: str, order: list[str], processor: keyed.Ordered, added: str, mode: str) -> DataFrame:
    """``rows`` with the columns that ``processor`` adds; it reads copies of the columns that it works on.

    Whole numbers go through pandas as text, since a null among them would make them floating. Nulls come first in order.
    """
    exact = {f.name: f.dataType for f in rows.schema if isinstance(f.dataType, (T.IntegralType, T.BooleanType, T.DecimalType))}
    own = {f.name: keyed.OWN.format(i) for i, f in enumerate(rows.schema)}
    passed = [(F.col(c).cast("string") if c in exact else F.col(c)).alias(n) for c, n in own.items()]
    first = F.lit(-(1 << 63)).cast("long")
    sorted_by = [F.coalesce(F.col(c).cast("long"), first) if isinstance(rows.schema[c].dataType, T.IntegralType) else F.col(c) for c in order]
    work = [_key_text(rows, key).alias(keyed.KEY), *[F.col(c).alias(n) for c, n in processor.reads.items()]]
    given = rows.select(*passed, *work, *[c.alias(n) for c, n in zip(sorted_by, processor.order, strict=True)])
    schema = T.StructType([
        *(T.StructField(n, T.StringType() if c in exact else rows.schema[c].dataType) for c, n in own.items()), *T._parse_datatype_string(added).fields])
    out = _keyed(given, processor, schema, mode)
    return out.select(*[F.col(n).cast(rows.schema[c].dataType).alias(c) for c, n in own.items()], *processor.added)


def stream_rate_limit(
    requests: DataFrame, key: str, time: str, folder: str, once: bool = True, *, order: tuple[str, ...] = (),
    limit: int = V.RATE_LIMIT, window: int = keyed.DEFAULT_WINDOW, late: str | None = None,
) -> StreamingQuery:
    """Verdict per request, as ``sessions.rate_limit``; ``time`` is in whole microseconds.

    ``late`` says how far a request may lie behind the newest one; then states of quiet keys expire with their window.
    """
    processor = keyed.RateLimit(1 + len(order), limit, window, expires=late is not None)
    rows = requests if late is None else _watched(requests, F.timestamp_micros(time), late)
    out = _ordered(rows, key, [time, *order], processor, "window_start bigint, request_no bigint, allowed boolean", "None" if late is None else "EventTime")
    return _written(out, folder, once)


def _timed(forget: int | None) -> str:
    return "None" if forget is None else "ProcessingTime"


def _watched(rows: DataFrame, at: F.Column, late: str) -> DataFrame:
    """``rows`` under a watermark on ``at`` that the engine drops no rows by: the column itself does not go on."""
    return rows.withColumn("_at", at).withWatermark("_at", late).drop("_at")


def stream_steps(
    steps: DataFrame, folder: str, once: bool = True, *, arrival: str = "arrival", forget: int | None = None,
) -> StreamingQuery:
    """Verdict per arriving step, as ``sessions.step_acceptance``. ``forget``: milliseconds after which a quiet session is forgotten."""
    processor = keyed.Steps(1, "step_number", forget)
    out = _ordered(steps, "session_id", [arrival], processor, "accepted boolean, expected_step int, continuity_break boolean", _timed(forget))
    return _written(out, folder, once)


def stream_frames(
    frames: DataFrame, folder: str, ts: str = "ts", order: tuple[str, ...] = (), once: bool = True, *, forget: int | None = None,
) -> StreamingQuery:
    """``skipped`` per frame; a frame is compared with the one before it, whatever its epoch. ``forget`` as in ``stream_steps``."""
    processor = keyed.Frames(1 + len(order), "content_hash", forget)
    return _written(_ordered(frames, "session_id", [ts, *order], processor, "skipped boolean", _timed(forget)), folder, once)


def stream_sessions(
    accesses: DataFrame, folder: str, late: str, ts: str = "ts", ttl: int = V.SESSION_TTL_SECONDS, once: bool = True,
) -> StreamingQuery:
    """Vault lifetimes as they expire, and accesses that came too late: session_id, opened, last_access, n_accesses, outcome.

    A lifetime (``outcome=closed``) is written once the watermark has passed its TTL; open ones stay in state. ``late`` says how
    far an access may lie behind the newest one. One that lies further behind is written by itself (``outcome=late``), so
    no access is lost. Times are whole microseconds since 1970.
    """
    kind = accesses.schema["session_id"].dataType
    spans = ["opened", "last_access", "n_accesses"]
    schema = f"{keyed.KEY} string, {', '.join(f'{c} bigint' for c in spans)}, outcome string"
    timed = accesses.select(_key_text(accesses, "session_id").alias(keyed.KEY), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    lives = _keyed(_watched(timed, F.timestamp_micros("at"), late), keyed.Lives("at", ttl * 1_000_000), schema, "EventTime")
    return _written(lives.select(_key_value(kind).alias("session_id"), *spans, "outcome"), folder, once, split="outcome")
