"""Quality rules: fixed base rules, and thresholds that follow each language and source. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.frames import fresh, sent_if_small
from veilgrid.session import cut_lineage

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Leading bits of a value that a sketch keeps: values up to 2 ** BITS are exact, larger ones to 2 ** (1 - BITS) of them.
BITS = 6
#: Rows that a group needs for thresholds of its own; a smaller one takes its language's, then those of all.
LEAST_ROWS = 200
#: A fence lies so many times the distance between the first and the last octile beyond these.
REACH = 3
#: A count may lie so many standard deviations above the one that its fence gives for the text's length.
DEVIATIONS = 3


@dataclass(frozen=True)
class Metric:
    """A whole-number rate. ``count`` out of ``base`` per mille, where ``event`` of the count arise at once; or any ``value``.

    Octiles of a rate are those over rows, or over ``mass``.
    """

    name: str
    value: str
    count: str | None = None
    base: str | None = None
    event: int = 1
    mass: str = "1"


#: A window found a second time makes ten words of repeats. Repeats become likelier with the text's length, so octiles of their rate are those over words.
METRICS = (
    Metric("symbol_rate", "1000 * n_symbols DIV greatest(word_chars, 1)", "n_symbols", "word_chars"),
    Metric("word_length", "100 * word_chars DIV greatest(n_words, 1)"),
    Metric("dup_line_rate", "1000 * n_dup_lines DIV greatest(n_words, 1)", "n_dup_lines", "n_words"),
    Metric("repeat_rate", "1000 * n_repeat_words DIV greatest(n_words, 1)", "n_repeat_words", "n_words", 10, "n_words"),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column, length: int) -> Column:
    """Places that windows found twice or more cover. ``windows``: a hash for each place."""

    def twice(z: Column) -> Column:
        value = lambda k: F.get(z, k)["h"]
        same = lambda k: value(k).eqNullSafe(value(k - 1)) | value(k).eqNullSafe(value(k + 1))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(z) - 1), same), lambda k: F.get(z, k)["i"]))

    def total(at: Column) -> Column:
        reach = F.transform(at, lambda p, k: F.least(F.lit(length), F.coalesce(F.get(at, k + 1) - p, F.lit(length))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(placed, twice), total)


def measured(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with the five measures, all bigint; existing columns of these names are replaced.

    Words are runs without white space. ``word_chars``: their characters; ``n_symbols``: characters of ``#*$%&|<>``;
    ``n_dup_lines``: lines with a word that equal an earlier one; ``n_repeat_words``: words in windows of ``window``
    words that the text holds twice or more. A null or empty text has 0 of each. Windows are compared by 64-bit hashes.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in MEASURES and c.lower() != text.lower()])
    words, hashes, windows = fresh(docs, "words", "hashes", "windows")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    out = docs.withColumn(words, F.array_remove(F.split(body, r"[ \t-\r]+", -1), ""))
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.length(body) - F.length(F.regexp_replace(body, r"[^ \t-\r]+", ""))).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        hashes: F.transform(words, lambda w: F.xxhash64(w)),
    })
    out = out.withColumn(windows, F.transform(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (window - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(F.col(hashes), i + k) for k in range(1, window)]),
    ))
    repeats = F.when(F.size(F.array_distinct(windows)) < F.size(windows), _covered(F.col(windows), window)).otherwise(0)
    return out.withColumn("n_repeat_words", repeats.cast("long")).select(*docs.columns, *MEASURES)


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def sketches(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """``lang``, ``source``, ``metric``, ``bin``, ``n``, ``mass``: counts and masses of values cut to their leading bits.

    Such a sketch is a table of sums; sketches of parts merge by adding. It has some hundred bins at most,
    however many rows it stands for, and they are combined before the shuffle.
    """
    value = lambda m: F.struct(F.lit(m.name).alias("metric"), F.expr(m.value).cast("long").alias("x"), F.expr(m.mass).cast("long").alias("mass"))
    one = F.explode(F.array(*[value(m) for m in METRICS]))
    values = rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), one.alias("v")).select("lang", "source", "v.*")
    low = F.greatest(F.length(F.bin("x")) - BITS, F.lit(0))
    values = values.withColumn("bin", F.call_function("shiftleft", F.call_function("shiftright", F.col("x"), low), low))
    return values.groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))


def _octiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    group = Window.partitionBy(*keys, "metric")
    run = merged.withColumns({"whole": F.sum("mass").over(group), "upto": F.sum("mass").over(group.orderBy("bin"))})
    first = lambda share: F.min(F.when(F.col("upto") * 8 >= F.col("whole") * share, F.col("bin")))
    return run.groupBy(*keys, "metric").agg(F.sum("n").alias("total"), first(1).alias("e1"), first(7).alias("e7"))


def fences(sketch: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``lang``, ``source`` and ``<metric>_low``, ``<metric>_high`` of every group of the sketch.

    Sketches of small groups are merged up: a group of fewer than ``least_rows`` rows takes the octiles of its
    language, or, if these have too few, of all rows.
    """
    group = sketch.select("lang", "source").distinct()
    enough = F.col("total") >= least_rows
    octiles = F.struct("e1", "e7")
    whole = _octiles(sketch, []).select("metric", octiles.alias("all"))
    by_lang = _octiles(sketch, ["lang"]).where(enough).select(F.col("lang").alias("l1"), F.col("metric").alias("m1"), octiles.alias("by_lang"))
    own = _octiles(sketch, ["lang", "source"]).where(enough).select(F.col("lang").alias("l2"), F.col("source").alias("s2"), F.col("metric").alias("m2"), octiles.alias("own"))
    metrics = F.explode(F.array(*[F.lit(m.name) for m in METRICS])).alias("metric")
    found = (
        group.select("*", metrics).join(whole, "metric")
        .join(by_lang, F.col("lang").eqNullSafe(F.col("l1")) & (F.col("metric") == F.col("m1")), "left")
        .join(own, F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2")) & (F.col("metric") == F.col("m2")), "left")
        .select("lang", "source", "metric", F.coalesce("own", "by_lang", "all").alias("q"))
    )
    columns = []
    for m in METRICS:
        reach = REACH * (F.col("q.e7") - F.col("q.e1"))
        is_it = F.col("metric") == m.name
        columns += [F.max(F.when(is_it, F.col("q.e1") - reach)).alias(f"{m.name}_low"), F.max(F.when(is_it, F.col("q.e7") + reach)).alias(f"{m.name}_high")]
    return found.groupBy("lang", "source").agg(*columns)


def _inside(m: Metric, low: Column, high: Column) -> Column:
    """A value lies between its fences; a count, not above what the upper one gives for the text but by chance.

    The square root of a count of events of mean ``x`` has a standard deviation of 1/2 about ``sqrt(x)``, whatever
    ``x`` is, so the bound in events is ``(sqrt(x) + DEVIATIONS / 2) ** 2``; both sides are multiplied by 1,000 events.
    """
    if m.count is None:
        return F.expr(m.value).between(low, high)
    given = high * F.col(m.base)
    chance = DEVIATIONS * F.sqrt((given * (1000 * m.event)).cast("double")) + DEVIATIONS ** 2 * 250 * m.event
    return 1000 * F.col(m.count) - given <= chance


def judged(rows: DataFrame, *, lang: str = "lang", source: str = "source", least_rows: int = LEAST_ROWS) -> DataFrame:
    """``rows`` (of ``measured``) with ``base_failed`` and ``kept``.

    Octiles of four rates come from quantile sketches of the rows that pass the base rules, per language and source.
    Fences lie ``REACH`` times the distance of the two octiles outside them; no range is fixed. A row is kept if it
    passes the base rules, its word length lies between both fences, and its symbols, repeated lines and repeated words
    are not above their upper fence by more than chance allows in a text of its length (``_inside``), which alone
    decides where both octiles are 0. Null languages and sources are groups of their own. Groups of which no row passes
    the base rules keep none. ``rows`` is read twice; cut its lineage before.
    """
    names = {c.lower() for c in rows.columns} & {"base_failed", "kept"}
    rows = rows.drop(*[c for c in rows.columns if c.lower() in names])
    limits = fences(sketches(rows.where(~base_failed()), lang, source), least_rows)
    mark = fresh(rows, *limits.columns)
    limits = sent_if_small(limits.toDF(*mark), "fences")  # a row for each language and source: rows stay where they are
    fence = dict(zip([c for m in METRICS for c in (f"{m.name}_low", f"{m.name}_high")], mark[2:], strict=True))
    joined = rows.join(limits, rows[lang].eqNullSafe(limits[mark[0]]) & rows[source].eqNullSafe(limits[mark[1]]), "left")
    inside = ~base_failed()
    for m in METRICS:
        inside = inside & _inside(m, F.col(fence[f"{m.name}_low"]), F.col(fence[f"{m.name}_high"]))
    return joined.select(*[rows[c] for c in rows.columns], base_failed().alias("base_failed"), F.coalesce(inside, F.lit(False)).alias("kept"))


def quality_filter(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_rows: int = LEAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, same columns; columns that have the names of measures stay as they are."""
    clash = {c: f"kept_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in (*MEASURES, "base_failed", "kept")}
    renamed = docs.withColumnsRenamed(clash)
    at = lambda c: clash.get(c, c)
    rows = cut_lineage(measured(renamed, at(text)), "measured")
    return judged(rows, lang=at(lang), source=at(source), least_rows=least_rows).where("kept").select(*renamed.columns).toDF(*docs.columns)
