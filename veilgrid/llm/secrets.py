"""Secret scans: candidate strings, and a random forest that removes false positives. DataFrame and ML functions only."""

from __future__ import annotations

import json
import random
import string

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.session import cut_lineage

#: A candidate is a run of these characters, so long at least.
LEAST_CHARS = 16
_RUN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Characters that are looked at on each side of a run, and of a neighbouring word.
SIDE = 64
#: Most labelled findings that train the forest, the first in the order of a hash.
TRAINED_ROWS = 20_000
#: Letter pairs that make the dictionary: the most frequent ones of words, in place of words. Large alphabets have more.
DICTIONARY_PAIRS = 1024
FEATURES = (
    "length", "transitions", "transition_rate", "digits", "uppers", "hex_rate", "distinct_rate", "coverage", "in_path", "keyword_before",
    "assigned", "quoted", "word_before_chars", "word_after_chars",
)
_KEYWORDS = "key|token|secret|password|passwd|pwd|auth|bearer|credential|apikey|access"


def _runs_in(text: Column) -> Column:
    """Words of the text that hold a run, with the words before and after: one struct each, in order."""
    words = F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[ \t-\r]+", -1), "")
    near = F.arrays_zip(
        words.alias("word"),
        F.concat(F.array(F.lit("")), words).alias("one"), F.concat(F.array(F.lit(""), F.lit("")), words).alias("two"),
        F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("after"),
        F.sequence(F.lit(0), F.size(words)).alias("at"),
    )
    return F.filter(near, lambda x: (F.length(x["word"]) >= LEAST_CHARS) & x["word"].rlike(_RUN))


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``doc_id``, ``word_at``, ``nth``, ``value``, ``path`` and the surroundings of every run of ``LEAST_CHARS`` or more.

    ``word_at`` counts the text's words from 0, ``nth`` the runs of that word. Whole texts are read; null and empty ones
    have no candidates. Repeated rows give their candidates again.

    ``lead`` and ``tail`` are what stands around the run in its word: the gap and the run next to it, ``SIDE`` characters at
    most; a shortened ``lead`` starts with a blank. Neighbouring words (``one``, ``two`` before, ``after``) are as short. So a
    word of very many runs takes time in proportion to its length.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).cast("string").alias("path"), F.explode(_runs_in(F.col(text))).alias("x"))
    near = lambda c, cut: cut(F.coalesce(F.col(c), F.lit("")), F.lit(SIDE)).alias(c.removeprefix("x."))
    parted = words.select(
        "doc_id", F.col("x.at").cast("long").alias("word_at"), "path", near("x.one", F.right), near("x.two", F.right), near("x.after", F.left),
        F.regexp_extract_all(F.col("x.word"), F.lit(f"({_RUN})"), F.lit(1)).alias("runs"), F.split(F.col("x.word"), _RUN, -1).alias("gaps"))

    def placed(i: Column) -> Column:
        run = lambda k: F.coalesce(F.get("runs", k), F.lit(""))
        before, behind = F.concat(run(i - 1), F.get("gaps", i)), F.concat(F.get("gaps", i + 1), run(i + 1))
        shortened = (i > 1) | (F.length(before) > SIDE)
        lead = F.when(shortened, F.concat(F.lit(" "), F.right(before, F.lit(SIDE)))).otherwise(before)
        return F.struct(i.alias("nth"), run(i).alias("value"), lead.alias("lead"), F.left(behind, F.lit(SIDE)).alias("tail"))

    found = parted.select("*", F.inline(F.transform(F.sequence(F.lit(0), F.size("runs") - 1), placed)))
    return found.select("doc_id", "word_at", "nth", "value", "path", "lead", "tail", "one", "two", "after")


def letter_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``pair`` and ``n``: neighbouring letters within words of all texts, the ``DICTIONARY_PAIRS`` most frequent.

    Words with digits or of ``LEAST_CHARS`` or more do not count. Words are combined before pairs are cut, pairs
    before they are sorted.
    """
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")).alias("word"))
    counted = words.where((F.length("word") > 1) & (F.length("word") < LEAST_CHARS) & ~F.col("word").rlike(r"\p{N}")).groupBy("word").agg(F.count("*").alias("n"))
    pairs = counted.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"))
    return pairs.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(DICTIONARY_PAIRS)


def _classes(value: Column) -> Column:
    """The value with each character replaced by its class: d, u, l or s."""
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return F.translate(value, upper + lower + digit + "+/_-=", "U" * 26 + "L" * 26 + "D" * 10 + "S" * 5)


def featured(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``found`` (of ``candidates``) with the columns of ``FEATURES``, all double.

    ``transitions``: changes between upper case, lower case, digits and signs. ``coverage``: share of the value's
    letter pairs that the dictionary holds. ``in_path``: parts between slashes look like a path or address. Different
    values are measured once, in a table of their own.
    """
    values = found.select("value").distinct()
    letters = F.split(F.lower("value"), "")
    cut = F.explode(F.zip_with(F.slice(letters, F.lit(1), F.size(letters) - 1), F.slice(letters, F.lit(2), F.size(letters) - 1), lambda a, b: F.concat(a, b)))
    known = F.broadcast(pairs.select("pair", F.lit(1).alias("known")))  # DICTIONARY_PAIRS rows
    coverage = values.select("value", cut.alias("pair")).join(known, "pair", "left").groupBy("value").agg(F.avg(F.coalesce("known", F.lit(0))).alias("coverage"))
    n = F.length("value")
    classes = _classes(F.col("value"))
    changes = F.length(F.regexp_replace(classes, "(.)\\1+", "$1")) - 1
    count = lambda pattern: n - F.length(F.regexp_replace("value", pattern, ""))
    # a word's own keyword counts as well as one or two words before it, for signs may stand between
    context = F.lower(F.concat_ws(" ", "two", "one", "lead"))
    columns = {
        "length": n, "transitions": changes, "transition_rate": changes / n, "digits": count("[0-9]") / n, "uppers": count("[A-Z]") / n,
        "hex_rate": count("[0-9a-f]") / n, "distinct_rate": F.size(F.array_distinct(F.split("value", ""))) / n, "coverage": F.col("coverage"),
        "in_path": F.concat("lead", "value", "tail").rlike("://|^/|/.*/"), "keyword_before": context.rlike(_KEYWORDS),
        "assigned": F.concat("one", "lead").rlike("[=:]"), "quoted": F.col("lead").rlike("[\"'`]$") & F.col("tail").rlike("^[\"'`]"),
        "word_before_chars": F.length("one"), "word_after_chars": F.length("after"),
    }
    return found.join(coverage, "value").select("*", *[c.cast("double").alias(k) for k, c in columns.items() if k != "coverage"])


def train(labelled: DataFrame, *, given: DataFrame | None = None, trees: int = 20, depth: int = 6, rows: int = TRAINED_ROWS, seed: int = 11) -> PipelineModel:
    """A random forest on ``FEATURES`` and ``label`` (1: a secret, 0: a false positive); rows of ``given`` train it as well.

    At most ``rows`` labelled findings train it, the first in the order of a hash of value and surroundings, so that
    the same findings train it however they are partitioned. Rows with a null label or feature do not.
    """
    order = F.xxhash64(F.lit(seed), "value", "lead", "one", "two")
    sample = labelled.dropna(subset=["label", *FEATURES]).orderBy(order, "value", "doc_id", "word_at", "nth").limit(rows)
    columns = [*FEATURES, F.col("label").cast("double").alias("label")]
    sample = sample.select(*columns)
    if given is not None:
        sample = sample.unionByName(given.orderBy("doc_id", "word_at", "nth").select(*columns))
    sample = cut_lineage(sample.coalesce(1), "labelled")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="sqrt")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    return PipelineModel([vectors, forest.fit(vectors.transform(sample))])


def scored(found: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """``found`` with ``score``, the forest's probability of a secret, and ``secret``."""
    out = model.transform(found).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return out.select(*found.columns, F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("secret"))


#: Documented formats of keys: a value of this form is a secret wherever it stands.
_FORMATS = (
    r"^(?:(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_\-]{32,}|AIza[A-Za-z0-9_\-]{35}"
    r"|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{64}|pypi-[A-Za-z0-9_\-]{50,}|eyJ[A-Za-z0-9_\-]{17,})={0,2}$"
)
_CREDENTIAL = r"(?<![a-z])(?:(?:api|access|auth|private|secret|signing|app|client)[_-]?(?:key|token|secret)|token|secret|passw(?:or)?d|pwd|passphrase|bearer|credentials?|apikey|key)s?(?![a-z])"
_HASH = r"(?<![a-z])(?:commit|sha-?[0-9]*|md5|digest|checksum|hash|etag|rev|revision|blob|tree|parent|fingerprint|integrity|cherry-pick|merge)(?![a-z])"
_UUID = r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
#: Words and short numbers, also joined by signs or a change of case: names, slugs, paths, dates.
_NAME = r"^(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|(?<![0-9])[0-9]{1,4}+(?![0-9])|[_/+=\-])++$"
_DIGESTS = (32, 40, 56, 64, 96, 128)
#: Characters of a value that its evidence reads; documented keys are shorter, but for the last part of a web token.
_READ_CHARS = 512


def _entropy(value: Column) -> Column:
    """Bits a character by the value's own counts."""
    n = F.length(value)
    count = lambda c: (n - F.length(F.replace(value, c, F.lit("")))).cast("double")
    return F.log2(n) - F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(count(c) * F.log2(count(c)))) / n


def _luhn(value: Column) -> Column:
    digit = F.transform(F.split(F.reverse(value), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(
        F.get(F.array(*[F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.try_cast("int"))))
    return value.rlike("^[0-9]{13,19}$") & (F.aggregate(digit, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0)


def evidence() -> Column:
    """1, 0 or null (unsure) for a row of ``candidates``, by what the value is; no column of ``FEATURES`` is read.

    1: a documented key format anywhere, or random letters and digits. 0: card numbers, plain names, words and paths,
    parts of addresses, ids, data, hashes that a hash's name announces, runs of few characters. A hexadecimal value
    of a digest's length is a key or a hash by the name before it alone, however that is written; unnamed it is unsure.
    """
    value = F.substring("value", 1, _READ_CHARS)
    before = F.lower(F.concat_ws(" ", "two", "one", "lead"))
    entropy = _entropy(value)
    body = F.regexp_replace(value, "=+$", "")
    hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & value.rlike("[0-9]") & value.rlike("[A-Fa-f]")
    digest = hexadecimal & F.length("value").isin(*_DIGESTS)
    address = F.col("lead").contains("://") | F.col("lead").rlike(r"^[\"'`(<]*\.{0,2}/") | value.rlike(r"^/[^+=]*/") | value.rlike(r"/.*/.*\.?[a-z]{2,}/")
    mixed = (F.length(body) >= 20) & value.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]") & (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 2)
    return (
        F.when(value.rlike(_FORMATS), 1)
        .when(_luhn(value) | (entropy < 2) | F.col("lead").contains("base64,"), 0)
        .when(before.rlike(_HASH) & hexadecimal, 0)
        .when(value.rlike(_UUID), F.when(~before.rlike(_CREDENTIAL), 0))
        .when(address, 0)
        .when(body.rlike(_NAME), 0)
        .when(digest, F.when(before.rlike(_CREDENTIAL) & (entropy >= 3), 1))
        .when(~hexadecimal & mixed & (F.length("value") <= _READ_CHARS) & (entropy >= 3.5), 1)
    )


def examples(spark: SparkSession, seed: int = 3) -> DataFrame:
    """``doc_id``, ``text``, ``source``, ``target``, ``label``: written and unwritten forms of secrets and of harmless values.

    A corpus may hold one form alone; these teach the others: keys that stand quoted, unquoted, in headers, in addresses
    and in prose, and hashes, ids, names and numbers in the same places.
    """
    r = random.Random(seed)
    draw = lambda chars, n: "".join(r.choices(chars, k=n))
    hexa, base36, base62 = "0123456789abcdef", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits
    word = lambda: r.choice(["the", "server", "then", "uses", "with", "next", "value", "for", "deploy", "it", "la", "und", "page", "config"])
    keys = [
        lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + draw(base62, 36), lambda: "sk_live_" + draw(base62, 24),
        lambda: f"xoxb-{draw(string.digits, 12)}-{draw(base62, 24)}", lambda: "AIza" + draw(base62 + "_-", 35), lambda: "eyJ" + draw(base62, 33),
        lambda: draw(base62, r.randrange(20, 48)), lambda: draw(base62 + "+/", 40), lambda: draw(base36, r.randrange(24, 40)),
    ]
    digest = lambda: draw(hexa, r.choice([32, 40, 64]))
    name = lambda: r.choice(["API_KEY", "token", "secret", "password", "access_token", "client_secret", "auth_token"])
    named = ["export {n}={v}", "{n}={v}", "{n}: {v}", "{n} = {v}", '{n} = "{v}"', "{n}='{v}'", '"{n}": "{v}",', "{n} is {v}", "Authorization: Bearer {v}", "--{n} {v}"]
    bare = ["{v}", "({v})", "{v}.", '"{v}"', "`{v}`"]
    harmless = [
        lambda: (digest(), ["commit {v}", "commit: {v}", "sha256:{v}", "md5 = {v}", 'checksum = "{v}"', '"hash": "{v}"', "https://host.org/files/{v}/x", "merge {v}", "/data/{v}/part"]),
        lambda: ("-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12)), ["id={v}", "request {v}", "https://host.org/{v}", '"id": "{v}"', "uuid: {v}"]),
        lambda: (draw(string.digits, 16), ["{v}", "card {v}", "order={v}", 'number: "{v}"']),
        lambda: (r.choice(["_", "-"]).join([word() + word() + word() for _ in range(3)]), ["{v}", "name={v}", 'key = "{v}"', "token = {v}", '"{v}"']),
        lambda: ("".join((word() + word()).capitalize() for _ in range(3)), ["{v}", "class {v}:", 'key: "{v}"', "{v}()"]),
        lambda: (r.choice(["internationalization", "responsibilities", "Verantwortlichkeiten", "desafortunadamente", "constitutionnellement"]), ["{v}", '"{v}"', "({v})", "password {v}", "key: {v}"]),
        lambda: (r.choice(["", "_"]).join([word() + word() + word(), word() + word() + word()]).upper(), ["{v}", "{v}!!", "({v})", "{v}: 5", '"{v}"']),
        lambda: ("/".join(["usr", word() + word(), word() + "er", word()]) + "/index", ["/{v}", "path=/{v}", "./{v}", "https://host.org/{v}"]),
    ]
    told = [(k(), f, 1) for k in keys for f in named + bare for _ in range(3)] + [(digest(), f, 1) for f in named for _ in range(9)]
    told += [(k(), "https://{v}@host.org/x", 1) for k in keys[:6]]
    told += [(v, f, 0) for make in harmless for _ in range(12) for v, forms in [make()] for f in forms]
    rows = []
    for i, (v, form, label) in enumerate(told):
        around = [" ".join(word() for _ in range(6)) for _ in range(2)]
        rows.append({"doc_id": i, "text": f"{around[0]} {form.format(n=name(), v=v)} {around[1]}", "source": "example", "target": v, "label": label})
    schema = "array<struct<doc_id: bigint, text: string, source: string, target: string, label: int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def taught(found: DataFrame) -> DataFrame:
    """``found`` with ``label`` of ``evidence``, for tables that come without labels.

    Two thirds of the values (by hash) are labelled, the rest has a null label and is held out.
    """
    return found.withColumn("label", F.when(F.pmod(F.xxhash64(F.lit(5), "value"), F.lit(3)) > 0, evidence()))


def secret_findings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of ``docs`` with its features, ``score`` and ``secret``.

    ``labelled``: findings (``doc_id``, ``word_at``, ``nth``, ``label``) of these documents; without it ``taught``
    labels them, and ``examples`` train the forest as well. Given labels of one kind only: findings keep that kind; given none, none is a secret.
    """
    pairs = cut_lineage(letter_pairs(docs, text), "letter-pairs")
    # values and their surroundings are two uses of one table: texts are searched once
    runs = cut_lineage(candidates(docs, doc_id=doc_id, text=text, path=path), "runs")
    found = cut_lineage(featured(runs, pairs), "candidates")
    if labelled is None:
        told = cut_lineage(examples(docs.sparkSession), "examples")
        targets = told.select("doc_id", F.col("target").alias("value"), "label")
        given = featured(candidates(told), pairs).join(F.broadcast(targets), ["doc_id", "value"])  # one row per example
        return scored(found, train(taught(found), given=given))
    labels = labelled.groupBy("doc_id", "word_at", "nth").agg(F.max("label").alias("label"))
    known = found.join(labels, ["doc_id", "word_at", "nth"])
    kinds = [r[0] for r in known.where("label IS NOT NULL").select(F.col("label").cast("int")).distinct().limit(3).collect()]
    if len(kinds) < 2:
        only = float(max(kinds, default=0))
        return found.withColumn("score", F.lit(only)).withColumn("secret", F.lit(only > 0))
    return scored(found, train(known))
