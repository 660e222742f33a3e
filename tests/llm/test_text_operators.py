"""Operators on texts against plain Python over small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.llm import decontaminate, linededup, neardup, quality, queries, tokens

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("N_WORDS", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("runs", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n_tokens", T.StringType()),
])


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def frame(spark, texts, partitions=3):
    rows = [(i, t, ("en", "de", None)[(i or 0) % 3], ("a", None)[(i or 0) % 2], "w", "s", "r", "k", "t") for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(partitions) if rows else spark.createDataFrame([], DOCS)


def prose(seed, n, vocabulary=40):
    r = random.Random(seed)
    return " ".join(r.choice(["Über", "the", "of", "x1", "señor", "Data", "#a$", "line."]) + str(r.randrange(vocabulary)) for _ in range(n))


ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (3, "One"), (4, "\n\n"), (5, "é\x0bÉ a\x0cA"), (6, "x" * 70_000), (7, "日本語 日本語")]


# --- decontamination -----------------------------------------------------------------------------------------------

def hits(text, items, window=10):
    words = TERM.findall(lower(text or ""))
    hit, found = set(), set()
    for name, item in items:
        parts = TERM.findall(lower(item or ""))
        k = min(window, len(parts))
        grams = {tuple(parts[i:i + k]) for i in range(len(parts) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add("" if name is None else str(name))
    return len(words), len(hit), sorted(found)


@pytest.fixture
def benchmark(spark):
    items = [(1, prose(1, 25)), (2, "Short item, two"), (3, None), (4, "..."), (None, "no id here at all"), (5, prose(1, 25)), (6, "日本語")]
    return spark.createDataFrame(items, "item_id bigint, text string"), items


@pytest.mark.parametrize("slice_windows", [1000, 4])
def test_benchmark_hits(spark, benchmark, slice_windows):
    table, items = benchmark
    passage = prose(1, 25)
    texts = ODD + [
        (10, f"before, {passage.upper().replace('Ü', 'ü')} after"), (11, "x short-ITEM (two) short item"), (12, prose(2, 300)),
        (13, prose(3, 50) + " " + " ".join(passage.split()[3:14]) + " no id here at all " + prose(4, 20)),
    ]
    rows = decontaminate.benchmark_hits(frame(spark, texts), table, slice_windows=slice_windows).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for r in rows) == sorted(
        (i, n, k, tuple(names)) for i, t in texts for n, k, names in [hits(t, items)])
    for r in rows:
        data = (r["text"] or "").encode()
        assert sum(len(TERM.findall(lower(data[s.start:s.end].decode()))) for s in r["spans"]) == r["n_hit"]


def test_decontaminate_removes_spans_only(spark, benchmark):
    table, items = benchmark
    passage = prose(1, 25)
    texts = [(1, f"Kept é {passage} kept too"), (2, passage), (3, "clean ü"), (4, None), (5, "")]
    docs = frame(spark, texts).withColumn("n_chars", F.length("text").cast("int"))
    out = decontaminate.decontaminate(docs, table)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == T.IntegerType()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(rows) == {1, 3, 4, 5}
    assert rows[1]["text"] == "Kept é  kept too" and rows[1]["n_chars"] == 16 and rows[1]["spans"] == "s"
    assert (rows[3]["text"], rows[4]["text"], rows[5]["text"]) == ("clean ü", None, "")
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, table, remove="documents").collect()} == {3, 4, 5}
    assert decontaminate.decontaminate(docs, table.limit(0)).count() == 5
    assert decontaminate.decontaminate(docs.limit(0), table).count() == 0


# --- line dedup ----------------------------------------------------------------------------------------------------

def line_verdict(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    common = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if common.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark):
    license_, common = "This work is licensed under terms", "  A COMMON line of twenty ü\t"
    texts = [(i, t if i != 6 else "x" * 500) for i, t in ODD] + [
        (i, "\n".join(random.Random(i).choices([license_, common.strip().lower(), common, "short", f"own line number {i} is long", ""], k=30)))
        for i in range(20, 60)
    ] + [(70, license_), (70, license_), (71, "\n" + license_ + "\n")]
    docs = frame(spark, texts)
    marked = linededup.with_bitmaps(docs, linededup.line_bitmaps(docs))
    rows = marked.select("doc_id", F.size(linededup.lines_of(F.col("text"))), linededup.n_dropped(F.col("runs")),
                         F.sha2(linededup.kept_text(F.col("text"), F.col("runs")), 256)).collect()
    assert sorted(map(tuple, rows)) == line_verdict(texts)
    assert linededup.line_bitmaps(docs.limit(0)).count() == 0


def test_hot_lines_are_found_whatever_their_share(spark, monkeypatch):
    docs = frame(spark, [(i, f"the same line in each document\nline of {i // 4} four documents here") for i in range(400)])
    usual = {tuple(r) for r in linededup.line_bitmaps(docs).select("doc_id", F.to_json("runs")).collect()}
    monkeypatch.setattr(linededup, "HOT_SHARE", 1)
    assert usual == {tuple(r) for r in linededup.line_bitmaps(docs).select("doc_id", F.to_json("runs")).collect()}
    assert len(usual) == 399


# --- token counts --------------------------------------------------------------------------------------------------

def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    r = random.Random(3)
    alphabet = ["a", "Bc", " ", "  ", "\n", "é", " ", "　", "'s", "'ll", "'", "9", "日", "<|endoftext|>", "<|", "endoftext|>", "!", "\t", "ñ ", "the "]
    texts = ODD + [(100 + i, "".join(r.choices(alphabet, k=r.randrange(1, 60)))) for i in range(300)]
    texts += [(500 + i, "".join(r.choices(alphabet, k=900))) for i in range(6)]
    texts += [(600, "z" * 3000), (601, " " * 2500 + "end"), (602, "<|endoftext|>" * 200), (603, "word " * 700), (603, "word " * 700), (604, "'" * 999)]
    out = tokens.token_counts(frame(spark, texts), queries.tokenizer_path(), chunk=200, overlap=80, whole=400)
    assert out.columns.count("n_tokens") == 1
    expected = sorted((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert sorted((x["doc_id"], x["n_tokens"]) for x in out.collect()) == expected
    assert tokens.token_counts(frame(spark, []), queries.tokenizer_path()).count() == 0


def test_chunks_of_a_run_without_boundary_are_widened(spark):
    from tokenizers import Tokenizer

    text = "q" * 5000 + " tail of words " * 300
    sizes = tokens.huge_counts(spark.createDataFrame([(text,)], "text string"), queries.tokenizer_path(), chunk=300, overlap=100).collect()
    assert [r["n"] for r in sizes] == [len(Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False).ids)]


# --- near duplicates -----------------------------------------------------------------------------------------------

def shingles(text, n):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def groups(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    own = {i: i for i in sets}

    def root(i):
        return i if own[i] == i else root(own[i])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                own[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    r = random.Random(5)
    texts = [x for i, x in enumerate(ODD) if i != 4]
    for family in range(6):
        base = prose(family, 80, 400).split()
        for k in range(12):
            words = list(base)
            for _ in range(r.randrange(0, 9)):
                words[r.randrange(len(words))] = f"new{r.random()}"
            texts.append((100 * (family + 1) + k, " ".join(words)))
    texts += [(900, texts[12][1]), (901, texts[12][1].upper().replace("Ü", "ü")), (902, "one"), (903, "ONE  "), (904, "\n")]
    found = neardup.near_duplicates(frame(spark, texts), neardup.Settings(words=n)).collect()
    assert sorted(map(tuple, found)) == groups(texts, n)


def test_near_duplicates_in_small_parts(spark, monkeypatch):
    """Buckets cut into many parts give the same groups."""
    usual = neardup._faced
    monkeypatch.setattr(neardup, "_faced", lambda a, b, block, weight: usual(a, b, 3, 50))
    test_near_duplicates(spark, 2)


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    rows = neardup.near_duplicates(frame(spark, [(1, None), (None, "a b"), (2, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (1, 1, True), (2, 2, True)]


def test_pruning_keeps_what_the_miss_probability_says():
    s = neardup.Settings()
    assert neardup.least_matches(s) == sorted(neardup.least_matches(s))
    assert all(0 < m < n * 0.8 for m, n in zip(neardup.least_matches(s), range(s.batch, s.hashes + 1, s.batch), strict=True))


# --- quality -------------------------------------------------------------------------------------------------------

def measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeated = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_measures(spark):
    texts = ODD + [(20, "a b c d e " * 4), (21, "x a b c d e y a b c d e z"), (22, "l 1\nl 1\n l 1\n\n\nl 1"), (23, "#$ *%&|<> ñ" * 3), (24, prose(1, 300, 2))]
    out = quality.measured(frame(spark, texts))
    assert [c for c in out.columns if c == "n_words"] and "N_WORDS" not in out.columns
    assert sorted((r["doc_id"], *(r[m] for m in quality.MEASURES)) for r in out.collect()) == sorted((i, *measures(t)) for i, t in texts)


def test_fences_reject_outliers_of_their_group(spark):
    texts = [(i, prose(i, 40, 400)) for i in range(0, 1200)] + [(3000, " ".join(f"#{k}$%&*<>" for k in range(40))), (3001, "w " * 5), (3002, None)]
    docs = frame(spark, texts)
    out = quality.quality_filter(docs, least_rows=50)
    assert out.columns == docs.columns and {r["kept"] for r in out.select("kept").distinct().collect()} == {"k"}
    kept = {r["doc_id"] for r in out.collect()}
    assert kept == set(range(1200))
    assert quality.quality_filter(docs.limit(0)).count() == 0


def test_fences_follow_their_group_alone(spark):
    """One share of symbols passes where such shares are usual and falls elsewhere; ranges scale with the group's own."""
    r = random.Random(4)
    row = lambda i, source, symbols, chars: (i, "en", source, 200, chars, symbols, 0, 0)
    rows = [row(i, "code", r.randrange(40, 161), 1000 + r.randrange(-50, 51)) for i in range(400)]
    rows += [row(1000 + i, "prose", 0, 1000 + r.randrange(-50, 51)) for i in range(400)]
    rows += [row(2000 + i, "wide", 0, 1000 + 6 * r.randrange(-50, 51)) for i in range(400)]
    odd = [row(5000, "code", 200, 1000), row(5001, "prose", 200, 1000), row(5002, "prose", 2, 1000), row(5003, "prose", 3, 1000),
           row(5004, "prose", 0, 1700), row(5005, "wide", 0, 1700), row(5006, "code", 900, 1000)]
    frame_of = spark.createDataFrame(rows + odd, "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint")
    kept = {x["doc_id"] for x in quality.judged(frame_of).where("kept").collect()}
    assert kept == {x[0] for x in rows} | {5000, 5002, 5005}
    limits = {x["source"]: x for x in quality.fences(quality.sketches(frame_of, "lang", "source")).collect()}
    width = lambda x: limits[x]["word_length_high"] - limits[x]["word_length_low"]
    assert 4 * width("prose") < width("wide") < 9 * width("prose")
    assert limits["prose"]["symbol_rate_high"] == 0 and limits["code"]["symbol_rate_high"] > 300


def test_sketches_merge_by_adding(spark):
    docs = frame(spark, [(i, prose(i, 30 + i % 50)) for i in range(300)])
    rows = quality.measured(docs)
    half = F.col("doc_id") % 2 == 0
    parts = quality.sketches(rows.where(half), "lang", "source").unionByName(quality.sketches(rows.where(~half), "lang", "source"))
    merged = parts.groupBy("lang", "source", "metric", "bin").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    whole = quality.sketches(rows, "lang", "source")
    assert merged.exceptAll(whole).isEmpty() and whole.exceptAll(merged).isEmpty()
    assert quality.fences(parts).exceptAll(quality.fences(whole)).isEmpty()


def test_marks_go_with_the_ids(spark):
    """Only parts of the filter with a set bit are held by the driver and sent."""
    ids = spark.range(40).selectExpr("id * 7 as id")
    marked = neardup._marked(ids)
    at = np.array([r[0] for r in ids.select(F.pmod(F.xxhash64("id"), F.lit(neardup.MARKS))).collect()])
    assert neardup._may_be_marked(marked, at).all() and len(marked[1]) <= 41 * neardup.PART // 8
    others = np.setdiff1d(np.arange(0, neardup.MARKS, 997), at)
    assert not neardup._may_be_marked(marked, others).any()
