"""op12 against plain Python, its SQL, and labels that the target has not seen."""

import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from threadloom.llm import quality_llr

from .test_llm import empty, odd, rows_of  # noqa: F401

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "llr"]
WORD = regex.compile("[^\x20\x09-\x0d]+")


def base(text):
    t = text or ""
    words, lines, seen = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)], Counter()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen.update(windows)
    again = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed]


def grams(text):
    p = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+", text or "")
    return [zlib.crc32(g.encode()) % 16384 for g in [*p, *(f"{a} {b}" for a, b in zip(p, p[1:], strict=False))]]


def brute(docs, good):
    found = [grams(t) for _, t in docs]
    raw, trusted = Counter(g for own in found for g in own), Counter(g for (i, _), own in zip(docs, found, strict=True) if i in good for g in own)
    r, t = raw.total(), trusted.total()
    told = {b: round(1000 * (math.log((trusted[b] + 1) / (t + 16384)) - math.log((raw[b] + 1) / (r + 16384)))) for b in raw}
    out = []
    for (i, text), own in zip(docs, found, strict=True):
        facts, n, s = base(text), len(own) if t else 0, sum(told[g] for g in own) if t else 0
        out.append((i, *facts, not facts[-1] and s >= -400 * n, n, s))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_op12_against_plain_counts_and_sql(spark, odd, sf_dir, which):  # noqa: F811
    path = odd if which == "odd" else sf_dir
    good = {r["doc_id"] for r in spark.read.parquet(f"{path}/labels.parquet").where("quality = 1").collect()} - {None}
    df = quality_llr.op12_quality_llr(spark, path)
    rows = got(df)
    assert rows == brute(rows_of(spark, path), good)
    assert which == "odd" or {r[7] for r in rows} == {True, False}
    con, tail = duckdb.connect(), "/*.parquet" if which == "odd" else ""
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path.removeprefix('file://')}/{t}.parquet{tail}'")
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({quality_llr.ORACLE})").fetchall(), key=str) == rows


def test_op12_no_trusted_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert got(quality_llr.judged(docs, labels.where("quality = 0"))) == brute(rows_of(spark, sf_dir), set())


def test_repeated_windows_of_long_and_periodic_texts(spark):
    rng = random.Random(4)
    some = [f"w{rng.randrange(30)}" for _ in range(400)]
    texts = [" ".join(["a"] * n) for n in (7, 8, 9, 40)] + [" ".join([*some, *some]), " ".join([*some[:9], "x", *some[:9], "y", *some[1:9]]), " ".join(str(i % 5000) for i in range(60_000)), "\n".join(["same line"] * 3 + [" ", " ", "same line "])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = quality_llr.base(df).orderBy("doc_id").collect()
    assert [[r[c] for c in COLUMNS[1:7]] for r in rows] == [base(t) for t in texts]


def test_op12_held_out_labels(spark):
    """The target has one half of the labelled rows; the other half tells how well the rest is judged."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = quality_llr.judged(docs, labels.where(half)).join(labels.where(~half), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg(F.col("base_failed").cast("int")).alias("failed")).collect()
    kept, failed = {r["quality"]: r["kept"] for r in out}, {r["quality"]: r["failed"] for r in out}
    assert kept[1] + failed[1] > 0.99 and kept[0] < 0.1


def test_op12_native_plan(spark, sf_dir):
    plan = quality_llr.op12_quality_llr(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan
