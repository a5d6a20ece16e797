"""Quality rules: fixed counts of a text, and a log-likelihood ratio of hashed n-grams against trusted documents.

Pieces of a text are runs of letters and digits, and runs of other signs; its n-grams are its pieces and its pairs of neighbouring
pieces, hashed into 16384 buckets. Two multinomials over the buckets, one of the trusted target (documents labelled good) and
one of the raw corpus (all documents), give each bucket its log ratio, smoothed and rounded to thousandths. A document's score is
the sum over its n-grams divided by their number; all documents below one threshold go, the same way at every size.

Only built-in functions run: arrays inside a row for counts, one aggregation with at most a row for each bucket and task,
and a table of one number a bucket that the driver gathers and sends along as a constant. Texts are never shuffled. The target is a
documented sample: ``target_rows`` labelled rows at most, the first by the checksum of their doc_id, so that what is broadcast is
bounded; the raw corpus is counted whole.

Eight-word windows are hashed by doubling (one word, two, four, eight) to 64 bits; only documents that hold one twice have their
windows sorted with their places, which is n log n for texts of any length.

Defined results: a null text has no words, lines or n-grams and fails the base rules as every text under 20 words does; repeated
rows and doc_ids are judged each; a doc_id labelled twice is trusted if one label says so; without trusted rows the base rules alone
decide; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: LEAST is in thousandths for each n-gram. Clean documents lie above -30 at sf0.1 (above -260 with 76 trusted rows), junk below -800.
BUCKETS, TARGET_ROWS, SMOOTH, LEAST = 16384, 20_000, 1.0, -400
WORD, WITH_WORD, PIECE = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
SYMBOL, WINDOW, FEWEST, MOST_REPEATED = "[#*$%&|<>]", 8, 20, 30


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though the body names it in lambdas."""
    return F.transform(F.array(value), body)[0]


def rest(a: Column, at: int) -> Column:
    """The array from its element ``at`` on, counted from 1."""
    return F.slice(a, at, F.size(a))


def covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more."""
    marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    alike = lambda e, x, i: F.coalesce(F.get(e, i)["h"] == x["h"], F.lit(False))
    places = let(marked, lambda e: F.array_compact(F.transform(e, lambda x, i: F.when(alike(e, x, i - 1) | alike(e, x, i + 1), x["i"]))))
    gaps = let(F.sort_array(places), lambda p: F.zip_with(p, rest(p, 2), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW)))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)


def repeated_words(words: Column) -> Column:
    """Words in windows of eight that the text holds twice or more."""
    pairs = lambda a, step: let(a, lambda v: F.zip_with(v, rest(v, 1 + step), lambda x, y: F.xxhash64(x, y)))
    doubled = pairs(pairs(pairs(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    whole = let(doubled, lambda v: F.slice(v, 1, F.greatest(F.size(v) - (WINDOW - 1), F.lit(0))))
    return let(whole, lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), covered(v)).otherwise(F.lit(0).cast("long")))


def base(docs: DataFrame) -> DataFrame:
    """Adds the counts and ``base_failed`` to rows with ``text``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WITH_WORD))
    counted = docs.withColumn("words_", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).select(
        *docs.columns,
        F.size("words_").cast("long").alias("n_words"),
        F.char_length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words_")).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def grams(text: Column) -> Column:
    """Buckets of a text's pieces and pairs of pieces."""
    bucket = lambda s: (F.crc32(s.cast("binary")) % BUCKETS).cast("int")
    both = lambda p: F.concat(
        F.transform(p, bucket), F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), rest(p, 2), lambda x, y: bucket(F.concat(x, F.lit(" "), y)))
    )
    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), both)


def ratios(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> list[int] | None:
    """Of each bucket, a thousand times the log of its share in the target over that in the corpus; None without a target."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("good_")).distinct()
    first = good.orderBy(F.crc32(F.col("good_").cast("string").cast("binary")), "good_").limit(target_rows)
    marked = docs.join(F.broadcast(first), docs["doc_id"] == first["good_"], "left").select(F.col("good_").isNotNull().cast("long").alias("good_"), F.explode(grams(F.col("text"))).alias("bucket"))
    counts = marked.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good_").alias("good")).collect()  # a row a bucket
    total, trusted = sum(r["raw"] for r in counts), sum(r["good"] for r in counts)
    if not trusted:
        return None
    of = {r["bucket"]: (r["raw"], r["good"]) for r in counts}
    share = lambda n, all_: math.log((n + SMOOTH) / (all_ + SMOOTH * BUCKETS))
    pairs = (of.get(b, (0, 0)) for b in range(BUCKETS))
    return [round(1000 * (share(good, trusted) - share(raw, total))) for raw, good in pairs]


def judged(docs: DataFrame, labels: DataFrame, least: int = LEAST, target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed, kept, n_grams and llr (sum of thousandths) of every row of documents (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = ratios(docs, labels, target_rows)
    told = F.split(F.lit(",".join(map(str, known or [0]))), ",").cast("array<int>")  # folded to a constant
    summed = lambda g: F.struct(F.size(g).cast("long").alias("n"), F.aggregate(g, F.lit(0).cast("long"), lambda s, b: s + F.get(told, b)).alias("llr"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("llr"))
    scored = base(docs.withColumn("score_", let(grams(F.col("text")), summed) if known else none))
    kept = ~F.col("base_failed") & (F.col("score_.llr") >= least * F.col("score_.n"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("score_.n").alias("n_grams"), F.col("score_.llr").alias("llr")
    )


def op12_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(encode({0})) + 1), lambda i: strpos('0123456789ABCDEF', substr(hex(encode({0})), 2 * i - 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({0})), 2 * i, 1)) - 17)), lambda c, b: xor(c >> 8, bits[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
ORACLE = f"""
WITH RECURSIVE steps AS (SELECT range AS i, 0 AS k, range::BIGINT AS v FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM steps WHERE k < 8),
bits AS (SELECT list(v ORDER BY i) AS bits FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, regexp_extract_all(t, '{PIECE}') AS ps FROM d),
starts AS (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i : i + 7], ' ')) AS times FROM starts),
again AS (SELECT rid, count(DISTINCT i + k) AS n FROM windows, range(8) r(k) WHERE times > 1 GROUP BY rid),
lines AS (SELECT rid, unnest(str_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{WITH_WORD}') GROUP BY rid),
grams AS (SELECT rid, unnest(list_concat(ps, list_transform(range(1, len(ps)), lambda i: ps[i] || ' ' || ps[i + 1]))) AS g FROM w),
codes AS (SELECT g, {_CRC.format("g")} % {BUCKETS} AS b FROM (SELECT DISTINCT g FROM grams), bits),
good AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), bits ORDER BY {_CRC.format("(doc_id::VARCHAR)")}, doc_id LIMIT {TARGET_ROWS}),
raw AS (SELECT b, count(*) AS n FROM grams JOIN codes USING (g) GROUP BY b),
trusted AS (SELECT b, count(*) AS n FROM grams JOIN codes USING (g) JOIN d USING (rid) WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY b),
sums AS (SELECT (SELECT sum(n) FROM raw) AS r, coalesce((SELECT sum(n) FROM trusted), 0) AS g),
told AS (SELECT raw.b, round(1000 * (ln((coalesce(trusted.n, 0) + 1) / (sums.g + {BUCKETS})) - ln((raw.n + 1) / (sums.r + {BUCKETS}))))::BIGINT AS v FROM raw LEFT JOIN trusted ON raw.b = trusted.b, sums),
scores AS (SELECT rid, count(*) AS n, sum(v)::BIGINT AS v FROM grams JOIN codes USING (g) JOIN told USING (b), sums WHERE sums.g > 0 GROUP BY rid),
facts AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOL}'))::BIGINT AS n_symbols FROM w),
counted AS (SELECT facts.*, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(scores.n, 0)::BIGINT AS n_grams, coalesce(scores.v, 0)::BIGINT AS llr
  FROM facts LEFT JOIN dup USING (rid) LEFT JOIN again USING (rid) LEFT JOIN scores USING (rid)),
told_base AS (SELECT *, n_words < {FEWEST} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND llr >= {LEAST} * n_grams AS kept, n_grams, llr FROM told_base
"""
