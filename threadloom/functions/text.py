"""Text, date and set functions as column expressions; nulls are treated as empty text throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as trimming knows it, ideographic and no-break blanks and the byte order mark among it (Java's and RE2's notation).
WHITE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: The same characters, for trimming without a pattern.
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: What parts the segments of a text.
BETWEEN = rf"""[{WHITE}=；;，,。.!！？?、|/:：()\[\]{{}}（）"'“”‘’\-]+"""


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_text(c: Column | str) -> Column:
    """Without white space at the ends; ``trim`` alone would strip blanks only."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(BLANKS))


def first_text(*cs: Column | str) -> Column:
    """The first that is not blank."""
    return F.coalesce(*(F.nullif(safe_text(c), F.lit("")) for c in cs), F.lit(""))


def compact(c: Column | str) -> Column:
    """Lower case without white space: the looser of the two identities that deduplication knows."""
    return F.regexp_replace(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), rf"[{WHITE}]+", "")


def compact_words(c: Column | str) -> Column:
    """Lower case without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), rf"[{WHITE}\p{{P}}\p{{S}}]+", "")


def inline(c: Column | str) -> Column:
    """White space runs become one blank."""
    return safe_text(F.regexp_replace(safe_text(c), rf"[{WHITE}]+", " "))


def clip_block(c: Column | str, most: int) -> Column:
    """A text over ``most`` characters keeps one less, trimmed, and an ellipsis; its lines stay."""
    t = safe_text(c)
    return F.when(F.length(t) > most, F.concat(safe_text(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def clip(c: Column | str, most: int) -> Column:
    """``clip_block`` of a text on one line."""
    return clip_block(inline(c), most)


def clip_note(c: Column | str, most: int = 72) -> Column:
    """Without Markdown marks and objects that were printed by mistake, on one line; what is cut is not trimmed."""
    t = inline(F.regexp_replace(F.replace(col(c), F.lit("[object Object]"), F.lit("")), r"[*_`>#]+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def preview(c: Column | str, most: int = 140) -> Column:
    """On one line; a text over ``most`` characters keeps these and gets three dots."""
    t = inline(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def excerpt(c: Column | str, most: int = 420) -> Column:
    """``preview`` without the block of extraction notes and without headings."""
    bare = F.regexp_replace(F.regexp_replace(safe_text(c), r"(?s)\[EXTRACT_META\].*?\[/EXTRACT_META\]", " "), r"(?m)^#[^\n\r\x{2028}\x{2029}]*", " ")
    return preview(bare, most)


def path_segment(c: Column | str) -> Column:
    """A name that is safe inside a path: 80 characters, ``unnamed`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(safe_text(c), r"[\s/\\]+", "_"), "_+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 80), F.lit("")), F.lit("unnamed"))


def tokens(c: Column | str, pattern: str) -> Column:
    """Trimmed, non-blank parts."""
    return F.filter(F.transform(F.split(safe_text(c), pattern), safe_text), lambda x: x != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though the body names it in lambdas."""
    return F.transform(F.array(value), body)[0]


def _at_most(xs: Column, most: int | None) -> Column:
    return xs if most is None else F.slice(xs, 1, most)


def distinct_compact(xs: Column, most: int | None = 999) -> Column:
    """Ordered distinct by compact form, first spelling kept."""
    order = F.array_sort(F.transform(xs, lambda x, i: F.struct(compact(x).alias("key"), i.alias("i"), safe_text(x).alias("text"))))
    first = lambda e, x, i: (x["key"] != "") & ((i == 0) | (F.get(e, i - 1)["key"] != x["key"]))  # noqa: E731  equal keys stand side by side
    heads = let(order, lambda e: F.array_compact(F.transform(e, lambda x, i: F.when(first(e, x, i), F.struct(x["i"].alias("i"), x["text"].alias("text"))))))
    return _at_most(F.transform(F.array_sort(heads), lambda x: x["text"]), most)


def distinct_exact(xs: Column, most: int | None = 999) -> Column:
    return _at_most(F.array_distinct(F.filter(F.transform(xs, safe_text), lambda x: x != "")), most)


def ngrams(c: Column, n: int, most: int | None = 256) -> Column:
    """The first ``most`` (all if None) distinct character n-grams; a shorter text is its own."""
    whole = F.filter(F.array(c), lambda x: x != "")
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, _at_most(F.array_distinct(grams), most)).otherwise(whole)


def dice(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of distinct arrays, 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def epoch_seconds(c: Column | str) -> Column:
    """Seconds from numbers in seconds, milliseconds or microseconds; 0 if unknown."""
    x = F.coalesce(col(c).try_cast("double"), F.lit(0.0))
    return F.when(x <= 0, 0).when(x >= 1e15, F.floor(x / 1e6)).when(x >= 1e11, F.floor(x / 1e3)).otherwise(F.floor(x)).cast("long")


def date_literal(c: Column | str) -> Column:
    """Dates from 2000 on as yyyy-mm-dd, a missing day is the first; other text stays as it is."""
    t, pattern = safe_text(c), r"^(20\d{2})[-/.年](\d{1,2})(?:[-/.月](\d{1,2}))?"
    part = lambda k: F.lpad(F.regexp_extract(t, pattern, k), 2, "0")
    day = F.when(F.regexp_extract(t, pattern, 3) == "", F.lit("01")).otherwise(part(3))
    return F.when(t.rlike(pattern), F.concat_ws("-", F.regexp_extract(t, pattern, 1), part(2), day)).otherwise(t)


def earlier(a: Column, b: Column) -> Column:
    """The earlier of two date texts, blanks aside."""
    return F.coalesce(F.least(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))), F.lit(""))


def later(a: Column, b: Column) -> Column:
    return F.coalesce(F.greatest(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))), F.lit(""))


def month_key(c: Column | str) -> Column:
    t = safe_text(c)
    found = lambda k: F.regexp_extract(t, r"(20\d{2})[-_/.年]?(0[1-9]|1[0-2])", k)
    return F.when(found(1) != "", F.concat_ws("-", found(1), found(2))).otherwise(F.lit(""))


def value_type(c: Column | str) -> Column:
    t = safe_text(c)
    return (
        F.when(t == "", "text").when(t.rlike("(?i)^(true|false)$"), "boolean").when(t.rlike(r"^-?\d+(\.\d+)?$"), "number")
        .when(t.rlike(r"^20\d{2}[-/.年]\d{1,2}([-/.月]\d{1,2}(日|号)?)?$"), "date")
        .when((t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]")), "json").otherwise("text")
    )


def fact_key(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(safe_text(c)), r"[^a-z0-9一-龥]+", "_"), "^_+|_+$", "")


def key_values(c: Column | str) -> Column:
    """``key = value`` pairs of a text as an array of structs."""
    t, pattern = safe_text(c), F.lit(r"([^|；。\n]+?)\s*=\s*([^|；。\n]+)")
    part = lambda k: F.transform(F.regexp_extract_all(t, pattern, F.lit(k)), safe_text)
    return F.arrays_zip(part(1).alias("key"), part(2).alias("value"))


def chat_line(c: Column | str) -> Column:
    """``[thread] role: content`` as a struct; other lines have role ``text``. Roles known here: user, assistant, tool."""
    t, pattern = col(c), r"^\[([^\]]+)\]\s+(user|assistant|tool):\s*(.*)$"
    part = lambda k: safe_text(F.regexp_extract(t, pattern, k))
    hit = F.coalesce(t.rlike(pattern), F.lit(False))
    return F.struct(
        F.when(hit, part(1)).otherwise(F.lit("")).alias("thread"), F.when(hit, part(2)).otherwise(F.lit("text")).alias("role"),
        F.when(hit, part(3)).otherwise(safe_text(t)).alias("content"),
    )


def utf16_length(c: Column | str) -> Column:
    return (F.octet_length(F.encode(F.coalesce(col(c), F.lit("")), "UTF-16BE")) / 2).cast("long")


def source_ref(c: Column | str) -> Column:
    """``window_<8 digits>_msg_<n>`` as a struct of window and number; null otherwise."""
    t, pattern = safe_text(c), r"^(window_\d{8})_msg_(\d+)$"
    return F.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, 1).alias("window"), F.regexp_extract(t, pattern, 2).cast("long").alias("msg_index")))


def signals(c: Column | str) -> Column:
    """Distinct signals of a text: its latin tokens of two letters and more, its Han runs up to eight letters and their 2- to 4-grams; without any, bigrams."""
    t = compact_words(c)
    latin = F.filter(F.regexp_extract_all(F.lower(inline(c)), F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: F.length(x) >= 2)
    han = F.regexp_extract_all(t, F.lit(r"\p{IsHan}{2,}"), F.lit(0))
    grams = lambda x, n: F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    own = F.flatten(F.transform(han, lambda x: F.concat(F.when(F.length(x) <= 8, F.array(x)).otherwise(F.array().cast("array<string>")), grams(x, 2), grams(x, 3), grams(x, 4))))
    found = F.array_distinct(F.concat(latin, own))
    return F.when(F.size(found) > 0, found).otherwise(F.array_distinct(grams(t, 2)))


def segments(c: Column | str, least: int = 3) -> Column:
    """The compact parts of a text between marks and blanks, of ``least`` letters and more, repeats kept."""
    return F.filter(F.transform(F.split(F.lower(safe_text(c)), BETWEEN), compact_words), lambda x: F.length(x) >= least)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))


def term_score(term: Column | str, corpus: Column) -> Column:
    """1 if the compact corpus holds the compact term; else the share, by length, of the term's segments that it holds."""
    term = F.lit(term) if isinstance(term, str) else term
    whole, parts = compact_words(term), segments(term)
    share = F.round(_total(F.filter(parts, lambda x: corpus.contains(x))) / F.nullif(_total(parts), F.lit(0)), 4)
    return F.when((whole == "") | (corpus == ""), 0.0).when(corpus.contains(whole), 1.0).otherwise(F.coalesce(share, F.lit(0.0)))


def corpus_share(term: Column, corpus: Column) -> Column:
    """How much of a term a corpus holds: 1 if all of it; with a segment of five letters its segments' share, 0.72 at least; else the larger of
    that share and the share of its signals, and nothing where either side has no signals."""
    text = compact_words(corpus)
    share, mine, theirs = term_score(term, text), signals(term), signals(corpus)
    long_ = F.exists(segments(term, 5), lambda x: text.contains(x))
    common = F.round(F.size(F.array_intersect(mine, theirs)) / F.nullif(F.size(mine), F.lit(0)), 4)
    return F.when((share == 0) & (text == ""), 0.0).when(share == 1, 1.0).when(long_, F.greatest(share, F.lit(0.72))).when((F.size(mine) == 0) | (F.size(theirs) == 0), 0.0).otherwise(F.greatest(common, share))
