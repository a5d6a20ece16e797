"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items and documents are reduced to lower-case words; every run of ``window`` words of an item is a pattern, items of
fewer words are one pattern. The automaton scans each whole document once; matches are word-aligned, because patterns
and texts have a blank on both sides of each word, and come back as word numbers and as offsets of the original text.

The patterns are broadcast in blocks of at most ``block_bytes``: their size is measured before any block is sent, and a
larger benchmark takes one scan of the documents per block, with hits merged. So a broadcast never outgrows its bound.

Defined results: a null or wordless text has no words and no hits; null or wordless items match nothing; repeated items
count once by item_id; an item whose id is null is ignored; tables may be empty; repeated documents are judged row by
row; other columns stay, but for those that bear the
name of a result column of ``find_windows``.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import light_batches, slices, table, written

#: Bytes of words: digits, letters, all of UTF-8's others; A-Z become a-z, the rest is a blank.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Of patterns in one automaton, which takes about 50 times as much in a worker: 200 MB.
BLOCK_BYTES = 4 << 20
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(pattern, item_ids): the distinct windows of all items, as space-joined words."""
    schema = "pattern string, item_id long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(t)
                found = sorted({b" ".join(w[k : k + window]).decode("utf-8", "surrogatepass") for k in range(max(1, len(w) - window + 1))}) if w else []
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([i] * len(found), pa.int64())], ["pattern", "item_id"])

    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    return rows.mapInArrow(cut, schema).groupBy("pattern").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def blocks_of(patterns: DataFrame, block_bytes: int) -> list[list]:
    """The patterns in lists of bounded size; only one list's rows travel to the driver at a time."""
    cost = F.octet_length("pattern") + 8 * F.size("item_ids") + 32
    total = patterns.agg(F.sum(cost)).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        yield [(r["pattern"], list(r["item_ids"])) for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k).collect()]


_automata: dict[str, object] = {}


def _automaton(key: str, block: list):
    """Built once in a worker process, which keeps only the last one."""
    if key not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for pattern, items in block:
            a.add_word(f" {pattern.encode('utf-8', 'surrogatepass').decode('latin-1')} ", (pattern.count(" ") + 1, items))
        a.make_automaton()
        _automata.clear()
        _automata[key] = a
    return _automata[key]


def _merged(spans: list) -> list:
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _spans(data: bytes, hits: list) -> list:
    """Offsets (code points, end exclusive) of the runs of words in the original text."""
    starts, ends, at = [], [], 0
    for w in data.translate(PLAIN).split(b" "):
        if w:
            starts.append(at)
            ends.append(at + len(w))
        at += len(w) + 1
    chars = lambda k: len(data[:k].decode("utf-8", "surrogatepass"))
    return [{"start": chars(starts[a]), "end": chars(ends[b])} for a, b in hits]


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with n_words, n_hit, items (ids, sorted), hit_words (runs of word numbers) and hit_spans, in place of columns of these names."""
    patterns, out, again = written(item_windows(benchmark, window)), docs.drop(*(f.name for f in ADDED)), False
    for block in blocks_of(patterns, block_bytes):
        out = _scan(written(out) if again else out, block, again)
        again = True
    return out if again else _scan(out, [], False)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any window of the benchmark, columns as before."""
    patterns, out, again = written(item_windows(benchmark, window)), docs, False
    for block in blocks_of(patterns, block_bytes):
        out = _clean(written(out) if again else out, block)
        again = True
    return out


def _sent(docs: DataFrame, block: list):
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))


def _clean(docs: DataFrame, block: list) -> DataFrame:
    """The documents without a match in this block of patterns."""
    sent, at = _sent(docs, block), docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(*sent.value)
        for b in slices(batches, at):
            stay = []
            for t in b.column(at).to_pylist():
                w = words(t)
                stay.append(not w or next(iter(automaton.iter(" " + b" ".join(w).decode("latin-1") + " ")), None) is None)
            yield b.filter(pa.array(stay, pa.bool_()))

    return light_batches(docs).mapInArrow(scan, docs.schema)


def _scan(docs: DataFrame, block: list, again: bool) -> DataFrame:
    """One block of patterns: adds the result columns, or adds to those of the blocks before."""
    sent, given, names = _sent(docs, block), list(docs.columns), [f.name for f in ADDED]
    keep, at = [i for i, n in enumerate(given) if n not in names], given.index("text")
    schema = T.StructType([*(docs.schema[i] for i in keep), *ADDED.fields])
    mine = {n: given.index(n) for n in names} if again else {}
    span = lambda a, z: pa.list_(pa.struct([(a, pa.int64()), (z, pa.int64())]))
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.int64()), "hit_words": span("first", "last"), "hit_spans": span("start", "end")}

    def hits_of(t: str | None, automaton) -> tuple[int, list, set]:
        """Word count, spans of matched words and item ids of a text."""
        w, hits, items = words(t), [], set()
        found = list(automaton.iter(" " + b" ".join(w).decode("latin-1") + " ")) if w and automaton is not None else []
        if found:
            ends, n = [], 0  # where the blank after each word stands
            for x in w:
                n += len(x) + 1
                ends.append(n)
            for end, (size, ids) in found:
                last = bisect.bisect_left(ends, end)
                hits.append([last - size + 1, last])
                items.update(ids)
        return len(w), hits, items

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, patterns = sent.value
        automaton = _automaton(key, patterns) if patterns else None
        for b in slices(batches, at):
            out = {n: [] for n in names}
            for k, t in enumerate(b.column(at).to_pylist()):
                n, hits, items = hits_of(t, automaton)
                if again:
                    hits += [[h["first"], h["last"]] for h in b.column(mine["hit_words"])[k].as_py()]
                    items |= set(b.column(mine["items"])[k].as_py())
                hits = _merged(hits)
                row = (n, sum(y - x + 1 for x, y in hits), sorted(items), [{"first": x, "last": y} for x, y in hits], _spans(t.encode("utf-8", "surrogatepass"), hits) if hits else [])
                for name, v in zip(names, row, strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *(pa.array(out[n], kinds[n]) for n in names)], [*(given[i] for i in keep), *names])

    return light_batches(docs).mapInArrow(scan, schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest_items(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
