"""Near-duplicate groups by b-bit MinHash.

One pass over the texts gives each document its set of 5-word shingles (as 64-bit hashes), a digest of that set, band
keys made of full minima, and the two low bits of 128 minima packed in four longs. Documents with equal sets form a
class; only one representative of each class goes on.

Candidates share a band key. Four centres of each bucket (the least id and three at random) are compared with its
members, which is linear in the bucket; the best two by the collision-corrected estimate are confirmed on full sets.
That already ties dense groups together. What may still be missing are links between different components: small
buckets compare all such pairs by estimate; members of buckets over ``small`` meet by a prefix filter that loses no pair (two sets that
are similar enough share one of their rarest shingles, the first n - ceil(t n) + 1, with enough left after it) and then by the
same estimate, which passes a pair at the threshold but for a chance of 3e-7. So no bucket is capped, and no group is expanded
into all its pairs. All links are confirmed on full sets.

The similarity that links two documents is a parameter in per cent; op5 asks for 85, the pipeline's stage for 80. The bands
and the least estimate that is worth confirming follow from it: a pair at the threshold misses all bands with a chance below
one in a million (25 bands of five minima at 85, 28 of four at 80), an estimate errs by five deviations.

Components come from alternating star contraction over the confirmed links, one checkpoint per round.

Defined results: a null, empty or blank text has no shingles and is its own component; fewer than five words are one
shingle, the whole sequence; repeated rows share a class; rows without a doc_id take no part and are kept; doc_ids are
expected to name one text (rows that share one are judged each by its own text); very long texts are read whole, a slice of
about 4 MB of text or one document at a time; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, light_batches, slices, table, word_hashes, written

WORDS, PERMS, SMALL, MISSED = 5, 128, 16, 5e-7
SKETCH = "doc_id long, row_key long, n long, set_key binary, bands array<long>, s0 long, s1 long, s2 long, s3 long"
_U = np.uint64
#: Odd 64-bit multipliers, from a seed.
_ODD = np.random.default_rng(20).integers(0, 2**63, PERMS + 2 * WORDS, dtype=np.uint64) * _U(2) + _U(1)
_PERM, _MIX, _BAND = _ODD[:PERMS], _ODD[PERMS : PERMS + WORDS], _ODD[PERMS + WORDS :]


def bands_of(percent: int) -> tuple[int, int]:
    """(bands, minima in each): the longest bands with which a pair at the threshold misses all of them in ``MISSED`` of cases."""
    for rows in range(WORDS, 0, -1):
        for bands in range(1, PERMS // rows + 1):
            if (1 - (percent / 100) ** rows) ** bands <= MISSED:
                return bands, rows
    raise ValueError(f"{PERMS} minima do not find pairs of {percent} %")


def least_of(percent: int) -> float:
    """The estimate five standard deviations under the threshold; pairs below it are not confirmed."""
    agree = 0.25 + 0.75 * percent / 100
    return percent / 100 - 5 * math.sqrt(agree * (1 - agree) / PERMS) / 0.75


def _mixed(x: np.ndarray, by: int = 0) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _MIX[by]
    return x ^ (x >> _U(29))


def shingles(a: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, from the hashes of its words."""
    if not len(a):
        return a
    n = max(1, len(a) - WORDS + 1)
    total = np.full(n, len(a) if len(a) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(a))):
        total = _mixed(total + a[i : i + n] * _MIX[i], i)
    return np.unique(total)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle hashes of each text."""
    hashes, lengths = word_hashes(texts)
    ends = np.cumsum(lengths)
    return (shingles(hashes[b - n : b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True))


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(PERMS, ~_U(0))
    for k in range(0, len(found), 2048):
        np.minimum(out, (found[k : k + 2048, None] * _PERM).min(0), out=out)
    return out


def sketch(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, row_key (a hash of the text), n, set_key, bands and the packed low bits of each document."""
    import hashlib

    n_bands, rows = bands_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.arange(0, 64, 2, dtype=np.uint64)
        for b in slices(batches, 1):
            ns, keys, mins = [], [], np.zeros((b.num_rows, PERMS), np.uint64)
            for i, found in enumerate(shingle_sets(b.column(1))):
                ns.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                if len(found):
                    mins[i] = minima(found)
            bands = np.zeros((b.num_rows, n_bands), np.uint64)
            for r in range(rows):
                bands = _mixed(bands + mins[:, r : n_bands * rows : rows] * _BAND[r] + np.arange(n_bands, dtype=np.uint64), r)
            low = (_mixed(mins, 1) >> _U(62)).reshape(b.num_rows, 4, 32)
            packed = np.bitwise_or.reduce(low << shift, axis=2).view(np.int64)
            some = np.array(ns) > 0
            offsets = np.concatenate([[0], np.cumsum(some * n_bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(bands[some]).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), lists, *(pa.array(np.ascontiguousarray(packed[:, k])) for k in range(4))],
                ["doc_id", "row_key", "n", "set_key", "bands", "s0", "s1", "s2", "s3"],
            )

    return light_batches(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, SKETCH)


def estimate(x: Column, y: Column) -> Column:
    """Collision-corrected similarity from the packed bits of two sketches: two bits agree by chance in a quarter of cases."""
    apart = F.lit(0)
    for k in range(4):
        z = x[f"s{k}"].bitwiseXOR(y[f"s{k}"])
        apart = apart + F.bit_count((z.bitwiseOR(F.shiftrightunsigned(z, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    return (1 - apart / F.lit(PERMS) - 0.25) / 0.75


def near_in_size(x: Column, y: Column, percent: int) -> Column:
    return (x["n"] * 100 >= y["n"] * percent) & (y["n"] * 100 >= x["n"] * percent)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_, b_, keep = b.column(2), b.column(3), []
            for i in range(b.num_rows):
                x, y = np.frombuffer(a_[i].as_py(), np.uint64), np.frombuffer(b_[i].as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("id").alias("a"), F.col("found").alias("found_a")), sets.select(F.col("id").alias("b"), F.col("found").alias("found_b"))
    return light_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "found_a", "found_b")).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of the links can reach; alternating large and small stars."""
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before = mark(edges)
    while before[0]:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = ends.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = kept(small.where("a <> b").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def prefixes(finalists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, prefix): each set's rarest shingles, rarest first, as many as the filter needs; rarity is counted over all finalists."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = np.frombuffer(v, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int64)), pa.array(found)], ["id", "shingle"])

    rows = sets.join(finalists, "id", "left_semi").select("id", "found").mapInArrow(spread, "id long, shingle long")
    common = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = rows.join(common, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("all"))
    n = F.size("all")
    return ranked.select("id", F.slice("all.shingle", F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int")).alias("prefix"))


def _grouped(docs: DataFrame, small: int, percent: int) -> DataFrame:
    """doc_id, row_key, n, least (doc_id of the group) and group (null without shingles or doc_id) of every row.

    Classes of equal sets have numbers of their own, so that rows of one doc_id and different texts are told apart.
    """
    enough_alike = least_of(percent)
    all_ = written(sketch(docs, percent))
    classes = all_.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "bands", "s0", "s1", "s2", "s3")).alias("r"))
    number = F.monotonically_increasing_id()  # written at once, so it stays as it is
    reps = written(classes.select("set_key", number.alias("id"), "r.doc_id", "r.n", "r.bands", "r.s0", "r.s1", "r.s2", "r.s3"))
    sketch_ = F.struct("n", "s0", "s1", "s2", "s3").alias("x")
    members = reps.select(F.posexplode("bands").alias("band", "key"), "id", sketch_)
    chance = lambda k: F.min(F.struct(F.xxhash64("id", F.lit(k)), "id", "x"))
    centre = lambda c: F.struct(c["id"].alias("id"), c["x"].alias("x"))
    buckets = members.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("id", "x")).alias("c0"), *(chance(k).alias(f"c{k}") for k in (1, 2, 3))).where("m > 1")
    within = written(members.join(buckets.select("key", "m", F.array(*(centre(F.col(f"c{k}")) for k in range(4))).alias("centres")), "key"))
    # a member's two likeliest centres over all its buckets; estimates are made row by row, no pair is emitted
    near = F.filter("centres", lambda c: (c["id"] != F.col("id")) & near_in_size(c["x"], F.col("x"), percent))
    guess = F.transform(near, lambda c: F.struct(estimate(c["x"], F.col("x")).alias("est"), (-c["id"]).alias("c")))
    probes = within.select("id", F.array_max(guess).alias("g")).where(F.col("g.est") >= enough_alike).groupBy("id", "g.c").agg(F.max("g.est").alias("est"))
    best = Window.partitionBy("id").orderBy(F.desc("est"), F.desc("c"))
    first = written(probes.withColumn("r", F.row_number().over(best)).where("r <= 2").select(F.col("id").alias("a"), (-F.col("c")).alias("b")))
    sets = written(_sets(docs, reps, within.select("id").distinct()))
    links = written(confirmed(first, sets, percent))
    parts = components(links)
    # what is left: links between different components
    tagged = written(within.select("band", "key", "id", "m", "x").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")))
    mixed = tagged.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
    open_ = tagged.join(mixed, "key")
    apart = (
        (F.col("p.key") == F.col("q.key")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.component") != F.col("q.component"))
        & near_in_size(F.col("p.x"), F.col("q.x"), percent) & (estimate(F.col("p.x"), F.col("q.x")) >= enough_alike)
    )
    pair = [F.col("p.id").alias("a"), F.col("q.id").alias("b")]
    few = open_.where(F.col("m") <= small).join(reps.select("id", "bands"), "id")
    shared = F.array_position(F.zip_with("p.bands", "q.bands", lambda x, y: x == y), True) == F.col("p.band") + 1  # their first common band
    rest = few.alias("p").join(few.alias("q"), apart & shared).select(*pair)
    many = open_.where(F.col("m") > small).select("id", "component", "x").distinct()
    rare = written(prefixes(many.select("id"), sets, percent).join(many, "id"))
    rare = rare.select(F.posexplode("prefix").alias("at", "key"), "*")
    rarest = F.element_at(F.array_intersect("p.prefix", "q.prefix"), 1) == F.col("p.key")
    n_p, n_q = F.col("p.x.n"), F.col("q.x.n")  # all they can share stands at or after their rarest common shingle
    enough = F.least(n_p - F.col("p.at"), n_q - F.col("q.at")) * (100 + percent) >= (n_p + n_q) * percent
    more = rare.alias("p").join(rare.alias("q"), apart & enough & rarest).select(*pair)
    late = confirmed(rest.unionByName(more).distinct(), sets, percent)
    groups = components(links.unionByName(written(late)))
    least = reps.select("id", "doc_id").join(groups, "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    grouped = groups.join(least, "component")
    ids = reps.select("set_key", "id", F.col("doc_id").alias("own")).join(grouped, "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("group"), F.coalesce("least", "own").alias("least")
    )
    judged = all_.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "row_key", "n", "set_key").join(ids, "set_key")
    alone = all_.where("n = 0 OR doc_id IS NULL").select("doc_id", "row_key", "n", F.col("doc_id").alias("least"), F.lit(None).cast("long").alias("group"))
    return judged.select("doc_id", "row_key", "n", "least", "group").unionByName(alone)


def near_duplicates(docs: DataFrame, small: int = SMALL, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents (doc_id, text); ``percent`` links two of them."""
    rows = _grouped(docs, small, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("least")).alias("kept"))


def _sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, found): the full shingle sets of the representatives that share a bucket with another."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            ids, out = [], []
            for i, key, found in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), shingle_sets(part.column(1)), strict=True):
                if hashlib.blake2b(found.tobytes(), digest_size=16).digest() == key:
                    ids.append(i)
                    out.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "found"])

    need = reps.select("id", "doc_id", "set_key").join(wanted, "id", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(need, "doc_id").select("id", "text", "set_key")
    return texts.mapInArrow(run, "id long, found binary").dropDuplicates(["id"])


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that stay, columns as before: of each group the row of the least (doc_id, hash of its text), and of
    those without shingles one row of each (doc_id, text); rows without a doc_id all stay."""
    rows = _grouped(docs.select("doc_id", "text"), SMALL, percent).where("doc_id IS NOT NULL")
    first = rows.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "row_key")).alias("r")).select("r.*")
    stay = first.unionByName(rows.where("group IS NULL").select("doc_id", "row_key")).select(F.col("doc_id").alias("doc_id_"), F.col("row_key").alias("row_key_")).distinct()
    names, key = docs.columns, f"row_key_{uuid.uuid4().hex[:8]}"
    held = docs.withColumn(key, F.xxhash64("text"))
    held = held.join(stay, (held["doc_id"] == stay["doc_id_"]) & (held[key] == stay["row_key_"]), "left_semi").dropDuplicates(["doc_id", key]).select(*names)
    return held.unionByName(docs.where("doc_id IS NULL"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)
