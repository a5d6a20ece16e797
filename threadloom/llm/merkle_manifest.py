"""A Merkle manifest of a dataset: leaves, subroots of sources, one root, and an inclusion proof for every row.

A row's leaf is the SHA-256 of its fields, each with its length. In each source the leaves stand by doc_id; runs of 16
become nodes until one is left, the subroot; subroots by source become the root in the same way.

Leaves get exact places by a range sort that is written once: rows of a part and a source are counted, and running sums of
those counts are the places where parts begin. Places fall into aligned blocks of 4096 (three levels of 16). A block is one
contiguous matrix of hex digests: reshaped by the fanout, its rows are hashed level by level; a whole tree is a few rounds
over blocks, whose roots are the next round's leaves. On the way down every leaf finds its siblings by index arithmetic
(run ``place // 16``, own column ``place % 16``) and takes over the path of its block. So no task holds more than some blocks,
whatever share of the rows one source has; the driver sees the number of rounds only.

A proof is checked by folding: the leaf, or a tampered one, goes into its place among the siblings of each run up to the root.

Defined results: a null field is ``-``, so null and empty texts differ; equal rows have a leaf each, side by side; rows of one
doc_id and different contents stand by their leaves; a null source is a source of its own, the first one; a null doc_id stands
first and is never tampered with; very long texts meet nothing but the JVM's hash; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table, trimmed, written

FANOUT, LEVELS, HEX = 16, 3, 64
#: A step of a path: the own place in the run and the run's other digests, left to right.
STEPS = "array<struct<at: int, others: binary>>"


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def field(c: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place`` (from 0, in each tree by ``order``) and ``n`` (rows of the tree); equal rows are spread by a number of their own."""
    numbered = rows.withColumn("nth_", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange("tree", *order, "nth_").sortWithinPartitions("tree", *order, "nth_").drop("nth_")
    held = written(ranged.withColumn("in_", F.monotonically_increasing_id()).withColumn("part_", F.spark_partition_id()))
    parts = held.groupBy("part_", "tree").agg(F.count("*").alias("rows_"), F.min("in_").alias("low_"))
    before = Window.partitionBy("tree").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    start = F.coalesce(F.sum("rows_").over(before), F.lit(0)) - F.col("low_")
    starts = parts.select("part_", "tree", start.alias("start_"), F.sum("rows_").over(Window.partitionBy("tree")).alias("n"))
    return held.join(starts, ["part_", "tree"]).withColumn("place", F.col("start_") + F.col("in_")).drop("part_", "in_", "start_")


def levels_of(n: int, levels: int) -> int:
    """How often a block of a tree of n leaves is folded: to its root if it is alone, else as far as whole blocks are."""
    if n > FANOUT**levels:
        return levels
    rounds = 0
    while n > 1:
        n, rounds = -(-n // FANOUT), rounds + 1
    return rounds


def matrices(leaves: np.ndarray, n: int, levels: int) -> list[np.ndarray]:
    """The nodes of a block, leaves first, one array of 64-byte digests for each level."""
    out = [np.ascontiguousarray(leaves)]
    for _ in range(levels_of(n, levels)):
        below = out[-1]
        whole = len(below) // FANOUT
        rows = below[: whole * FANOUT].reshape(whole, FANOUT)
        up = [digest(r.tobytes()) for r in rows]
        if len(below) > whole * FANOUT:
            up.append(digest(below[whole * FANOUT :].tobytes()))
        out.append(np.array(up, f"S{HEX}"))
    return out


def siblings(nodes: list[np.ndarray], place: int) -> list[tuple[int, bytes]]:
    """The steps of the leaf at ``place`` up to its block's root."""
    out = []
    for level in nodes[:-1]:
        first, at = place // FANOUT * FANOUT, place % FANOUT
        run = level[first : first + FANOUT]
        out.append((at, run[:at].tobytes() + run[at + 1 :].tobytes()))
        place //= FANOUT
    return out


def folded(own: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a digest and its path lead to."""
    for at, others in path:
        own = digest(others[: HEX * at] + own + others[HEX * at :])
    return own


def hexes(column: pa.Array) -> np.ndarray:
    """A column of hex digests as one contiguous array."""
    return np.frombuffer(b"".join(column.to_pylist()), f"S{HEX}")


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks (columns tree, block first) of a partition that is sorted by them; what a batch cuts is carried over."""
    carried: list[pa.RecordBatch] = []
    trimmed()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
        pairs = list(zip(*keys, strict=True))
        cuts = [i for i in range(1, len(pairs)) if pairs[i] != pairs[i - 1]]
        if carried and (carried[-1].column(0)[0].as_py(), carried[-1].column(1)[0].as_py()) != pairs[0]:
            cuts.insert(0, 0)
        first = 0
        for i in cuts:
            if i > first:
                carried.append(batch.slice(first, i - first))
            yield pa.Table.from_batches(carried).combine_chunks().to_batches()[0]
            carried, first = [], i
        carried.append(batch.slice(first))
    if carried:
        yield pa.Table.from_batches(carried).combine_chunks().to_batches()[0]


def dealt(nodes: DataFrame, *columns: str) -> DataFrame:
    """Rows of a block together, in order."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").select("tree", "block", "place", "n", "digest", *columns)


def with_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {FANOUT**levels}"))


def block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """tree, place, n, digest of the next round: a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches):
            n = b.column(3)[0].as_py()
            root = matrices(hexes(b.column(4)), n, levels)[-1][0]
            yield pa.RecordBatch.from_arrays([b.column(0)[:1], b.column(1)[:1], pa.array([-(-n // FANOUT**levels)], pa.int64()), pa.array([root], pa.binary())], ["tree", "place", "n", "digest"])

    return dealt(nodes).mapInArrow(run, "tree string, place long, n long, digest binary")


def rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes of all rounds, the leaves first; the last one has a root for each tree. All but the leaves are written once."""
    out = [with_block(nodes, levels)]
    most = out[0].agg(F.max("n")).first()[0] or 0
    while len(out) == 1 or most > 1:
        out.append(with_block(written(block_roots(out[-1], levels)), levels))
        most = -(-most // FANOUT**levels)
    return out


def under(nodes: DataFrame, above: DataFrame, *columns: str) -> DataFrame:
    """Blocks of nodes, each led by one row (place -1) with what ``above`` (tree, block, path, subroot, root) says of the block."""
    none = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in columns]
    heads = above.select("tree", "block", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"), "path", "subroot", "root", *none)
    rows = nodes.select("tree", "block", "place", "n", "digest", F.lit(None).cast(STEPS).alias("path"), *(F.lit(None).cast("binary").alias(c) for c in ("subroot", "root")), *columns)
    return dealt(heads.unionByName(rows), "path", "subroot", "root", *columns)


def led(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[tuple[int, bytes]], bytes | None, bytes]]:
    """Of each block of ``under``: its rows, its matrices, and the path, subroot and root that its leading row has."""
    for b in in_blocks(batches):
        path, rows = [(s["at"], s["others"]) for s in b.column(5)[0].as_py()], b.slice(1)
        yield rows, matrices(hexes(rows.column(4)), rows.column(3)[0].as_py(), levels), path, b.column(6)[0].as_py(), b.column(7)[0].as_py()


def path_array(found: list[list[tuple[int, bytes]]]) -> pa.Array:
    return pa.array([[{"at": at, "others": others} for at, others in p] for p in found], pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())])))


def paths_under(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """tree, place, path, subroot, root of nodes, from those of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, nodes_, rest, subroot, root in led(batches, levels):
            own = path_array([siblings(nodes_, i) + rest for i in range(b.num_rows)])
            same = [pa.array([v] * b.num_rows, pa.binary()) for v in (subroot, root)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), own, *same], ["tree", "place", "path", "subroot", "root"])

    return under(nodes, above).mapInArrow(run, f"tree string, place long, path {STEPS}, subroot binary, root binary")


def block_paths(trees: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """tree, block, path, subroot, root of the blocks of the leaves, from ``above`` (tree, path, subroot, root) of the trees' roots."""
    known = trees[-1].select("tree", F.col("place").alias("block")).join(above, "tree")
    for nodes in reversed(trees[1:-1]):
        known = written(paths_under(nodes, known, levels)).withColumnRenamed("place", "block")
    return known


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of (doc_id, source, lang, n_chars, text).

    ``levels``: those of a block, which has 16 ** levels leaves; any number gives the same digests.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null first, then by bytes
    changed = F.when(tampered(F.col("doc_id")), leaf(F.translate("text", UPPER, LOWER)))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), changed.alias("changed"))
    # written first: a range sort reads its rows twice, and texts are hashed once
    sources = rounds(placed(written(rows), ["doc_id", "leaf"]).withColumn("digest", F.encode("leaf", "UTF-8")), levels)
    # the same again, with the sources' roots as leaves of one tree
    top = rounds(placed(sources[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"]), levels)
    ends = top[-1].select("tree", F.array().cast(STEPS).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    ranks = top[0].select("place", "source", F.col("digest").alias("subroot"))
    of_sources = written(paths_under(top[0], block_paths(top, ends, levels), levels).drop("subroot", "tree").join(ranks, "place").drop("place")).withColumnRenamed("source", "tree")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, nodes, rest, subroot, root in led(batches, levels):
            tail, proof, ends, met = b"".join(others for _, others in rest), [], [], {}
            for i, other in enumerate(b.column(9).to_pylist()):
                own = siblings(nodes, i)
                proof.append(digest(b"".join(others for _, others in own) + tail).decode())
                here = folded(other.encode() if other else bytes(nodes[0][i]), own)
                if here not in met:  # what leads on from here is the same for the whole block
                    met[here] = folded(here, rest)
                ends.append(met[here])
            same = [pa.array([v.decode()] * len(ends)) for v in (subroot, root)]
            yield pa.RecordBatch.from_arrays(
                [b.column(8), b.column(4).cast(pa.string()), *same, pa.array(proof), pa.array([e.decode() for e in ends]), pa.array([e == root for e in ends])],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return under(sources[0], block_paths(sources, of_sources, levels), "doc_id", "changed").mapInArrow(
        prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _levels(k: int, nodes: str, name: str) -> str:
    """CTEs of k levels above ``nodes`` (tree, p, n, d): runs and the nodes they become."""
    out, below = [], nodes
    for i in range(1, k + 1):
        out.append(f"{name}_run{i} AS (SELECT tree, p // 16 AS p, any_value(n) AS n, list(d ORDER BY p) AS r FROM {below} GROUP BY tree, p // 16)")
        below = f"{name}{i}"
        out.append(f"{below} AS (SELECT tree, p, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(r, '')) ELSE r[1] END AS d FROM {name}_run{i})")
    return ", ".join(out)


def _climb(k: int, start: str, name: str, out: str) -> str:
    """CTEs that add each level's siblings to ``proof`` and fold ``d`` on, for rows of ``start`` (id, tree, p, d, proof)."""
    ctes, below = [], start
    for i in range(1, k + 1):
        this = out if i == k else f"{out}{i}"
        ctes.append(
            f"{this} AS (SELECT x.* REPLACE (x.p // 16 AS p, CASE WHEN n > 1 THEN proof || array_to_string(r[1 : x.p % 16], '') || array_to_string(r[x.p % 16 + 2 :], '') ELSE proof END AS proof, "
            f"CASE WHEN n > 1 THEN sha256(array_to_string(r[1 : x.p % 16], '') || x.d || array_to_string(r[x.p % 16 + 2 :], '')) ELSE x.d END AS d) "
            f"FROM {below} x JOIN {name}_run{i} y ON x.tree = y.tree AND x.p // 16 = y.p)"
        )
        below = this
    return ", ".join(ctes)


def _sql() -> str:
    say = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    hashed = lambda text: f"sha256({' || '.join(map(say, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    k = 5  # levels: a million rows a source, and as many sources
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)), lambda c, b: xor(c >> 8, bits[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
    return f"""
WITH RECURSIVE steps AS (SELECT range AS i, 0 AS k, range::BIGINT AS v FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM steps WHERE k < 8),
bits AS (SELECT list(v ORDER BY i) AS bits FROM steps WHERE k = 8),
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {hashed("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents, bits),
s0 AS (SELECT *, leaf AS d, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_levels(k, "s0", "s")},
t0 AS (SELECT '' AS tree, tree AS source, d, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM s{k}),
{_levels(k, "t0", "t")},
low AS (SELECT doc_id, leaf, tree, p, '' AS proof, coalesce(changed, leaf) AS d FROM s0),
{_climb(k, "low", "s", "mid")},
turn AS (SELECT m.doc_id, m.leaf, t0.d AS subroot, '' AS tree, t0.p, m.proof, m.d FROM mid m JOIN t0 ON m.tree = t0.source),
{_climb(k, "turn", "t", "high")}
SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, h.d AS folded_root, h.d = t.d AS verified FROM high h JOIN t{k} t ON h.tree = t.tree
"""


ORACLE = _sql()
