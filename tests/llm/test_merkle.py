"""op13 against a plain tree in Python and against its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom.llm import merkle_manifest

from .test_llm import empty, low, odd  # noqa: F401

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root, and of each leaf the runs on its way: (place in the run, run)."""
    ways, nodes, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for way, k in zip(ways, at, strict=True):
            way.append((k % 16, runs[k // 16]))
        at, nodes = [k // 16 for k in at], [h(*r) for r in runs]
    return nodes[0], ways


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault("" if r[1] is None else "=" + r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    keys = sorted(by, key=lambda k: k.encode())
    trees = [tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in keys]
    root, ups = tree([t[0] for t in trees])
    out = []
    for k, (subroot, ways), up in zip(keys, trees, ups, strict=True):
        for (_, _, own, r), way in zip(sorted(by[k], key=lambda x: x[:3]), ways, strict=True):
            now = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = leaf((*r[:4], None if r[4] is None else low(r[4])))
            proof = "".join("".join(run[:i] + run[i + 1 :]) for i, run in way + up)
            for i, run in way + up:
                now = h(*run[:i], now, *run[i + 1 :])
            out.append((r[0], own, subroot, root, h(proof), now, now == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def rows_of(df):
    return [tuple(r) for r in df.select(*FIELDS).collect()]


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_op13_against_plain_trees(spark, odd, sf_dir, which):  # noqa: F811
    path = odd if which == "odd" else sf_dir
    want = brute(rows_of(spark.read.parquet(f"{path}/documents.parquet")))
    assert got(merkle_manifest.op13_merkle_manifest(spark, path)) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("levels", [1, 3])
def test_op13_blocks_and_rounds(spark, levels):
    """A source of 5000 rows (two blocks of 4096; of 16: four rounds), 300 sources of one row, 17 and 257 rows at the edges."""
    n = F.col("id")
    source = F.when(n < 5000, F.lit("hot")).when(n < 5017, F.lit("x17")).when(n < 5274, F.lit("x257")).when(n < 5290, F.lit(None)).otherwise(F.concat(F.lit("é"), n))
    docs = spark.range(5590).select(n.alias("doc_id"), source.alias("source"), F.lit("en").alias("lang"), n.alias("n_chars"), F.concat(F.lit("Text "), n % 7).alias("text")).repartition(5, "text")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0"))  # repeated rows
    assert got(merkle_manifest.manifest(docs, levels)) == brute(rows_of(docs))


def test_op13_sql(spark, odd, sf_dir):  # noqa: F811
    for path, files in ((sf_dir, f"{sf_dir}/documents.parquet"), (odd, f"{odd[len('file://'):]}/documents.parquet/*.parquet")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
        df = merkle_manifest.op13_merkle_manifest(spark, path)
        want = con.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle_manifest.ORACLE})").fetchall()
        assert got(df) == sorted(want, key=str)
