"""Each query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from threadloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    clean = lambda v: None if v is None else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(str([clean(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(got) == plain(want)


def test_no_caps(spark, tmp_path):
    spellings = ["".join(c.upper() if i >> k & 1 else c for k, c in enumerate("abcdefghijklmn")) for i in range(10_050)]
    spark.createDataFrame([(1, 0, ",".join(spellings)), (1, 1, ",".join(f"t{i}" for i in range(1200)))], "conv_id long, turn long, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    letters = "".join(chr(0x4E00 + i) for i in range(10_050))
    spark.createDataFrame([(1, letters), (2, letters[5000:])], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("token_identities", "neighbour_dice"):
        df = QUERIES[name](spark, f"file://{tmp_path}")
        columns = sorted(df.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
        assert plain([tuple(r) for r in df.select(*columns).collect()]) == plain(want), name
