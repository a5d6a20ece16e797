"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; a local one is set only where that is unset."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    now = context._jsc.sc().getCheckpointDir()
    if where is None and now.isDefined():
        return now.get()
    if where is None:
        where = f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
    if not now.isDefined():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def light_batches(df: DataFrame, rows: int = 1000, size: str = "4m") -> DataFrame:
    """The frame, after the session's Arrow batches are set to ``rows`` rows and ``size`` bytes where they have Spark's defaults
    (10,000 rows, 64 MB): whole texts travel in them, and a batch stands in the executor and in its worker at once. A session's
    own numbers stay."""
    conf = df.sparkSession.conf
    for name, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size)):
        if conf.get(name) == default:
            conf.set(name, value)
    return df


def sliced(batch: pa.RecordBatch, at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts (column ``at``) have about ``most`` bytes together, one row at least: what a worker
    holds follows from that and from its longest text, not from the number of rows in a batch."""
    ends = np.cumsum(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All batches of a task, ``sliced``; what the worker's task before, and the last slices, have left is given back."""
    trimmed()
    held = 0
    for batch in batches:
        for part in sliced(batch, at, most):
            yield part
            held += 1
            if held % 4 == 0:
                trimmed()
    trimmed()


def trimmed() -> None:
    """Give memory that is free in this process back to the machine: workers are used again by later stages, and what the
    allocators hold of large arrays adds up with the next stage's own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts (as bytes), the number of each word among them in order, and how many words each text has.

    Words are what ASCII white space parts, as in ``bytes.split``; A-Z are lowered if asked; a null text has none.
    """
    texts = texts.fill_null("")
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    found = cut.flatten().dictionary_encode()
    words, numbers, offsets = found.dictionary, found.indices.to_numpy(), cut.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    blank = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)  # what stands before a leading and after a trailing blank
    if len(blank):
        keep = numbers != blank[0]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        numbers = numbers[keep]
    kind = pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()
    return words.cast(kind).to_numpy(zero_copy_only=False), numbers, np.diff(offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words of the texts, and how many words each text has."""
    import xxhash

    words, numbers, lengths = words_of(texts)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[numbers], lengths


def written(df: DataFrame) -> DataFrame:
    """The frame, computed once, written to the shared folder and read back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for small frames of iterative jobs."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ascii_lower(c: Column) -> Column:
    """A-Z only, as the contracts ask; ``lower`` would change other letters too."""
    return F.translate(c, UPPER, LOWER)


def width(df: DataFrame) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
