"""Packing into fixed windows by best-fit decreasing.

A document's ids are followed by the end id; full windows are cut off first and fill a sequence each. The remainders
are dealt by hash to groups of about ``group_rows``, and each group is packed on its own: pieces by falling length, each
into the open window with the tightest room, found in a segment tree whose leaves are room sizes. A group leaves at
most a window or so half filled, so padding falls with ``group_rows`` and no task grows with the input.

Tokenising keeps a bounded cache of white-space separated chunks: this tokenizer's pieces never
cross white space, so ids of a text are the ids of its chunks one after the other. A very long text is tokenised whole.

Defined results: a null text is empty and yields the end id alone; repeated rows are packed as often as they come;
equal lengths stand by doc_id, then crc; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import light_batches, slices, table, words_of, written

WINDOW, END, GROUP_ROWS, CACHE, SLICE = 2048, 1, 4000, 120_000, 2 << 20
#: A comma or full stop at the end of a word, after a Latin-1 letter; it is a piece of its own, and words without it are fewer.
#: Only these letters: of some others (U+0130, U+0958 and more) the tokenizer's normal form ends in a mark, which joins the sign.
MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,])([ \t\n\v\f\r]|$)"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECE + ", sequence_id long, offset long"


def byte_letters() -> dict[int, str]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class ChunkIds:
    """Ids of texts. Words are told apart and counted off in Arrow; only the distinct ones of a slice are looked up, in a
    cache of two generations of which the elder is dropped when the younger is full."""

    def __init__(self, path: str, most: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.encoder, self.most, self.seen, self.old = Tokenizer.from_file(path), most, {}, {}
        self.model, self.letters = self.encoder.model, byte_letters()

    def _learn(self, chunks: list[bytes]) -> None:
        seen, easy, hard, ids, ends = self.seen, [], [], [], []
        for c in chunks:
            if (known := self.old.get(c)) is not None:
                seen[c] = known
            elif (w := c.decode("utf-8", "surrogatepass")).isalpha() and w == w.lower() and (w.isascii() or unicodedata.is_normalized("NFC", w)):
                easy.append(c)  # one piece that no normaliser changes
            else:
                hard.append(c)
        for c in easy:
            ids += [t.id for t in self.model.tokenize(c.decode("latin-1").translate(self.letters))]
            ends.append(4 * len(ids))
        for e in self.encoder.encode_batch_fast([c.decode("utf-8", "surrogatepass") for c in hard], add_special_tokens=False) if hard else ():
            ids += e.ids
            ends.append(4 * len(ids))
        flat = np.array(ids, "<u4").tobytes()
        seen.update(zip(easy + hard, (flat[a:b] for a, b in itertools.pairwise([0, *ends])), strict=True))

    def of_words(self, words: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each of some distinct words."""
        if len(self.seen) > self.most:
            self.old, self.seen = self.seen, {}
        self._learn([w for w in words if w not in self.seen])
        return list(map(self.seen.__getitem__, words))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        texts = texts.fill_null("")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # special tokens are found before letters are lowered
        texts = pc.replace_substring_regex(texts, MARK, r"\1 \2\3")
        words, numbers, lengths = words_of(texts, lower=False)
        ids = self.of_words(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(starts[numbers] - ends[:-1], n) + np.arange(ends[-1])]
        return out, np.diff(ends[np.concatenate([[0], np.cumsum(lengths)])])


@lru_cache(1)
def chunk_ids(path: str, most: int) -> ChunkIds:
    """One for a worker process: its tasks go on with the words that those before have met."""
    return ChunkIds(path, most)


class TightestRoom:
    """Open windows by their room; a segment tree over room sizes counts the windows at or below each node."""

    def __init__(self, window: int):
        self.n = 1 << window.bit_length()
        self.tree, self.at = [0] * (2 * self.n), [[] for _ in range(self.n)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.n
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window of least room >= need, and that room."""
        i = need + self.n
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.n:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.n
        self._add(room, -1)
        return self.at[room].pop(), room


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """For each piece, given by falling length: its window and the offset there."""
    tree, out, opened = TightestRoom(window), [], 0
    for n in lengths:
        found = tree.take(n)
        k, room = found or (opened, window)
        opened += found is None
        out.append((k, window - room))
        if room > n:
            tree.put(room - n, k)
    return out


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, cache: int = CACHE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece: full windows and a remainder. ``cache``: chunks in a generation, about 200 bytes each; any number gives the same ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = chunk_ids(tokenizer, cache), END.to_bytes(4, "little")
        for part in slices(batches, 1, SLICE):
            out = [[], [], [], [], []]
            flat, sizes = ids_of(part.column(1))
            flat, at = flat.tobytes(), 0
            for doc, size in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                ids, n, at = flat[4 * at : 4 * (at + size)] + end, size + 1, at + size
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    for column, v in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return light_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def packed(cut: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Places pieces: adds sequence_id (unique, not dense) and offset."""
    cut = written(cut)
    rest = cut.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group_rows))
    whole = cut.where(F.col("length") == window)
    salted = rest.withColumn("g", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start", F.monotonically_increasing_id()), F.lit(groups)))

    def place(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "ids_crc32"], ascending=[False, True, True], kind="stable")
        placed = best_fit_decreasing(pdf["length"].tolist(), window)
        first = int(key[0]) << 32
        return pdf.drop(columns="g").assign(sequence_id=[first + k for k, _ in placed], offset=[o for _, o in placed])

    few = salted.groupBy("g").applyInPandas(place, PLACED)
    alone = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return few.unionByName(alone)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents"), tokenizer_path()))
