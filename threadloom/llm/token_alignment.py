"""Alignment of two tokenizers' tokens, and how often their ids are linked in the corpus.

Both tokenizers cut the same bytes. A token of A and one of B that overlap are joined in a bipartite graph; union-find over its
edges gives components, which are the smallest groups that begin and end where both have a boundary. Inside a group every
A-B pair is a link.

One pass over the texts tokenises, aligns and gathers, block by block (about 16 MB of text or one long text): each document's
distinct linked id pairs with their numbers, and in how many documents of the block each pair occurs. Blocks are written
once. The pairs' documents are summed in Spark, the highest sum of each A id is joined on, and every block gets the sums of
its own pairs back: pairs travel once for each block, never once for each link, and nothing is broadcast or collected.

Texts are cut into chunks where a blank, tab or line feed follows a character that is no white space. Neither
tokenizer has a token across such a place (checked on the vocabulary of B when it is loaded; a tokenizer that has one gets
whole texts), so a chunk's tokens do not depend on its surroundings; a bounded cache keeps those of chunks that were met.

Defined results: null and empty texts, and texts whose joined bytes of A or B differ from blank + text (such as one with
U+2581), have no tokens: zeros and an empty ``groups_sha256``; special tokens' strings are plain text; repeated rows are documents
each; a very long text is a block of its own, tokenised whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import light_batches, slices, table, written
from .packing import byte_letters

BLOCK_BYTES, CACHE, CACHE_CHARS = 16 << 20, 400_000, 32 << 20
#: White space, the part of it that may begin a chunk, and the rest.
_RARE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE, FIRST, OTHER = "\t-\r " + _RARE, " \n\t", "\x0b-\r" + _RARE
CHUNK = re.compile(f"[{WHITE}]*+(?:[^{WHITE}]++(?:[{OTHER}][{WHITE}]*+)?+)*+")
ACROSS = re.compile(f"[^{WHITE}▁][{FIRST}▁]")
BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, n_pairs array<long>, places binary, times binary, pairs array<long>, docs array<long>"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over n nodes: the least node of each node's component. Edges whose ends have different roots hang the larger
    root under the smaller one, then all paths are halved until they are flat; again while an edge has two roots."""
    parent = np.arange(n)
    while True:
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        if not apart.any():
            return parent
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, in order, of the tokens of A and B, from the byte offsets where they end (the last ones are equal)."""
    bounds = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted runs, merged
    bounds = bounds[np.concatenate([bounds[1:] != bounds[:-1], [True]])] if len(bounds) else bounds
    a, b = np.searchsorted(ends_a, bounds), np.searchsorted(ends_b, bounds)  # each stretch between bounds is in one token of A and one of B
    root = components(len(ends_a) + len(ends_b), a, len(ends_a) + b)
    at = np.cumsum(root == np.arange(len(root))) - 1  # roots are tokens of A, as those come first
    group = at[root]
    return group[: len(ends_a)], group[len(ends_a) :]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


def summed(first: np.ndarray, second: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of two keys, sorted, and the sums of ``times``."""
    if not len(times):
        return first, second, times
    order = np.argsort(first * (int(second.max()) + 1) + second)
    first, second, times = first[order], second[order], times[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    return first[new], second[new], np.add.reduceat(times, np.flatnonzero(new))


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def lengths(*lists: list[list[int]]) -> Iterator[np.ndarray]:
    return (np.fromiter(map(len, x), np.int64, len(x)) for x in lists)


def flats(*lists: list[list[int]]) -> Iterator[np.ndarray]:
    return (np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in lists)


class Aligner:
    """Chunks' tokens of both tokenizers, their groups and their links; see the module's text."""

    def __init__(self, path_a: str, path_b: str, most: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), most
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in byte_letters().items()}
        entries = {i: e for e, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [bytes(letters.get(c, 0) for c in entries.get(i, "")) for i in range(max(entries) + 1)]  # special entries never come up
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.whole = any(map(ACROSS.search, pieces))
        self.head = self.b.encode("x")
        self.many = len(pieces)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.held = 0
        self.text: list[str | None] = []  # the groups' text; None if bytes differ
        self.sizes = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, distinct pairs
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        if self.whole:
            return [" " + text]
        out = CHUNK.findall(" " + text)
        out.pop()  # the empty match at the end
        return out

    def learn(self, chunks: list[str]) -> None:
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        if self.whole:
            b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        else:
            b = [ids[len(self.head) :] for ids in self.b.encode(["x" + c for c in chunks], num_threads=1)]
        n_a, n_b, flat_a, flat_b = *lengths(a, b), *flats(a, b)
        raw = [c.encode() for c in chunks]
        size_a, size_b = self.length_a[flat_a], self.length_b[flat_b]
        owner_a, owner_b = np.repeat(np.arange(len(chunks)), n_a), np.repeat(np.arange(len(chunks)), n_b)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        same = (np.bincount(owner_a, size_a, minlength=len(raw)) == size) & (np.bincount(owner_b, size_b, minlength=len(raw)) == size)
        joined = [b"".join(map(of.__getitem__, flat.tolist())) for of, flat in ((self.bytes_a, flat_a), (self.bytes_b, flat_b))]
        if not same.all() or joined[0] != joined[1] or joined[0] != b"".join(raw):
            said = [[b"".join([of[i] for i in ids]) for ids in x] for of, x in ((self.bytes_a, a), (self.bytes_b, b))]
            same = np.array([x == y == c for x, y, c in zip(*said, raw, strict=True)], bool)
            a, b = [x if g else [] for x, g in zip(a, same, strict=True)], [y if g else [] for y, g in zip(b, same, strict=True)]
            n_a, n_b, flat_a, flat_b = *lengths(a, b), *flats(a, b)
            size_a, size_b = self.length_a[flat_a], self.length_b[flat_b]
        good = same.tolist()
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        group_a, group_b = aligned(ends_a, ends_b)
        (start_a, size_a), (start_b, size_b) = runs(group_a), runs(group_b)
        chunk_of = np.repeat(np.arange(len(chunks)), n_a)[start_a] if len(start_a) else start_a  # of each group
        n_groups = np.bincount(chunk_of, minlength=len(chunks))
        n_links = np.bincount(chunk_of, size_a * size_b, minlength=len(chunks)).astype(np.int64)
        # distinct ids of each group, paired
        g_a, id_a, times_a = summed(group_a, flat_a, np.ones(len(flat_a), np.int64))
        g_b, id_b, times_b = summed(group_b, flat_b, np.ones(len(flat_b), np.int64))
        first_b, count_b = runs(g_b)
        n = count_b[g_a] if len(g_a) else g_a
        right = gathered(first_b[g_a], n) if len(g_a) else g_a
        pairs, times = np.repeat(id_a, n) * self.many + id_b[right], np.repeat(times_a, n) * times_b[right]
        owner, pairs, times = summed(np.repeat(chunk_of[g_a], n) if len(g_a) else g_a, pairs, times)
        said_a, said_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        groups = [
            f"{said_a[i]}|{said_b[j]}" if p == q == 1 else f"{','.join(said_a[i : i + p])}|{','.join(said_b[j : j + q])}" for i, p, j, q in zip(start_a.tolist(), size_a.tolist(), start_b.tolist(), size_b.tolist(), strict=True)
        ]
        ends, first = np.cumsum(n_groups).tolist(), 0
        base = len(self.text)
        for k, (c, g, end) in enumerate(zip(chunks, good, ends, strict=True)):
            self.at[c] = base + k
            self.text.append(";".join(groups[first:end]) if g else None)
            self.held += len(c)
            first = end
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, n_links, np.bincount(owner, minlength=len(chunks))], 1).astype(np.int64)])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens of A and B, groups and links (columns of the first array), and the digest of its groups. Then
        distinct (text, pair) with the number of links, as three arrays sorted by text."""
        if len(self.at) > self.most or self.held > CACHE_CHARS:
            self.clear()
        cut = [self.chunks(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        self.learn([c for c in dict.fromkeys(flat) if c not in self.at])
        codes = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        digests, keep, first = [], np.ones(len(flat), bool), 0
        for chunks in cut:
            said = list(map(self.text.__getitem__, codes[first : first + len(chunks)].tolist()))
            if None in said:
                keep[first : first + len(chunks)] = False
                said = []
            digests.append(hashlib.sha256(";".join(said).encode()).hexdigest() if said else "")
            first += len(chunks)
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])[keep]
        owner, code, times = summed(owner, codes[keep], np.ones(int(keep.sum()), np.int64))
        sizes = np.stack([np.bincount(owner, self.sizes[code, k] * times, minlength=len(texts)) for k in range(4)], 1).astype(np.int64)
        n = self.sizes[code, 4]
        at = gathered((np.cumsum(self.sizes[:, 4]) - self.sizes[:, 4])[code], n)
        owner, pairs, times = summed(np.repeat(owner, n), self.pairs[at], self.times[at] * np.repeat(times, n))
        return sizes, digests, owner, pairs, times


@lru_cache(1)
def aligner(path_a: str, path_b: str, most: int) -> Aligner:
    """One for a worker process: its tasks go on with the chunks that those before have met."""
    return Aligner(path_a, path_b, most)


def packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<u4").tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64)


def blocks_of(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES, cache: int = CACHE) -> DataFrame:
    """A row for each block: its documents' figures, their pairs (places in the block's list) and that list with its documents."""

    def block(number: int, parts: list[tuple]) -> pa.RecordBatch:
        ids = list(chain.from_iterable(p[0] for p in parts))
        sizes, digests = np.concatenate([p[1] for p in parts]), list(chain.from_iterable(p[2] for p in parts))
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        owner = np.concatenate([p[3] + s for p, s in zip(parts, shift[:-1], strict=True)])
        pairs, place = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True)
        times, n = np.concatenate([p[5] for p in parts]), np.bincount(owner, minlength=len(ids))
        place = place.astype(np.int64)  # rises in each document, so that steps are small
        steps = np.diff(place, prepend=0)
        first = (np.cumsum(n) - n)[n > 0]
        steps[first] = place[first]
        row = [number, ids, *(sizes[:, k].tolist() for k in range(4)), digests, n.tolist(), packed(steps), packed(times), pairs, np.bincount(place, minlength=len(pairs))]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    long_, longs = pa.int64(), pa.list_(pa.int64())
    kinds = [long_, longs, longs, longs, longs, longs, pa.list_(pa.string()), longs, pa.binary(), pa.binary(), longs, longs]
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, number, parts, held = aligner(path_a, path_b, cache), TaskContext.get().partitionId() << 32, [], 0
        for b in slices(batches, 1):
            if held and held + b.nbytes > block_bytes:
                yield block(number, parts)
                number, parts, held = number + 1, [], 0
            held += b.nbytes
            parts.append((b.column(0).to_pylist(), *align(b.column(1).to_pylist())))
        if parts:
            yield block(number, parts)

    return light_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of documents (doc_id, text)."""
    import sentencepiece

    many = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    blocks = written(blocks_of(docs, path_a, path_b, block_bytes))
    named = blocks.select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = named.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"pair div {many}"))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    home = named.select("block", "pair").join(counts, "pair").select(F.col("block").alias("of_block"), "pair", "count", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        count, best = (right.column(c).to_numpy() for c in ("count", "best"))
        outs = []
        for row in left.to_batches():
            cell = lambda c: row.column(c)[0]  # noqa: B023, E731
            n = np.array(cell("n_pairs").as_py(), np.int64)
            steps, times = unpacked(cell("places").as_py()), unpacked(cell("times").as_py())
            ends = np.cumsum(n)
            walked = np.cumsum(steps)
            place = walked - np.repeat(np.concatenate([[0], walked])[ends - n], n)
            tally = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])])  # noqa: B023, E731
            same = {c: pa.array(cell(c).values) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            outs.append(pa.table(same | {"n_best": tally(times * best[place]), "count_sum": tally(times * count[place]), "groups_sha256": pa.array(cell("groups").values)}))
        return pa.concat_tables(outs) if outs else pa.table({f.split()[0]: pa.array([], pa.string() if "string" in f else pa.int64()) for f in OUT.split(", ")})

    rest = blocks.drop("pairs", "docs")
    return rest.groupBy("block").cogroup(home.groupBy("of_block")).applyInArrow(finish, OUT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
