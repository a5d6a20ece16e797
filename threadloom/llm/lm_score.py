"""Trigram scores of whole texts from Elias-Fano tries, one per shard of contexts.

Exchanges of packed columns, each dealt by a hash and none through the driver:
1. Texts become tokens; every task sends the distinct words of a block with their training counts to word shards, which
   add them up and send back dense ids (falling by count within the shard) and counts. The tokens wait in a written table.
2. Words that make up ``FREQUENT`` or more of the training tokens (at most 1 / FREQUENT of them) would fill a shard with
   their successors. Blocks count their distinct pairs (u, w) and deal them by a hash of the pair; totals come back, and
   the numbers of tokens and types after u, so that p(w | u) is known without one shard for u.
3. A block of documents meets its ids and counts. The base score is made there; its *distinct* n-grams (v, u, w), with
   their training counts, go to the shard of their last context word u, or of the pair (v, u) if u is frequent, with
   log p(w), or log p(w | u), at hand, and the list of documents that each n-gram is met in.
4. A shard builds its trie from the training n-grams, maps it from files of its own temporary folder, and looks up all
   n-grams; the sums of their codes go back to the block by document and are added.

The model: p(w) = (c + 1) / (N + V + 1); Witten-Bell interpolation for p(w | u) and p(w | v, u), for all words u and pairs
at every size. The first token is scored by p(w). Log probabilities are multiples of one step, so scores do not depend on
the number of blocks, shards or partitions.

There is a shard for every ``SHARD_TOKENS`` training tokens. A word of just under ``FREQUENT``, or a pair of words, still has
all its n-grams in one shard: once for each block at most, however often a block repeats them, with four bytes for each
occurrence beside.

Defined results: a null or empty text is its end token alone; very long texts are blocks of their own; without training
tokens every token has probability 1 / (N + V + 1) = 1; repeated rows are scored each, and count each in training; a null
doc_id counts as an empty text of the id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import light_batches, slices, table, trimmed, width, word_hashes, written
from .ef_trie import Trie, quantised

BLOCK_TOKENS, SHARD_TOKENS, FREQUENT = 2_000_000, 800_000, 0.002
END, START = 0x9E3779B97F4A7C15, 0xFFFFFFFE  # hash of the end token; id of what stands before the first


def _pack(*columns: np.ndarray) -> bytes:
    """Columns byte plane by byte plane, compressed."""
    import zstandard

    parts = []
    for x in columns:
        x = np.ascontiguousarray(x)
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
        body = zstandard.ZstdCompressor(level=1).compress(planes)
        parts.append(x.dtype.str.encode().ljust(4) + len(x).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body)
    return b"".join(parts)


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    out, at = [], 0
    while at < len(blob):
        kind, n, size = np.dtype(blob[at : at + 4].decode().strip()), int.from_bytes(blob[at + 4 : at + 12], "little"), int.from_bytes(blob[at + 12 : at + 20], "little")
        planes = zstandard.ZstdDecompressor().decompress(blob[at + 20 : at + 20 + size], max_output_size=max(1, n * kind.itemsize))
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += 20 + size
    return out


def held_out_of(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def blocks(docs: DataFrame, word_shards: int) -> DataFrame:
    """(block, blob, words): a block's documents and tokens, and the hashes of its distinct words, by word shard. A block's
    number is its task's and its own within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, end = TaskContext.get().partitionId() << 32, np.array([END], np.uint64)
        ids, tokens, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths, all_ = np.array([len(t) for t in tokens], np.uint32), np.concatenate(tokens)
            tokens.clear()
            words, local = np.unique(all_, return_inverse=True)
            del all_
            shard = (words % np.uint64(word_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")  # local numbers run through the word shards in turn
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            local, words = place[local], words[order]
            out = np.array([held_out_of(i) for i in ids], bool)
            known = np.array([i is not None for i in ids], bool)
            doc = np.array([i or 0 for i in ids], np.int64)
            row = number, _pack(doc, known.view(np.uint8), out.view(np.uint8), lengths, local), words.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "blob", "words"])

        for b in slices(batches, 1):
            hashes, lengths = word_hashes(b.column(1))
            ends = np.cumsum(lengths)
            for doc, n, to in zip(b.column(0).to_pylist(), lengths.tolist(), ends.tolist(), strict=True):
                ids.append(doc)
                tokens.append(np.concatenate([hashes[to - n : to], end]))
                size += n + 1
                if size >= BLOCK_TOKENS:
                    yield from flush()
                    trimmed()
                    ids, size, number = [], 0, number + 1
        if ids:
            yield from flush()

    return light_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, blob binary, words binary")


PARTS = "block long, shard long, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["block", "shard", "blob"])


def word_ids(cut: DataFrame, word_shards: int) -> DataFrame:
    """(block, shard, blob): ids and counts of each block's words; shard -1: a shard's training tokens and types, and the
    hashes and counts of those words that may be frequent (they are so in their shard; at most 1 / FREQUENT)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x) for x in pdf["blob"]]
        sizes = [len(p[0]) for p in parts]
        words, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c = np.bincount(back, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(words))
        ids = rank * word_shards + key[0]
        at = np.split(back, np.cumsum(sizes)[:-1])
        rows = [(b, key[0], _pack(ids[i], c[i])) for b, i in zip(pdf["block"], at, strict=True)]
        often = c >= max(1, FREQUENT * c.sum())
        return pd.DataFrame([*rows, (0, -1, _pack(np.array([c.sum(), (c > 0).sum()]), words[often], c[often]))], columns=["block", "shard", "blob"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, _, out, lengths, local = _unpack(blob)
                words = np.frombuffer(words, np.uint64)
                counts = np.bincount(local[np.repeat(out == 0, lengths)], minlength=len(words)).astype(np.uint32)
                ends = np.searchsorted((words % np.uint64(word_shards)).astype(np.int64), np.arange(word_shards + 1)).tolist()
                yield _rows([(block, s, _pack(words[i:j], counts[i:j])) for s, (i, j) in enumerate(itertools.pairwise(ends)) if j > i])

    return cut.mapInArrow(deal, PARTS).groupBy("shard").applyInPandas(run, PARTS)


def _told(parts: DataFrame, rows_of) -> DataFrame:
    """(kind, key, n) of what shards tell of themselves (their rows of shard -1), by ``rows_of`` a row's arrays, for Spark to add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(np.uint64).view(np.int64)) for c in rows_of(*_unpack(blob))], ["kind", "key", "n"])

    return parts.where("shard < 0").select("blob").mapInArrow(run, "kind long, key long, n long")


def _totals(ids: DataFrame) -> tuple[int, int, np.ndarray]:
    """Training tokens, types, and the sorted hashes of frequent words other than the end. Shards' sums and candidates are added up and cut in Spark;
    what comes to the driver are the frequent words, of which there are at most 1 / FREQUENT."""
    told = _told(ids, lambda sums, words, counts: (np.concatenate([[0, 1], np.full(len(words), 2)]), np.concatenate([np.zeros(2, np.uint64), words.astype(np.uint64)]), np.concatenate([sums, counts])))
    total, types = told.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in (0, 1))).first()
    often = told.where((F.col("kind") == 2) & (F.col("n") >= FREQUENT * total)).select("key").collect()
    words = np.array([r["key"] for r in often], np.int64).view(np.uint64)
    return int(total), int(types), np.sort(words[words != np.uint64(END)])


def _begins(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths.astype(np.int64))
    return ends - lengths


def _followers(local: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all tokens but the first of each document."""
    some = np.ones(len(local), bool)
    some[_begins(lengths)] = False
    return np.flatnonzero(some)


def _pairs_after(frequent: np.ndarray, local: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (u, w) of a block whose u is frequent, as u << 32 | w of local numbers in order; places of their second
    words, and the pair at each."""
    at = _followers(local, lengths)
    at = at[frequent[local[at - 1]]]
    return *np.unique(local[at - 1].astype(np.int64) << 32 | local[at], return_inverse=True), at


def pair_counts(cut: DataFrame, often: np.ndarray, shards: int) -> DataFrame:
    """(block, shard, blob): which of a block's pairs with a frequent first word a shard has, their training counts, and the number
    of the first word among frequent ones; shard -1: types after each frequent word, of one shard of pairs."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, _, out, lengths, local = _unpack(blob)
                words = np.frombuffer(words, np.uint64)
                which = np.minimum(np.searchsorted(often, words), max(0, len(often) - 1))
                keys, of_pair, at = _pairs_after(often[which] == words if len(often) else np.zeros(len(words), bool), local, lengths)
                u, w = keys >> 32, keys & 0xFFFFFFFF
                mixed = (words[w] ^ words[u] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
                train = np.repeat(out == 0, lengths)[at]
                counts = np.bincount(of_pair[train], minlength=len(keys)).astype(np.uint32)
                shard = ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
                order, rows = np.argsort(shard, kind="stable"), []
                for s, i in zip(*_runs(shard[order]), strict=True):
                    i = order[i]
                    rows.append((block, s, _pack(np.diff(i, prepend=0).astype(np.uint32), mixed[i], counts[i], which[u[i]].astype(np.uint16))))
                yield _rows(rows)

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x) for x in pdf["blob"]]
        pairs, first, back = np.unique(np.concatenate([p[1] for p in parts]), return_index=True, return_inverse=True)
        c = np.bincount(back, np.concatenate([p[2] for p in parts]), len(pairs)).astype(np.uint32)
        which = np.concatenate([p[3] for p in parts])[first]
        at = np.split(back, np.cumsum([len(p[0]) for p in parts])[:-1])
        rows = [(b, key[0], _pack(p[0], c[i], p[3])) for b, i, p in zip(pdf["block"], at, parts, strict=True)]
        return pd.DataFrame([*rows, (0, -1, _pack(np.bincount(which[c > 0], minlength=len(often))))], columns=["block", "shard", "blob"])

    return cut.mapInArrow(deal, PARTS).groupBy("shard").applyInPandas(add, PARTS)


def _distinct(local: np.ndarray, lengths: np.ndarray, n_words: int) -> tuple[np.ndarray, ...]:
    """The distinct n-grams (u, v, w) of a block as local numbers (``n_words``: the start), the places of their last words, and
    the n-gram at each place."""
    at, begins = _followers(local, lengths), _begins(lengths)
    x = local.astype(np.int64)
    v = x[at - 2]
    second = np.zeros(len(x), bool)
    second[begins[lengths > 1] + 1] = True
    v[second[at]] = n_words
    bits = max(1, int(n_words).bit_length())
    if 3 * bits <= 63:
        keys = x[at - 1] << bits
        keys |= v
        del v
        keys <<= bits
        keys |= x[at]
        del x
        keys, back = np.unique(keys, return_inverse=True)
        mask = (1 << bits) - 1
        return keys >> 2 * bits, keys >> bits & mask, keys & mask, at, back.astype(np.uint32)
    u, w = x[at - 1], x[at]
    order = np.lexsort((w, v, u))  # a block with more than two million distinct words
    u, v, w = u[order], v[order], w[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    back = np.empty(len(u), np.int64)
    back[order] = np.cumsum(new) - 1
    return u[new], v[new], w[new], at, back


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    word_shards = max(width(docs), docs.rdd.getNumPartitions() // 8)  # grows with the input's splits
    cut = written(blocks(docs, word_shards))
    ids = written(word_ids(cut, word_shards))
    total, types, often = _totals(ids)
    shards = max(word_shards, -(-total // SHARD_TOKENS))
    unit = np.log10(total + types + 1)
    step = (unit + np.log10(2)) / 65535  # no stored probability is below 1 / (2 N) or 1 / (N + V + 1)
    pairs = written(pair_counts(cut, often, word_shards))
    after = _told(pairs, lambda types: (np.zeros(len(types)), np.arange(len(types)), types)).groupBy("key").agg(F.sum("n").alias("n"))
    types_after = np.zeros(len(often), np.int64)
    for r in after.collect():  # a row for each frequent word
        types_after[r["key"]] = r["n"]

    def spread(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trimmed()
        right = right.sort_values("shard")
        words = right["shard"].to_numpy() < word_shards
        known = [_unpack(x) for x in right["blob"][words]]
        word, c = np.concatenate([k[0] for k in known]), np.concatenate([k[1] for k in known])
        del known
        doc, some, out, lengths, local = _unpack(left["blob"].iloc[0])
        begins, cw = _begins(lengths), c[local]
        p1 = np.log10(c + 1) - unit  # by local number
        base = np.add.reduceat(p1[local], begins)
        rows = [(-1, key[0], _pack(doc, some, out, lengths, np.add.reduceat((cw > 0).astype(np.int64), begins), base, p1[local[begins]]))]
        u, v, w, at, back = _distinct(local, lengths, len(word))
        counts = np.bincount(back[np.repeat(out == 0, lengths)[at]], minlength=len(u)).astype(np.uint32)
        plain = quantised(p1, step)[w]
        low = plain.astype(np.uint32)
        frequent = c >= max(1, FREQUENT * total)
        keys, *_ = _pairs_after(frequent, local, lengths)
        if len(keys):
            c2, kinds = np.zeros(len(keys)), np.zeros(len(keys))
            for place, n, which in (_unpack(x) for x in right["blob"][~words]):
                place = np.cumsum(place, dtype=np.int64)
                c2[place], kinds[place] = n, types_after[which]
            p2 = np.log10((c2 + kinds * 10.0 ** p1[keys & 0xFFFFFFFF]) / (c[keys >> 32] + kinds))  # each of u's tokens has one after it
            p2 = np.rint(p2 / -step).astype(np.uint32)  # unseen pairs are beyond 16 bits; the trie stores seen ones only
            fixed = np.append(frequent, False)[u]
            low[fixed] = p2[np.searchsorted(keys, u[fixed] << 32 | w[fixed])]
            del p2, c2, kinds, fixed
        del keys, cw
        given = np.append(frequent, False)
        ids_ = np.append(word, START)
        given, u, v, w = given[u], ids_[u], ids_[v], word[w]
        mixed = (u * 0x9E3779B1 + np.where(given, v + 1, 0) * 0x85EBCA77) & 0x7FFFFFFF
        shard = (mixed * 40503 % 2147483647 % shards).astype(np.int32)
        del mixed
        order = np.argsort(u << 32 | v)
        order = order[np.argsort(shard[order], kind="stable")]  # by shard, u, v: steps from one to the next are small
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        met = np.bincount(back, minlength=len(u)).astype(np.uint32)[order]
        whose = np.repeat(np.arange(len(doc), dtype=np.uint32), lengths)[at][np.argsort(rank[back], kind="stable")]  # documents, n-gram by n-gram
        del rank, back, at
        ends = np.concatenate([[0], np.cumsum(met, dtype=np.int64)])
        for s, run in zip(*_runs(shard[order]), strict=True):
            i = order[run]
            seen, one, nth = np.unique(w[i], return_index=True, return_inverse=True)  # a successor's id and log p(w) travel once
            nth, g = nth.astype(np.uint16 if len(seen) <= 1 << 16 else np.uint32), given[i]
            rows.append((s, key[0], _pack(*_steps(u[i], v[i]), np.diff(seen, prepend=0).astype(np.uint32), plain[i][one], nth, counts[i], g.view(np.uint8), low[i][g], met[run], whose[ends[run.start] : ends[run.stop]])))
        return pd.DataFrame(rows, columns=["shard", "block", "blob"])

    def look_up(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pdf[["block", "blob"]].assign(shard=-1)
        trimmed()
        homes, columns = [], []
        for blob in pdf["blob"]:
            u, v, seen, code, nth, count, g, exact, met, whose = _unpack(blob)
            u, v = _unstepped(u, v)
            g, low = g == 1, code[nth].astype(np.uint32)
            low[g] = exact
            homes.append((met, whose))
            columns.append((u, v, np.cumsum(seen, dtype=np.int64)[nth], count, low, g))
        u, v, w, count, low, g = (np.concatenate(c) for c in zip(*columns, strict=True))
        del columns
        t = count > 0
        trie = Trie.build(u[t], v[t], w[t], count[t], low[t], g[t], step)
        with tempfile.TemporaryDirectory() as folder:
            found = trie.mapped(folder).score(u, v, w, low)
            del trie
        rows, at = [], 0
        for block, (met, whose) in zip(pdf["block"], homes, strict=True):
            docs_, back = np.unique(whose, return_inverse=True)
            sums = np.bincount(back, np.repeat(found[at : at + len(met)], met))  # whole numbers, exact in any order
            rows.append((block, _pack(np.diff(docs_, prepend=docs_.dtype.type(0)), sums.astype(np.uint32 if sums.max(initial=0) < 1 << 32 else np.uint64)), key[0]))
            at += len(met)
        return pd.DataFrame(rows, columns=["block", "blob", "shard"])

    def add_up(key, pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["shard"].to_numpy() < 0
        doc, some, held, lengths, known, base, first = _unpack(pdf["blob"][head].iloc[0])
        codes = np.zeros(len(doc), np.int64)
        for steps, x in (_unpack(blob) for blob in pdf["blob"][~head]):
            codes[np.cumsum(steps, dtype=np.int64)] += x.astype(np.int64)
        out = pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "held_out": held == 1, "n_tokens": lengths.astype(np.int64), "n_known": known, "train_tokens": total, "base_score": base, "score": first - step * codes})
        out.loc[some == 0, "doc_id"] = pd.NA
        return out

    asked = ids.where("shard >= 0").unionByName(pairs.where("shard >= 0").withColumn("shard", F.col("shard") + word_shards))
    sent = cut.select("block", "blob").groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(spread, "shard long, block long, blob binary")
    # sums go home by block; the heads of all blocks are dealt one by one, not as one shard
    dealt = sent.withColumn("part", F.when(F.col("shard") < 0, -1 - F.pmod("block", F.lit(shards))).otherwise(F.col("shard")))
    back = dealt.groupBy("part").applyInPandas(look_up, "block long, blob binary, shard long")
    return back.groupBy("block").applyInPandas(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _steps(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of u, which never falls, and of v, which starts anew with each u."""
    du, dv = np.diff(u, prepend=0), np.diff(v, prepend=0)
    new = du > 0
    new[:1] = True
    dv[new] = v[new]
    return du.astype(np.uint32), dv.astype(np.uint32)


def _unstepped(du: np.ndarray, dv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, v = np.cumsum(du, dtype=np.int64), np.cumsum(dv, dtype=np.int64)
    new = du > 0
    new[:1] = True
    at = np.flatnonzero(new)
    return u, v - np.repeat(v[at] - dv[at], np.diff(np.append(at, len(v))))


def _runs(x: np.ndarray) -> tuple[list[int], list[slice]]:
    """The values of a sorted array and where each stands."""
    cuts = np.flatnonzero(np.diff(x)) + 1 if len(x) else np.zeros(0, np.int64)
    bounds = [0, *cuts.tolist(), len(x)] if len(x) else []
    return x[bounds[:-1]].tolist(), [slice(a, b) for a, b in itertools.pairwise(bounds)]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
