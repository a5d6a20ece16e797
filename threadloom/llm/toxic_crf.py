"""Toxic spans by a linear-chain conditional random field; marginals make document scores and offending offsets.

Two tags, toxic or not. A token's potential is the sum of hashed weights of its lower-cased form without outer marks
and of that form's beginnings (3 to 6 letters); a 2 x 2 matrix joins neighbours. Tokens are what ASCII white space parts; a
sequence is a sentence of any length (a token that ends in . ! ? closes it, and so does the text's end). Labels mark documents, so token labels are made first: in labelled toxic
documents a token counts as toxic if one of its features is far commoner, by documents, in toxic than in clean ones (20 times, and beyond chance).
The field is then trained by its likelihood on those tokens, and a logistic curve from the marginals to the label.

The fit uses a bounded sample of labelled rows: at most ``sample_toxic`` and ``sample_clean`` documents in order of a
hash of doc_id, one row of each doc_id, whole texts of ``sample_chars`` characters in all; at most ``train_docs`` of each
kind train the field. Near copies in the sample count once. What is sent to the executors is the model: 2**18 weights
whatever the input. Scoring is one pass without a shuffle.

Defined results: null and empty texts get the score of a text without any toxic token; labels without documents, null
labels and null ids are ignored, a document labelled twice is toxic if any label says so; without labels of both kinds
all scores are 0; repeated rows are scored alike, and count once in the fit; a null doc_id has the checksum of an empty
text; very long texts are scored whole; an empty table gives an empty result. ``tag`` adds score, predicted and spans in
place of columns of these names and keeps all others.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import light_batches, slices, table, words_of
from .near_dup import shingle_sets

BITS, THRESHOLD, CACHE, STEPS, AT_ONCE, SLICE = 18, 0.3, 100_000, 64, 20_000, 1 << 20
ADDED = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
MARKS = ".,;:!?|\"'()[]{}<>*_-"


@dataclass
class Model:
    weights: np.ndarray  # of hashed features
    bias: float
    moves: np.ndarray  # 2 x 2, log potentials of neighbours
    curve: np.ndarray  # constant, slope of the largest marginal's log odds, slope of the log of expected toxic tokens


def features(token: str) -> list[str]:
    w = token.lower().strip(MARKS)
    return [f"={w}", *(f"^{w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k)] if w else []


def slots(token: str) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(f) >> (64 - BITS) for f in features(token)]


class Potentials:
    """The potential of tokens, and whether they close a sentence, by way of a cache that is cleared when it has grown."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def _learn(self, tokens: list[bytes]) -> None:
        """Potentials of some new tokens, ``AT_ONCE`` of them at most, as their features are Python objects."""
        found = [slots(t.decode("utf-8", "surrogatepass")) for t in tokens]
        sizes = np.array([len(f) for f in found])
        total = np.bincount(np.repeat(np.arange(len(found)), sizes), self.model.weights[np.fromiter((s for f in found for s in f), np.int64, int(sizes.sum()))], len(found)) + self.model.bias
        self.seen.update(zip(tokens, ((u, t[-1:] in (b".", b"!", b"?")) for t, u in zip(tokens, total.tolist(), strict=True)), strict=True))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Potentials of all tokens, sentence closings, and where documents end."""
        tokens, numbers, lengths = words_of(texts, lower=False)
        if len(self.seen) > CACHE:
            self.seen = {}
        if new := [t for t in tokens if t not in self.seen]:
            for k in range(0, len(new), AT_ONCE):
                self._learn(new[k : k + AT_ONCE])
        both = list(map(self.seen.__getitem__, tokens))
        u, closes = np.array([b[0] for b in both], float), np.array([b[1] for b in both], bool)
        return u[numbers], closes[numbers], np.cumsum(lengths)


def sequences(closes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each sequence, longest first."""
    n = len(closes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = closes.copy()
    last[ends[ends > 0] - 1] = True
    last[-1] = True
    stops = np.flatnonzero(last) + 1
    start = np.concatenate([[0], stops[:-1]])
    length = stops - start
    order = np.argsort(-length, kind="stable")
    return start[order], length[order]


def marginals(u: np.ndarray, start: np.ndarray, length: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of toxic for each token, and the forward and backward odds, by forward-backward.

    The first ``STEPS`` tokens of all sequences go together, step by step; what longer ones have left goes one by one.
    """
    a, e = np.exp(moves), np.exp(np.clip(u, -30, 30))
    fore, back = np.ones(len(u)), np.ones(len(u))
    longest = min(STEPS, int(length[0])) if len(length) else 0
    active = [int(np.searchsorted(-length, -t)) for t in range(longest + 1)]  # sequences longer than t
    for t in range(longest):
        at = start[: active[t]] + t
        r = fore[at - 1] if t else None
        fore[at] = e[at] if r is None else e[at] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
    (a00, a01), (a10, a11) = a.tolist()
    for first, n in zip(start[: active[longest]].tolist(), length[: active[longest]].tolist(), strict=True):
        r, tail = float(fore[first + longest - 1]), e[first + longest : first + n].tolist()
        out = []
        for x in tail:
            r = x * (a01 + r * a11) / (a00 + r * a10)
            out.append(r)
        fore[first + longest : first + n] = out
        x, out = 1.0, []
        for y in reversed(tail):  # back of the token before y
            x = (a10 + a11 * y * x) / (a00 + a01 * y * x)
            out.append(x)
        back[first + longest - 1 : first + n - 1] = out[::-1]
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        x = e[at + 1] * back[at + 1]
        back[at] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
    return np.log(fore) + np.log(back), fore, back


def evidence(odds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each document: 1, its largest marginal's log odds, log of one plus the expected number of toxic tokens that are likelier toxic than not."""
    out = np.zeros((len(ends), 3))
    out[:, 0], out[:, 1] = 1, -10
    begins = np.concatenate([[0], ends[:-1]])
    some = ends > begins
    if some.any():
        at = begins[some]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        out[some, 1] = np.clip(np.maximum.reduceat(odds, at), -10, 10)
        out[some, 2] = np.log1p(np.add.reduceat(np.where(p > 0.5, p, 0), at))
    return out


def _token_labels(texts: list[str], toxic: list[bool]) -> set[str]:
    """Features that are far commoner in toxic documents; near copies (equal least shingle hash) count once."""
    seen, kept = set(), ([], [])
    for text, y in zip(texts, toxic, strict=True):
        found = next(shingle_sets(pa.array([text], pa.string())))
        key = (y, int((found * np.uint64(0x9E3779B97F4A7C15)).min())) if len(found) else None
        if key not in seen:
            seen.add(key)
            kept[y].append(text)
    n = (len(kept[0]), len(kept[1]))
    share = n[1] / max(1, n[0] + n[1])

    def surprise(k: int, k0: int) -> float:
        """Log likelihood ratio, in nats, of k toxic among k + k0 documents against the toxic share of all."""
        x = k / (k + k0)
        return k * math.log(x / share) + (k0 * math.log((1 - x) / (1 - share)) if k0 else 0)

    df = [Counter(), Counter()]
    for text in kept[1]:
        df[1].update({f for w in set(text.split()) for f in features(w)})
    maybe = {f: k for f, k in df[1].items() if surprise(k, 0) >= 8}  # the others cannot pass, whatever clean documents hold
    del df[1]
    for text in kept[0]:
        df[0].update({f for w in set(text.split()) for f in features(w) if f in maybe})
    return {f for f, k in maybe.items() if (k + 0.5) / (n[1] + 1) >= 20 * (df[0][f] + 0.5) / (n[0] + 1) and surprise(k, df[0][f]) >= 8}


def fit(texts: list[str], toxic: list[int], rounds: int = 40, train_docs: int = 500, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    """The field and the curve from labelled documents; ``train_docs`` of each kind train the field, all fit the curve."""
    model = Model(np.zeros(1 << BITS), -2.0, np.zeros((2, 2)), np.array([-30.0, 0.0, 0.0]))
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return model
    bad = _token_labels(texts, y.tolist())
    chosen = [*np.flatnonzero(y)[:train_docs], *np.flatnonzero(~y)[:train_docs]]
    words, ids, lengths = words_of(pa.array([texts[i] for i in chosen], pa.string()), lower=False)
    words, ends = [w.decode("utf-8", "surrogatepass") for w in words], np.cumsum(lengths)
    closes = np.array([w[-1:] in (".", "!", "?") for w in words], bool)[ids]
    marked = np.array([any(f in bad for f in features(w)) for w in words], bool)
    tags = marked[ids] & np.repeat(y[chosen], lengths)
    sizes = np.array([len(features(w)) for w in words])
    slot, of_word = np.fromiter((s for w in words for s in slots(w)), np.int64, int(sizes.sum())), np.repeat(np.arange(len(words)), sizes)
    del words
    start, length = sequences(closes, ends)
    joined = np.ones(len(ids), bool)
    joined[start] = False
    right = np.flatnonzero(joined)  # tokens with a neighbour on the left
    real = np.zeros((2, 2))
    np.add.at(real, (tags[right - 1].astype(int), tags[right].astype(int)), 1)
    params = [model.weights, np.array([model.bias]), model.moves]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    scale = max(1, tags.sum())
    for step in range(1, rounds + 1):
        weights, bias, moves = params
        u = (np.bincount(of_word, weights[slot], len(sizes)) + bias[0])[ids]
        odds, fore, back = marginals(u, start, length, moves)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        miss = np.bincount(ids, tags - p, len(sizes))
        f, b = fore[right - 1], np.exp(np.clip(u[right], -30, 30)) * back[right]
        a = np.exp(moves)
        whole = a[0, 0] + a[0, 1] * b + a[1, 0] * f + a[1, 1] * f * b
        pairs = a * np.array([[(1 / whole).sum(), (b / whole).sum()], [(f / whole).sum(), (f * b / whole).sum()]])
        grads = [np.bincount(slot, miss[of_word], len(weights)) / scale - ridge * weights, np.array([miss.sum()]) / scale, (real - pairs) / scale]
        for k, g in enumerate(grads):  # Adam
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    model.weights, model.bias, model.moves = params[0].astype(np.float32), float(params[1][0]), params[2]
    index, rows = Potentials(model), []
    for k in range(0, len(texts), 500):
        u, closes, ends = index.of(pa.array(texts[k : k + 500], pa.string()))
        rows.append(evidence(marginals(u, *sequences(closes, ends), model.moves)[0], ends))
    x, c = np.concatenate(rows), np.array([-3.0, 0.3, 1.0])
    for _ in range(50):  # Newton steps with a small ridge around the start
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        c = c + np.linalg.solve(h, x.T @ (y - q) - 0.1 * (c - np.array([-3.0, 0.3, 1.0])))
    model.curve = c
    return model


def checksum(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def sample(docs: DataFrame, labels: DataFrame, sample_toxic: int, sample_clean: int, sample_chars: int) -> tuple[list[str], list[int]]:
    """Whole texts and labels of training rows (crc32 of doc_id mod 4 is not 2), bounded as the arguments say: no more rows
    than documents asked for, as a doc_id gives one text (the shortest, then the least); by the checksum of their ids, rows are taken
    until their texts have ``sample_chars`` characters, so long and short ones are as likely to be in."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.pmod(checksum(F.col("doc_id")), F.lit(4)) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda t, n: known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, sample_toxic).unionByName(pick(0, sample_clean)).select(F.col("doc_id").alias("id_"), "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id_")).where("text IS NOT NULL")  # at most sample_toxic + sample_clean ids
    sizes = texts.groupBy("id_").agg(F.min(F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("r")).select("id_", "r.n", "r.h").collect()
    fits, left = [], sample_chars
    for r in sorted(sizes, key=lambda r: (zlib.crc32(str(r["id_"]).encode()), r["id_"])):
        left -= r["n"]
        if left < 0:  # the rows end here, whatever the lengths of those after
            break
        fits.append((r["id_"], r["h"]))
    if not fits:
        return [], []
    wanted = docs.sparkSession.createDataFrame(fits, "id_ long, h long")
    one = texts.join(F.broadcast(wanted), ["id_"]).where(F.xxhash64("text") == F.col("h")).groupBy("id_").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = sorted(((r["id_"], r["text"], r["toxic"]) for r in one.collect()), key=lambda r: r[0])
    return [r[1] for r in rows], [int(r[2]) for r in rows]


def train(docs: DataFrame, labels: DataFrame, sample_toxic: int = 1000, sample_clean: int = 3000, sample_chars: int = 12_000_000, train_docs: int = 500) -> Model:
    return fit(*sample(docs, labels, sample_toxic, sample_clean, sample_chars), train_docs=train_docs)


def _offsets(text: str, odds: np.ndarray) -> list[dict]:
    """Runs of tokens that are likelier toxic than not, as offsets in the text."""
    out, before = [], False
    for m, o in zip(re.finditer(r"[^\x20\x09-\x0D]+", text), odds, strict=True):
        if o > 0:
            if before:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
        before = o > 0
    return out


def tag(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """The documents with score, predicted and the offending spans (code points, end exclusive), in place of columns of these names."""
    added = [f.name for f in ADDED.fields[: None if with_spans else 2]]
    return _mapped(docs.drop(*added), model, added)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, columns as before."""
    return _mapped(docs, model, [])


def _mapped(docs: DataFrame, model: Model, added: list[str]) -> DataFrame:
    """The documents with the named columns added, or only those that stay if none are named."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, names, with_spans = docs.columns.index("text"), list(docs.columns), "spans" in added
    schema = T.StructType([*docs.schema.fields, *(ADDED[n] for n in added)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        index = Potentials(m)
        for part in slices(batches, at, SLICE):
            u, closes, ends = index.of(part.column(at))
            odds = marginals(u, *sequences(closes, ends), m.moves)[0]
            score = 1 / (1 + np.exp(-np.clip(evidence(odds, ends) @ m.curve, -30, 30)))
            if not added:
                yield part.filter(pa.array(score < THRESHOLD))
                continue
            more = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            if with_spans:
                begins = np.concatenate([[0], ends[:-1]])
                more.append(pa.array([_offsets(t, odds[i:j]) if (odds[i:j] > 0).any() else [] for t, i, j in zip(part.column(at).to_pylist(), begins, ends, strict=True)], span))
            yield pa.RecordBatch.from_arrays([*part.columns, *more], [*names, *added])

    return light_batches(docs).mapInArrow(run, schema)


def op10_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = tag(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.pmod(checksum(F.col("doc_id")), F.lit(4)) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")
