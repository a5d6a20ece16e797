"""op11 against whole texts, a plain union-find and plain counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from threadloom.llm import token_alignment
from threadloom.llm.packing import byte_letters

from .test_llm import empty, odd, rows_of  # noqa: F401

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def ranges(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute_groups(a, b):
    """Groups of token numbers by union-find over all overlapping pairs (near ones; both are sorted)."""
    parent = {("a", i): ("a", i) for i in range(len(a))} | {("b", j): ("b", j) for j in range(len(b))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    j = 0
    for i, (s, e) in enumerate(a):
        while j and b[j - 1][1] > s:
            j -= 1
        while j < len(b) and b[j][0] < e:
            if b[j][1] > s:
                parent[find(("b", j))] = find(("a", i))
            j += 1
    by = {}
    for side, spans in (("a", a), ("b", b)):
        for k in range(len(spans)):
            by.setdefault(find((side, k)), ([], []))[side == "b"].append(k)
    return sorted(by.values())


def brute(texts):
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    letters = {c: n for n, c in byte_letters().items()}
    pieces = [tb.id_to_piece(i) for i in range(tb.get_piece_size())]
    found = []
    for t in texts:
        ids_a, ids_b = (ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)) if t else ([], [])
        bytes_a = [bytes(letters[c] for c in ta.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(pieces[i][3:5], 16)]) if tb.is_byte(i) else pieces[i].replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            found.append(([], [], []))
            continue
        found.append((ids_a, ids_b, brute_groups(ranges(bytes_a), ranges(bytes_b))))
    links = [[(x[i], y[j]) for p, q in g for i in p for j in q] for x, y, g in found]
    count = Counter(pair for own in links for pair in set(own))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (x, y, g), own in zip(found, links, strict=True):
        said = ";".join(f"{','.join(str(x[i]) for i in p)}|{','.join(str(y[j]) for j in q)}" for p, q in g)
        out.append((len(x), len(y), len(g), len(own), sum(count[k] == best[k[0]] for k in own), sum(count[k] for k in own), hashlib.sha256(said.encode()).hexdigest() if x else ""))
    return out


def test_union_find_on_random_graphs():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 30), (2000, 1500)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        want = list(range(n))
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            low, high = sorted((want[x], want[y]))
            want = [low if w == high else w for w in want]
        assert token_alignment.components(n, u, v).tolist() == want
    chain = np.arange(9999)
    assert not token_alignment.components(10000, chain + 1, chain).any()


def test_chunks_do_not_change_tokens():
    """Random strings over white space of all kinds, marks, letters and scripts, chunk by chunk and whole."""
    rng = random.Random(8)
    alphabet = [*" \n\t\r\x0b\x0c\x1c\x85\xa0    　", *"aAbt'sdé.,;:)}{>\"!*/-_=#09", " ", " ", " ", "\r\n", "the", "ing", "中", "😀", "▁", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "\x00", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(6000)]
    align = token_alignment.Aligner(A, B)
    sizes, digests, owner, pairs, times = align(texts)
    want = brute(texts)
    assert not align.whole
    assert [(*s, d) for s, d in zip(sizes.tolist(), digests, strict=True)] == [(*w[:4], w[6]) for w in want]
    assert any(not d for d in digests) and sum(map(bool, digests)) > 3000


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_op11_against_whole_texts(spark, odd, sf_dir, which):  # noqa: F811
    path = odd if which == "odd" else sf_dir
    docs = rows_of(spark, path)
    want = sorted(((i, *w) for (i, _), w in zip(docs, brute([t or "" for _, t in docs]), strict=True)), key=str)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    df = token_alignment.op11_token_alignment(spark, path)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == want
    small = token_alignment.align(spark.read.parquet(f"{path}/documents.parquet").repartition(7), A, B, block_bytes=20_000)
    assert sorted((tuple(r) for r in small.select(*columns).collect()), key=str) == want
