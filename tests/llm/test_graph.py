"""op8's flows on a graph of some thousand hosts: every host's verdict as at the fixed point, however small its share."""

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import link_graph


def test_verdicts_of_many_hosts(spark):
    rng = np.random.default_rng(7)
    n, m = 3000, 9000
    src, dst = rng.integers(0, n, m), (rng.pareto(1.2, m) * 5).astype(int) % n
    links = sorted({(int(a), int(b)) for a, b in zip(src, dst, strict=True) if a != b} | {(k, k + 1) for k in range(n - 40, n - 1)})  # and a chain
    good, bad = rng.choice(n - 40, 60, replace=False), rng.choice(n - 40, 60, replace=False)
    trust, distrust = np.zeros(n), np.zeros(n)
    trust[good], distrust[bad] = 1 / len(good), 1 / len(bad)
    a = np.zeros((n, n))
    for s, t in links:
        a[s, t] = 1
    out, into = a.sum(1, keepdims=True), a.sum(0, keepdims=True)
    forward, back = np.divide(a, out, where=out > 0, out=np.zeros_like(a)), np.divide(a, into, where=into > 0, out=np.zeros_like(a))
    t, d = trust.copy(), distrust.copy()
    for _ in range(300):
        t, d = 0.15 * trust + 0.85 * (t @ forward), 0.15 * distrust + 0.85 * (back @ d)
    t, d = t / t.sum(), d / d.sum()
    edges = spark.createDataFrame([(f"h{s}", f"h{e}", 1.0) for s, e in links], "src string, dst string, weight double")
    seeds = spark.createDataFrame([(f"h{k}", float(trust[k]), float(distrust[k])) for k in range(n) if trust[k] or distrust[k]], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in link_graph.propagate(edges, seeds).where(F.col("trust") + F.col("distrust") > 0).collect()}
    for k in range(n):
        x, y = got.get(f"h{k}", (0.0, 0.0))
        assert abs(x - t[k]) + abs(y - d[k]) <= 0.01 * (t[k] + d[k]) + 1e-15, k
    share = d / np.maximum(t + d, 1e-300)
    assert sum((t + d > 0) & (abs(share - 0.5) > 0.01)) > 150
