"""Link-graph URL filter: trust and distrust flow over host edges from rule-given seeds, hosts are judged by a threshold.

Rules (host, path prefix) decide first, the longest that fits. Hosts that rules allow are trusted seeds, hosts that
rules block are blocked seeds. Trust is personalised PageRank along the edges, distrust the same along reversed edges
(who links to the blocked is suspect). Both are iterated until a round changes less than ``tolerance`` of their mass, which
leaves them within tolerance * damping / (1 - damping) of the fixed point; what hosts without edges lose returns to the
seeds, so each flow sums to 1. Every nine rounds a power extrapolation (Haveliwala et al. 2003) adds up the slowest part of
what is to come, which kinship (back and forth between two hosts) mostly is. Edges: absolute links in the pages' html, and kinship (a host and the domain
above it vouch for each other), which stands in where pages have no links to other hosts. A host whose share of
distrust exceeds ``threshold`` is blocked; one that neither reaches is allowed.

A host's edges are split by a salt into parts of about ``part_edges``, and its flow travels once to each part, so a hub
with a third of all edges is many groups.

Defined results: a url that is null or without ``://`` has empty host and path and is judged ``allow``; null html has
no links; very long html is matched whole; of fitting rules of equal length (host and path together) the last by host wins;
repeated links add weight; links of a host to itself do not count; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

AT_ONCE = 3  # rounds between two written tables
#: Fixed rules of the contract: host, path prefix, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty without ``://``."""
    part = lambda k: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.coalesce(ascii_lower(part(1)), F.lit("")), F.coalesce(part(2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (``host`` + ``path``) and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) from pages (host, html): counted links, and kinship at weight 1 both ways."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("to")).select("src", ascii_lower(F.col("to")).alias("dst"))
    hosts = pages.select("host").where("host <> ''").distinct()
    kin = hosts.select("host", F.expr("substring(host, locate('.', host) + 1)").alias("above")).where("host LIKE '%.%.%'")
    kin = kin.select(F.col("host").alias("src"), F.col("above").alias("dst")).unionByName(kin.select(F.col("above").alias("src"), F.col("host").alias("dst"))).distinct()
    return links.where("src <> '' AND src <> dst").unionByName(kin).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, rounds: int = 200, part_edges: int = 100_000) -> DataFrame:
    """host, trust, distrust at the fixed point, from seeds (host, trust, distrust, each summing to 1 or to 0).

    Both flows travel in one join: an edge carries trust forwards and distrust backwards. Sums are partial before the
    shuffle, so a host that many link to costs one row per task. Rounds end when no host's flows change by more than ``tolerance`` of
    their own sum, however small a part of all mass that is, so a verdict does not depend on the number of hosts. ``rounds`` ends a run whose
    tolerance is too fine for it: a round shrinks the change by ``damping``, so 200 rounds reach 1e-14.
    """
    out_w = edges.groupBy("src").agg(F.sum("weight").alias("out_w"))
    in_w = edges.groupBy("dst").agg(F.sum("weight").alias("in_w"))
    shares = edges.join(out_w, "src").join(in_w, "dst")
    both = (
        shares.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("weight") / F.col("out_w")).alias("t"), F.lit(0.0).alias("d"))
        .unionByName(shares.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("weight") / F.col("in_w")).alias("d")))
        .groupBy("host", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    )
    parts = written(both.groupBy("host").agg(F.ceil(F.count("*") / part_edges).cast("int").alias("parts")))
    # an edge knows its part of the host it leaves, and the number of parts of the host it reaches
    both = written(
        both.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("to"), F.col("parts")).cast("int")).drop("parts")
        .join(parts.select(F.col("host").alias("to"), "parts"), "to", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    )
    start = written(seeds.join(parts, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(0))))
    zero, own = F.lit(0.0), ["host", "trust", "distrust", "parts"]

    def step(now: DataFrame, compare: bool) -> DataFrame:
        sent = now.where("parts > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
        moved = both.join(sent, ["host", "part"]).select(F.col("to").alias("host"), (damping * F.col("t") * F.col("trust")).alias("trust"), (damping * F.col("d") * F.col("distrust")).alias("distrust"), "parts")
        all_ = moved.unionByName(start.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"), "parts"))
        if compare:
            old = now.select("host", zero.alias("trust"), zero.alias("distrust"), "parts", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
            all_ = all_.select(*own, zero.alias("t0"), zero.alias("d0")).unionByName(old)
        sums = [F.sum(c).alias(c) for c in ("trust", "distrust", *(("t0", "d0") if compare else ()))]
        return all_.groupBy("host").agg(*sums, F.max("parts").alias("parts"))

    past = [start]  # every AT_ONCE rounds
    for _ in range(0, rounds, AT_ONCE):
        now = past[-1]
        for k in range(AT_ONCE):
            now = step(now, k == AT_ONCE - 1)
        now = written(now)  # lineage ends here: a lost executor repeats these rounds at most
        change = F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0"))
        change = now.agg(F.max(change / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0)))).first()[0]  # of the host that changes most
        now = now.select(*own)
        if not change or change < tolerance:
            break
        past.append(now)
        if len(past) > 3:  # power extrapolation: what turns round with a period of 2 * AT_ONCE, or one that divides it, is summed at once
            gone, old = damping ** (2 * AT_ONCE), past[-3].select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
            ahead = lambda c, o: ((F.col(c) - gone * F.coalesce(o, zero)) / (1 - gone)).alias(c)
            past = [written(now.join(old, "host", "left").select("host", ahead("trust", "t0"), ahead("distrust", "d0"), "parts"))]
    t, d = now.agg(F.sum("trust"), F.sum("distrust")).first()  # a scale is all that lost mass changes
    return now.select("host", (F.col("trust") / (t or 1.0)).alias("trust"), (F.col("distrust") / (d or 1.0)).alias("distrust"))


def judge(pages: DataFrame, threshold: float = 0.5, tolerance: float = 1e-3) -> DataFrame:
    """Pages (page_id, url, html) with host, path, rule, trust, distrust and verdict."""
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"))
    p = p.withColumns({"rule": name, "given": verdict})
    seeds = p.where("given IS NOT NULL").groupBy("host").agg(F.count_if(F.col("given") == "allow").alias("good"), F.count_if(F.col("given") == "block").alias("bad"))
    seeds = written(seeds)
    good, bad = seeds.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    start = seeds.select("host", (F.col("good") / max(1, good)).alias("trust"), (F.col("bad") / max(1, bad)).alias("distrust"))
    scores = propagate(host_edges(p), start, tolerance=tolerance)
    scores = scores.withColumn("given_up", F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")))
    return p.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("given_up"), "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op8_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))

