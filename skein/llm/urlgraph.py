"""URL filters by link-graph propagation over hosts.

Rules (host suffix and path prefix, longest wins) judge the pages they fit. Their hosts seed two scores of personalised
PageRank. Trust starts from the share of a host's pages that rules allow and walks forward over host links:

    trust(h) = (1 - damping) * seed(h) + damping * sum over hosts g linking to h of trust(g) / links of g

where a host without links keeps its own share. Distrust starts from the share that rules block and walks the reversed links:

    distrust(h) = seed(h) + damping * mean over hosts t that h links to of distrust(t),

which is what blocked hosts contribute to a walk that starts at h (Andersen et al., 2007). It does not thin out with the
number of hosts that link to a blocked one: a host of a farm is judged by where its own links lead. A host whose distrust
exceeds its trust by ``threshold`` is blocked, any other is allowed; this verdict holds for pages that no rule fits.

Links are absolute or protocol-relative href targets in the page's html; they are pre-aggregated to host pairs. Hosts are
rows, so joins have one row per host on one side and Spark can split a host with very many links.

Defined cases: a null url or one without ``://`` has empty host and path; null html has no links; rows with a null
page_id are judged as any other; repeated rows count as pages of their own; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import dropped, saved

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LINK = r"""(?i)href\s*+=\s*+["']?(?:https?:)?//([^/?#"'\s>]++)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    results = [F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")) for v, h, p in ordered]
    return reduce(lambda rest, i: F.when(fits[i], results[i]).otherwise(rest), reversed(range(len(ordered))), F.lit(None))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Scores (kind, host, seed, score) from seeds (kind, host, seed) and distinct links (src, dst).

    Rounds go on until trust moves by less than ``tolerance`` of its seeds' sum, all hosts together, and no distrust by
    ``tolerance``. Both kinds of movement shrink by the damping in each round, so that is certain to come, and no score is then
    off by more than damping / (1 - damping) times as much.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = edges.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("weight"))
    back = weighted.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    steps = saved(weighted.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(back), "steps")
    ends = hosts.join(degree.select(F.col("src").alias("host"), F.lit(False).alias("ends")), "host", "left")
    state = saved(ends.select("kind", "host", "seed", F.coalesce("ends", F.lit(True)).alias("ends"), F.lit(0.0).alias("moved"), F.col("seed").alias("score")), "scores")
    if steps.isEmpty():
        return state.drop("moved")
    trusts = F.col("kind") == "trust"
    mass = state.filter(trusts).agg(F.sum("seed")).first()[0] or 0.0
    while True:
        passed = steps.join(state.select("kind", F.col("host").alias("src"), "score"), ["kind", "src"])
        got = passed.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("weight")).alias("got"))
        came = F.coalesce("got", F.lit(0.0))
        kept = F.when(F.col("ends"), F.col("score")).otherwise(0.0)
        next_ = F.when(trusts, F.lit(1 - damping) * F.col("seed") + F.lit(damping) * (came + kept)).otherwise(F.col("seed") + F.lit(damping) * came)
        stepped = state.join(got, ["kind", "host"], "left").withColumn("next", next_)
        state = saved(stepped.select("kind", "host", "seed", "ends", F.abs(F.col("next") - F.col("score")).alias("moved"), F.col("next").alias("score")), "scores", instead_of=state)
        trust, distrust = state.agg(F.sum(F.when(trusts, F.col("moved"))), F.max(F.when(~trusts, F.col("moved")))).first()
        if (trust or 0.0) <= tolerance * max(mass, 1.0) and (distrust or 0.0) < tolerance:
            dropped(steps)
            return state.drop("moved")


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = 0.5, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    host, path = url_parts(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), F.lit(1)).alias("targets"))
    judged = saved(parsed.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("fit.verdict").alias("ruled"), F.col("fit.rule").alias("rule"), F.transform(F.array_distinct(F.coalesce("targets", F.array())), lambda t: F.translate(t, UPPER, LOWER)).alias("targets")), "judged")

    edges = judged.select(F.col("host").alias("src"), F.explode("targets").alias("dst")).filter("src <> dst and src <> ''").distinct()
    share = lambda v: F.count(F.when(F.col("ruled") == v, 1)) / F.count(F.lit(1))
    own = judged.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    seen = own.unionByName(edges.select(F.col("dst").alias("host"), F.lit(0.0).alias("allowed"), F.lit(0.0).alias("blocked"))).groupBy("host").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    seeds = seen.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("seed")))).alias("s")).select("s.kind", "host", "s.seed")
    scores = propagate(seeds, edges, damping)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("score")))
    per_host = scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    verdict = F.coalesce("ruled", F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow"))
    return judged.join(per_host, "host").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
