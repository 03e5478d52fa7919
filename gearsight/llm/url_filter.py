"""URL verdicts from fixed rules and from trust that flows over links.

Rules name a host and a path prefix and fit the host and all its subdomains;
the longest fitting rule decides. For the pages that no rule fits, the link
graph between hosts decides:

* trust is a personalised PageRank whose restarts go to the hosts with pages
  that a rule allows, in proportion to their number, over links as they point;
* distrust is the same from hosts with blocked pages over reversed links: who
  links to a blocked host is suspect.

Both are scaled back to pages. A host is blocked if distrust is at least
``threshold`` of distrust, trust and its number of undecided pages together.
Links inside a host say nothing about it and are left out.

Everything is DataFrame expressions. Pages are reduced to (host, host, links)
counts before any shuffle, so a host with a third of all pages is one partial
row per task. Each iteration's ranks are aggregates over the edge table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import written

# The rules of the query (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
DAMPING = 0.85
ITERATIONS = 10
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#\s"'>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(verdict, rule)`` of the longest fitting rule, by the length of host
    and path together (the first listed of equal ones); null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    cases = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                    F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered]
    return F.coalesce(*cases)


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links between different hosts. ``pages(host, html)``."""
    found = pages.where("host <> ''").select("host", F.explode(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
    dst = F.translate(F.regexp_replace("link", r"^.*@|:\d*$", ""), UPPER, LOWER)
    return (found.select(F.col("host").alias("src"), dst.alias("dst")).where("src <> dst and dst <> ''")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """``(host, mass)``: ``seeds(host, mass)`` restarted with ``1 - damping`` at each
    step, the rest moved along ``edges(src, dst, n)`` in proportion to ``n``; a
    host without edges keeps what it holds for itself. The masses' sum stays."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    steps = written(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    ends = written(out.select(F.col("src").alias("host"), F.lit(True).alias("moves")))
    rank = seeds
    if steps.isEmpty():
        return rank
    for _ in range(iterations):
        moved = (rank.join(steps, rank["host"] == steps["src"])
                 .select(F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass")))
        kept = rank.join(ends, "host", "left_anti").select("host", (F.col("mass") * damping).alias("mass"))
        restart = seeds.select("host", (F.col("mass") * (1 - damping)).alias("mass"))
        rank = written(moved.unionAll(kept).unionAll(restart).groupBy("host").agg(F.sum("mass").alias("mass")))
    return rank


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING,
          iterations: int = ITERATIONS, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)``, one row per page.

    ``trust`` and ``distrust`` are the host's, in pages. A page without a host
    and a host without trust or distrust are allowed. A null html has no links;
    repeated rows count each; an empty table gives no rows.
    """
    host, path = url_parts(pages[url_col].cast("string"))
    parsed = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"),
                          pages[html_col].cast("string").alias("html"))
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    named = parsed.select("page_id", "host", "path", ruled.alias("r"))
    counts = written(named.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("r.verdict") == "allow").cast("double").alias("allowed"),
        F.count_if(F.col("r.verdict") == "block").cast("double").alias("blocked"),
        F.count_if(F.col("r").isNull()).cast("double").alias("open")))
    links = written(host_links(parsed))
    trust = propagate(counts.where("allowed > 0").select("host", F.col("allowed").alias("mass")), links,
                      damping, iterations)
    distrust = propagate(counts.where("blocked > 0").select("host", F.col("blocked").alias("mass")),
                         links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), damping, iterations)
    hosts = (counts.select("host", "open")
             .join(trust.withColumnRenamed("mass", "trust"), "host", "left")
             .join(distrust.withColumnRenamed("mass", "distrust"), "host", "left")
             .na.fill(0.0, ["trust", "distrust"])
             .withColumn("bad", F.col("distrust") >= threshold * (F.col("distrust") + F.col("trust") + F.col("open")))
             .withColumn("bad", F.col("bad") & (F.col("distrust") > 0)))
    return (named.join(hosts.drop("open"), "host", "left")
            .select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce("r.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"),
                    F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
