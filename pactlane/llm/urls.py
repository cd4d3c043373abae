"""URL filter: longest matching rule, else trust and distrust propagated over the host graph.

Hosts are linked by the absolute links in their pages and, both ways, with their parent domain (two
labels at least). Each page of a host starts one share of the host's weight: trusted if a rule
allows it, blocked if a rule blocks it, neutral otherwise. Personalised PageRank spreads trust along
the links and distrust against them; the same walk from all shares gives each host's whole rank, so
``trust`` and ``distrust`` are the parts of a host's rank that come from trusted and from blocked
pages. Pages without a rule are blocked when their host's distrust reaches ``THRESHOLD`` and exceeds
its trust.

All of it is DataFrame code: links are counted per pair of hosts before they are joined, each step
is one join and one aggregate over hosts, and ranks are written to the shared folder now and then.

Defined results: a null url or one without ``://`` has an empty host and path, matches no rule and
is allowed (no links lead to an empty host); null pages have no links; repeated rows are judged alike
and count as pages; an empty table gives no row. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlane.llm.blocks import sheltered, stored

DAMPING = 0.85
STEPS = 12
THRESHOLD = 0.5
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """Struct (rule, action) of the longest rule that fits; null without one. ``rules`` are (action, rule).
    A rule is written host/path; the list is part of the program, not of the data."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, begin = rule.partition("/")
        fits = (host == name) | host.endswith("." + name)
        found = F.when(fits & path.startswith(slash + begin), F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(a, b, n): links from host a to another host b. ``pages`` has host and html."""
    to = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    named = pages.where("host <> '' AND html IS NOT NULL").select(F.col("host").alias("a"), to.alias("url"))
    linked = named.select("a", url_host(F.concat(F.lit("x:"), F.regexp_replace("url", "^(?i)https?:", ""))).alias("b"))
    linked = linked.where("b <> '' AND a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    names = pages.where("host <> ''").select("host").distinct()
    labels = F.split("host", r"\.")
    tail = lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    places = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda k: k <= F.size(labels) - 2)
    pair = F.transform(places, lambda k: F.struct(tail(k).alias("a"), tail(k + 1).alias("b")))
    parents = names.select(F.explode(pair).alias("p")).select("p.a", "p.b").distinct()
    both = parents.union(parents.select("b", "a")).withColumn("n", F.lit(1))
    return linked.union(both).groupBy("a", "b").agg(F.sum("n").alias("n"))


def host_shares(pages: DataFrame, links: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust) from pages (host, action) and links (a, b, n)."""
    seeds = pages.where("host <> ''").groupBy("host").agg(
        *[F.avg(F.coalesce(F.col("action") == a, F.lit(False)).cast("double")).alias(n) for a, n in (("allow", "t"), ("block", "d"))]
    )
    ends = links.select(F.col("a").alias("host")).union(links.select(F.col("b").alias("host")))
    seeds = ends.select("host", F.lit(0.0).alias("t"), F.lit(0.0).alias("d")).union(seeds).groupBy("host").agg(F.max("t").alias("t"), F.max("d").alias("d"))
    seeds = stored(seeds.select("host", *[(F.lit(1 - damping) * c).alias(n) for n, c in (("t", F.col("t")), ("u", F.lit(1.0)), ("d", F.col("d")), ("v", F.lit(1.0)))]), "seeds")
    out = links.groupBy("a").agg(F.sum("n").alias("out"))
    into = links.groupBy("b").agg(F.sum("n").alias("into"))
    moves = links.join(out, "a").select("a", "b", (F.col("n") / F.col("out")).alias("ahead"), F.lit(0.0).alias("back"))
    moves = moves.union(links.join(into, "b").select(F.col("b"), F.col("a"), F.lit(0.0), F.col("n") / F.col("into")))
    moves = stored(moves.groupBy("a", "b").agg((damping * F.sum("ahead")).alias("ahead"), (damping * F.sum("back")).alias("back")), "moves")
    ranks = seeds
    for step in range(1, steps + 1):
        sent = moves.join(ranks.withColumnRenamed("host", "a"), "a")
        sent = sent.select(F.col("b").alias("host"), *[(F.col(c) * F.col(w)).alias(c) for c, w in (("t", "ahead"), ("u", "ahead"), ("d", "back"), ("v", "back"))])
        ranks = sent.union(seeds).groupBy("host").agg(*[F.sum(c).alias(c) for c in "tudv"])
        if step % 3 == 0:
            ranks = stored(ranks, "ranks")
    return ranks.select("host", (F.col("t") / F.col("u")).alias("trust"), (F.col("d") / F.col("v")).alias("distrust"))


@sheltered("page_id", "url", "html")
def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` (url, html, any others) with ``__host``, ``__path``, ``__rule`` and ``__verdict``."""
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    parsed = pages.select(host.alias("host"), longest_rule(rules, host, path)["action"].alias("action"), "html")
    links = stored(host_links(parsed.select("host", "html")), "links")
    shares = stored(host_shares(parsed.select("host", "action"), links), "shares")
    bad = shares.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias("__bad"))
    out = pages.withColumns({"__host": host, "__path": path})
    out = out.withColumn("__found", longest_rule(rules, F.col("__host"), F.col("__path")))
    out = out.join(bad, F.col("__host") == F.col("__bad"), "left")
    verdict = F.coalesce(F.col("__found.action"), F.when(F.col("__bad").isNotNull(), "block").otherwise("allow"))
    return out.select(*pages.columns, "__host", "__path", F.col("__found.rule").alias("__rule"), verdict.alias("__verdict"))
