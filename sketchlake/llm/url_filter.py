"""URL verdicts: host and path rules first, link-graph propagation for the rest.

Hosts are joined by the links of their pages. Trust starts at hosts whose pages
the rules allow and flows along links (personalised PageRank); distrust starts
at hosts whose pages the rules block and flows against them, to those that link
there. A host without pages in the table stands with the addresses that are linked to, one for each link. A page that no rule judges is blocked if the distrust that its host receives
passes a threshold and the host's trust by a factor. Everything per host: pages, links and rules
are aggregated before any join on hosts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchlake.llm.runtime import checkpoint

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and scheme-relative addresses in attributes.
#: Keys that a host's pages are dealt to, by path, where they meet what is known of the host.
SALTS = 16
_LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""


@dataclass(frozen=True)
class Propagation:
    """damping and rounds of both walks; block where distrust received by links exceeds ``level`` times the mean distrust and ``factor`` times the host's trust."""

    damping: float = 0.85
    rounds: int = 12
    level: float = 1.0
    factor: float = 2.0
    every: int = 4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty without ``://``."""
    at = F.locate("://", url) if isinstance(url, str) else F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``host`` and the rules that fit it by host, the longest first, as structs (length, path, rule, verdict)."""
    table = hosts.sparkSession.createDataFrame([(r.host.translate(str.maketrans(_UPPER, _LOWER)), r.path, r.host + r.path, r.verdict) for r in rules], "suffix string, path string, rule string, verdict string")
    found = hosts.withColumn("suffix", F.explode(suffixes(F.col("host")))).join(table, "suffix")
    fitting = F.collect_list(F.struct((-F.length("rule")).alias("order"), "rule", "path", "verdict"))
    return found.groupBy("host").agg(F.sort_array(fitting).alias("fitting"))


def with_host(rows: DataFrame, per_host: DataFrame) -> DataFrame:
    """Rows (host, path ...) with what is known of their host, if anything; one host may have a third of all rows."""
    copies = per_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(copies, ["host", "_salt"], "left").drop("_salt")


def propagate(hosts: DataFrame, edges: DataFrame, how: Propagation) -> DataFrame:
    """``host, trust, distrust`` from ``host, trusted, blocked`` (seed masses) and ``source, target, links`` between these hosts."""
    edges = edges.where("source <> target").groupBy("source", "target").agg(F.sum("links").cast("double").alias("links"))
    out = edges.groupBy("source").agg(F.sum("links").alias("out"))
    into = edges.groupBy("target").agg(F.sum("links").alias("into"))
    edges = checkpoint(edges.join(out, "source").join(into, "target").select("source", "target", (F.col("links") / F.col("out")).alias("forward"), (F.col("links") / F.col("into")).alias("backward")))
    state = checkpoint(hosts.select("host", "trusted", "blocked", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust")))
    if edges.isEmpty():
        return state.withColumns({"trust": (1 - how.damping) * F.col("trusted"), "distrust": (1 - how.damping) * F.col("blocked")})
    for i in range(how.rounds):
        ahead = edges.join(state.select(F.col("host").alias("source"), "trust"), "source").select(F.col("target").alias("host"), (F.col("forward") * F.col("trust")).alias("t"), F.lit(0.0).alias("d"))
        back = edges.join(state.select(F.col("host").alias("target"), "distrust"), "target").select(F.col("source").alias("host"), F.lit(0.0).alias("t"), (F.col("backward") * F.col("distrust")).alias("d"))
        flow = ahead.union(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        d = how.damping
        state = state.join(flow, "host", "left").select(
            "host", "trusted", "blocked",
            ((1 - d) * F.col("trusted") + d * F.coalesce("t", F.lit(0.0))).alias("trust"),
            ((1 - d) * F.col("blocked") + d * F.coalesce("d", F.lit(0.0))).alias("distrust"),
        )
        if (i + 1) % how.every == 0 or i + 1 == how.rounds:
            state = checkpoint(state)
    return state


def judge_urls(pages: DataFrame, rules: Sequence[Rule], how: Propagation = Propagation()) -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` of every page.

    ``rule`` is the longest rule that fits (host or a subdomain of it, path
    prefix; of equal lengths the alphabetically first), else null; ``verdict`` is ``allow`` or ``block``. A null url or one
    without ``://`` has an empty host and path and is allowed, as no rule or link
    reaches it. Null html has no links. Hosts that only appear as link targets
    take part in the walks, but have no rows. Repeated rows are judged each; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    # one narrow pass over the pages; the html is only read for its links, which leave it as (source, target, count)
    at = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    counted = checkpoint(at.groupBy("host", "path").agg(F.count("*").alias("n")))
    target, to = split_url(F.concat(F.lit("x:"), F.regexp_replace("link", r"^[^/]*", "")))
    links = pages.select(host.alias("source"), F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(_LINK), 1)).alias("link")).select("source", target.alias("host"), to.alias("path"))
    links = checkpoint(links.where("source <> '' and host <> '' and source <> host").groupBy("source", "host", "path").agg(F.count("*").alias("n")))
    uncrawled = links.groupBy("host", "path").agg(F.sum("n").alias("n")).join(counted.select("host").distinct(), "host", "left_anti")
    counted = checkpoint(counted.union(uncrawled.select("host", "path", "n")))
    fitting = checkpoint(host_rules(counted.select("host").distinct(), rules))
    first = F.try_element_at(F.filter("fitting", lambda r: F.col("path").startswith(r["path"])), F.lit(1))
    ruled = with_host(counted, fitting).withColumn("first", first)
    seeds = ruled.where("host <> ''").groupBy("host").agg(
        F.sum(F.when(F.col("first.verdict") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("first.verdict") == "block", F.col("n")).otherwise(0)).alias("b"), F.sum("n").alias("n")
    )
    seeds = checkpoint(seeds.select("host", F.greatest((F.col("a") - F.col("b")) / F.col("n"), F.lit(0.0)).alias("trusted"), F.greatest((F.col("b") - F.col("a")) / F.col("n"), F.lit(0.0)).alias("blocked")))
    masses = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b"), F.count("*").alias("n")).first()
    share = lambda c, total: F.col(c) * F.lit((masses["n"] or 1) / total if total else 0.0)
    edges = links.select("source", F.col("host").alias("target"), F.col("n").alias("links"))
    state = propagate(seeds.select("host", share("trusted", masses["t"]).alias("trusted"), share("blocked", masses["b"]).alias("blocked")), edges, how)
    mean = state.agg(F.avg("distrust").alias("mean")).first()["mean"] or 0.0
    received = F.col("distrust") - (1 - how.damping) * F.col("blocked")  # rules speak for a host's own blocked paths; links for the rest
    distrusted = state.where((received > 1e-12) & (received > how.level * mean) & (received > how.factor * F.col("trust"))).select("host", F.lit(True).alias("distrusted"))
    per_host = fitting.join(distrusted, "host", "full_outer")
    judged = with_host(at, per_host).withColumn("first", first)
    return judged.select(
        "page_id", "url", "host", "path", F.col("first.rule").alias("rule"), F.coalesce("first.verdict", F.when(F.col("distrusted"), "block").otherwise("allow")).alias("verdict")
    )
