"""URL filters: rules first, then trust and distrust spread over host links.

Seeds are hosts of which rules decide at least ``seed_share`` of the pages: a
trusted seed weighs its share of allowed pages, a blocked seed its share of
blocked ones. Trust is a personalised PageRank along links, distrust one along
reversed links. A page that no rule fits is blocked if its host's distrust is
above its trust and above ``threshold`` times the mean score of a host.

Defined results: a null url, or one without ``://``, has an empty host and path
and no rule; it is allowed, as the empty host takes no part in the graph. Null
html has no links. Repeated pages are judged one by one. Of rules that are as long as
each other one that blocks is followed first, then the first by verdict, host and path.
Very long urls are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_of(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, ruled): for each different host and path that a rule (verdict, host, path) fits, the rule to follow.

    A host is looked up by the names it ends with, a path by its beginnings of the lengths
    that rules of such a host have, both by equality, so there may be any number of rules.
    """
    rules = rules.select("verdict", F.col("host").alias("of"), F.col("path").alias("begins")).distinct()
    sizes = rules.groupBy(F.col("of").alias("under")).agg(F.collect_set(F.length("begins")).alias("sizes"))
    parts = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = pages.select("host").distinct().select("host", F.explode(names).alias("name"))
    asked = hosts.join(sizes, F.col("name") == F.col("under")).select(F.col("host").alias("at"), "name", F.explode("sizes").alias("size"))
    keys = pages.select("host", "path").distinct().join(asked, F.col("host") == F.col("at")).where(F.col("size") <= F.length("path"))
    fit = keys.join(rules, (F.col("name") == F.col("of")) & (F.substr("path", F.lit(1), F.col("size")) == F.col("begins")))
    order = F.struct((-F.length("of") - F.length("begins")).alias("size"), (F.col("verdict") != "block").alias("mild"), "verdict", "of", "begins")
    best = fit.groupBy("host", "path").agg(F.min(order).alias("r"))
    return best.select("host", "path", F.concat("r.of", "r.begins").alias("rule"), F.col("r.verdict").alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), 1)
    links = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src != dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 120, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) from links (src, dst, n) and seeds (host, trust, distrust weights).

    Both kinds run in one loop, as rows (kind, host). A round is one join and one
    sum; the driver gets two sums a round, and the table of the round before goes. Mass that has nowhere to go returns to
    the seeds. What moves shrinks by ``damping`` a round; if ``rounds`` end before it is
    less than ``tolerance``, that is an error (a tolerance of 0 asks for just so many rounds).
    """
    steps = materialize(
        links.select(F.lit(0).alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")).alias("l"),
        "links",
    )
    out = steps.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    flows = materialize(steps.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "flows")
    hosts = seeds.select("host").unionByName(steps.select(F.col("src").alias("host"))).distinct()
    sums = seeds.agg(F.sum("trust"), F.sum("distrust")).first()
    whole = [float(x or 0) for x in sums]
    both = F.array(*[F.struct(F.lit(k).alias("kind"), (F.coalesce(F.col(c), F.lit(0.0)) / F.lit(whole[k] or 1.0)).alias("seed")) for k, c in enumerate(("trust", "distrust"))])
    state = hosts.join(seeds, "host", "left").select("host", F.explode(both).alias("s")).select("s.kind", "host", "s.seed", F.col("s.seed").alias("r"))
    state = last = materialize(state, "ranks")
    if flows.isEmpty():
        rounds = 0
    for _ in range(rounds):
        got = state.where("r > 0").join(flows, (state.kind == flows.kind) & (state.host == flows.src)).groupBy(flows.kind.alias("to_kind"), flows.dst.alias("to")).agg(F.sum(F.col("r") * F.col("share")).alias("got"))
        new = materialize(state.join(got, (F.col("kind") == F.col("to_kind")) & (F.col("host") == F.col("to")), "left").select("kind", "host", "seed", "r", F.coalesce("got", F.lit(0.0)).alias("got")), "ranks")
        discard(last)
        last = new
        moved = {x["kind"]: x["got"] for x in new.groupBy("kind").agg(F.sum("got").alias("got")).collect()}
        back = F.when(F.col("kind") == 0, F.lit(1 - damping * float(moved.get(0, 0.0)))).otherwise(F.lit(1 - damping * float(moved.get(1, 0.0))))
        new = new.withColumn("next", F.lit(damping) * F.col("got") + back * F.col("seed"))
        delta = new.agg(F.sum(F.abs(F.col("next") - F.col("r")))).first()[0] or 0.0
        state = new.select("kind", "host", "seed", F.col("next").alias("r"))
        if delta < tolerance:
            break
    else:
        if rounds and tolerance > 0:
            raise RuntimeError(f"ranks still move by {delta:g} after {rounds} rounds")
    return state.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("r"))).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("r"))).alias("distrust"))


def judge_pages(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, seed_share: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each page. Rules are (verdict, host, path start), in a list or a table."""
    host, path = split_url(F.col("url").cast("string"))
    given = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    best = rules_of(given, rules).withColumnsRenamed({"host": "at_host", "path": "at_path"})
    own = given.select("page_id", "host", "path").join(best, (F.col("host") == F.col("at_host")) & (F.col("path") == F.col("at_path")), "left").drop("at_host", "at_path")
    own = materialize(own, "ruled")
    n = F.count(F.lit(1))
    by_host = own.where("host != ''").groupBy("host").agg((F.sum((F.col("ruled") == "allow").cast("int")) / n).alias("a"), (F.sum((F.col("ruled") == "block").cast("int")) / n).alias("b"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    seeds = by_host.select("host", F.when((a >= seed_share) & (a >= b), a).otherwise(0.0).alias("trust"), F.when((b >= seed_share) & (b > a), b).otherwise(0.0).alias("distrust"))
    seeds = materialize(seeds, "seeds")
    scores = materialize(spread(host_links(given), seeds), "hosts")
    mean = 1.0 / max(1, scores.count())
    judged = own.join(scores.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").drop("h")
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > F.lit(threshold * mean))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")
