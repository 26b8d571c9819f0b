"""Link-graph expansion, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import url as U
from tessera.storage import materialize


def depths(edges: DataFrame, seeds: DataFrame, *, max_depth: int) -> DataFrame:
    """(url, depth): least number of links from a seed, up to max_depth."""
    seen = materialize(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "bfs")
    frontier = seen
    for d in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = materialize(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def robots_gate(rows: DataFrame, robots: DataFrame) -> DataFrame:
    """``rows`` (url, ...) with allowed by robots(host, allowed); hosts that are missing or null there are blocked."""
    known = robots.groupBy(F.lower("host").alias("_host")).agg(F.min(F.coalesce("allowed", F.lit(False))).alias("_allowed"))
    return rows.withColumn("_host", U.host(F.col("url"))).join(known, "_host", "left").withColumn("allowed", F.coalesce("_allowed", F.lit(False))).drop("_host", "_allowed")


def crawl(edges: DataFrame, seeds: DataFrame, fetchable: DataFrame, *, domains: list[str], max_depth: int, max_pages: int, done: DataFrame | None = None, home: str | None = None, robots: DataFrame | None = None) -> DataFrame:
    """(url, depth, outcome, visit) of a crawl with a page budget.

    Outcomes: page, failed (not in ``fetchable``), document, known (in
    ``done``: reported, not expanded), out_of_domain, excluded, skipped,
    robots_blocked (pages and documents of hosts that ``robots``, if given,
    doesn't allow), budget. Pages and failures draw on the budget in the order of visits:
    parent's visit, then priority, then URL. Documents are kept one level past
    max_depth; every URL is looked at once, before the filters.
    """
    order = Window.orderBy("parent", F.desc("score"), "url")
    level = seeds.select("url").distinct().select("url", F.lit(0).cast("long").alias("parent"))
    seen, out, spent, visits = None, None, 0, 0
    for d in range(max_depth + 2):
        new = level.groupBy("url").agg(F.min("parent").alias("parent"))
        new = new.join(seen, "url", "left_anti") if seen is not None else new
        u = F.col("url")
        kind = (
            F.when(~U.in_domains(u, domains), "out_of_domain").when(U.is_excluded(u, home=home), "excluded")
            .when(U.url_class(u) == "document", "document").when(U.url_class(u) == "skip", "skipped").otherwise("page")
        )
        new = new.withColumn("kind", kind).withColumn("score", U.priority(u)).where(F.lit(d <= max_depth) | (F.col("kind") == "document"))
        if done is not None:
            new = new.join(done.select("url").withColumn("was", F.lit(True)), "url", "left").withColumn("kind", F.when((F.col("kind") == "page") & F.col("was"), "known").otherwise(F.col("kind"))).drop("was")
        if robots is not None:
            new = robots_gate(new, robots).withColumn("kind", F.when(F.col("kind").isin("page", "document") & ~F.col("allowed"), "robots_blocked").otherwise(F.col("kind"))).drop("allowed")
        new = new.join(fetchable.select("url").distinct().withColumn("ok", F.lit(True)), "url", "left")
        charged = (F.col("kind") == "page").cast("int")
        # the budget bounds what the order decides: beyond it rows only get the outcome "budget"
        first = new.where("kind = 'page'").orderBy("parent", F.desc("score"), "url").limit(max(0, max_pages - spent)).withColumn("visit", F.row_number().over(order) + visits)
        first = materialize(first.select("url", "visit"), "visits")
        placed = new.join(first, "url", "left").withColumn("outcome", F.when(charged == 0, F.col("kind")).when(F.col("visit").isNull(), "budget").when(F.col("ok"), "page").otherwise("failed"))
        placed = materialize(placed.select("url", F.lit(d).alias("depth"), "outcome", F.col("visit").cast("long").alias("visit")), "level")
        used = first.count()
        spent, visits = spent + used, visits + used
        out = placed if out is None else out.unionByName(placed)
        seen = out.select("url")
        level = edges.join(placed.where("outcome = 'page'").select(F.col("url").alias("src"), F.col("visit").alias("parent")), "src").select(F.col("dst").alias("url"), "parent")
        if not used:
            break
    return out


def crawl_counters(visited: DataFrame) -> DataFrame:
    """Counts per outcome of a crawl."""
    names = ("page", "failed", "document", "known", "out_of_domain", "excluded", "skipped", "robots_blocked", "budget")
    return visited.agg(F.count("*").alias("urls"), *(F.count_if(F.col("outcome") == n).alias(n) for n in names))
