"""Links, bounded crawling and link analysis."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.scratch import drop, materialize
from textloom.session import ship

HREF = "(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"']"


def resolve(base: Column, href: Column) -> Column:
    """href as seen from base: absolute, of the scheme, of the host, a query, a fragment or a path beside base; dots are kept."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    host = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, "^([^?#]*)", 1)
    folder = F.when(page == host, F.concat(host, F.lit("/"))).otherwise(F.regexp_extract(page, "^(.*/)", 1))
    return (
        F.when(href == "", base)
        .when(F.regexp_like(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(host, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .otherwise(F.concat(folder, href))
    )


def outlinks(pages: DataFrame) -> DataFrame:
    """page_id, pos (from 0), href and url of each link, in page order, repeats kept."""
    found = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "href"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "href", resolve(F.col("base"), F.col("href")).alias("url"))


def physical_depth(url: Column) -> Column:
    """The number of path segments."""
    path = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("long")


#: Second-level labels below which countries register names: with a country's label behind one, a registered domain has three labels.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "gub", "int", "ltd", "me", "mil", "net", "nom", "or", "org", "plc", "sch")


def domain(url: Column) -> Column:
    """The registered domain of the host: its last two labels, or three behind a public suffix of two such as co.uk."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(host, "[.]")
    public = (F.length(F.element_at(labels, -1)) == 2) & F.coalesce(F.get(labels, F.size(labels) - 2).isin(*SECOND_LEVEL), F.lit(False))
    kept = F.when(public, 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - kept + 1), kept), ".")


def dynamic(url: Column) -> Column:
    return F.contains(url, F.lit("?"))


def crawlable(url: Column, most: int) -> Column:
    return url.startswith("http") & (physical_depth(url) <= most)


def shared_link_graph(pages: DataFrame, k: int = 3) -> DataFrame:
    """src and dst: for each page the k smallest other pages that have one of its hrefs.

    They are among the k + 1 smallest pages of each of its hrefs, so a frequent href
    costs k + 1 rows a page and not the square of its pages.
    """
    has = outlinks(pages).select("page_id", "href").distinct()
    few = has.withColumn("n", F.row_number().over(Window.partitionBy("href").orderBy("page_id"))).where(F.col("n") <= k + 1)
    near = has.join(few.select("href", F.col("page_id").alias("dst")), "href").where("page_id <> dst").select(F.col("page_id").alias("src"), "dst").distinct()
    return near.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("n") <= k).select("src", "dst")


def fetch(urls: DataFrame, fetcher: Callable[[str], str], several: int = 64) -> DataFrame:
    """url, html and error of each distinct url of urls, by a function that returns a page or raises.

    What it raises, or returns that is no text, gives a null page and the error's name: one page
    that cannot be had never ends a crawl. `several` tasks fetch at a time.
    """
    ship(urls.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    html = fetcher(url)
                    rows.append((url, html, None) if isinstance(html, str) else (url, None, "no text"))
                except Exception as error:  # whatever a connection raises
                    rows.append((url, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").distinct().repartition(several, "url").mapInPandas(run, "url string, html string, error string")


def fetched_links(pages: DataFrame) -> DataFrame:
    """url, pos and link of fetched pages (url, html), as crawl() takes them; a page without links has one row, one that was not had has none."""
    had = pages.where("html IS NOT NULL")
    found = outlinks(had.select(F.col("url").alias("page_id"), "url", "html")).select(F.col("page_id").alias("url"), "pos", F.col("url").alias("link"))
    return had.select("url").join(found, "url", "left")


def crawl(seeds: DataFrame, web: DataFrame, per_site: int = 20, max_logical: int = 3, max_physical: int = 3, max_known: int = 1000, max_pages: int | None = None) -> DataFrame:
    """Bounded breadth-first crawl, level by level, with the outcome of a first-in first-out queue.

    seeds (url, place); web (url, pos, link), a page that cannot be fetched having no
    row with a null link either. Returns id, url, site, depth, visited and outlinks
    (sorted ids). Within a level ids, counters and caps follow the queue's order by
    running counts; no level has more than max_known entries.
    """
    max_pages = max_pages or max_known
    spark = seeds.sparkSession
    pages = web.select("url").distinct()
    start = seeds.groupBy("url").agg(F.min("place").alias("place"))
    level = materialize(start.select((F.row_number().over(Window.orderBy("place")) - 1).cast("long").alias("id"), "url", domain(F.col("url")).alias("site"), F.lit(0).alias("depth")), "crawl")
    known, edges = level, None
    visited = spark.createDataFrame([], "id long, site string")
    n_known, n_visited, depth = level.count(), 0, 0
    while n_known and depth <= max_logical:
        done = visited.groupBy("site").agg(F.count("*").alias("had"))
        fetched = level.join(pages, "url", "left_semi").join(done, "site", "left").fillna(0, ["had"])
        fetched = fetched.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("id")) + F.col("had")).where(F.col("rank") <= per_site)
        fetched = fetched.withColumn("nth", F.row_number().over(Window.orderBy("id")) + n_visited).where(F.col("nth") <= max_pages)
        fetched = materialize(fetched.select("id", "url", "site"), "crawl")
        n_visited += fetched.count()
        visited = materialize(visited.union(fetched.select("id", "site")), "crawl")
        links = fetched.select(F.col("id").alias("parent"), "url").join(web, "url").where(crawlable(F.col("link"), max_physical))
        links = links.select("parent", "pos", F.col("link").alias("url"), domain(F.col("link")).alias("site"))
        old = links.join(known.select("url", "id"), "url")
        found = old.select("parent", F.col("id").alias("to"))
        fresh = links.join(known, "url", "left_anti")
        if depth == max_logical:
            fresh = fresh.limit(0)
        # pages of the link's site that were visited before or as the parent was
        before = visited.select("site", F.col("id").alias("parent"), F.lit(1).alias("one"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("url"))
        events = before.unionByName(fresh.select("site", "parent", F.lit(0).alias("one"), F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), "url"))
        running = Window.partitionBy("site").orderBy("parent", "kind", "pos").rowsBetween(Window.unboundedPreceding, 0)
        open_ = events.withColumn("had", F.sum("one").over(running)).where((F.col("kind") == 1) & (F.col("had") < per_site))
        first = open_.groupBy("url", "site").agg(F.min(F.struct("parent", "pos")).alias("at"))
        few = first.orderBy("at").limit(max(0, max_known - n_known))
        new = few.select((F.row_number().over(Window.orderBy("at")) - 1 + n_known).cast("long").alias("id"), "url", "site", F.lit(depth + 1).alias("depth"), "at")
        new = materialize(new, "crawl")
        later = links.join(new.select("url", "id", F.col("at.parent").alias("p0"), F.col("at.pos").alias("x0")), "url").where("parent > p0 OR (parent = p0 AND pos >= x0)")
        found = materialize(found.union(later.select("parent", F.col("id").alias("to"))).distinct(), "crawl")
        edges = found if edges is None else edges.union(found)
        level = new.drop("at")
        known = materialize(known.union(level), "crawl")
        n_new = level.count()
        n_known, depth = n_known + n_new, depth + 1
        if not n_new:
            break
    out = known.join(visited.select("id", F.lit(True).alias("visited")), "id", "left").withColumn("visited", F.coalesce("visited", F.lit(False)))
    if edges is None:
        return out.withColumn("outlinks", F.array().cast("array<bigint>"))
    lists = edges.groupBy("parent").agg(F.array_sort(F.collect_set("to")).alias("outlinks"))
    return out.join(lists, out["id"] == lists["parent"], "left").select("id", "url", "site", "depth", "visited", F.coalesce("outlinks", F.array().cast("array<bigint>")).alias("outlinks"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


#: Graphs of up to so many links are settled within one task, in numpy: a round costs less there than a job does.
FEW_LINKS = 1_000_000


def _settled(change: float, tolerance: float, round_: int, most: int, name: str) -> bool:
    if change < tolerance:
        return True
    if round_ + 1 == most:
        raise ArithmeticError(f"{name} did not converge in {most} rounds")
    return False


def _in_one_task(links: DataFrame, settle, columns: str) -> DataFrame:
    """settle(n, src, dst) -> columns of values, over the whole graph in a single task; src and dst are places among the sorted nodes."""
    ship(links.sparkSession)

    def run(batches):
        rows = pd.concat(list(batches))
        ids, ends = np.unique(np.concatenate([rows["src"].to_numpy(), rows["dst"].to_numpy()]), return_inverse=True)
        values = settle(len(ids), ends[: len(rows)], ends[len(rows) :])
        yield pd.DataFrame({"id": ids} | dict(zip(columns.split(","), values, strict=True)))

    kind = links.schema["src"].dataType.simpleString()
    return links.select("src", "dst").coalesce(1).mapInPandas(run, f"id {kind}, " + ", ".join(f"{c} double" for c in columns.split(",")))


def _rounds(state: DataFrame, step, values: tuple[str, ...], tolerance: float, most: int, name: str) -> DataFrame:
    """step() applied to state until the L1 change of every value is below tolerance.

    state holds each value and, as `old_` and its name, that of the round before. Rounds are
    written, so that lineage stays short, and a round's table goes with the next one.
    """
    change = [F.coalesce(F.sum(F.abs(F.col(v) - F.col(f"old_{v}"))), F.lit(0.0)).alias(v) for v in values]
    for i in range(most):
        new = materialize(step(state), name)
        drop(state)
        state = new
        if _settled(max(state.agg(*change).first()), tolerance, i, most, name):
            break
    return state


def pagerank(edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-10, most: int = 1000, few_links: int = FEW_LINKS) -> DataFrame:
    """id and score by power iteration to a tolerance; the rank of nodes without links out is shared by all.

    What is left is below tolerance * alpha / (1 - alpha) in L1. Not to converge in `most` rounds is an error.
    """
    links = materialize(edges.distinct(), "links")
    n_links = links.count()
    if not n_links:
        return nodes(links).select("id", F.lit(0.0).alias("score"))
    if n_links <= few_links:

        def settle(n, src, dst):
            degree = np.bincount(src, minlength=n)
            score, shared = np.full(n, 1.0 / n), np.maximum(degree, 1)
            for i in range(most):
                given = np.bincount(dst, (score / shared)[src], n)
                new = (1 - alpha) / n + alpha * (given + score[degree == 0].sum() / n)
                change, score = np.abs(new - score).sum(), new
                if _settled(change, tolerance, i, most, "PageRank"):
                    break
            return [score]

        return _in_one_task(links, settle, "score")
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    every = nodes(links).join(degree, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    every = materialize(every, "nodes")
    n = every.count()
    state = materialize(every.select("id", "degree", F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("old_score")), "ranks")

    def step(ranks: DataFrame) -> DataFrame:
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("score"))), F.lit(0.0)).alias("loose"))  # one row
        given = ranks.join(links, ranks["id"] == links["src"]).groupBy("dst").agg(F.sum(F.col("score") / F.col("degree")).alias("given"))
        shared = ranks.join(given, ranks["id"] == given["dst"], "left").crossJoin(F.broadcast(loose))
        score = F.lit((1 - alpha) / n) + alpha * (F.coalesce("given", F.lit(0.0)) + F.col("loose") / n)
        return shared.select("id", "degree", score.alias("score"), F.col("score").alias("old_score"))

    return _rounds(state, step, ("score",), tolerance, most, "PageRank").select("id", "score")


def hits(edges: DataFrame, tolerance: float = 1e-10, most: int = 1000, few_links: int = FEW_LINKS) -> DataFrame:
    """id, hub and authority to a tolerance; each round sums along the links and scales to a total of 1. Not to converge in `most` rounds is an error."""
    links = materialize(edges.distinct(), "links")
    n_links = links.count()
    if not n_links:
        return nodes(links).select("id", F.lit(0.0).alias("hub"), F.lit(0.0).alias("authority"))
    if n_links <= few_links:

        def settle(n, src, dst):
            hub, authority = np.full(n, 1.0 / n), np.zeros(n)
            for i in range(most):
                a = np.bincount(dst, hub[src], n)
                a /= a.sum()
                h = np.bincount(src, a[dst], n)
                h /= h.sum()
                change = max(np.abs(h - hub).sum(), np.abs(a - authority).sum())
                hub, authority = h, a
                if _settled(change, tolerance, i, most, "HITS"):
                    break
            return [hub, authority]

        return _in_one_task(links, settle, "hub,authority")
    every = materialize(nodes(links), "nodes")
    state = every.select("id", F.lit(1.0 / every.count()).alias("hub"), F.lit(0.0).alias("authority"), F.lit(0.0).alias("old_hub"), F.lit(0.0).alias("old_authority"))
    state = materialize(state, "hits")

    def step(state: DataFrame) -> DataFrame:
        raw = materialize(links.join(state, links["src"] == state["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a")), "authority")
        total = raw.agg(F.sum("a")).first()[0]
        authority = raw.select("id", (F.col("a") / total).alias("a"))
        hub = links.join(authority.withColumnRenamed("id", "to"), F.col("dst") == F.col("to")).groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("h"))
        weight = hub.agg(F.sum("h").alias("weight"))  # one row
        old = state.select("id", F.col("hub").alias("old_hub"), F.col("authority").alias("old_authority"))
        new = old.join(hub, "id", "left").join(authority, "id", "left").crossJoin(F.broadcast(weight))
        return new.select("id", F.coalesce(F.col("h") / F.col("weight"), F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("authority"), "old_hub", "old_authority")

    return _rounds(state, step, ("hub", "authority"), tolerance, most, "HITS").select("id", "hub", "authority")


def order_by(scores: DataFrame, score: str) -> DataFrame:
    """id and rank from 1, highest first, ties (to nine digits) by id."""
    from textloom.operators.scan import ordered_scan

    rounded = scores.select("id", F.round(score, 9).alias("s"))
    return ordered_scan(rounded, [F.desc("s"), F.asc("id")], number="rank").select("id", F.col("rank").cast("long").alias("rank"))


def node_class(url: Column, seed: Column, out_degree: Column) -> Column:
    return F.when(seed, "red").when(dynamic(url), "deepskyblue").when(out_degree == 0, "limegreen").otherwise("yellow")


def two_hops(edges: DataFrame) -> DataFrame:
    """src and dst within two links, src itself left out."""
    e = edges.distinct()
    second = e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
    return e.union(second).where("src <> dst").distinct()

