"""Queries on links, crawling and link analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import evaluation, web
from textloom.plans.base import query, shared
from textloom.scratch import folder
from textloom.sources import sinks
from textloom.sources.readers import table

#: Rounds of the SQL, which cannot stop by a tolerance: more than the queries need to reach theirs.
ROUNDS = 100
HOST = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
LINKS_SQL = rf"""lk AS (SELECT page_id, pos - 1 AS pos, href, CASE WHEN href LIKE '/%' THEN {HOST} || href ELSE href END AS url FROM
  (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS h FROM pages)))"""
GRAPH_SQL = f"""{LINKS_SQL}, hs AS (SELECT DISTINCT page_id, href FROM lk),
  pair AS (SELECT DISTINCT a.page_id AS src, b.page_id AS dst FROM hs a JOIN hs b ON a.href = b.href AND a.page_id <> b.page_id),
  ed AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM pair) WHERE n <= 3),
  nd AS MATERIALIZED (SELECT src AS id FROM ed UNION SELECT dst FROM ed)"""
DEPTH_SQL = "len(list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/'), lambda p: p <> ''))"
_LABELS = "string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.')"
DOMAIN_SQL = f"array_to_string(list_slice({_LABELS}, CASE WHEN length({_LABELS}[-1]) = 2 AND len({_LABELS}) > 1 AND {_LABELS}[-2] IN ({', '.join(repr(x) for x in web.SECOND_LEVEL)}) THEN -3 ELSE -2 END, -1), '.')"


@shared("graph")
def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.shared_link_graph(table(spark, sf_dir, "pages"))


@query(f"WITH {LINKS_SQL} SELECT page_id, pos, href, url FROM lk")
def page_outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.outlinks(table(spark, sf_dir, "pages"))


@query(f"WITH {LINKS_SQL} SELECT {DEPTH_SQL} AS depth, count(*) AS n FROM lk GROUP BY 1")
def url_depth_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.outlinks(table(spark, sf_dir, "pages")).groupBy(web.physical_depth(F.col("url")).alias("depth")).agg(F.count("*").alias("n"))


@query(f"WITH {LINKS_SQL} SELECT contains(url, '?') AS is_dynamic, count(*) AS n FROM lk GROUP BY 1")
def url_dynamic_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.outlinks(table(spark, sf_dir, "pages")).groupBy(web.dynamic(F.col("url")).alias("is_dynamic")).agg(F.count("*").alias("n"))


@query(f"SELECT {DOMAIN_SQL} AS domain, count(*) AS n FROM pages GROUP BY 1")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(web.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"WITH {LINKS_SQL} SELECT url FROM lk WHERE url LIKE 'http%' AND {DEPTH_SQL} <= 3 GROUP BY url")
def crawlable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.outlinks(table(spark, sf_dir, "pages")).where(web.crawlable(F.col("url"), 3)).select("url").distinct()


@query(f"WITH {GRAPH_SQL} SELECT src, dst FROM ed")
def page_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)


@query(f"WITH {GRAPH_SQL} SELECT id, count(src) AS out_degree, count(src) = 0 AS leaf FROM nd LEFT JOIN ed ON id = src GROUP BY id")
def out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph(spark, sf_dir)
    counts = edges.groupBy("src").agg(F.count("*").alias("n"))
    return web.nodes(edges).join(counts, F.col("id") == F.col("src"), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("out_degree"), F.col("n").isNull().alias("leaf"))


@query(f"WITH {GRAPH_SQL} SELECT page_id AS id, CASE WHEN page_id <= (SELECT min(page_id) + 4 FROM pages) THEN 'red' WHEN contains(url, '?') THEN 'deepskyblue' WHEN page_id NOT IN (SELECT src FROM ed) THEN 'limegreen' ELSE 'yellow' END AS color FROM pages")
def node_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each page; the five smallest ids are the seeds."""
    pages, edges = table(spark, sf_dir, "pages"), graph(spark, sf_dir)
    counts = edges.groupBy("src").agg(F.count("*").alias("n"))
    first = pages.agg(F.min("page_id").alias("first"))  # one row
    rows = pages.select("page_id", "url").crossJoin(F.broadcast(first)).join(counts, F.col("page_id") == F.col("src"), "left")
    return rows.select(F.col("page_id").alias("id"), web.node_class(F.col("url"), F.col("page_id") <= F.col("first") + 4, F.coalesce("n", F.lit(0))).alias("color"))


@query(f"WITH {GRAPH_SQL} SELECT src, dst FROM (SELECT src, dst FROM ed UNION SELECT a.src, b.dst FROM ed a JOIN ed b ON a.dst = b.src) WHERE src <> dst")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.two_hops(graph(spark, sf_dir))


def _pagerank_sql() -> str:
    out = f"{GRAPH_SQL}, dg AS MATERIALIZED (SELECT id, count(src) AS g FROM nd LEFT JOIN ed ON id = src GROUP BY id), n AS (SELECT count(*) AS n FROM nd), r0 AS MATERIALIZED (SELECT id, 1 / n AS s FROM nd, n)"
    for i in range(ROUNDS):
        out += f""", r{i + 1} AS MATERIALIZED (SELECT id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(x, 0) + loose / n) AS s FROM nd LEFT JOIN
          (SELECT dst AS id, sum(s / g) AS x FROM r{i} JOIN dg USING (id) JOIN ed ON id = src GROUP BY dst) USING (id), n, (SELECT coalesce(sum(s), 0) AS loose FROM r{i} JOIN dg USING (id) WHERE g = 0))"""
    return out


def _hits_sql() -> str:
    out = f"{GRAPH_SQL}, h0 AS MATERIALIZED (SELECT id, 1 / (SELECT count(*) FROM nd) AS s FROM nd)"
    scaled = lambda x: f"SELECT id, s / (SELECT sum(s) FROM ({x})) AS s FROM ({x})"
    for i in range(ROUNDS):
        sums = lambda to, at, old: f"SELECT id, coalesce(x, 0) AS s FROM nd LEFT JOIN (SELECT {to} AS id, sum(s) AS x FROM {old} JOIN ed ON id = {at} GROUP BY {to}) USING (id)"
        out += f", a{i + 1} AS MATERIALIZED ({scaled(sums('dst', 'src', f'h{i}'))}), h{i + 1} AS MATERIALIZED ({scaled(sums('src', 'dst', f'a{i + 1}'))})"
    return out


@shared("pagerank")
def _pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.pagerank(graph(spark, sf_dir))


@shared("hits")
def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.hits(graph(spark, sf_dir))


@query(f"WITH {_pagerank_sql()} SELECT id, round(s, 6) AS score FROM r{ROUNDS}")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pagerank(spark, sf_dir).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_hits_sql()} SELECT id, round(h.s, 6) AS hub, round(a.s, 6) AS authority FROM h{ROUNDS} h JOIN a{ROUNDS} a USING (id)")
def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("id", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


def _order_sql(source: str, name: str) -> str:
    return f"{name} AS (SELECT id, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank FROM {source})"


@query(f"WITH {_pagerank_sql()}, {_order_sql(f'r{ROUNDS}', 'o')} SELECT id, rank FROM o")
def pagerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.order_by(_pagerank(spark, sf_dir), "score")


@query(f"WITH {_hits_sql()}, {_order_sql(f'a{ROUNDS}', 'o')} SELECT id, rank FROM o")
def hits_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by authority."""
    return web.order_by(_hits(spark, sf_dir), "authority")


_OVERLAP = """ks AS (SELECT unnest(range(10, (SELECT least(501, count(*)) FROM o), 10)) AS k)
  SELECT k, (SELECT count(*) FROM o JOIN di USING (id) WHERE greatest(o.rank, di.rank) <= k) / k AS overlap FROM ks"""


@query(f"""WITH {_pagerank_sql()}, {_order_sql(f'r{ROUNDS}', 'o')}, {_hits_sql()[len(GRAPH_SQL) + 2:]}, {_order_sql(f'a{ROUNDS}', 'di')}, {_OVERLAP}""")
def rank_overlap_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the PageRank order with the authority order of HITS."""
    return evaluation.overlap(pagerank_order(spark, sf_dir), hits_order(spark, sf_dir))


@query(f"""WITH {_pagerank_sql()}, {_order_sql(f'r{ROUNDS}', 'o')}, di AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM nd), {_OVERLAP}""")
def discovery_overlap_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the PageRank order with the order of discovery (by id)."""
    found = web.nodes(graph(spark, sf_dir)).withColumn("score", -F.col("id").cast("double"))
    return evaluation.overlap(pagerank_order(spark, sf_dir), web.order_by(found, "score"))


def _offline_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, pos, link: the page graph as a web without a network."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    order = Window.partitionBy("src").orderBy("dst")
    links = graph(spark, sf_dir).withColumn("pos", F.row_number().over(order).cast("long"))
    named = links.join(pages.select(F.col("page_id").alias("dst"), F.col("url").alias("link")), "dst")
    return pages.join(named, pages["page_id"] == named["src"], "left").select("url", "pos", "link")


def _crawl(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    seeds = table(spark, sf_dir, "pages").orderBy(F.desc("page_id")).limit(5).select("url", F.col("page_id").alias("place"))
    found = web.crawl(seeds, _offline_web(spark, sf_dir), **limits)
    return found.withColumn("outlinks", F.array_join(F.col("outlinks").cast("array<string>"), ","))


@query()
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent counters, so no SQL; held against a queue in the tests."""
    return _crawl(spark, sf_dir)


@query()
def crawl_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both caps at 500 pages, 50 a site; only what was visited is returned."""
    return _crawl(spark, sf_dir, per_site=50, max_known=500, max_pages=500).where("visited")


@query()
def crawl_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the number of links from a seed."""
    return _crawl(spark, sf_dir).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query()
def crawl_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between the pages of a crawl, by their numbers."""
    return _crawl(spark, sf_dir).select(F.col("id").alias("src"), F.explode(F.split("outlinks", ",")).alias("dst")).where("dst <> ''").select("src", F.col("dst").cast("long").alias("dst"))


@query(f"""WITH {GRAPH_SQL}, c AS (SELECT page_id AS id, url AS label, CASE WHEN page_id <= (SELECT min(page_id) + 4 FROM pages) THEN 'red' WHEN contains(url, '?') THEN 'deepskyblue' WHEN page_id NOT IN (SELECT src FROM ed) THEN 'limegreen' ELSE 'yellow' END AS color FROM pages)
  SELECT id, label, color, (SELECT count(*) FROM ed WHERE src = id) AS n_links FROM c""")
def graph_for_viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page graph written for a viewer and read back: each node with its number of links."""
    path = folder(spark, "viewer")
    labels = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("label"))
    sinks.viewer_files(node_class(spark, sf_dir).join(labels, "id"), graph(spark, sf_dir), path)
    nodes = spark.read.schema("id long, label string, color string").json(f"{path}/nodes")
    edges = spark.read.schema("`from` long, `to` long").json(f"{path}/edges").groupBy(F.col("from").alias("id")).agg(F.count("*").alias("n"))
    return nodes.join(edges, "id", "left").select("id", "label", "color", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
