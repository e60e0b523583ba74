"""Named queries over the projected graph, each with its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ancestra.functions import text
from ancestra.operators import answers, clean, content, crawl, fields, metrics, models, narrative, present, ranking, recover, stats, temporal, walks
from ancestra.plans import fixtures as fx
from ancestra.plans.storage import checkpointed, new_folder
from ancestra.sources import settings
from ancestra.sources import works as records

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p.strip() for p in parts) + "\n"


REACH = "reached(id) AS (SELECT origin FROM newest UNION SELECT e.target FROM reached r JOIN {edges} e ON e.source = r.id)"
LINEAGE = "lineage AS (SELECT e.source, e.target FROM {edges} e WHERE e.source IN (SELECT id FROM reached) AND e.target IN (SELECT id FROM reached))"
DAG = (fx.BASE, REACH.format(edges="edges"), LINEAGE.format(edges="edges"))
CYCLIC = (fx.BASE, REACH.format(edges="cyclic"), LINEAGE.format(edges="cyclic"))

ACYCLIC = (
    "paths(a, b) AS (SELECT source, target FROM lineage UNION SELECT p.a, l.target FROM paths p JOIN lineage l ON l.source = p.b)",
    "knots AS (SELECT p.a AS id, least(min(p.b), p.a) AS knot FROM paths p JOIN paths q ON q.a = p.b AND q.b = p.a WHERE p.a <> p.b GROUP BY p.a)",
    "marked AS (SELECT l.source, l.target, k.knot AS ks, m.knot AS kt FROM lineage l LEFT JOIN knots k ON k.id = l.source LEFT JOIN knots m ON m.id = l.target)",
    "within AS (SELECT target AS id, count(*) AS degree FROM marked WHERE ks = kt GROUP BY target)",
    "places AS (SELECT k.id, row_number() OVER (PARTITION BY k.knot ORDER BY -coalesce(w.year, 0), coalesce(d.degree, 0), k.id) AS place FROM knots k LEFT JOIN works w ON w.id = k.id LEFT JOIN within d ON d.id = k.id)",
    "straight AS (SELECT m.source, m.target FROM marked m LEFT JOIN places s ON s.id = m.source LEFT JOIN places t ON t.id = m.target WHERE NOT coalesce(m.ks = m.kt AND s.place > t.place, false))",
)

ROUNDS = 64


def _mass(edges: str, weight: str, tag: str = "") -> list[str]:
    """A chain of common tables that moves mass along edges, a round each."""
    m = f"m{tag}"
    out = [f"{m}0 AS MATERIALIZED (SELECT origin AS id, CAST(1 AS DOUBLE) AS mass FROM newest)"]
    for k in range(1, ROUNDS):
        out.append(f"{m}{k} AS MATERIALIZED (SELECT e.target AS id, sum(m.mass * {weight}) AS mass FROM {m}{k - 1} m JOIN {edges} e ON e.source = m.id GROUP BY e.target)")
    out.append(f"moved{tag} AS (SELECT id, sum(mass) AS mass FROM (" + " UNION ALL ".join(f"SELECT * FROM {m}{k}" for k in range(1, ROUNDS)) + ") GROUP BY id)")
    return out


AGED = "power(0.5, coalesce((SELECT year FROM works WHERE id = (SELECT origin FROM newest)) - w.year, 0) / 10.0)"


class Lineage:
    """What the ranking queries share: works, edges, the origin, and what it reaches."""

    def __init__(self, spark: SparkSession, sf_dir: str, cyclic: bool = False):
        self.works = fx.works(spark, sf_dir)
        self.years = self.works.select("id", "year")
        self.edges = fx.cyclic(spark, sf_dir) if cyclic else fx.citations(spark, sf_dir)
        self.origins = checkpointed(fx.newest(spark, sf_dir))
        self.reached = checkpointed(walks.reach(self.edges, self.origins))
        self.lineage = checkpointed(walks.ancestry(self.edges, self.reached))

    def straight(self) -> DataFrame:
        return checkpointed(walks.acyclic(self.lineage, self.years))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Sources and projections


@query(_with(fx.BASE) + "SELECT w.id, w.title, w.year FROM works w WHERE w.n IN (SELECT 7 * i FROM range(1, 21) r(i))")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.range(1, 21).select(F.concat(F.lit("W"), (F.col("id") * 7).cast("string")).alias("id"))
    return fx.works(spark, sf_dir).join(ids, "id", "left_semi").select("id", "title", "year")


@query(_with(fx.BASE) + "SELECT id, topic, year FROM works WHERE topic = 'Ten' AND year BETWEEN 1990 AND 2000")
def topic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.works(spark, sf_dir).where("topic = 'Ten' AND year BETWEEN 1990 AND 2000").select("id", "topic", "year")


@query(_with(fx.BASE) + "SELECT e.target AS id, e.source AS citer, w.year FROM edges e JOIN works w ON w.id = e.source WHERE e.target IN ('W3', 'W10', 'W50') AND w.year >= 1981")
def citing_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = fx.works(spark, sf_dir).select(F.col("id").alias("citer"), "year")
    edges = fx.citations(spark, sf_dir).where("target IN ('W3', 'W10', 'W50')").select(F.col("target").alias("id"), F.col("source").alias("citer"))
    return edges.join(works, "citer").where("year >= 1981").select("id", "citer", "year")


@query(_with(fx.BASE) + "SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 50 AS BIGINT) AS chunk FROM works")
def id_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chunks(fx.works(spark, sf_dir).select("id"), 50)


@query(_with(fx.BASE, fx.RAW) + "SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM raw_works) WHERE k = 1")
def journal_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.first_of_each(fx.raw_works(spark, sf_dir)).select("id", "title")


@query(_with(fx.BASE, fx.RAW) + "SELECT DISTINCT source, target FROM raw_edges")
def journal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.distinct_edges(fx.raw_citations(spark, sf_dir))


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY user_id, event_type")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT doc_id, CASE WHEN text = '' THEN NULL ELSE text END AS abstract FROM documents")
def inverted_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as places by word and back, inside its row."""
    told = fx.documents(spark, sf_dir).select("doc_id", F.when(F.col("text") != "", text.inverted(F.col("text"))).alias("index"))
    return told.select("doc_id", text.inverted_to_text(F.col("index")).alias("abstract"))


@query("SELECT page_id, string_split(url, '/')[-1] AS id FROM pages")
def id_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.strip_prefix(F.col("url")).alias("id"))


# Cleaning

FIRST_RUN = "regexp_extract_all(lower(authors[1]), '[a-z]+')[-1]"
SHOWN = """list_transform(authors, lambda x: CASE WHEN len(string_split(regexp_replace(x, '\\s+[0-9]{4}-([0-9]{4})?$', ''), ',')) = 2
  THEN array_to_string(list_filter(list_reverse(list_transform(string_split(regexp_replace(x, '\\s+[0-9]{4}-([0-9]{4})?$', ''), ','), lambda p: trim(p))), lambda p: p <> ''), ' ')
  ELSE regexp_replace(x, '\\s+[0-9]{4}-([0-9]{4})?$', '') END)"""


@query(_with(fx.BASE, fx.RAW) + f"SELECT id, ord, array_to_string({SHOWN}, '; ') AS authors FROM raw_works")
def author_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.renamed(fx.raw_works(spark, sf_dir)).select("id", "ord", F.array_join("authors", "; ").alias("authors"))


@query(_with(fx.BASE, fx.RAW) + "SELECT id, ord, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key FROM raw_works")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.raw_works(spark, sf_dir).select("id", "ord", text.title_key(F.col("title")).alias("key"))


def _redate(nodes: str, edges: str) -> str:
    return f"SELECT n.* REPLACE (CASE WHEN n.year > c.earliest + 1 THEN c.earliest ELSE n.year END AS year) FROM {nodes} n LEFT JOIN (SELECT e.target, min(s.year) AS earliest FROM {edges} e JOIN {nodes} s ON s.id = e.source GROUP BY e.target) c ON c.target = n.id"


def _fold(nodes: str, edges: str, pairs: str, new: str) -> tuple[str, ...]:
    return (
        f"live{new} AS (SELECT dup, kept FROM {pairs} WHERE dup IN (SELECT id FROM {nodes}) AND kept IN (SELECT id FROM {nodes}))",
        f"edges{new} AS (SELECT coalesce(a.kept, e.source) AS source, coalesce(b.kept, e.target) AS target FROM {edges} e LEFT JOIN live{new} a ON a.dup = e.source LEFT JOIN live{new} b ON b.dup = e.target)",
        f"spare{new} AS (SELECT l.kept, min_by(n.abstract, n.ord) AS spare FROM {nodes} n JOIN live{new} l ON l.dup = n.id WHERE n.abstract IS NOT NULL AND n.abstract <> '' GROUP BY l.kept)",
        f"nodes{new} AS (SELECT n.* REPLACE (CASE WHEN (n.abstract IS NULL OR n.abstract = '') AND s.spare IS NOT NULL THEN s.spare ELSE n.abstract END AS abstract) FROM {nodes} n LEFT JOIN spare{new} s ON s.kept = n.id WHERE n.id NOT IN (SELECT dup FROM live{new}))",
    )


CLEAN = (
    fx.BASE,
    fx.RAW,
    "unique_works AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM raw_works) WHERE k = 1)",
    f"nodes0 AS (SELECT id, n, CASE WHEN n % 97 = 1 AND id LIKE 'W%' THEN 'Corrected ' || n ELSE title END AS title, CASE WHEN n % 97 = 1 AND id LIKE 'W%' THEN NULL ELSE abstract END AS abstract, year, topic, {SHOWN} AS authors, ord FROM unique_works WHERE NOT (n % 211 = 5 AND id LIKE 'W%'))",
    "merge0 AS (SELECT 'W' || n AS dup, 'W' || (n - 6) AS kept FROM works WHERE n % 101 = 7)",
    *_fold("nodes0", "raw_edges", "merge0", "1"),
    "dated1 AS (" + _redate("nodes1", "edges1") + ")",
    f"keyed AS (SELECT d.id, d.year, regexp_replace(lower(d.title), '[^a-z0-9]', '', 'g') AS t, {FIRST_RUN} AS a, coalesce(c.n, 0) AS cited FROM dated1 d LEFT JOIN (SELECT target, count(*) AS n FROM edges1 GROUP BY target) c ON c.target = d.id)",
    "firsts AS (SELECT id, year, first_value(id) OVER w AS kept, first_value(year) OVER w AS kept_year FROM keyed WHERE t <> '' AND a <> '' WINDOW w AS (PARTITION BY t, a ORDER BY cited DESC, id))",
    "merge1 AS (SELECT id AS dup, kept FROM firsts WHERE id <> kept AND abs(year - kept_year) <= 2)",
    *_fold("nodes1", "edges1", "merge1", "2"),
    f"nodes3 AS (SELECT * FROM nodes2 WHERE year BETWEEN {fx.START} AND {fx.END})",
    "edges3 AS (SELECT DISTINCT source, target FROM edges2)",
    "edges4 AS (SELECT * FROM edges3 WHERE source <> target)",
    "edges5 AS (SELECT * FROM edges4 WHERE source IN (SELECT id FROM nodes3) AND target IN (SELECT id FROM nodes3))",
    "nodes4 AS (" + _redate("nodes3", "edges5") + ")",
    "around AS MATERIALIZED (SELECT source AS x, target AS y FROM edges5 UNION SELECT target, source FROM edges5)",
    "spread(id, other) AS (SELECT id, id FROM nodes4 UNION SELECT s.id, a.y FROM spread s JOIN around a ON a.x = s.other)",
    "labels AS MATERIALIZED (SELECT id, min(other) AS label FROM spread GROUP BY id)",
)


def _cleaned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return clean.clean(fx.raw_works(spark, sf_dir), fx.raw_citations(spark, sf_dir), exclude=fx.exclusions(spark, sf_dir), titles=fx.corrections(spark, sf_dir), merge=fx.merges(spark, sf_dir), start=fx.START, end=fx.END, ascii_only=True)


KEPT = "kept AS (SELECT id FROM labels WHERE label = (SELECT label FROM labels GROUP BY label ORDER BY count(*) DESC, label LIMIT 1))"


@query(_with(*CLEAN, KEPT, recursive=True) + "SELECT id, title, abstract, year, array_to_string(authors, '; ') AS authors FROM nodes4 WHERE id IN (SELECT id FROM kept)")
def clean_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)[0].select("id", "title", "abstract", "year", F.array_join("authors", "; ").alias("authors"))


@query(_with(*CLEAN, KEPT, recursive=True) + "SELECT source, target FROM edges5 WHERE source IN (SELECT id FROM kept)")
def clean_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)[1]


@query(
    _with(*CLEAN, KEPT, recursive=True)
    + """SELECT (SELECT count(*) FROM raw_works) AS raw_nodes, (SELECT count(*) FROM raw_edges) AS raw_edges,
  (SELECT count(*) FROM raw_works) - (SELECT count(*) FROM unique_works) AS duplicate_nodes,
  (SELECT count(*) FROM nodes0 WHERE title LIKE 'Corrected %') AS retitled_nodes,
  (SELECT count(*) FROM unique_works WHERE id LIKE 'P%') AS renamed_authors,
  (SELECT count(*) FROM unique_works) - (SELECT count(*) FROM nodes0) AS excluded_nodes,
  (SELECT count(*) FROM nodes0) - (SELECT count(*) FROM nodes2) AS merged_nodes,
  (SELECT count(*) FROM nodes2) - (SELECT count(*) FROM nodes3) AS out_of_range_nodes,
  (SELECT count(*) FROM raw_edges) - (SELECT count(*) FROM edges3) AS duplicate_edges,
  (SELECT count(*) FROM edges3) - (SELECT count(*) FROM edges4) AS self_loops,
  (SELECT count(*) FROM edges4) - (SELECT count(*) FROM edges5) AS dangling_edges,
  (SELECT count(*) FROM nodes4 a JOIN nodes3 b ON a.id = b.id WHERE a.year <> b.year) AS redated_nodes,
  (SELECT count(*) FROM nodes3) - (SELECT count(*) FROM kept) AS disconnected_nodes,
  (SELECT count(*) FROM kept) AS nodes, (SELECT count(*) FROM edges5 WHERE source IN (SELECT id FROM kept)) AS edges"""
)
def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)[2]


@query(_with(*CLEAN, recursive=True) + "SELECT dup, kept FROM merge1")
def fold_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = clean.renamed(clean.retitled(clean.excluded(clean.first_of_each(fx.raw_works(spark, sf_dir)), fx.exclusions(spark, sf_dir)), fx.corrections(spark, sf_dir)))
    works, cites = clean.folded(held, fx.raw_citations(spark, sf_dir), fx.merges(spark, sf_dir))
    return clean.versions(works, cites, ascii_only=True)


@query(_with(fx.BASE, "dated AS (" + _redate("works", "cyclic") + ")") + "SELECT d.id, d.year, w.year AS old_year FROM dated d JOIN works w ON w.id = d.id WHERE d.year <> w.year")
def redate(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = fx.works(spark, sf_dir)
    return clean.redated(works, fx.cyclic(spark, sf_dir)).select("id", "year").join(works.select("id", F.col("year").alias("old_year")), "id").where("year <> old_year")


@query(
    _with(fx.BASE, "near(id, other) AS (SELECT id, id FROM works UNION SELECT n.id, l.y FROM near n JOIN (SELECT source AS x, target AS y FROM edges UNION SELECT target, source FROM edges) l ON l.x = n.other)", recursive=True)
    + "SELECT id, min(other) AS label FROM near GROUP BY id"
)
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.components(fx.citations(spark, sf_dir), fx.works(spark, sf_dir).select("id"))


@query(_with(fx.BASE, fx.RAW) + "SELECT id, ord, coalesce(regexp_extract_all(lower(strip_accents(authors[1])), '[a-z]+')[-1], regexp_replace(authors[1], '\\s', '', 'g'), '') AS key FROM raw_works")
def author_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.raw_works(spark, sf_dir).select("id", "ord", text.first_author_key(F.col("authors")).alias("key"))


@query(_with(fx.BASE, fx.RAW) + "SELECT id, coalesce(title, '') AS title, coalesce(year, -1) AS year, topic FROM works UNION ALL SELECT id, '', -1, '' FROM (SELECT source AS id FROM raw_edges UNION SELECT target FROM raw_edges) WHERE id NOT IN (SELECT id FROM works)")
def graph_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = fields.attributed(fx.works(spark, sf_dir), fx.raw_citations(spark, sf_dir), ("title", "year", "topic"))
    return graph.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("year", F.lit(-1)).alias("year"), F.coalesce("topic", F.lit("")).alias("topic"))


@query()
def field_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field cleaned by its settings into a snapshot: the report of its steps and graph."""
    told = {t: [tuple(r) for r in rows.orderBy("id").limit(20).collect()] for t, rows in (("exclude", fx.exclusions(spark, sf_dir)), ("titles", fx.corrections(spark, sf_dir)))}
    field = settings.Field("all", "", ("W1", "W2"), exclude=tuple(r[0] for r in told["exclude"]), titles=dict(told["titles"]), crawl=settings.Crawl(start=fx.START, end=fx.END))
    return fields.build_field(spark, field, fx.raw_works(spark, sf_dir), fx.raw_citations(spark, sf_dir), new_folder(spark, "fields"), "2025-01-01")[1]


# Statistics

DEGREES = "degrees AS (SELECT w.id, count(DISTINCT i.source) AS in_degree, count(DISTINCT o.target) AS out_degree FROM works w LEFT JOIN edges i ON i.target = w.id LEFT JOIN edges o ON o.source = w.id GROUP BY w.id)"


@query(
    _with(fx.BASE, DEGREES, "near(id, other) AS (SELECT id, id FROM works UNION SELECT n.id, e.y FROM near n JOIN (SELECT source AS x, target AS y FROM edges UNION SELECT target, source FROM edges) e ON e.x = n.other)", "labels AS (SELECT id, min(other) AS label FROM near GROUP BY id)", recursive=True)
    + """SELECT count(*) AS nodes, round(avg(in_degree), 6) AS mean_in, max(in_degree) AS max_in, max(out_degree) AS max_out, count(*) FILTER (in_degree + out_degree = 0) AS isolated,
  (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT label) FROM labels) AS components, (SELECT min(year) FROM works) AS first_year, (SELECT max(year) FROM works) AS last_year,
  (SELECT count(*) FROM works WHERE year IS NULL) AS undated, (SELECT count(*) FROM works WHERE abstract IS NULL OR abstract = '') AS no_abstract,
  round((SELECT count(*) FROM edges) / (count(*) * (count(*) - 1)), 6) AS density, round((SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY label)) / count(*), 6) AS largest_share FROM degrees"""
)
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.summary(fx.works(spark, sf_dir), fx.citations(spark, sf_dir)), "mean_in", "density", "largest_share")


@query(_with(fx.BASE, DEGREES) + "SELECT d.id, w.title, w.year, d.in_degree FROM degrees d JOIN works w ON w.id = d.id ORDER BY in_degree DESC, d.id LIMIT 20")
def most_cited_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_cited(fx.works(spark, sf_dir), fx.citations(spark, sf_dir), 20)


@query(_with(fx.BASE, DEGREES) + "SELECT in_degree, count(*) AS n FROM degrees GROUP BY in_degree")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(stats.degrees(fx.works(spark, sf_dir), fx.citations(spark, sf_dir)), "in_degree")


@query(_with(fx.BASE) + "SELECT year, count(*) AS n FROM works GROUP BY year")
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(fx.works(spark, sf_dir), "year")


ORDERS = fx.ORDER_CITATIONS.format(lineitem="lineitem", orders="orders").replace("STRING", "VARCHAR")


@query(f"WITH e AS ({ORDERS}) SELECT target AS id, count(*) AS n FROM e GROUP BY target ORDER BY n DESC, id LIMIT 50")
def order_graph_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.order_citations(spark, sf_dir).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "id").limit(50)


@query(_with(fx.BASE, "reached(id) AS (SELECT id FROM works WHERE n % 100 = 99 UNION SELECT e.target FROM reached r JOIN edges e ON e.source = r.id)", recursive=True) + "SELECT count(*) AS covered, (SELECT count(*) FROM works) AS nodes FROM reached")
def seed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = fx.works(spark, sf_dir)
    seeds = works.where("n % 100 = 99").select(F.lit("all").alias("origin"), F.col("id"))
    turned = fx.citations(spark, sf_dir).union(seeds.select(F.col("origin").alias("source"), F.col("id").alias("target")))
    covered = walks.reach(turned, seeds.select("origin").distinct()).where("depth > 0").agg(F.count("*").alias("covered"))
    return covered.crossJoin(works.agg(F.count("*").alias("nodes")))  # one row each


# Crawling

HOPS = "hops(id, hop) AS (SELECT id, 0 FROM works WHERE n >= (SELECT max(n) FROM works) - 2 UNION SELECT e.target, h.hop + 1 FROM hops h JOIN works w ON w.id = h.id AND w.year >= 1985 JOIN edges e ON e.source = h.id WHERE h.hop < 3)"
FETCHED = "fetched AS (SELECT h.id, min(h.hop) AS hop FROM hops h WHERE h.id IN (SELECT id FROM works) GROUP BY h.id)"


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = fx.works(spark, sf_dir)
    last = works.agg(F.max("n").alias("last"))
    seeds = works.crossJoin(F.broadcast(last)).where("n >= last - 2")  # one row
    return crawl.backward(works, fx.citations(spark, sf_dir), seeds, 3, start=1985)


@query(_with(fx.BASE, HOPS, FETCHED, recursive=True) + "SELECT id, hop FROM fetched")
def snowball_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fetched(spark, sf_dir)


@query(
    _with(fx.BASE, HOPS, FETCHED, "allowed AS (SELECT id FROM works WHERE year >= 1985 AND topic = 'Ten')", "f1 AS (SELECT DISTINCT source AS id FROM edges WHERE target IN (SELECT id FROM fetched) AND source IN (SELECT id FROM allowed))", "f2 AS (SELECT DISTINCT source AS id FROM edges WHERE target IN (SELECT id FROM f1) AND source IN (SELECT id FROM allowed))", recursive=True)
    + "SELECT id, 1 AS hop FROM f1 WHERE id NOT IN (SELECT id FROM fetched) UNION ALL SELECT id, 2 FROM f2 WHERE id NOT IN (SELECT id FROM fetched) AND id NOT IN (SELECT id FROM f1)"
)
def forward_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.forward(fx.works(spark, sf_dir), fx.citations(spark, sf_dir), _fetched(spark, sf_dir), 2, topic="Ten", start=1985)


@query(_with(fx.BASE, HOPS, FETCHED, recursive=True) + "SELECT target AS id, count(*) AS n FROM edges WHERE source IN (SELECT id FROM fetched) AND target NOT IN (SELECT id FROM fetched) GROUP BY target HAVING count(*) >= 2")
def threshold_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.fill(fx.citations(spark, sf_dir), _fetched(spark, sf_dir), 2)


@query(_with(fx.BASE, HOPS, FETCHED, recursive=True) + "SELECT 'backward' AS phase, hop, id FROM fetched ORDER BY hop, id LIMIT 40")
def crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty works of a crawl that may fetch no more."""
    works = fx.works(spark, sf_dir)
    last = works.agg(F.max("n").alias("last"))
    seeds = works.crossJoin(F.broadcast(last)).where("n >= last - 2").select("id")  # one row
    return crawl.snowball(works, fx.citations(spark, sf_dir), seeds, new_folder(spark, "crawl"), hops=3, start=1985, most=40)


# Recovery

REFS = "refs AS (SELECT 'W' || n AS source, CASE WHEN n % 4 = 0 THEN CAST(n // 2 AS VARCHAR) END AS ref_id, t.title || '.' AS ref_title, CASE WHEN n % 5 > 0 THEN t.year + n % 3 END AS ref_year FROM works s JOIN (SELECT n // 1 AS tn, title, year FROM works) t ON t.tn = s.n // 3 WHERE s.n % 2 = 0)"
MATCHED = (
    REFS,
    "by_id AS (SELECT r.*, w.id AS found FROM refs r LEFT JOIN works w ON w.id = 'W' || r.ref_id)",
    "titled AS (SELECT id, year, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t FROM works)",
    "one AS (SELECT b.source, t.t, b.ref_year, min(t.id) AS target FROM by_id b JOIN titled t ON t.t = regexp_replace(lower(b.ref_title), '[^a-z0-9]', '', 'g') AND t.t <> '' AND (b.ref_year IS NULL OR t.year IS NULL OR abs(t.year - b.ref_year) <= 1) WHERE b.found IS NULL GROUP BY ALL HAVING count(DISTINCT t.id) = 1)",
    "matched AS (SELECT DISTINCT source, target FROM (SELECT source, found AS target FROM by_id WHERE found IS NOT NULL UNION ALL SELECT source, target FROM one) WHERE source <> target)",
)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = fx.works(spark, sf_dir)
    cited = works.select(F.col("n").alias("tn"), F.col("title").alias("old"), F.col("year").alias("old_year"))
    met = works.where("n % 2 = 0").join(cited, F.expr("n div 3 = tn"))
    return met.selectExpr("id AS source", "CASE WHEN n % 4 = 0 THEN CAST(n div 2 AS STRING) END AS ref_id", "old || '.' AS ref_title", "CASE WHEN n % 5 > 0 THEN old_year + n % 3 END AS ref_year")


@query(_with(fx.BASE, *MATCHED) + "SELECT source, target FROM matched")
def recover_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recover.recovered(fx.works(spark, sf_dir), _references(spark, sf_dir))


@query(_with(fx.BASE, *MATCHED) + "SELECT source, target FROM matched EXCEPT SELECT source, target FROM edges")
def new_edges_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recover.new_only(recover.recovered(fx.works(spark, sf_dir), _references(spark, sf_dir)), fx.citations(spark, sf_dir))


@query(_with(fx.BASE) + "SELECT id, CASE WHEN n * 9973 * 1000 < 4000000000 THEN n * 9973 * 1000 END AS foreign_id FROM works")
def foreign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.works(spark, sf_dir).select("id", recover.foreign_id(F.concat(F.lit("W"), (F.col("n") * 9973 * 1000).cast("string"))).alias("foreign_id"))


# Ranking one work's ancestors

IN_DEGREE = "scores AS (SELECT r.id, CAST(count(l.source) AS DOUBLE) AS score FROM reached r LEFT JOIN lineage l ON l.target = r.id WHERE r.id <> (SELECT origin FROM newest) GROUP BY r.id)"
TOP = "SELECT (SELECT origin FROM newest) AS origin, id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS place FROM scores QUALIFY place <= 10"
ALL = "SELECT (SELECT origin FROM newest) AS origin, id, round(score, 6) AS score FROM scores"


@query(_with(*DAG, IN_DEGREE, recursive=True) + TOP)
def ancestors_indegree_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir)
    return _rounded(walks.ranked(walks.in_degree(g.lineage, g.reached)), "score")


@query(_with(fx.BASE, "steps(id, depth) AS (SELECT origin, 0 FROM newest UNION SELECT e.target, s.depth + 1 FROM steps s JOIN edges e ON e.source = s.id)", recursive=True) + "SELECT (SELECT origin FROM newest) AS origin, id, min(depth) AS depth FROM steps GROUP BY id")
def reach_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.reach(fx.citations(spark, sf_dir), fx.newest(spark, sf_dir))


@query(_with(*CYCLIC, *ACYCLIC, recursive=True) + "SELECT (SELECT origin FROM newest) AS origin, source, target FROM straight")
def scc_acyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lineage(spark, sf_dir, cyclic=True).straight()


@query(
    _with(*DAG, "avoided(w, id) AS (SELECT r.id, n.origin FROM reached r, newest n WHERE r.id <> n.origin UNION SELECT a.w, l.target FROM avoided a JOIN lineage l ON l.source = a.id WHERE l.target <> a.w)", "scores AS (SELECT w AS id, CAST((SELECT count(*) FROM reached) - 1 - count(*) AS DOUBLE) AS score FROM avoided GROUP BY w)", recursive=True)
    + ALL
)
def dominator_gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir)
    return walks.gateway(g.lineage, g.origins)


@query(_with(*DAG, *_mass("lineage", "0.5"), "scores AS (SELECT r.id, coalesce(m.mass, 0) AS score FROM reached r LEFT JOIN moved m ON m.id = r.id WHERE r.id <> (SELECT origin FROM newest))", recursive=True) + ALL)
def path_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir)
    return _rounded(walks.path_weight(g.lineage, g.reached), "score")


PASSED = "passed AS MATERIALIZED (SELECT source, target, 0.85::DOUBLE / count(*) OVER (PARTITION BY source) AS w FROM lineage)"
PAGERANK = (*CYCLIC, PASSED, *_mass("passed", "e.w"), "masses AS (SELECT r.id, coalesce(m.mass, 0) + CASE WHEN r.id = (SELECT origin FROM newest) THEN 1 ELSE 0 END AS mass FROM reached r LEFT JOIN moved m ON m.id = r.id)", "ranks AS (SELECT id, mass / (SELECT sum(mass) FROM masses) AS r FROM masses)")


@query(_with(*PAGERANK, recursive=True) + "SELECT (SELECT origin FROM newest) AS origin, id, round(r, 6) AS score FROM ranks WHERE id <> (SELECT origin FROM newest)")
def ppr_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir, cyclic=True)
    return _rounded(walks.pagerank(g.lineage, g.reached), "score")


@query(_with(*PAGERANK, recursive=True) + f"SELECT (SELECT origin FROM newest) AS origin, p.id, round(p.r * {AGED}, 6) AS score FROM ranks p JOIN works w ON w.id = p.id WHERE p.id <> (SELECT origin FROM newest)")
def ppr_time_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir, cyclic=True)
    return _rounded(walks.aged(walks.pagerank(g.lineage, g.reached), g.years, 10.0), "score")


FLOWED = f"scores AS (SELECT r.id, coalesce(m.mass, 0) * {AGED} AS score FROM reached r JOIN works w ON w.id = r.id LEFT JOIN moved m ON m.id = r.id WHERE r.id <> (SELECT origin FROM newest))"
UNIFORM = "evenly AS MATERIALIZED (SELECT source, target, 1.0::DOUBLE / count(*) OVER (PARTITION BY source) * 0.85 AS w FROM straight)"


@query(_with(*CYCLIC, *ACYCLIC, UNIFORM, *_mass("evenly", "e.w"), FLOWED, recursive=True) + ALL)
def uniform_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir, cyclic=True)
    return _rounded(walks.flow(g.straight(), g.reached, g.years), "score")


STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TERMS = (
    f"found AS (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', nullif(title, ''), nullif(abstract, ''))), '{text.WORD}')) AS word FROM works)",
    f"terms AS MATERIALIZED (SELECT id, word, count(*) AS tf FROM found WHERE word NOT IN ({STOP}) GROUP BY id, word)",
    "weighed AS (SELECT t.id, t.word, (1 + ln(t.tf)) * ln((SELECT count(*) FROM works) / d.df) AS w FROM terms t JOIN (SELECT word, count(*) AS df FROM terms GROUP BY word) d ON d.word = t.word)",
    "vectors AS MATERIALIZED (SELECT id, word, CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY id)) > 0 THEN w / sqrt(sum(w * w) OVER (PARTITION BY id)) ELSE w END AS weight FROM weighed)",
)


def _cosine(pairs: str) -> str:
    return f"SELECT p.source, p.target, coalesce(sum(a.weight * b.weight), 0) AS similarity FROM {pairs} p LEFT JOIN vectors a ON a.id = p.source LEFT JOIN vectors b ON b.id = p.target AND b.word = a.word GROUP BY p.source, p.target"


@query(_with(fx.BASE, *TERMS) + "SELECT id, word, tf FROM terms")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.term_counts(fx.works(spark, sf_dir))


@query(_with(fx.BASE, *TERMS) + "SELECT id, word, round(weight, 6) AS weight FROM vectors")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(content.tfidf(fx.works(spark, sf_dir)), "weight")


@query(_with(fx.BASE, *TERMS) + f"SELECT source, target, round(similarity, 6) AS similarity FROM ({_cosine('edges')})")
def edge_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(content.similarity(fx.citations(spark, sf_dir), content.tfidf(fx.works(spark, sf_dir))), "similarity")


CONTENT = ("alike AS MATERIALIZED (" + _cosine("lineage") + ")", "heavy AS MATERIALIZED (SELECT source, target, sqrt(0.02 + similarity) / sum(sqrt(0.02 + similarity)) OVER (PARTITION BY source) * 0.85 AS w FROM alike)")


@query(_with(*DAG, *TERMS, *CONTENT, *_mass("heavy", "e.w"), FLOWED, recursive=True) + ALL)
def content_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir)
    weighted = checkpointed(content.content_weights(g.lineage, content.tfidf(g.works, only=g.reached)))
    return _rounded(walks.flow(weighted, g.reached, g.years), "score")


SHOWN_TOP = "shown AS (SELECT origin AS id FROM newest UNION SELECT id FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM scores) WHERE k <= 10)"
LINKS = (
    *DAG,
    IN_DEGREE,
    SHOWN_TOP,
    "paths(a, b) AS (SELECT source, target FROM lineage UNION SELECT p.a, l.target FROM paths p JOIN lineage l ON l.source = p.b)",
    "short AS (SELECT a, b FROM paths WHERE a IN (SELECT id FROM shown) AND b IN (SELECT id FROM shown) AND a <> b)",
    "links AS (SELECT s.a AS citing, s.b AS cited, (s.a, s.b) IN (SELECT (source, target) FROM lineage) AS direct FROM short s WHERE NOT EXISTS (SELECT 1 FROM short x JOIN short y ON y.a = x.b WHERE x.a = s.a AND y.b = s.b))",
)


def _links(g: Lineage) -> tuple[DataFrame, DataFrame]:
    top = walks.ranked(walks.in_degree(g.lineage, g.reached))
    shown = checkpointed(top.select("origin", "id").union(g.origins.select("origin", F.col("origin").alias("id"))))
    return walks.skeleton(g.lineage, shown), top


@query(_with(*LINKS, recursive=True) + "SELECT (SELECT origin FROM newest) AS origin, citing, cited, direct FROM links")
def skeleton_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(Lineage(spark, sf_dir))[0]


@query(_with(*LINKS, "up(id) AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM scores) WHERE k = 3 UNION SELECT l.citing FROM up u JOIN links l ON l.cited = u.id)", recursive=True) + "SELECT (SELECT origin FROM newest) AS origin, id FROM up")
def upstream_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, top = _links(Lineage(spark, sf_dir))
    return present.upstream(checkpointed(links), top.where("place = 3").select("origin", "id"))


@query(
    _with(*PAGERANK, IN_DEGREE, "best AS (SELECT id FROM scores ORDER BY score DESC, id LIMIT 10)", "other AS (SELECT id FROM ranks WHERE id <> (SELECT origin FROM newest) ORDER BY round(r, 6) DESC, id LIMIT 10)", recursive=True)
    + "SELECT (SELECT origin FROM newest) AS origin, round((SELECT count(*) FROM best WHERE id IN (SELECT id FROM other)) / 10.0::DOUBLE, 6) AS overlap"
)
def baseline_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir, cyclic=True)
    left = walks.ranked(walks.in_degree(g.lineage, g.reached))
    right = walks.ranked(_rounded(walks.pagerank(g.lineage, g.reached), "score"))
    return _rounded(walks.overlap(left, right), "overlap")


@query(
    _with(
        *DAG,
        "counts AS (SELECT r.id, CAST(count(l.source) AS DOUBLE) AS score FROM reached r LEFT JOIN lineage l ON l.target = r.id GROUP BY r.id)",
        "avoided(w, id) AS (SELECT r.id, n.origin FROM reached r, newest n WHERE r.id <> n.origin UNION SELECT a.w, l.target FROM avoided a JOIN lineage l ON l.source = a.id WHERE l.target <> a.w)",
        *_mass("lineage", "0.5"),
        PASSED,
        *_mass("passed", "e.w", "q"),
        "masses AS (SELECT r.id, coalesce(m.mass, 0) + CASE WHEN r.id = (SELECT origin FROM newest) THEN 1 ELSE 0 END AS mass FROM reached r LEFT JOIN movedq m ON m.id = r.id)",
        recursive=True,
    )
    + f"""SELECT scorer, (SELECT origin FROM newest) AS origin, id, round(score, 6) AS score FROM (
  SELECT 'in_degree' AS scorer, id, score FROM counts
  UNION ALL SELECT 'gateway', w, CAST((SELECT count(*) FROM reached) - 1 - count(*) AS DOUBLE) FROM avoided GROUP BY w
  UNION ALL SELECT 'path_weight', r.id, coalesce(m.mass, 0) FROM reached r LEFT JOIN moved m ON m.id = r.id
  UNION ALL SELECT 'time_decayed_pagerank', p.id, p.mass / (SELECT sum(mass) FROM masses) * {AGED} FROM masses p JOIN works w ON w.id = p.id)
WHERE id <> (SELECT origin FROM newest)"""
)
def all_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir)
    return _rounded(ranking.baselines(g.lineage, g.reached, g.years, g.lineage), "score")


@query(_with(fx.BASE) + "SELECT source, target FROM edges WHERE CAST('0x' || substr(md5('7|' || source || '|' || target), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE >= 0.1")
def edge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.thinned(fx.citations(spark, sf_dir), 0.1, "7")


# Text shown to a model


@query(
    _with(fx.BASE)
    + """SELECT page_id, '<source id="' || replace(translate(url, '"' || chr(10) || chr(13), '''  '), '<', '') || '" year="2000" title="' ||
  replace(replace(translate(html, '"' || chr(10) || chr(13), '''  '), '<', ''), '>', '') || '">' || chr(10) || replace(html, '</source>', '') || chr(10) || '</source>' AS quoted FROM pages"""
)
def quoted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.quoted(F.col("url"), F.col("html"), F.lit("2000"), F.col("html")).alias("quoted"))


# Splits in time

DATED = "dated AS MATERIALIZED (SELECT e.source, e.target, s.year AS sy, t.year AS ty FROM edges e LEFT JOIN works s ON s.id = e.source LEFT JOIN works t ON t.id = e.target)"
CUTS = (
    DATED,
    "years AS (SELECT sy AS year, count(*) AS n, sum(count(*)) OVER (ORDER BY sy) AS upto, sum(count(*)) OVER () AS total FROM dated WHERE sy IS NOT NULL GROUP BY sy)",
    "c0 AS (SELECT min(year) FILTER (upto > greatest(CAST(trunc(total * (1 - 0.1::DOUBLE - 0.1::DOUBLE)) AS INT) - 1, 0)) AS train, min(year) FILTER (upto > greatest(CAST(trunc(total * (1 - 0.1::DOUBLE)) AS INT) - 1, 0)) AS val, max(year) AS last FROM years)",
    "c1 AS (SELECT train, CASE WHEN val = last THEN coalesce((SELECT max(year) FROM years WHERE year < last), val) ELSE val END AS val FROM c0)",
    "cuts AS (SELECT CASE WHEN train >= val THEN coalesce((SELECT max(year) FROM years WHERE year < val), train) ELSE train END AS train_until, val AS val_until FROM c1)",
    "splits AS MATERIALIZED (SELECT d.*, CASE WHEN sy IS NULL THEN 'undated' WHEN sy <= train_until THEN 'train' WHEN sy <= val_until THEN 'val' ELSE 'test' END AS split FROM dated d, cuts)",
)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    works = fx.works(spark, sf_dir)
    edges = temporal.dated(fx.citations(spark, sf_dir), works)
    return works, checkpointed(temporal.split(edges, temporal.cut_points(edges)))


@query(_with(fx.BASE, *CUTS) + "SELECT train_until, val_until FROM cuts")
def temporal_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.cut_points(temporal.dated(fx.citations(spark, sf_dir), fx.works(spark, sf_dir)))


@query(_with(fx.BASE, *CUTS) + "SELECT source, target, split FROM splits")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)[1].select("source", "target", "split")


@query(
    _with(fx.BASE, *CUTS, "past AS (SELECT source, target FROM splits WHERE split IN ('train', 'undated'))")
    + """SELECT w.id, round(coalesce((w.year - (SELECT min(year) FROM works)) / (SELECT greatest(max(year) - min(year), 1) FROM works), 0), 6) AS year_scaled, CASE WHEN w.year IS NULL THEN 0 ELSE 1 END AS dated,
  round(ln(1 + (SELECT count(*) FROM past WHERE target = w.id)), 6) AS log_in, round(ln(1 + (SELECT count(*) FROM past WHERE source = w.id)), 6) AS log_out, round(ln(1 + len(authors)), 6) AS log_authors FROM works w"""
)
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    works, edges = _split(spark, sf_dir)
    return _rounded(temporal.features(works, edges.where("split IN ('train', 'undated')")), "year_scaled", "log_in", "log_out", "log_authors")


@query(
    _with(fx.BASE)
    + """SELECT w.id, round(coalesce((w.year - (SELECT min(year) FROM works)) / (SELECT greatest(max(year) - min(year), 1) FROM works), 0), 6) AS year_scaled, CASE WHEN w.year IS NULL THEN 0 ELSE 1 END AS dated,
  round(ln(1 + (SELECT count(*) FROM edges WHERE target = w.id)), 6) AS log_in, round(ln(1 + (SELECT count(*) FROM edges WHERE source = w.id)), 6) AS log_out, round(ln(1 + len(authors)), 6) AS log_authors FROM works w"""
)
def full_record_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(temporal.features(fx.works(spark, sf_dir), fx.citations(spark, sf_dir)), "year_scaled", "log_in", "log_out", "log_authors")


def _negatives(matched: bool, per: int, positives: str = "SELECT source, target, sy, ty FROM splits WHERE split = 'test'") -> str:
    low = "(SELECT count(*) FROM ranked r WHERE r.year < p.ty)" if matched else "0"
    high = f"(SELECT count(*) FROM ranked r WHERE r.year <= p.{'ty' if matched else 'sy'})"
    return f"""ranked AS MATERIALIZED (SELECT id, year, row_number() OVER (ORDER BY year, id) - 1 AS p FROM works WHERE year IS NOT NULL),
bounds AS MATERIALIZED (SELECT p.source, p.target AS cited, {low} AS low, {high} AS high FROM ({positives}) p),
drawn AS (SELECT b.source, b.cited, c.c AS candidate, a.a AS attempt, b.low + CAST(floor(CAST('0x' || substr(md5('0|' || b.source || '|' || b.cited || '|' || c.c || '|' || a.a), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * (b.high - b.low)) AS BIGINT) AS p
  FROM bounds b, range(1, {per + 1}) c(c), range(1, 17) a(a) WHERE b.high > b.low),
negatives AS (SELECT d.source, d.cited, CAST(d.candidate AS INT) AS candidate, min_by(r.id, d.attempt) AS target FROM drawn d JOIN ranked r ON r.p = d.p
  WHERE r.id <> d.source AND (d.source, r.id) NOT IN (SELECT (source, target) FROM edges) GROUP BY d.source, d.cited, d.candidate)"""


@query(_with(fx.BASE, *CUTS, _negatives(False, 1)) + "SELECT source, cited, candidate, target FROM negatives")
def negatives_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    works, edges = _split(spark, sf_dir)
    return temporal.negatives(edges.where("split = 'test'"), works, edges)


@query(_with(fx.BASE, *CUTS, _negatives(True, 1)) + "SELECT source, cited, candidate, target FROM negatives")
def negatives_year_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    works, edges = _split(spark, sf_dir)
    return temporal.negatives(edges.where("split = 'test'"), works, edges, year_matched=True)


HORIZONS = "horizons AS (SELECT min(year) AS horizon, k FROM years, range(0, 3) g(k) WHERE upto > CASE WHEN trunc(total * (1 - k * 0.2::DOUBLE)) - 1 < 0 THEN trunc(total * (1 - k * 0.2::DOUBLE)) - 1 + total ELSE trunc(total * (1 - k * 0.2::DOUBLE)) - 1 END GROUP BY k)"


@query(_with(fx.BASE, *CUTS, HORIZONS) + "SELECT h.horizon, d.source, d.target FROM (SELECT DISTINCT horizon FROM horizons) h JOIN dated d ON (d.sy IS NULL OR d.sy <= h.horizon) AND (d.ty IS NULL OR d.ty <= h.horizon)")
def rolling_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = temporal.dated(fx.citations(spark, sf_dir), fx.works(spark, sf_dir))
    return temporal.view(edges, temporal.horizons(edges, 3, 0.2))


@query(_with(fx.BASE, *CUTS, "held AS (SELECT DISTINCT source FROM splits WHERE split = 'train' AND CAST('0x' || substr(md5('0|' || source), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.2)") + "SELECT source, target, 'positive' AS kind FROM splits WHERE split = 'train' AND source IN (SELECT source FROM held) UNION ALL SELECT source, target, 'message' FROM splits WHERE split IN ('train', 'undated') AND source NOT IN (SELECT source FROM held) AND target NOT IN (SELECT source FROM held)")
def cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _split(spark, sf_dir)[1]
    past = edges.where("split IN ('train', 'undated')").select("source", "target")
    positives, messages = temporal.cold_start(edges.where("split = 'train'").select("source", "target"), past, 0.2)
    return positives.withColumn("kind", F.lit("positive")).unionByName(messages.withColumn("kind", F.lit("message")))


@query(_with(fx.BASE, *CUTS) + "SELECT split, count(*) AS edges, count(DISTINCT source) AS sources, min(sy) AS first_year, max(sy) AS last_year FROM splits GROUP BY split")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)[1].groupBy("split").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"), F.min("source_year").alias("first_year"), F.max("source_year").alias("last_year"))


@query(_with(fx.BASE) + "SELECT source, target FROM edges UNION SELECT target, source FROM edges")
def undirected_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.undirected(fx.citations(spark, sf_dir))


# Metrics of the two scorers that need no model

SCORED = (
    "pool AS MATERIALIZED (SELECT source, target AS cited, 0 AS candidate, target, 1 AS label FROM splits WHERE split = 'test' UNION ALL SELECT source, cited, candidate, target, 0 FROM negatives)",
    "degree AS (SELECT target AS id, count(*) AS d FROM splits WHERE split <> 'test' GROUP BY target)",
    "facts AS MATERIALIZED (SELECT p.*, CAST(t.year - s.year AS DOUBLE) AS recency, CAST(coalesce(d.d, 0) AS DOUBLE) AS in_degree FROM pool p JOIN works s ON s.id = p.source JOIN works t ON t.id = p.target LEFT JOIN degree d ON d.id = p.target)",
    "scored AS MATERIALIZED (SELECT 'recency' AS scorer, source, cited, candidate, target, label, recency AS score FROM facts UNION ALL SELECT 'in_degree', source, cited, candidate, target, label, in_degree FROM facts)",
)
PER = 100
POOL = (fx.BASE, *CUTS, _negatives(False, PER), *SCORED)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    works, edges = _split(spark, sf_dir)
    test = edges.where("split = 'test'")
    degree = edges.where("split <> 'test'").groupBy("target").agg(F.count("*").alias("d"))
    sources = works.select(F.col("id").alias("source"), F.col("year").alias("from_year"))
    targets = works.select(F.col("id").alias("target"), F.col("year").alias("to_year")).join(degree, "target", "left")
    drawn = temporal.negatives(test, works, edges, per=PER, sources=sources, targets=targets)
    positive = test.select("source", F.col("target").alias("cited"), F.lit(0).alias("candidate"), "target", F.lit(1).alias("label")).join(sources, "source").join(targets, "target")
    facts = positive.unionByName(drawn.withColumn("label", F.lit(0))).withColumn("recency", (F.col("to_year") - F.col("from_year")).cast("double")).withColumn("in_degree", F.coalesce("d", F.lit(0)).cast("double"))
    scored = facts.unpivot(["source", "cited", "candidate", "target", "label"], ["recency", "in_degree"], "scorer", "score")
    return scored.withColumn("id", F.concat_ws("|", "source", "cited", F.col("candidate").cast("string")))


@query(_with(*POOL) + "SELECT scorer, round((sum(rank * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY scorer ORDER BY score) + (count(*) OVER (PARTITION BY scorer, score) - 1) / 2 AS rank FROM scored) GROUP BY scorer")
def auc_by_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_scored(spark, sf_dir), ["scorer"]), "auc")


@query(_with(*POOL) + "SELECT scorer, round(avg(found / place), 6) AS average_precision FROM (SELECT *, row_number() OVER w AS place, sum(label) OVER w AS found FROM scored WINDOW w AS (PARTITION BY scorer ORDER BY score DESC, concat_ws('|', source, cited, candidate) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE label = 1 GROUP BY scorer")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_precision(_scored(spark, sf_dir), ["scorer"]), "average_precision")


RANKS = "ranks AS (SELECT p.scorer, p.source, p.cited, 1 + sum(CASE WHEN n.score > p.score THEN 1.0 WHEN n.score = p.score THEN 0.5 ELSE 0 END) AS rank FROM scored p JOIN scored n ON n.scorer = p.scorer AND n.source = p.source AND n.cited = p.cited AND n.label = 0 WHERE p.label = 1 GROUP BY p.scorer, p.source, p.cited)"


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("owner", F.concat_ws("|", "source", "cited"))
    return metrics.positive_ranks(scored.where("label = 1").select("scorer", "owner", "score"), scored.where("label = 0").select("scorer", "owner", "score"), ["scorer"])


@query(_with(*POOL, RANKS) + "SELECT scorer, round(avg(1 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hits_at_10 FROM ranks GROUP BY scorer")
def mrr_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.mrr_hits(_ranks(spark, sf_dir), ["scorer"]), "mrr", "hits_at_10")


@query(_with(*POOL, RANKS) + "SELECT scorer, round(avg(rank), 6) AS rank_mean, round(stddev_pop(rank), 6) AS rank_std FROM ranks GROUP BY scorer")
def summary_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.mean_std(_ranks(spark, sf_dir), ["scorer"], ["rank"]), "rank_mean", "rank_std")


GOLD = "gold AS (SELECT row_number() OVER (ORDER BY id) - 1 AS work, [id, 'P' || substr(id, 2)] AS ids FROM reached WHERE id <> (SELECT origin FROM newest) AND CAST(substr(id, 2) AS BIGINT) % 9 = 0)"


@query(
    _with(*DAG, IN_DEGREE, "best AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM scores QUALIFY place <= 10)", GOLD, "hit AS (SELECT g.work, min(b.place) AS place FROM gold g JOIN best b ON list_contains(g.ids, b.id) GROUP BY g.work)", recursive=True)
    + """SELECT (SELECT origin FROM newest) AS origin, round((SELECT count(*) FROM hit) / (SELECT count(*) FROM gold), 6) AS recall,
  round(coalesce((SELECT sum(1 / log2(place + 1)) FROM hit), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= (SELECT count(*) FROM gold)), 6) AS ndcg, (SELECT count(*) FROM hit) AS found, (SELECT count(*) FROM gold) AS findable"""
)
def ndcg_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir)
    best = walks.ranked(walks.in_degree(g.lineage, g.reached))
    some = g.reached.where("depth > 0").where(F.substring("id", 2, 20).cast("long") % 9 == 0)
    gold = some.select("origin", (F.row_number().over(W.partitionBy("origin").orderBy("id")) - 1).alias("work"), F.array("id", F.concat(F.lit("P"), F.substring("id", 2, 20))).alias("ids"))
    return _rounded(metrics.recall_ndcg(best, gold), "recall", "ndcg")


TARGETS = "SELECT doc_id AS origin, CASE WHEN lang = 'en' THEN 'dev' ELSE 'test' END AS split, source AS scorer, CAST(doc_id % 5 + 1 AS BIGINT) AS originators, CAST(doc_id % 5 AS BIGINT) AS reachable, CAST(doc_id % 3 AS BIGINT) AS found, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 11) / CAST(10 AS DOUBLE) END AS recall, CASE WHEN doc_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE (doc_id % 13) / CAST(12 AS DOUBLE) END AS ndcg, (doc_id % 9) / CAST(8 AS DOUBLE) AS dropout_overlap, CAST(NULL AS DOUBLE) AS seed_overlap FROM documents"


@query(
    f"WITH targets AS ({TARGETS}) SELECT split, scorer, count(*) AS targets, CAST(sum(originators) AS BIGINT) AS originators, CAST(sum(reachable) AS BIGINT) AS reachable, CAST(sum(found) AS BIGINT) AS found, round(avg(recall), 6) AS recall, "
    "round(avg(CASE WHEN isnan(ndcg) THEN NULL ELSE ndcg END), 6) AS ndcg, round(avg(dropout_overlap), 6) AS dropout_overlap, avg(seed_overlap) AS seed_overlap FROM targets GROUP BY split, scorer"
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.documents(spark, sf_dir).createOrReplaceTempView("summary_documents")
    targets = spark.sql(TARGETS.replace("FROM documents", "FROM summary_documents"))
    return _rounded(ranking.split_summary(targets), "recall", "ndcg", "dropout_overlap")


# Narratives

CLAIMS = "claims AS (SELECT conv_id AS origin, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS claim, 'S' || (turn % 4) AS id, text FROM conversations)"


@query(
    f"WITH {CLAIMS}, verdicts AS (SELECT conv_id AS origin, (turn * 3) % 5 - 1 AS claim, length(text) % 3 > 0 AS supported, 'says ' || role AS reason, turn AS ord FROM conversations), "
    "fit AS (SELECT v.* FROM verdicts v JOIN (SELECT origin, count(*) AS n FROM claims GROUP BY origin) c ON c.origin = v.origin WHERE v.claim >= 0 AND v.claim < c.n), "
    "last AS (SELECT origin, claim, max_by(supported, ord) AS supported, max_by(reason, ord) AS reason FROM fit GROUP BY origin, claim) "
    f"SELECT c.origin, c.claim, c.id, c.id <> 'S3' AND coalesce(l.supported, false) AS kept, CASE WHEN c.id = 'S3' THEN '{narrative.UNKNOWN}' WHEN l.supported IS NULL THEN '{narrative.NO_VERDICT}' WHEN NOT l.supported THEN l.reason END AS reason FROM claims c LEFT JOIN last l ON l.origin = c.origin AND l.claim = c.claim"
)
def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("conv_id", "origin")
    claims = talk.selectExpr("origin", "CAST(row_number() OVER (PARTITION BY origin ORDER BY turn) - 1 AS BIGINT) AS claim", "'S' || (turn % 4) AS id")
    found = talk.select("origin").distinct().withColumn("id", F.explode(F.array(F.lit("S0"), F.lit("S1"), F.lit("S2"))))
    verdicts = talk.selectExpr("origin", "(turn * 3) % 5 - 1 AS claim", "length(text) % 3 > 0 AS supported", "'says ' || role AS reason", "turn AS ord")
    return narrative.verified(claims, found, narrative.judged(verdicts, claims))


def _quote(id_: str, year: str, title: str, body: str) -> str:
    clean_ = "replace(replace(translate({}, '\"' || chr(10) || chr(13), '''  '), '<', ''), '>', '')"
    return f"'<source id=\"' || {id_} || '\" year=\"' || {year} || '\" title=\"' || {clean_.format(title)} || '\">' || chr(10) || replace({body}, '</source>', '') || chr(10) || '</source>'"


@query(
    _with(*DAG, IN_DEGREE, "best AS (SELECT s.id, w.title, CAST(w.year AS VARCHAR) AS year, w.abstract, row_number() OVER (ORDER BY score DESC, s.id) AS place FROM scores s JOIN works w ON w.id = s.id QUALIFY place <= 8)", recursive=True)
    + f"""SELECT t.id AS origin, 'The work traced is ' || t.id || ', "' || t.title || '" (' || t.year || ').' || chr(10) || chr(10) || 'Its abstract:' || chr(10) || {_quote("t.id", "''", "''", "t.abstract")} || chr(10) || chr(10)
  || 'Works that it depends on, in order:' || chr(10) || (SELECT string_agg({_quote("id", "year", "title", "abstract")}, chr(10) || chr(10) ORDER BY place) FROM best WHERE abstract <> '') || chr(10) || chr(10)
  || 'Make one claim a work, with these ids only: ' || (SELECT string_agg(id, ', ' ORDER BY place) FROM best WHERE abstract <> '') || '.' AS prompt FROM works t WHERE t.id = (SELECT origin FROM newest)"""
)
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir)
    return narrative.prompts(narrative.sources(walks.in_degree(g.lineage, g.reached), g.works), g.works)


@query("SELECT conv_id AS origin, CAST(count(*) AS BIGINT) AS turns, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def structured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a scripted model, which breaks off in the middle until it is told of the form."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").alias("origin")).agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"))
    talk = checkpointed(talk)

    def ask(told: DataFrame) -> DataFrame:
        whole = F.to_json(F.struct("turns", "last_role"))
        broken = (F.xxhash64("origin") % 3 == 0) & ~F.contains("prompt", F.lit("does not fit the schema"))
        return told.join(talk, "origin").select("origin", F.when(broken, F.substring(whole, 1, 9)).otherwise(whole).alias("text"))

    form = StructType([StructField("turns", LongType()), StructField("last_role", StringType())])
    return answers.structured(talk.select("origin", F.lit("How many turns, and who has the last?").alias("prompt")), form, ask).select("origin", "answer.*")


@query()
def narrative_scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir)
    return narrative.narrate(walks.in_degree(g.lineage, g.reached), g.works, narrative.scripted_draft, narrative.scripted_judge)


# Presentation


@query(
    _with(*DAG, IN_DEGREE, "best AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM scores QUALIFY place <= 10 UNION ALL SELECT origin, NULL, 0 FROM newest)", "placed AS (SELECT b.*, w.year FROM best b JOIN works w ON w.id = b.id)", recursive=True)
    + f"""SELECT (SELECT origin FROM newest) AS origin, id, CAST(place AS INT) AS place, round({present.LEFT} + (year - min(year) OVER ()) / (max(year) OVER () - min(year) OVER ()) * {present.WIDTH - present.RIGHT - present.LEFT}, 6) AS x,
  CAST({present.TOP} + place * {present.ROW} AS INT) AS y, round(CASE WHEN place = 0 THEN 9 ELSE 4 + 6 * sqrt(score / max(score) OVER ()) END, 6) AS r FROM placed"""
)
def timeline_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir)
    top = walks.ranked(walks.in_degree(g.lineage, g.reached))
    shown = top.select("origin", "id", "place", "score").union(g.origins.select("origin", F.col("origin").alias("id"), F.lit(0), F.lit(None).cast("double")))
    return _rounded(present.timeline(shown.join(g.years, "id")), "x", "r")


@query(_with(fx.BASE) + "SELECT id, nullif(title, '') AS title, year, array_to_string(authors, '; ') AS authors, array_to_string(list_slice(authors, 1, 3), ', ') || ' · ' || year AS byline FROM works")
def byline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.client_rows(fx.works(spark, sf_dir)).withColumn("authors", F.array_join("authors", "; "))


@query()
def lineage_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir)
    scores = walks.flow(g.lineage, g.reached, g.years)
    top = walks.ranked(scores)
    shown = checkpointed(top.select("origin", "id").union(g.origins.select("origin", F.col("origin").alias("id"))))
    return present.lineage_payload(scores, g.works, walks.skeleton(g.lineage, shown), {"in_degree": walks.in_degree(g.lineage, g.reached), "path_weight": walks.path_weight(g.lineage, g.reached)})


# The learned scorer


def _trained(spark: SparkSession, sf_dir: str, score: DataFrame | None = None) -> DataFrame:
    """Logits of labelled pairs of each split, and of pairs to score, by a model trained on the first."""
    works, edges = _split(spark, sf_dir)
    past = edges.where("split IN ('train', 'undated')")
    traits = temporal.features(works, past)
    none = F.lit(None)
    node = traits.select(F.lit("node").alias("kind"), F.col("id").alias("a"), none.cast("string").alias("b"), F.array(*(F.col(c).cast("double") for c in models.FEATURES)).alias("x"), none.cast("string").alias("split"), none.cast("int").alias("label"))

    def ends(kind: str, pairs: DataFrame, split: str | None, label: int | None) -> DataFrame:
        return pairs.select(F.lit(kind).alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), none.cast("array<double>").alias("x"), F.lit(split).cast("string").alias("split"), F.lit(label).cast("int").alias("label"))

    rows = node.union(ends("message", past, None, None))
    for name in ("train", "test"):
        positive = edges.where(F.col("split") == name)
        rows = rows.union(ends("pair", positive, name, 1)).union(ends("pair", temporal.negatives(positive, works, edges), name, 0))
    if score is not None:
        rows = rows.union(ends("pair", score, "score", 0))
    return models.trained(rows.withColumn("cut", F.lit("all")), epochs=40)


@query()
def gnn_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = _trained(spark, sf_dir).select("split", F.col("logit").alias("score"), "label")
    return metrics.roc_auc(checkpointed(logits), ["split"])


@query()
def learned_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Lineage(spark, sf_dir)
    chance = _trained(spark, sf_dir, g.lineage).where("split = 'score'").select("source", "target", models.probability(F.col("logit")).alias("probability"))
    weighted = checkpointed(content.content_weights(g.lineage, content.tfidf(g.works, only=g.reached), checkpointed(chance)))
    return walks.ranked(walks.flow(weighted, g.reached, g.years))


SAMPLERS = {"uniform": False, "year_matched": True}


def _contest(edges: DataFrame, works: DataFrame, split: str, per: int, matched: bool) -> DataFrame:
    """source, cited, candidate, target, label: a split's positives (candidate 0) and their drawn rivals."""
    positive = edges.where(F.col("split") == split)
    drawn = temporal.negatives(positive, works, edges, per=per, year_matched=matched)
    return positive.select("source", F.col("target").alias("cited"), F.lit(0).alias("candidate"), "target", F.lit(1).alias("label")).unionByName(drawn.withColumn("label", F.lit(0)))


def _grid(spark: SparkSession, sf_dir: str, candidates: int = 100) -> DataFrame:
    """Scores of the test split's pools by sampler and scorer; an undated work is of year -1."""
    works, edges = _split(spark, sf_dir)
    years = works.select("id", F.coalesce("year", F.lit(-1)).alias("year"))

    def degree(hidden: list[str]) -> DataFrame:
        return edges.where(~F.col("split").isin(hidden)).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))

    pools = []
    for sampler, matched in SAMPLERS.items():
        fitted = models.logistic(checkpointed(models.design(_contest(edges, works, "val", 1, matched), years, degree(["val", "test"])).select("gap", "log_in", "label")))
        facts = fitted.transform(models.design(_contest(edges, works, "test", candidates, matched), years, degree(["test"])))
        scores = ((-F.col("gap")).alias("recency"), F.col("log_in").alias("in_degree"), vector_to_array("rawPrediction")[1].alias("logistic"))
        pools.append(facts.select(F.lit(sampler).alias("sampler"), "source", "cited", "candidate", "target", "label", *scores))
    pool = checkpointed(pools[0].unionByName(pools[1]))
    learned = _trained(spark, sf_dir, pool.select("source", "target").distinct()).where("split = 'score'").select("source", "target", F.col("logit").alias("model"))
    scored = pool.join(learned, ["source", "target"]).unpivot(["sampler", "source", "cited", "candidate", "target", "label"], ["recency", "in_degree", "logistic", "model"], "scorer", "score")
    return checkpointed(scored.withColumn("id", F.concat_ws("|", "source", "cited", F.col("candidate").cast("string"))))


@query()
def evaluate_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sampler and scorer on one cut, 100 candidates a positive."""
    scored, by = _grid(spark, sf_dir).withColumn("owner", F.concat_ws("|", "source", "cited")), ["sampler", "scorer"]
    ranks = checkpointed(metrics.positive_ranks(scored.where("label = 1").select(*by, "owner", "score"), scored.where("label = 0").select(*by, "owner", "score"), by))
    parts = (metrics.average_precision(scored, by), metrics.mrr_hits(ranks, by), metrics.mean_std(ranks, by, ["rank"]))
    out = metrics.roc_auc(scored, by)
    for part in parts:
        out = out.join(part, by, "left")
    return out
