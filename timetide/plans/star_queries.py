"""The check operators over the star-schema tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timetide.operators import graph, intervals, ordered, relational, robust, spatial
from timetide.plans import notices as N

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None):
    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return plan

    return register


@query("q_fk_orphans", """
SELECT 'lineitem.l_partkey' AS reference, l_partkey AS key, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5) GROUP BY l_partkey
UNION ALL SELECT 'orders.o_custkey', o_custkey, count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) GROUP BY o_custkey
UNION ALL SELECT 'lineitem.l_orderkey', l_orderkey, count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) GROUP BY l_orderkey
""")
def fk_orphans(t: Tables) -> DataFrame:
    parts = [
        ("lineitem.l_partkey", t.lineitem, "l_partkey", t.part.filter("p_size > 5"), "p_partkey"),
        ("orders.o_custkey", t.orders, "o_custkey", t.customer.filter("c_acctbal > 0"), "c_custkey"),
        ("lineitem.l_orderkey", t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
    ]
    out = [relational.missing_keys(c, fk, p, pk).select(F.lit(name).alias("reference"), "key", F.col("rows").alias("n")) for name, c, fk, p, pk in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("q_unused_parent", """
SELECT 'customer' AS entity, c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'part', p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)
""")
def unused_parent(t: Tables) -> DataFrame:
    a = relational.unused(t.customer, "c_custkey", t.orders, "o_custkey").select(F.lit("customer").alias("entity"), F.col("c_custkey").alias("key"))
    b = relational.unused(t.part, "p_partkey", t.lineitem.filter("l_quantity > 45"), "l_partkey").select(F.lit("part"), "p_partkey")
    return a.union(b)


@query("q_dup_pk", """
SELECT l_orderkey, l_linenumber, nth FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice)::INTEGER AS nth FROM lineitem) WHERE nth > 1
""")
def dup_pk(t: Tables) -> DataFrame:
    return relational.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "nth")


@query("q_conflicting_key", "SELECT p_brand, p_size, count(DISTINCT p_type) AS n_values FROM part GROUP BY ALL HAVING count(DISTINCT p_type) > 1")
def conflicting_key(t: Tables) -> DataFrame:
    return relational.conflicting(t.part, ["p_brand", "p_size"], "p_type")


@query("q_group_having", "SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1 HAVING count(*) >= 10 AND count(DISTINCT o_orderstatus) = 2")
def group_having(t: Tables) -> DataFrame:
    return relational.having(t.orders, ["o_custkey"], "n >= 10 AND statuses = 2", n=F.count(F.lit(1)), statuses=F.count_distinct("o_orderstatus"))


@query("q_type_checks", """
SELECT event_id, props FROM events WHERE props IS NULL OR NOT regexp_full_match(coalesce(regexp_extract(props, ':\\s*"?([^",}]*)', 1), ''), '[0-9]+') OR value < 0
""")
def type_checks(t: Tables) -> DataFrame:
    number = F.coalesce(F.regexp_extract("props", r':\s*"?([^",}]*)', 1), F.lit("")).rlike(r"^[0-9]+\z")
    return t.events.filter(F.col("props").isNull() | ~number | (F.col("value") < 0)).select("event_id", "props")


@query("q_enum", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def enum(t: Tables) -> DataFrame:
    bad = ~F.col("o_orderstatus").isin("F", "O") | ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    return t.orders.filter(bad).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("q_cross_field", "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def cross_field(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderdate")
    return t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "o_orderdate")


@query("q_feed_ratio", """
SELECT count(*) AS n, sum(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS hits, round(sum(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) / count(*), 6) AS ratio
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
""")
def feed_ratio(t: Tables) -> DataFrame:
    seen = t.labels.select(F.col("doc_id").alias("labelled")).distinct()
    return relational.share(t.documents.select("doc_id").join(seen, F.col("doc_id") == F.col("labelled"), "left"), F.col("labelled").isNotNull())


@query("q_backward_time", """
SELECT event_id, user_id, ts, reached FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM events) WHERE ts < reached
""")
def backward_time(t: Tables) -> DataFrame:
    return ordered.backwards(t.events, "user_id", ["event_id"], "ts").select("event_id", "user_id", "ts", "reached")


LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity"


@query("q_seq_not_increasing", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, before FROM (
  SELECT *, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS before FROM lineitem) WHERE l_quantity <= before
""")
def seq_not_increasing(t: Tables) -> DataFrame:
    return ordered.not_increasing(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "before")


@query("q_unsorted_once", """
SELECT user_id, event_id, value, reached FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM (
    SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM events) WHERE value <= reached) WHERE n = 1
""")
def unsorted_once(t: Tables) -> DataFrame:
    return ordered.unsorted_once(t.events, "user_id", ["event_id"], "value").select("user_id", "event_id", "value", "reached")


@query("q_first_last", """
SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id
""")
def first_last(t: Tables) -> DataFrame:
    return ordered.first_and_last(t.conversations, "conv_id", "turn", "role")


@query("q_run_length", """
SELECT user_id, event_type, count(*) AS length, min(event_id) AS run_start FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
GROUP BY user_id, event_type, island HAVING count(*) >= 3
""")
def run_length(t: Tables) -> DataFrame:
    return ordered.runs(t.events, "user_id", ["event_id"], "event_type", 3)


@query("q_service_gap", """
SELECT o_custkey, gap_from, gap_to, (gap_to - gap_from - 1)::INTEGER AS missing FROM (
  SELECT o_custkey, d AS gap_to, lag(d) OVER (PARTITION BY o_custkey ORDER BY d) AS gap_from FROM (SELECT DISTINCT o_custkey, o_orderdate::DATE AS d FROM orders)) WHERE gap_to - gap_from - 1 >= 14
""")
def service_gap(t: Tables) -> DataFrame:
    return ordered.day_gaps(t.orders, "o_custkey", "o_orderdate", 14)


@query("q_headway", """
SELECT user_id, event_type, count(g) AS n_gaps, round(avg(g), 4) AS mean_gap, max(g) AS max_gap, round(stddev_pop(g) / avg(g), 4) AS variation FROM (
  SELECT user_id, event_type, s - lag(s) OVER (PARTITION BY user_id, event_type ORDER BY s) AS g FROM (SELECT DISTINCT user_id, event_type, floor(epoch(ts))::BIGINT AS s FROM events)) WHERE g IS NOT NULL GROUP BY ALL
""")
def headway(t: Tables) -> DataFrame:
    return ordered.headways(t.events, ["user_id", "event_type"], F.unix_seconds(F.col("ts").cast("timestamp")))


_CALENDAR = """
cal AS (SELECT o_custkey AS service_id, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1),
exc AS (SELECT o_custkey AS service_id, o_orderdate::DATE AS d, min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END) AS lo, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END) AS hi FROM orders GROUP BY 1, 2)
"""


_ACTIVE = f"""
WITH {_CALENDAR}, days AS (SELECT service_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM cal)
SELECT service_id, d AS date FROM (SELECT service_id, d FROM days WHERE isodow(d) <= 5 UNION SELECT service_id, d FROM exc WHERE lo = 1) x
WHERE NOT EXISTS (SELECT 1 FROM exc e WHERE e.service_id = x.service_id AND e.d = x.d AND e.hi = 2)
"""


@query("q_calendar_expand_full", _ACTIVE)
@query("q_calendar_expand", _ACTIVE)
def calendar_expand(t: Tables) -> DataFrame:
    """Active days from each customer's first to last order (the second name is kept for what asked for whole ranges before)."""
    o = t.orders.select(F.col("o_custkey").alias("service_id"), F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("exception_type"))
    weekdays = {d: F.lit(1 if i < 5 else 0) for i, d in enumerate(intervals.WEEKDAYS)}
    calendar = o.groupBy("service_id").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date")).withColumns(weekdays)
    return intervals.active_dates(calendar, o)


@query("q_override_window", """
SELECT a.o_custkey, a.o_orderdate::DATE AS day, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'
AND b.o_orderdate BETWEEN a.o_orderdate AND a.o_orderdate + INTERVAL 30 DAY GROUP BY 1, 2
""")
def override_window(t: Tables) -> DataFrame:
    a = t.orders.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").alias("at"))
    b = t.orders.filter("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderdate").alias("over"))
    return a.join(b, "o_custkey").filter("over BETWEEN at AND at + INTERVAL 30 DAYS").groupBy("o_custkey", F.col("at").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("q_interval_overlap", """
SELECT event_id, user_id, s AS start, busy_until FROM (
  SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM (
    SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + floor(value * 60)::BIGINT AS e FROM events)) WHERE s < busy_until
""")
def interval_overlap(t: Tables) -> DataFrame:
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = t.events.select("event_id", "user_id", start.alias("start"), (start + F.floor(F.col("value") * 60)).alias("end"))
    return intervals.overlapping(rows, ["user_id"], "start", "end", "event_id").select("event_id", "user_id", "start", "busy_until")


@query("q_mad_outlier", """
WITH x AS (SELECT p_partkey, p_brand, p_retailprice FROM part), m AS (SELECT p_brand, median(p_retailprice) AS group_median, count(*) AS n FROM x GROUP BY 1),
a AS (SELECT x.*, group_median, n, abs(p_retailprice - group_median) AS away FROM x JOIN m USING (p_brand)), s AS (SELECT p_brand, median(away) * 1.4826 AS mad FROM a GROUP BY 1)
SELECT p_partkey, p_brand, p_retailprice, group_median, round(away / mad, 4) AS score FROM a JOIN s USING (p_brand) WHERE n >= 5 AND mad > 0 AND away > 1.2 * mad
""")
def mad_outlier(t: Tables) -> DataFrame:
    return robust.mad_outliers(t.part.select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice", 1.2).select("p_partkey", "p_brand", "p_retailprice", "group_median", "score")


_POINTS = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"


def _points(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("q_median_distance", f"""
WITH p AS ({_POINTS}), c AS (SELECT median(x) AS mx, median(y) AS my FROM p), d AS (SELECT id, sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS distance FROM p, c)
SELECT id, round(distance, 6) AS distance FROM d WHERE distance > (SELECT greatest(0.05, 0.9 * quantile_cont(distance, 0.99)) FROM d)
""")
def median_distance(t: Tables) -> DataFrame:
    return robust.far_from_centre(_points(t), 0.05, 0.9)


@query("q_grid_near", f"""
WITH p AS ({_POINTS}) SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM p a JOIN p b ON a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.01
""")
def grid_near(t: Tables) -> DataFrame:
    return spatial.near_pairs(_points(t), 0.01)


@query("q_jaccard", """
WITH s AS (SELECT DISTINCT s_nationkey, s_suppkey, l_partkey AS item FROM supplier JOIN lineitem ON l_suppkey = s_suppkey), n AS (SELECT s_suppkey, count(*) AS size FROM s GROUP BY 1),
j AS (SELECT a.s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b, count(*) AS shared FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.item = b.item AND a.s_suppkey < b.s_suppkey GROUP BY ALL)
SELECT s_nationkey, a, b, shared, round(shared / (x.size + y.size - shared), 6) AS jaccard FROM j JOIN n x ON x.s_suppkey = a JOIN n y ON y.s_suppkey = b WHERE shared / (x.size + y.size - shared) >= 0.15
""")
def jaccard(t: Tables) -> DataFrame:
    """Suppliers of one nation that sell much the same parts."""
    sets = t.supplier.join(t.lineitem, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "s_suppkey", F.col("l_partkey").alias("item"))
    return relational.jaccard_pairs(sets, "s_nationkey", "s_suppkey", "item", 0.15)


@query("q_share", """
SELECT c_nationkey AS nation, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def share(t: Tables) -> DataFrame:
    per = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))  # one row
    return per.join(F.broadcast(total)).select("nation", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


_EDGES = "SELECT DISTINCT user_id AS a, (user_id * 7 + event_id % 3) % 1009 + 100000 AS b FROM events"


def _edges(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("a"), F.expr("(user_id * 7 + event_id % 3) % 1009 + 100000").alias("b")).distinct()


@query("q_components", f"""
WITH RECURSIVE e AS ({_EDGES}), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, both_ways.b FROM r JOIN both_ways ON r.other = both_ways.a)
SELECT node, min(other) AS component FROM r GROUP BY 1
""")
def components(t: Tables) -> DataFrame:
    return graph.components(_edges(t))


@query("q_reachability", """
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, 'supplier ' || l_suppkey AS b FROM lineitem), f AS (
  SELECT 'part ' || a AS a, b FROM e UNION SELECT DISTINCT 'supplier ' || l_suppkey, 'order ' || l_orderkey FROM lineitem UNION SELECT 'order ' || o_orderkey, 'customer ' || o_custkey FROM orders),
r(node) AS (SELECT 'part ' || p_partkey FROM part WHERE p_size = 1 UNION SELECT f.b FROM r JOIN f ON r.node = f.a) SELECT node FROM r
""")
def reachability(t: Tables) -> DataFrame:
    """From small parts to their suppliers, to all orders that these serve, to the customers."""
    edges = [
        ("part", "supplier", t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))),
        ("supplier", "order", t.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_orderkey").alias("b"))),
        ("order", "customer", t.orders.select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))),
    ]
    found = graph.reachable_kinds(edges, {"part": t.part.filter("p_size = 1").select(F.col("p_partkey").alias("node"))})
    named = [rows.select(F.concat(F.lit(f"{kind} "), F.col("node").cast("string")).alias("node")) for kind, rows in found.items()]
    every = named[0]
    for rows in named[1:]:
        every = every.unionByName(rows)
    # Nodes without a key are one node, whatever their kind.
    return every.filter("node IS NOT NULL").unionByName(every.filter("node IS NULL").distinct())


@query("q_whitespace", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '^[\s]|[\s]$')")
def whitespace(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("text").rlike(r"^[\t\n\f\r ]|[\t\n\f\r ]\z")).select("doc_id")


@query("q_bad_chars", r"SELECT 'document' AS kind, doc_id AS id FROM documents WHERE regexp_matches(text, '[\x00-\x08\x0B-\x1F\x7F]') UNION ALL SELECT 'page', page_id FROM pages WHERE regexp_matches(html, '[\x00-\x08\x0B-\x1F\x7F]')")
def bad_chars(t: Tables) -> DataFrame:
    bad = r"[\x00-\x08\x0B-\x1F\x7F]"
    a = t.documents.filter(F.col("text").rlike(bad)).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    return a.union(t.pages.filter(F.col("html").rlike(bad)).select(F.lit("page"), "page_id"))


@query("q_non_ascii", r"SELECT lang, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE regexp_matches(text, '[^\x00-\x7F]') GROUP BY lang")
def non_ascii(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("text").rlike(r"[^\x00-\x7F]")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("q_tab_newline", r"SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, '[\t\r\n]') GROUP BY source")
def tab_newline(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("text").rlike(r"[\t\r\n]")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("q_html_markup", r"SELECT page_id, len(regexp_extract_all(html, '</?[A-Za-z][^<>]*>')) AS tags, len(regexp_extract_all(html, '&(?:[a-z]+|#[0-9]+);')) AS escapes FROM pages WHERE regexp_matches(html, '</?[A-Za-z][^<>]*>|&(?:[a-z]+|#[0-9]+);')")
def html_markup(t: Tables) -> DataFrame:
    tag, escape = "</?[A-Za-z][^<>]*>", "&(?:[a-z]+|#[0-9]+);"
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return t.pages.filter(F.col("html").rlike(f"{tag}|{escape}")).select("page_id", count(tag).alias("tags"), count(escape).alias("escapes"))


@query("q_case", "SELECT doc_id, CASE WHEN text = upper(text) THEN 'upper' ELSE 'lower' END AS letters FROM documents WHERE text <> '' AND lower(text) <> upper(text) AND (text = upper(text) OR text = lower(text)) AND NOT regexp_matches(text, 'ß')")
def case(t: Tables) -> DataFrame:
    text = F.col("text")
    rows = t.documents.filter((text != "") & (F.lower(text) != F.upper(text)) & ((text == F.upper(text)) | (text == F.lower(text))) & ~text.contains("ß"))
    return rows.select("doc_id", F.when(text == F.upper(text), "upper").otherwise("lower").alias("letters"))


@query("q_url", r"SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, count(*) AS n, sum(CASE WHEN url LIKE 'http://%' THEN 1 ELSE 0 END)::BIGINT AS insecure FROM pages WHERE regexp_matches(url, '^https?://[^/:?#]+') GROUP BY 1")
def url(t: Tables) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))
    return t.pages.filter(F.col("url").rlike(r"^https?://[^/:?#]+")).groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("url").startswith("http://"), 1).otherwise(0)).alias("insecure"))


# The notices of a small catalogue over the star schema, and what is made of them.

RULES = [
    ("ORD_001", "Critical", "Spec", "Entity", 1, 1, ["LIN_002", "LIN_003"]),
    ("ORD_002", "Low", "Quality", "Entity", 1, 1, []),
    ("LIN_001", "Medium", "Interop", "Feed", 2, 1, []),
    ("LIN_002", "High", "Spec", "Entity", 1, 1, ["CUS_001"]),
    ("LIN_003", "Info", "Analytics", "Row", 1, 0, []),
    ("CUS_001", "Medium", "Quality", "Entity", 3, 1, []),
]


def _rules(t: Tables) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r[:-1], ("rule_id", "severity", "rule_class", "dedup", "base_effort", "score_weight"), strict=True)], (F.array(*map(F.lit, r[-1])) if r[-1] else F.array().cast("array<string>")).alias("blocks")) for r in RULES]
    return t.spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _notices(t: Tables) -> DataFrame:
    """Findings over orders, lines and customers; a line's scope is its order."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate")
    parts = [
        N.notices(t.orders.filter("o_totalprice < 20000 AND o_orderstatus = 'F'"), "ORD_001", "orders", "order", "o_orderkey", "o_orderkey"),
        N.notices(t.orders.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'"), "ORD_002", "orders", "order", "o_orderkey", "o_orderkey"),
        N.notices(lines.filter("l_discount > 0.09"), "LIN_001", "lineitem", "line", "l_orderkey", "l_orderkey", "l_linenumber", "l_discount"),
        N.notices(lines.filter("l_quantity >= 49"), "LIN_002", "lineitem", "line", "l_orderkey", "l_orderkey", "l_linenumber", "l_quantity"),
        N.notices(lines.filter("l_quantity <= 2"), "LIN_003", "lineitem", "line", "l_orderkey", "l_orderkey", "l_linenumber", "l_quantity"),
        N.notices(relational.unused(t.customer, "c_custkey", t.orders, "o_custkey"), "CUS_001", "customer", "customer", "c_custkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sql(rule: str, file: str, kind: str, key: str, scope: str | None, line: str | None, field: str | None, source: str) -> str:
    return f"SELECT '{rule}' AS rule_id, '{kind}' AS entity_type, {key}::VARCHAR AS entity_id, {(scope or 'NULL')}::VARCHAR AS scope_key, '{file}' AS file, {(line or 'NULL')}::BIGINT AS line, {repr(field) if field else 'NULL'}::VARCHAR AS field, NULL::VARCHAR AS observed_value, 1::BIGINT AS instances FROM {source}"


_N = "n AS (" + " UNION ALL ".join([
    _sql("ORD_001", "orders", "order", "o_orderkey", "o_orderkey", None, None, "orders WHERE o_totalprice < 20000 AND o_orderstatus = 'F'"),
    _sql("ORD_002", "orders", "order", "o_orderkey", "o_orderkey", None, None, "orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'"),
    _sql("LIN_001", "lineitem", "line", "l_orderkey", "l_orderkey", "l_linenumber", "l_discount", "lineitem WHERE l_discount > 0.09"),
    _sql("LIN_002", "lineitem", "line", "l_orderkey", "l_orderkey", "l_linenumber", "l_quantity", "lineitem WHERE l_quantity >= 49"),
    _sql("LIN_003", "lineitem", "line", "l_orderkey", "l_orderkey", "l_linenumber", "l_quantity", "lineitem WHERE l_quantity <= 2"),
    _sql("CUS_001", "customer", "customer", "c_custkey", None, None, None, "customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
]) + "), r AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e}, {f}, {list(g) if g else '[]::VARCHAR[]'})" for a, b, c, d, e, f, g in RULES) + ") AS v(rule_id, severity, rule_class, dedup, base_effort, score_weight, blocks))"
_ORDER = "rule_id, coalesce(entity_type, ''), coalesce(entity_id, ''), coalesce(line, 0), coalesce(file, ''), coalesce(field, ''), coalesce(scope_key, '')"
_PAIRS = "pr AS (SELECT DISTINCT rule_id, coalesce(scope_key, '') AS scope FROM n), roots AS (SELECT pr.rule_id AS root_rule, scope AS root_scope, unnest(blocks) AS rule_id FROM pr JOIN r USING (rule_id)), caused AS (SELECT DISTINCT root_rule, root_scope, pr.rule_id, pr.scope FROM pr JOIN roots USING (rule_id) WHERE root_scope = '' OR root_scope = scope)"
_MULT = "CASE WHEN {0} <= 5 THEN 1.0 WHEN {0} <= 50 THEN 1.5 ELSE 2.0 END"
_SEV = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"


@query("q_notices", f"WITH {_N} SELECT * FROM n")
def all_notices(t: Tables) -> DataFrame:
    return _notices(t)


@query("q_dedup", f"""
WITH {_N} SELECT n.* FROM (SELECT n.*, row_number() OVER (PARTITION BY rule_id, CASE dedup WHEN 'Feed' THEN '' WHEN 'File' THEN file WHEN 'Entity' THEN entity_type || '|' || entity_id WHEN 'Row' THEN file || '|' || coalesce(line::VARCHAR, chr(1) || coalesce(entity_id, '') || chr(1) || coalesce(observed_value, '')) ELSE file || '|' || coalesce(line::VARCHAR, chr(1) || coalesce(entity_id, '') || chr(1) || coalesce(observed_value, '')) || '|' || coalesce(field, '') END ORDER BY {_ORDER}) AS k FROM n JOIN r USING (rule_id)) n WHERE k = 1
""".replace("SELECT n.* FROM (", "SELECT n.* EXCLUDE (k) FROM ("))
def dedup(t: Tables) -> DataFrame:
    return N.deduplicate(_notices(t), _rules(t))


@query("q_aggregate_summary", f"""
WITH {_N}, e AS (SELECT rule_id, file, entity_id, row_number() OVER (PARTITION BY rule_id, file ORDER BY entity_id) AS k FROM (SELECT DISTINCT rule_id, file, entity_id FROM n))
SELECT rule_id, file, affected, first_line, examples FROM (SELECT rule_id, file, count(*) AS affected, min(line) AS first_line FROM n GROUP BY 1, 2) JOIN (SELECT rule_id, file, string_agg(entity_id, ',' ORDER BY entity_id) AS examples FROM e WHERE k <= 3 GROUP BY 1, 2) USING (rule_id, file)
""")
def aggregate_summary(t: Tables) -> DataFrame:
    return N.summaries(_notices(t))


@query("q_cap", f"""
WITH {_N} SELECT rule_id, entity_id, line, nth, total FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY {_ORDER})::INTEGER AS nth, count(*) OVER (PARTITION BY rule_id) AS total FROM n) WHERE nth <= 20
""")
def cap(t: Tables) -> DataFrame:
    return N.cap(_notices(t), 20).select("rule_id", "entity_id", "line", "nth", "total")


@query("q_symptoms", f"WITH {_N}, {_PAIRS} SELECT n.* FROM n WHERE EXISTS (SELECT 1 FROM caused c WHERE c.rule_id = n.rule_id AND c.scope = coalesce(n.scope_key, ''))")
def symptoms(t: Tables) -> DataFrame:
    return N.symptoms(_notices(t), _rules(t))


@query("q_closure", f"""
WITH RECURSIVE {_N}, {_PAIRS}, reach(root_rule, root_scope, rule_id, scope) AS (SELECT * FROM caused UNION SELECT a.root_rule, a.root_scope, b.rule_id, b.scope FROM reach a JOIN caused b ON a.rule_id = b.root_rule AND a.scope = b.root_scope)
SELECT * FROM reach WHERE NOT (root_rule = rule_id AND root_scope = scope)
""")
def closure(t: Tables) -> DataFrame:
    return N.closure(_notices(t), _rules(t))


_PENALTY = f"p AS (SELECT rule_class, severity, {_SEV} * score_weight * {_MULT.format('instances')} AS penalty FROM (SELECT rule_id, sum(instances) AS instances FROM n GROUP BY 1) JOIN r USING (rule_id))"
_CLASS = "100.0::DOUBLE * 50 / (50 + coalesce(sum(penalty::DOUBLE) FILTER (WHERE {}), 0))"


@query("q_scores", f"""
WITH {_N}, {_PENALTY}, s AS (SELECT {', '.join(_CLASS.format(f"rule_class = '{c}'") + ' AS ' + c for c in N.CLASS_WEIGHTS)}, {_CLASS.format("rule_class = 'Spec' AND severity = 'Critical'")} AS publish FROM p)
{' UNION ALL '.join(f"SELECT '{c}' AS name, round({c}, 1) AS score FROM s" for c in [*N.CLASS_WEIGHTS, 'publish'])} UNION ALL SELECT 'overall', round({' + '.join(f'{w}::DOUBLE * {c}' for c, w in N.CLASS_WEIGHTS.items())}, 1) FROM s
""")
def scores(t: Tables) -> DataFrame:
    return N.scores(_notices(t), _rules(t))


@query("q_fix_queue", f"""
WITH {_N}, {_PAIRS}, d AS (SELECT root_rule AS rule_id, count(DISTINCT rule_id) AS dependents FROM caused GROUP BY 1),
a AS (SELECT rule_id, sum(instances)::BIGINT AS affected FROM n WHERE NOT EXISTS (SELECT 1 FROM caused c WHERE c.rule_id = n.rule_id AND c.scope = coalesce(n.scope_key, '')) GROUP BY 1)
SELECT rule_id, severity, affected, coalesce(dependents, 0) AS dependents, (base_effort * {_MULT.format('affected')})::DOUBLE AS fix_effort,
round({_SEV} * (1 + coalesce(dependents, 0)) * log2(1 + affected) / (base_effort * {_MULT.format('affected')})::DOUBLE, 2) AS priority FROM a JOIN r USING (rule_id) LEFT JOIN d USING (rule_id)
""")
def fix_queue(t: Tables) -> DataFrame:
    return N.fix_queue(_notices(t), _rules(t))


_PUBLISHING = "rule_class = 'Spec' AND severity = 'Critical'"
_RISE = " + ".join(f"{w}::DOUBLE * (5000::DOUBLE / (50 + s.{c} - d.{c}) - 5000::DOUBLE / (50 + s.{c}))" for c, w in N.CLASS_WEIGHTS.items())


@query("q_score_deltas", f"""
WITH RECURSIVE {_N}, {_PAIRS}, reach(root_rule, root_scope, rule_id, scope) AS (SELECT * FROM caused UNION SELECT a.root_rule, a.root_scope, b.rule_id, b.scope FROM reach a JOIN caused b ON a.rule_id = b.root_rule AND a.scope = b.root_scope),
e AS (SELECT rule_id, coalesce(scope_key, '') AS scope, sum(instances)::BIGINT AS i FROM n GROUP BY 1, 2),
f AS (SELECT rule_id AS root_rule, scope AS root_scope FROM e ANTI JOIN caused USING (rule_id, scope)),
m AS (SELECT root_rule, root_rule AS rule_id, root_scope AS scope FROM f UNION SELECT root_rule, rule_id, scope FROM reach JOIN f USING (root_rule, root_scope)),
k AS (SELECT root_rule, rule_id, sum(i)::BIGINT AS taken FROM m JOIN e USING (rule_id, scope) GROUP BY 1, 2),
p AS (SELECT rule_id, rule_class, severity, instances, {_SEV} * score_weight AS w, (w * {_MULT.format('instances')})::DOUBLE AS penalty FROM (SELECT rule_id, sum(instances)::BIGINT AS instances FROM n GROUP BY 1) JOIN r USING (rule_id)),
s AS (SELECT {', '.join(f"coalesce(sum(penalty) FILTER (WHERE rule_class = '{c}'), 0) AS {c}" for c in N.CLASS_WEIGHTS)}, coalesce(sum(penalty) FILTER (WHERE {_PUBLISHING}), 0) AS publish FROM p),
x AS (SELECT root_rule, rule_class, severity, penalty - CASE WHEN instances > taken THEN w * {_MULT.format('(instances - taken)')} ELSE 0 END::DOUBLE AS less, (w * {_MULT.format('taken')})::DOUBLE AS gone FROM k JOIN p USING (rule_id)),
d AS (SELECT root_rule AS rule_id, {', '.join(f"coalesce(sum(less) FILTER (WHERE rule_class = '{c}'), 0) AS {c}" for c in N.CLASS_WEIGHTS)}, coalesce(sum(gone) FILTER (WHERE {_PUBLISHING}), 0) AS publish FROM x GROUP BY 1)
SELECT rule_id, round({_RISE}, 1) AS score_delta, round(5000::DOUBLE / (50 + greatest(s.publish - d.publish, 0)) - 5000::DOUBLE / (50 + s.publish), 1) AS publish_delta FROM d, s
""")
def score_deltas(t: Tables) -> DataFrame:
    return N.score_deltas(_notices(t), _rules(t))


@query("q_publishable", f"WITH {_N} SELECT count(*) = 0 AS publishable, count(*) AS blocking FROM (SELECT DISTINCT rule_id FROM n) JOIN r USING (rule_id) WHERE rule_class = 'Spec' AND severity = 'Critical'")
def publishable(t: Tables) -> DataFrame:
    return N.publishable(_notices(t), _rules(t))


@query("q_metrics", """
SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_customers, (SELECT count(*) FROM lineitem) AS n_lines,
(SELECT count(DISTINCT o_orderdate::DATE) FROM orders) AS active_days, (SELECT round(count(*) / count(DISTINCT o_orderdate::DATE), 2) FROM orders) AS orders_a_day
""")
def metrics(t: Tables) -> DataFrame:
    days = F.count_distinct(F.col("o_orderdate").cast("date"))
    o = t.orders.agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"), days.alias("active_days"), F.round(F.count(F.lit(1)) / days, 2).alias("orders_a_day"))
    return o.join(F.broadcast(t.lineitem.agg(F.count(F.lit(1)).alias("n_lines"))))  # one row each


@query("q_attribution", f"""
WITH {_N} SELECT n.rule_id, n_name AS nation, count(*) AS n FROM n JOIN orders ON n.scope_key = o_orderkey::VARCHAR JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
""")
def attribution(t: Tables) -> DataFrame:
    per_order = _notices(t).filter("scope_key IS NOT NULL").groupBy("rule_id", F.col("scope_key").cast("long").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"))
    owner = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    named = per_order.join(owner, "o_orderkey").join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("rule_id", F.col("n_name").alias("nation")).agg(F.sum("k").alias("n"))


@query("q_compare_runs", f"""
WITH {_N}, h AS (SELECT rule_id, sum(CASE WHEN hash_side = 0 THEN 1 ELSE 0 END)::BIGINT AS n_before, sum(CASE WHEN hash_side = 1 THEN 1 ELSE 0 END)::BIGINT AS n_after FROM (SELECT rule_id, length(entity_id) % 2 AS hash_side FROM n) GROUP BY 1)
SELECT rule_id, n_before, n_after, CASE WHEN n_after = 0 THEN 'Fixed' WHEN n_before = 0 THEN 'New' WHEN n_after < n_before THEN 'Decreased' WHEN n_after > n_before THEN 'Increased' ELSE 'Same' END AS change FROM h
""")
def compare_runs(t: Tables) -> DataFrame:
    n = _notices(t)
    return N.compare(n.filter("length(entity_id) % 2 = 0"), n.filter("length(entity_id) % 2 = 1"))
