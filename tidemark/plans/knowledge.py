"""Queries on graphs, texts, records and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import cut
from ..functions.columns import compact, mixed_fraction, squeeze, strip_tags
from ..operators import graph, lineage, slots
from .registry import query, table

# A small graph with a cycle, a self-edge and an unknown end, beside the trade tables' own hierarchy.
EXTRA = [("x1", "a", "b", 1, 5), ("x2", "b", "c", 1, 2), ("x3", "c", "a", 3, 2), ("x4", "d", "d", 0, 1), ("x5", "c", "e", 0, 1), ("x6", "e", "nowhere", 0, 4)]
EXTRA_SQL = ", ".join(str(x) for x in EXTRA)
EDGES = f"""ed AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 0 AS lag_min, 1 AS lag_max FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 's' || s_suppkey, 0, 2 FROM supplier
    UNION ALL SELECT * FROM (VALUES {EXTRA_SQL}) t(id, source, target, lag_min, lag_max)),
    nd AS (SELECT 'r' || r_regionkey AS id, 'ready' AS status FROM region UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'planned' ELSE 'ready' END FROM nation UNION ALL SELECT 's' || s_suppkey, 'ready' FROM supplier UNION ALL SELECT * FROM (VALUES ('a', 'ready'), ('b', 'ready'), ('c', 'planned'), ('d', 'ready'), ('e', 'ready')) t(id, status))"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("source"), key("n", "n_nationkey").alias("target"), F.lit(0).alias("lag_min"), F.lit(1).alias("lag_max"))
    s = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("id"), key("n", "s_nationkey").alias("source"), key("s", "s_suppkey").alias("target"), F.lit(0).alias("lag_min"), F.lit(2).alias("lag_max"))
    return n.union(s).union(spark.createDataFrame(EXTRA, "id string, source string, target string, lag_min int, lag_max int"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"), F.lit("ready").alias("status"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, "planned").otherwise("ready").alias("status"))
    s = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("id"), F.lit("ready").alias("status"))
    return r.union(n).union(s).union(spark.createDataFrame([("a", "ready"), ("b", "ready"), ("c", "planned"), ("d", "ready"), ("e", "ready")], "id string, status string"))


@query(f"""WITH {EDGES} SELECT id, 'unknown_source' AS problem FROM ed WHERE source NOT IN (SELECT id FROM nd) UNION ALL SELECT id, 'unknown_target' FROM ed WHERE target NOT IN (SELECT id FROM nd) UNION ALL SELECT id, 'self_edge' FROM ed WHERE source = target
    UNION ALL SELECT id, 'bad_lag' FROM ed WHERE lag_min > lag_max OR lag_min < 0 UNION ALL SELECT id, 'repeated_id' FROM ed GROUP BY id HAVING count(*) > 1""")
def graph_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_problems(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}, w AS (SELECT source AS a, target AS b FROM ed UNION SELECT w.a, ed.target FROM w JOIN ed ON ed.source = w.b) SELECT DISTINCT a AS node FROM w WHERE a = b")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cyclic_nodes(_edges(spark, sf_dir), cut)


@query(f"WITH RECURSIVE {EDGES}, w AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT ed.target, depth + 1 FROM w JOIN ed ON ed.source = w.node WHERE depth < 4) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_edges(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"), 4, cut)


CHAINS_SQL = "ch AS (SELECT 'r' || n_regionkey AS id, list_sort(list('n' || n_nationkey)) AS node_ids, list('n' || n_nationkey) AS edge_ids FROM nation GROUP BY n_regionkey UNION ALL SELECT 'loop', ['a', 'b', 'c'], ['x1', 'x2', 'x3'])"


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    own = table(spark, sf_dir, "nation").groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("id")).agg(F.array_sort(F.collect_list(name)).alias("node_ids"), F.collect_list(name).alias("edge_ids"))
    return own.unionByName(spark.createDataFrame([("loop", ["a", "b", "c"], ["x1", "x2", "x3"])], "id string, node_ids array<string>, edge_ids array<string>"))


@query(f"WITH {EDGES}, {CHAINS_SQL}, e AS (SELECT id AS chain, node_ids, unnest(edge_ids) AS edge FROM ch) SELECT chain, edge FROM e LEFT JOIN ed ON ed.id = e.edge WHERE NOT coalesce(list_contains(node_ids, source) AND list_contains(node_ids, target), false)")
def chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.open_chains(_chains(spark, sf_dir), _edges(spark, sf_dir))


@query(f"""WITH {EDGES}, {CHAINS_SQL}, e AS (SELECT id AS chain, unnest(node_ids) AS node FROM ch), b AS (SELECT chain, coalesce(string_agg(DISTINCT node, ',' ORDER BY node) FILTER (WHERE coalesce(status, '') <> 'ready'), '') AS blocked FROM e LEFT JOIN nd ON nd.id = e.node GROUP BY chain)
    SELECT chain, blocked, blocked = '' AS ready FROM b""")
def chain_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chain_readiness(_chains(spark, sf_dir), _nodes(spark, sf_dir))


@query(f"""WITH {EDGES}, {CHAINS_SQL}, ca AS (SELECT 's' || s_suppkey AS id, ['n' || s_nationkey, 'a', 'zz'] AS node_ids, s_suppkey % 3 AS replications, s_suppkey % 2 AS interactions FROM supplier), o AS (SELECT id, unnest(node_ids) AS node FROM ca),
    n AS (SELECT o.id, count(DISTINCT node) AS n_nodes FROM o WHERE node IN (SELECT id FROM nd) GROUP BY 1), t AS (SELECT o.id, count(DISTINCT c.chain) AS n_chains FROM o JOIN (SELECT id AS chain, unnest(node_ids) AS node FROM ch) c USING (node) GROUP BY 1)
    SELECT ca.id, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_chains, 0) AS n_chains, CAST(coalesce(n_nodes, 0) + coalesce(n_chains, 0) + 3 * replications + 2 * interactions AS BIGINT) AS score FROM ca LEFT JOIN n ON n.id = ca.id LEFT JOIN t ON t.id = ca.id""")
def investment_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit("a"), F.lit("zz")).alias("node_ids"), (F.col("s_suppkey") % 3).alias("replications"), (F.col("s_suppkey") % 2).alias("interactions"))
    return graph.ranked(s, _nodes(spark, sf_dir), _chains(spark, sf_dir))


# A hypothesis graph over the trade tables with faults of every kind in it. Nations are nodes, suppliers edges from their nation to a nation, regions chains.
NODE_TYPES, STATUSES, SIGNS, UNITS = ("market", "policy"), ("ready", "planned"), ("plus", "minus"), ("session", "day")
RULED = """nd AS (SELECT CASE WHEN n_nationkey = 24 THEN 'n3' ELSE 'n' || n_nationkey END AS id, CASE WHEN n_nationkey = 5 THEN 'moon' ELSE 'market' END AS type, CASE WHEN n_nationkey = 6 THEN '' ELSE 'l' || n_regionkey END AS layer, CASE WHEN n_nationkey = 7 THEN -1 ELSE n_regionkey END AS o,
        CASE WHEN n_nationkey = 8 THEN NULL WHEN n_nationkey = 9 THEN 'lost' ELSE 'ready' END AS data_status FROM nation),
    ed AS (SELECT CASE WHEN s_suppkey % 23 = 1 THEN NULL ELSE 's' || s_suppkey END AS id, 'n' || s_nationkey AS source, 'n' || (s_suppkey % 26) AS target, CASE WHEN s_suppkey % 19 = 2 THEN NULL ELSE 'market' END AS type, CASE WHEN s_suppkey % 17 = 3 THEN 'up' ELSE 'plus' END AS sign, s_suppkey % 5 AS lag_min, CASE WHEN s_suppkey % 13 = 4 THEN NULL ELSE 3 + s_suppkey % 2 END AS lag_max,
        CASE WHEN s_suppkey % 11 = 5 THEN 'year' ELSE 'day' END AS horizon_unit, CASE WHEN s_suppkey % 7 = 6 THEN ['n0', 'zz'] WHEN s_suppkey % 7 = 5 THEN [] ELSE ['n1'] END AS conditioning_on FROM supplier),
    ch AS (SELECT 'r' || r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN [] ELSE ['n' || r_regionkey, 'n2'] END AS node_ids, CASE WHEN r_regionkey = 2 THEN NULL ELSE ['s2', CASE WHEN r_regionkey = 3 THEN 'gone' ELSE 's3' END] END AS edge_ids FROM region)"""


def _ruled(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    n, s, r = (table(spark, sf_dir, t) for t in ("nation", "supplier", "region"))
    text = lambda prefix, c: F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))
    k, q = F.col("n_nationkey"), F.col("s_suppkey")
    nodes = n.select(
        F.when(k == 24, "n3").otherwise(text("n", "n_nationkey")).alias("id"), F.when(k == 5, "moon").otherwise("market").alias("type"), F.when(k == 6, "").otherwise(text("l", "n_regionkey")).alias("layer"), F.when(k == 7, -1).otherwise(F.col("n_regionkey")).alias("order"),
        F.when(k == 9, "lost").when(k != 8, "ready").alias("data_status"))
    some = F.when(q % 7 == 6, F.array(F.lit("n0"), F.lit("zz"))).when(q % 7 == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("n1")))
    edges = s.select(
        F.when(q % 23 != 1, text("s", "s_suppkey")).alias("id"), text("n", "s_nationkey").alias("source"), text("n", q % 26).alias("target"), F.when(q % 19 != 2, "market").alias("type"), F.when(q % 17 == 3, "up").otherwise("plus").alias("sign"), (q % 5).alias("lag_min"),
        F.when(q % 13 != 4, 3 + q % 2).alias("lag_max"), F.when(q % 11 == 5, "year").otherwise("day").alias("horizon_unit"), F.lit("open").alias("evidence_status"), some.alias("conditioning_on"))
    c = F.col("r_regionkey")
    chains = r.select(text("r", "r_regionkey").alias("id"), F.when(c == 1, F.array().cast("array<string>")).otherwise(F.array(text("n", "r_regionkey"), F.lit("n2"))).alias("node_ids"), F.when(c != 2, F.array(F.lit("s2"), F.when(c == 3, "gone").otherwise("s3"))).alias("edge_ids"))
    return {"nodes": nodes, "edges": edges, "chains": chains}


@query(f"""WITH {RULED}, p AS (
    SELECT 'nodes' AS kind, id, 'repeated_id' AS problem, 'id' AS field FROM nd GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'nodes', id, 'unknown_value', 'type' FROM nd WHERE type NOT IN ('market', 'policy') UNION ALL SELECT 'nodes', id, 'missing_field', 'layer' FROM nd WHERE layer = ''
    UNION ALL SELECT 'nodes', id, 'missing_field', 'data_status' FROM nd WHERE data_status IS NULL UNION ALL SELECT 'nodes', id, 'unknown_value', 'data_status' FROM nd WHERE data_status NOT IN ('ready', 'planned') UNION ALL SELECT 'nodes', id, 'bad_order', '' FROM nd WHERE o < 0
    UNION ALL SELECT 'edges', coalesce(id, ''), 'missing_id', 'id' FROM ed WHERE id IS NULL UNION ALL SELECT 'edges', coalesce(id, ''), 'missing_field', 'type' FROM ed WHERE type IS NULL UNION ALL SELECT 'edges', coalesce(id, ''), 'missing_field', 'lag_max' FROM ed WHERE lag_max IS NULL
    UNION ALL SELECT 'edges', coalesce(id, ''), 'unknown_value', 'sign' FROM ed WHERE sign NOT IN ('plus', 'minus') UNION ALL SELECT 'edges', coalesce(id, ''), 'unknown_value', 'horizon_unit' FROM ed WHERE horizon_unit NOT IN ('session', 'day')
    UNION ALL SELECT 'edges', coalesce(id, ''), 'self_edge', '' FROM ed WHERE source = target UNION ALL SELECT 'edges', coalesce(id, ''), 'bad_lag', '' FROM ed WHERE NOT (lag_min >= 0 AND lag_max >= lag_min)
    UNION ALL SELECT 'edges', coalesce(id, ''), 'unknown_reference', 'source' FROM ed WHERE source NOT IN (SELECT id FROM nd) UNION ALL SELECT 'edges', coalesce(id, ''), 'unknown_reference', 'target' FROM ed WHERE target NOT IN (SELECT id FROM nd)
    UNION ALL SELECT 'edges', coalesce(id, ''), 'unknown_reference', 'conditioning_on' FROM (SELECT id, unnest(conditioning_on) AS x FROM ed) WHERE x NOT IN (SELECT id FROM nd)
    UNION ALL SELECT 'chains', id, 'missing_field', 'node_ids' FROM ch WHERE len(node_ids) = 0 UNION ALL SELECT 'chains', id, 'missing_field', 'edge_ids' FROM ch WHERE edge_ids IS NULL
    UNION ALL SELECT 'chains', id, 'unknown_reference', 'node_ids' FROM (SELECT id, unnest(node_ids) AS x FROM ch) WHERE x NOT IN (SELECT id FROM nd) UNION ALL SELECT 'chains', id, 'unknown_reference', 'edge_ids' FROM (SELECT id, unnest(edge_ids) AS x FROM ch) WHERE x NOT IN (SELECT id FROM ed WHERE id IS NOT NULL))
    SELECT DISTINCT kind, id, problem, field FROM p""")
def graph_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of a graph's nodes, edges and chains."""
    rules = {kind: dict(spec) for kind, spec in graph.RULES.items()}
    rules["nodes"]["enums"] = {"type": NODE_TYPES, "data_status": STATUSES}
    rules["edges"]["enums"] = {"type": NODE_TYPES, "sign": SIGNS, "horizon_unit": UNITS}
    return graph.rule_problems(_ruled(spark, sf_dir), rules, graph.CHECKS)


# ---- lineage: regions, nations, the parties of each nation and its trade, which comes from all its parties

LINEAGE = """ld AS (SELECT 'region ' || r_regionkey AS name, r_name AS config, 0 AS depth, []::VARCHAR[] AS parents FROM region UNION ALL SELECT 'nation ' || n_nationkey, n_name, 1, ['region ' || n_regionkey] FROM nation
    UNION ALL SELECT 'supplier ' || s_suppkey, s_name, 2, ['nation ' || s_nationkey] FROM supplier UNION ALL SELECT 'trade ' || s_nationkey, 'sum', 3, list('supplier ' || s_suppkey) FROM supplier GROUP BY s_nationkey)"""


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, r = (table(spark, sf_dir, t) for t in ("nation", "supplier", "region"))
    text = lambda prefix, c: F.concat(F.lit(f"{prefix} "), F.col(c).cast("string"))
    out = r.select(text("region", "r_regionkey").alias("name"), F.col("r_name").alias("config"), F.array().cast("array<string>").alias("parents"))
    out = out.unionByName(n.select(text("nation", "n_nationkey").alias("name"), F.col("n_name").alias("config"), F.array(text("region", "n_regionkey")).alias("parents")))
    out = out.unionByName(s.select(text("supplier", "s_suppkey").alias("name"), F.col("s_name").alias("config"), F.array(text("nation", "s_nationkey")).alias("parents")))
    return out.unionByName(s.groupBy(text("trade", "s_nationkey").alias("name")).agg(F.lit("sum").alias("config"), F.collect_list(text("supplier", "s_suppkey")).alias("parents")))


@query(f"""WITH {LINEAGE}, a AS (SELECT *, left(sha256(config || '|'), 20) AS x FROM ld WHERE depth = 0), b AS (SELECT ld.*, left(sha256(ld.config || '|' || a.x), 20) AS x FROM ld JOIN a ON a.name = ld.parents[1] WHERE ld.depth = 1), c AS (SELECT ld.*, left(sha256(ld.config || '|' || b.x), 20) AS x FROM ld JOIN b ON b.name = ld.parents[1] WHERE ld.depth = 2),
    e AS (SELECT t.name, any_value(t.config) AS config, string_agg(c.x, ',' ORDER BY c.x) AS xs FROM (SELECT name, config, unnest(parents) AS p FROM ld WHERE depth = 3) t JOIN c ON c.name = t.p GROUP BY t.name),
    i AS (SELECT name, depth, x FROM a UNION ALL SELECT name, depth, x FROM b UNION ALL SELECT name, depth, x FROM c UNION ALL SELECT name, 3, left(sha256(config || '|' || xs), 20) FROM e),
    k AS (SELECT 'nation ' || n_nationkey AS name, true AS own FROM nation WHERE n_nationkey IN (3, 7) UNION ALL SELECT 'supplier ' || s_suppkey, s_nationkey NOT IN (3, 7) FROM supplier WHERE s_nationkey IN (3, 7) OR s_suppkey = 11 UNION ALL SELECT DISTINCT 'trade ' || s_nationkey, false FROM supplier WHERE s_nationkey IN (3, 7) OR s_suppkey = 11)
    SELECT i.name, depth, x AS dataset_id, k.name IS NOT NULL AS stale, coalesce(own, false) AS changed FROM i LEFT JOIN k USING (name)""")
def dataset_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of datasets by their lineage. The recorded ones are from before two nations and one supplier changed: they and what comes from them are out of date."""
    now = cut(_datasets(spark, sf_dir))
    before = F.when(F.col("name").isin("nation 3", "nation 7", "supplier 11"), F.concat(F.lit("old "), "config")).otherwise(F.col("config"))
    recorded = lineage.lineage_ids(now.withColumn("config", before))
    return lineage.staleness(now, recorded).select("name", "depth", "dataset_id", "stale", "changed")


# ---- texts and records

CUSTOMER_SLOTS = """ev AS (SELECT c_custkey AS event_id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 1200 END AS t1, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 700 END AS t2, CASE WHEN c_custkey % 7 = 1 THEN 5 + c_custkey % 90 END AS t3, CASE WHEN c_custkey % 11 = 1 THEN c_custkey % 1200 END AS t4 FROM customer),
    sl AS (SELECT event_id, unnest([0, 1, 2, 3]) AS slot, unnest([t1, t2, t3, t4]) AS text_id FROM ev), lk AS (SELECT event_id, slot, text_id, doc_id IS NOT NULL AS found, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS text, coalesce(lang, '') AS lang FROM sl LEFT JOIN documents ON doc_id = text_id WHERE text_id IS NOT NULL)"""


def _slot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("event_id"), F.when(k % 5 != 0, k % 1200).alias("t1"), F.when(k % 3 == 0, k % 700).alias("t2"), F.when(k % 7 == 1, 5 + k % 90).alias("t3"), F.when(k % 11 == 1, k % 1200).alias("t4"))


def _slot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.linked_texts(_slot_events(spark, sf_dir), "event_id", ["t1", "t2", "t3", "t4"], table(spark, sf_dir, "documents"), "doc_id", {"full_text": ("text", "\n\n"), "langs": ("lang", " | ")})


@query(f"""WITH {CUSTOMER_SLOTS}, g AS (SELECT event_id, count(*) AS n_named, count(*) FILTER (found) AS n_found, nullif(trim(string_agg(text, chr(10) || chr(10) ORDER BY slot) FILTER (found), chr(32) || chr(9) || chr(10) || chr(13)), '') AS full_text, nullif(trim(string_agg(lang, ' | ' ORDER BY slot) FILTER (found)), '') AS langs FROM lk GROUP BY 1)
    SELECT ev.event_id, coalesce(n_named, 0) AS n_named, coalesce(n_found, 0) AS n_found, coalesce(langs, '') AS langs, sha256(coalesce(full_text, '')) AS text_sha256 FROM ev LEFT JOIN g USING (event_id)""")
def slot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as events that name up to four texts, some of them unknown; the texts in the order of their slots."""
    out = _slot_texts(spark, sf_dir)
    return out.select("event_id", "n_named", "n_found", F.coalesce("langs", F.lit("")).alias("langs"), F.sha2(F.coalesce("full_text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query(f"""WITH {CUSTOMER_SLOTS}, g AS (SELECT event_id, count(*) AS n_named, count(*) FILTER (found) AS n_found, bool_or(found AND text <> '') AS has_text FROM lk GROUP BY 1), rx AS (SELECT o_custkey + o_orderkey % 2 * 100000000 AS event_id, o_totalprice / 1000 - 150 AS r FROM orders),
    j AS (SELECT rx.*, ev.event_id IS NOT NULL AS known, coalesce(has_text, false) AS has_text FROM rx LEFT JOIN ev USING (event_id) LEFT JOIN g USING (event_id))
    SELECT (SELECT count(*) FROM ev) AS events, (SELECT CAST(sum(n_named) AS BIGINT) FROM g) AS named, (SELECT CAST(sum(n_named - n_found) AS BIGINT) FROM g) AS missing, count(*) AS reactions, count(*) FILTER (NOT known) AS unknown_events, count(*) FILTER (known AND has_text) AS examples,
    round(quantile_cont(abs(r), 0.5) FILTER (known), 6) AS median_absolute, round(avg(abs(r)) FILTER (known), 6) AS mean_absolute FROM j""")
def slot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known and what is missing between events, their texts and the market's reactions."""
    texts = _slot_texts(spark, sf_dir).select("event_id", "n_named", "n_found", F.col("full_text").isNotNull().alias("has_text"))
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 2 * 100000000).alias("event_id"), (F.col("o_totalprice") / 1000 - 150).alias("r"))
    met = o.join(texts.select("event_id", "has_text"), "event_id", "left")
    known, size = F.col("has_text").isNotNull(), F.when(F.col("has_text").isNotNull(), F.abs("r"))
    sums = texts.agg(F.count("*").alias("events"), F.sum("n_named").alias("named"), F.sum(F.col("n_named") - F.col("n_found")).alias("missing")).withColumn("one", F.lit(1))
    out = met.agg(F.count("*").alias("reactions"), F.count_if(~known).alias("unknown_events"), F.count_if(F.coalesce("has_text", F.lit(False))).alias("examples"), F.round(F.percentile(size, F.lit(0.5)), 6).alias("median_absolute"), F.round(F.avg(size), 6).alias("mean_absolute"))
    return sums.join(F.broadcast(out.withColumn("one", F.lit(1))), "one").drop("one")


@query(r"""SELECT page_id, length(regexp_replace(html, '\s+', ' ', 'g')) AS squeezed, len(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)) AS links, coalesce(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    links = F.size(F.regexp_extract_all("html", F.lit('(?i)href="([^"]*)"'), 1)).cast("long")
    return p.select("page_id", F.length(F.regexp_replace("html", r"\s+", " ")).cast("long").alias("squeezed"), links.alias("links"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html")).alias("text"))


@query("""SELECT p_partkey, sha256(p_brand || '|' || p_type) AS record_hash, left(sha256(p_brand || '|' || p_type), 20) AS short_id, CASE WHEN p_partkey % 3 = 0 THEN 5.25::DOUBLE WHEN p_partkey % 3 = 1 THEN 0.5::DOUBLE ELSE NULL END AS rate FROM part""")
def record_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    digest = F.sha2(F.concat_ws("|", "p_brand", "p_type").cast("binary"), 256)
    written = F.when(F.col("p_partkey") % 3 == 0, "5-1/4").when(F.col("p_partkey") % 3 == 1, "1/2").otherwise("none")
    return p.select("p_partkey", digest.alias("record_hash"), F.substring(digest, 1, 20).alias("short_id"), mixed_fraction(written).alias("rate"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS full_text, count(*) FILTER (WHERE role = 'user') AS user_turns FROM conversations GROUP BY conv_id""")
def joined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("turn", "role", "text"))))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("full_text"), F.count_if(F.col("role") == "user").alias("user_turns"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 144) || chr(10) || '[...]' || chr(10) || right(text, 49) END AS compact, contains(lower(text), 'password') OR contains(lower(text), 'license') AS forbidden FROM documents WHERE text IS NOT NULL")
def compact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    lower = F.lower("text")
    return d.select("doc_id", compact(F.col("text"), 200).alias("compact"), (lower.contains("password") | lower.contains("license")).alias("forbidden"))


@query("""SELECT o_orderkey, 'status: ' || o_orderstatus || chr(10) || 'priority: ' || o_orderpriority || chr(10) || 'days: ' || day(o_orderdate) AS state, left(sha256('status: ' || o_orderstatus || chr(10) || 'priority: ' || o_orderpriority || chr(10) || 'days: ' || day(o_orderdate)), 24) AS job_id FROM orders""")
def rendered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.concat_ws("\n", F.concat(F.lit("status: "), "o_orderstatus"), F.concat(F.lit("priority: "), "o_orderpriority"), F.concat(F.lit("days: "), F.dayofmonth("o_orderdate").cast("string")))
    return o.select("o_orderkey", state.alias("state"), F.substring(F.sha2(state.cast("binary"), 256), 1, 24).alias("job_id"))


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS i, count(*) OVER () AS c FROM conversations), w AS (SELECT DISTINCT CAST(round_even(k * ((SELECT max(c) FROM n) - 1) / 9.0, 0) AS BIGINT) AS i FROM range(0, 10) t(k)) SELECT conv_id, turn, role FROM n JOIN w USING (i)""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows spaced evenly over the ordered table, both ends among them. Rows are numbered by range partitions, not in one task."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    n = c.count()
    wanted = sorted({round(k * (n - 1) / 9) for k in range(10)}) if n else []
    ordered = c.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id())
    ordered = ordered.withColumn("k", F.monotonically_increasing_id())
    ordered = cut(ordered)
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size"), F.min("k").alias("low"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before", "low")
    placed = ordered.join(F.broadcast(offsets), "part").withColumn("i", F.col("before") + F.col("k") - F.col("low"))
    return placed.where(F.col("i").isin(wanted)).select("conv_id", "turn", "role")


@query("""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders WHERE month(o_orderdate) NOT IN (2, 7)), e AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE) AS month FROM orders)
    SELECT CAST(month AS VARCHAR) AS month FROM e WHERE month NOT IN (SELECT month FROM m)""")
def missing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month"))
    expected = o.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    seen = o.where("month(month) not in (2, 7)").distinct()
    return expected.join(seen, "month", "left_anti").select(F.col("month").cast("string").alias("month"))


@query("SELECT event_id, squeezed, kind FROM (SELECT event_id, trim(regexp_replace(props, '[\\s]+', ' ', 'g')) AS squeezed, event_type || '+' || CAST(user_id % 3 AS VARCHAR) AS kind FROM events)")
def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", squeeze(F.col("props")).alias("squeezed"), F.concat_ws("+", "event_type", (F.col("user_id") % 3).cast("string")).alias("kind"))
