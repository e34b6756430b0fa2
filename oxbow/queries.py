"""The queries of the engine's own operators, each over whole tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oxbow.functions import vectors
from oxbow.functions.text import redact, redaction_sql, tokens
from oxbow.functions.vectors import cosine_distance
from oxbow.operators import communities, evaluation, graph, ivf, memory, recall, retrieval, stored_graph
from oxbow.operators.patterns import Graph
from oxbow.operators.push import forward_push
from oxbow.plans import search_bar
from oxbow.plans.cypher import cypher
from oxbow.plans.kql import kql
from oxbow.session import table
from oxbow.sources import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "kql_summarize"


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def piped(name: str, text: str, sql: str) -> None:
    """A query in the pipe language."""
    query(name, sql)(lambda spark, sf_dir: kql(text, lambda t: table(spark, sf_dir, t)))


piped("kql_where", "events | where event_type == 'click' and value > 50.0 | project event_id, user_id, value", "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 50.0")
piped("kql_between_in", "lineitem | where l_quantity between (10 .. 20) and l_returnflag in ('A', 'R') | project l_orderkey, l_linenumber, l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R')")
piped("kql_not_in", "nation | where n_regionkey !in (1, 2) | project n_name", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 2)")
piped("kql_time_range", "events | where ts >= datetime(2024-01-05) and ts < datetime('2024-01-10 12:00:00') | count", 'SELECT count(*) AS "Count" FROM events WHERE ts >= TIMESTAMP \'2024-01-05\' AND ts < TIMESTAMP \'2024-01-10 12:00:00\'')
piped("kql_project_away", "customer | project-away c_acctbal, c_name", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
piped("kql_extend", "orders | extend half = o_orderkey / 2, twice = half * 2 | project o_orderkey, half, twice, rest = o_orderkey % 7", "SELECT o_orderkey, o_orderkey // 2 AS half, (o_orderkey // 2) * 2 AS twice, o_orderkey % 7 AS rest FROM orders")
piped("kql_summarize", "lineitem | where l_shipdate <= datetime(1998-09-02) | summarize sum_qty = round(sum(l_quantity), 2), n = count(), most = max(l_extendedprice) by l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n, max(l_extendedprice) AS most FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
piped("kql_having", "orders | summarize n = count() by o_custkey | where n > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
piped("kql_dcount", "events | summarize users = dcount(user_id), clicks = dcountif(user_id, event_type == 'click') by event_type", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS clicks FROM events GROUP BY event_type")
piped("kql_bin", "events | summarize n = count() by hour = bin(ts, 6h), event_type", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
piped("kql_start_of", "events | summarize n = count() by day = startofday(ts)", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL")
piped("kql_top", "customer | top 10 by c_acctbal desc, c_custkey asc | project c_custkey, c_acctbal", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
piped("kql_sort_take", "part | sort by p_retailprice desc, p_partkey asc | take 25 | project p_partkey", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
piped("kql_distinct", "orders | distinct o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
piped("kql_count_after", "orders | distinct o_custkey | count", 'SELECT count(*) AS "Count" FROM (SELECT DISTINCT o_custkey FROM orders)')
piped("kql_union", "union withsource=origin (customer | project key = c_custkey, name = c_name), (supplier | project key = s_suppkey, balance = s_acctbal)", "SELECT 'customer' AS origin, c_custkey AS key, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier")
piped("kql_join", "orders | join kind=inner (customer | where c_mktsegment == 'BUILDING') on $left.o_custkey == $right.c_custkey | summarize n = count() by c_nationkey", "SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey")
piped("kql_join_left", "nation | join kind=leftouter (supplier | summarize suppliers = count() by n_nationkey = s_nationkey) on n_nationkey | project n_name, suppliers", "SELECT n_name, suppliers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY s_nationkey) ON n_nationkey = s_nationkey")
piped("kql_strings", "customer | where c_name contains '1' and c_mktsegment startswith 'B' | project c_custkey, tag = strcat(tolower(c_mktsegment), '-', tostring(c_nationkey)), size = strlen(c_name)", "SELECT c_custkey, concat(lower(c_mktsegment), '-', c_nationkey::VARCHAR) AS tag, length(c_name)::INT AS size FROM customer WHERE contains(c_name, '1') AND starts_with(c_mktsegment, 'B')")
piped("kql_has", "documents | where text has 'the' | count", "SELECT count(*) AS \"Count\" FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^0-9a-z]+'), 'the')")
piped("kql_iff", "lineitem | summarize late = sum(iff(l_discount > 0.05, 1, 0)), nulls = countif(isnull(l_tax)) by l_linestatus", "SELECT l_linestatus, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS late, count(*) FILTER (l_tax IS NULL) AS nulls FROM lineitem GROUP BY l_linestatus")
piped("kql_json_path", "events | extend k = tolong(props.k) | summarize n = count(), most = max(k) by event_type", "SELECT event_type, count(*) AS n, max((props->>'$.k')::BIGINT) AS most FROM events GROUP BY event_type")
piped("kql_regex", "part | where p_name matches regex '[aeiou]{2}' | count", "SELECT count(*) AS \"Count\" FROM part WHERE regexp_matches(p_name, '[aeiou]{2}')")

query("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda spark, d: table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")))


@query("sql_window", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def sql_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("oxbow_orders")
    return spark.sql("SELECT o_orderkey, o_custkey, cast(row_number() OVER w AS bigint) AS nth, lag(o_totalprice) OVER w AS previous FROM oxbow_orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")


@query("sql_set_operations", "(SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def sql_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    both = t("supplier").select(F.col("s_nationkey").alias("k")).intersect(t("customer").select("c_nationkey"))
    return both.subtract(t("nation").where("n_regionkey = 0").select("n_nationkey"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers place orders, orders hold parts, parts are from suppliers; whole keys, four kinds of ids side by side. Parallel edges stay: the searches take each step once anyhow."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda c, kind: F.col(c) * 4 + kind
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return (
        t("orders").select(node("o_custkey", 0).alias("src"), node("o_orderkey", 1).alias("dst"), F.lit("PLACED").alias("type"))
        .unionAll(items.select(node("l_orderkey", 1), node("l_partkey", 2), F.lit("HOLDS")))
        .unionAll(items.select(node("l_partkey", 2), node("l_suppkey", 3), F.lit("FROM")))
    )


EDGES = "e AS MATERIALIZED (SELECT o_custkey * 4 AS src, o_orderkey * 4 + 1 AS dst, 'PLACED' AS type FROM orders UNION ALL SELECT DISTINCT l_orderkey * 4 + 1, l_partkey * 4 + 2, 'HOLDS' FROM lineitem UNION ALL SELECT DISTINCT l_partkey * 4 + 2, l_suppkey * 4 + 3, 'FROM' FROM lineitem)"


@query("graph_var_length", f"WITH RECURSIVE {EDGES}, w(node, depth) AS (SELECT 20::BIGINT, 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3) SELECT 20::BIGINT AS src, node AS dst, min(depth)::INT AS depth FROM w GROUP BY node HAVING min(depth) >= 1")
def graph_var_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order_edges(spark, sf_dir)
    return kql("edges | graph-var-length source 20 from src to dst min-hops 1 max-hops 3", lambda _: edges)


@query("graph_shortest_path", f"WITH RECURSIVE {EDGES}, w(node, depth) AS (SELECT 20::BIGINT, 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 4) SELECT min(depth)::INT AS depth, min(depth) IS NOT NULL AS found FROM w WHERE node = 15")
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order_edges(spark, sf_dir)
    return kql("edges | graph-shortest-path source 20 target 15 from src to dst max-hops 4", lambda _: edges)


@query("graph_traverse", f"WITH RECURSIVE {EDGES}, w(node, depth) AS (SELECT 28::BIGINT, 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 1), m AS (SELECT node, min(depth) + 1 AS depth FROM w GROUP BY node) SELECT e.src, e.dst, e.type, m.depth::INT AS depth FROM e JOIN m ON e.src = m.node")
def graph_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order_edges(spark, sf_dir)
    return kql("edges | graph-traverse source 28 from src to dst max-hops 2", lambda _: edges)


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers and suppliers, with HAS, HOSTS and SEATS edges."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    none = F.lit(None).cast("double")
    nodes = (
        t("region").select(key("r", "r_regionkey").alias("id"), F.lit("Region").alias("label"), F.col("r_name").alias("name"), none.alias("balance"))
        .unionAll(t("nation").select(key("n", "n_nationkey"), F.lit("Nation"), "n_name", none))
        .unionAll(t("customer").select(key("c", "c_custkey"), F.lit("Customer"), "c_name", "c_acctbal"))
        .unionAll(t("supplier").select(key("s", "s_suppkey"), F.lit("Supplier"), "s_name", "s_acctbal"))
    )
    edges = (
        t("nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"), F.lit("HAS").alias("type"))
        .unionAll(t("customer").select(key("n", "c_nationkey"), key("c", "c_custkey"), F.lit("HOSTS")))
        .unionAll(t("supplier").select(key("n", "s_nationkey"), key("s", "s_suppkey"), F.lit("SEATS")))
    )
    return Graph(nodes, edges)


@query("graph_match", "SELECT r_name AS a, n_name AS b, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def graph_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade_graph(spark, sf_dir)
    return graph.match(g.nodes, g.edges, ["a", "b", "c"], ["HAS", "HOSTS"]).groupBy(F.col("a_name").alias("a"), F.col("b_name").alias("b")).agg(F.count("*").alias("n"))


def graph_piped(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = trade_graph(spark, sf_dir)
        return kql(text, lambda t: {"edges": g.edges, "nodes": g.nodes}[t])

    query(name, sql)(run)


graph_piped("kql_graph_match", "edges | make-graph src --> dst with nodes on id | graph-match (r:Region)-[:HAS]->(n)-[e:HOSTS]->(c) project r.name, c.id as customer, e.type | summarize n = count(), most = max(customer) by r_name, e_type", "SELECT r_name, 'HOSTS' AS e_type, count(*) AS n, max('c' || c_custkey) AS most FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
graph_piped("kql_graph_match_optional", "edges | make-graph src --> dst with nodes on id | graph-match (r)-[:HAS]->(n), optional (n)-[:SEATS]->(s) project n.name, s.name as supplier", "SELECT n_name, s_name AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
graph_piped("kql_graph_var_match", "edges | make-graph src --> dst with nodes on id | graph-var-match (a:Region)-[r]->(b) min-hops 2 max-hops 2 project a.name as region, b.label as label, r.depth | summarize n = count() by region, label, r_depth", "SELECT r_name AS region, label, 2 AS r_depth, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey AS k, 'Customer' AS label FROM customer UNION ALL SELECT s_nationkey, 'Supplier' FROM supplier) ON k = n_nationkey GROUP BY ALL")


def cypher_query(name: str, text: str, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: cypher(text, trade_graph(spark, sf_dir)))


cypher_query("cypher_chain", "MATCH (r:Region)-[:HAS]->(n)-[:HOSTS]->(c:Customer) WHERE c.balance > 9000 AND r.name IN ['ASIA', 'EUROPE'] RETURN r.name, n.name AS nation, c.id", "SELECT r_name, n_name AS nation, 'c' || c_custkey AS c_id FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 AND r_name IN ('ASIA', 'EUROPE')")
cypher_query("cypher_backward", "MATCH (c:Customer)<-[:HOSTS]-(n)<-[:HAS]-(r) WHERE NOT n.name STARTS WITH 'A' RETURN DISTINCT r.name, n.name", "SELECT DISTINCT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE NOT starts_with(n_name, 'A')")
cypher_query("cypher_star", "MATCH (n:Nation)-[:HOSTS]->(c), (n)-[:SEATS]->(s) RETURN n.id, count(*) AS pairs, max(c.balance) AS best", "SELECT 'n' || n_nationkey AS n_id, count(*) AS pairs, max(c_acctbal) AS best FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
cypher_query("cypher_optional", "MATCH (r:Region)-[:HAS]->(n) OPTIONAL MATCH (n)-[:SEATS]->(s) RETURN n.name, count(s) AS suppliers", "SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
cypher_query("cypher_var_length", "MATCH (r:Region)-[*1..2]->(x) RETURN r.name, x.label, count(*) AS n", "SELECT r_name, x_label, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN (SELECT n_nationkey AS k, 'Nation' AS x_label FROM nation UNION ALL SELECT c_nationkey, 'Customer' FROM customer UNION ALL SELECT s_nationkey, 'Supplier' FROM supplier) ON k = n_nationkey GROUP BY ALL")
cypher_query("cypher_undirected", "MATCH (n:Nation)-[e]-(x) RETURN n.name, e.type, count(x) AS n", "SELECT n_name, e_type, count(*) AS n FROM nation JOIN (SELECT n_nationkey AS k, 'HAS' AS e_type FROM nation UNION ALL SELECT c_nationkey, 'HOSTS' FROM customer UNION ALL SELECT s_nationkey, 'SEATS' FROM supplier) ON k = n_nationkey GROUP BY ALL")
cypher_query("cypher_with", "MATCH (n:Nation)-[:HOSTS]->(c) WITH n, count(c) AS customers, sum(c.balance) AS total WHERE customers > 5 AND total > 0 RETURN n.name, customers", "SELECT n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name HAVING count(*) > 5 AND sum(c_acctbal) > 0")
cypher_query("cypher_arithmetic", "MATCH (n)-[:SEATS]->(s) RETURN s.id, s.balance * 2 + 1 AS twice ORDER BY s.balance DESC, s.id LIMIT 7", "SELECT 's' || s_suppkey AS s_id, s_acctbal * 2 + 1 AS twice FROM supplier ORDER BY s_acctbal DESC, 's' || s_suppkey LIMIT 7")
cypher_query("cypher_shortest", "MATCH p = shortestPath((a)-[*..4]->(b)) WHERE a.id = 'r0' AND b.id = 'c1' RETURN length(p)", "SELECT max(2) FILTER (n_regionkey = 0)::INT AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1")


@query("graph_k_hop", f"WITH RECURSIVE {EDGES}, w(source, node, d) AS (SELECT s, s, 0 FROM (VALUES (8::BIGINT), (44::BIGINT)) v(s) UNION SELECT w.source, e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < 2) SELECT source, node, min(d)::INT AS dist FROM w GROUP BY source, node")
def graph_k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order_edges(spark, sf_dir)
    return graph.k_hop(graph.steps(edges, "src", "dst"), graph.seeds(edges, [8, 44], "src"), 2)


@query("graph_modularity", f"WITH {EDGES}, t AS (SELECT count(*) AS m, count(*) FILTER (src % 5 = dst % 5) AS i FROM e), d AS (SELECT c, count(*) AS n FROM (SELECT src % 5 AS c FROM e UNION ALL SELECT dst % 5 FROM e) GROUP BY c) SELECT round(any_value(i) / any_value(m) - sum(n * n) / (4.0 * any_value(m) * any_value(m)), 9)::DOUBLE AS modularity FROM t, d")
def graph_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order_edges(spark, sf_dir).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", (F.col("node") % 5).alias("community"))
    return graph.modularity(edges, nodes, "src", "dst").select(F.round("modularity", 9).alias("modularity"))


@query(
    "graph_communities",
    "WITH e AS (SELECT c_nationkey AS n, 'c' || c_custkey AS x FROM customer UNION ALL SELECT s_nationkey, 's' || s_suppkey FROM supplier), a AS (SELECT n, x AS node FROM e UNION SELECT n, 'n' || n FROM e), m AS (SELECT n, min(node) AS community FROM a GROUP BY n) SELECT node, community FROM a JOIN m USING (n)",
)
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of nations and their customers and suppliers: every nation's star is best left whole."""
    return communities.detect_communities(trade_graph(spark, sf_dir).edges.where("type <> 'HAS'"), levels=2)


@query("graph_stats", "SELECT 'node' AS kind, 'Region' AS name, count(*) AS n FROM region UNION ALL SELECT 'node', 'Nation', count(*) FROM nation UNION ALL SELECT 'node', 'Customer', count(*) FROM customer UNION ALL SELECT 'node', 'Supplier', count(*) FROM supplier UNION ALL SELECT 'edge', 'HAS', count(*) FROM nation UNION ALL SELECT 'edge', 'HOSTS', count(*) FROM customer UNION ALL SELECT 'edge', 'SEATS', count(*) FROM supplier")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph.stats(stored_graph.built(trade_graph(spark, sf_dir)))


@query("graph_degrees", "WITH e AS (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS d FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), k AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier), o AS (SELECT s, count(*) AS n FROM e GROUP BY s), i AS (SELECT d, count(*) AS n FROM e GROUP BY d) SELECT id, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM k LEFT JOIN o ON s = id LEFT JOIN i ON d = id")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph.degrees(trade_graph(spark, sf_dir))


@query("graph_subgraph", "SELECT 'r1' AS src, 'n' || n_nationkey AS dst, 'HAS' AS type FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'HOSTS' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'SEATS' FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1")
def graph_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph.subgraph(trade_graph(spark, sf_dir), ["r1"], 2).edges.select("src", "dst", "type")


@query(
    "graph_components",
    "WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem), l AS MATERIALIZED (SELECT DISTINCT a.s AS x, b.s AS y FROM p a JOIN p b USING (k)), r(x, y) AS (SELECT DISTINCT s, s FROM p UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y), "
    "c AS MATERIALIZED (SELECT x, max(y) AS m FROM r GROUP BY x) SELECT -1 - x AS node, -1 - m AS component FROM c UNION ALL SELECT p.k, -1 - max(c.m) FROM p JOIN c ON c.x = p.s GROUP BY p.k",
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"))
    return graph.star_components(edges)


RANK_ROUNDS = 12
RANKS = ", ".join(
    f"s{k + 1} AS MATERIALIZED (SELECT node, h * (0.15 + 0.85 * (SELECT coalesce(sum(score), 0) FROM s{k} JOIN v USING (node) WHERE d = 0)) + 0.85 * coalesce(got, 0) AS score FROM v LEFT JOIN (SELECT e.dst AS node, sum(score / d) AS got FROM e JOIN s{k} ON s{k}.node = e.src JOIN v ON v.node = e.src GROUP BY e.dst) USING (node))"
    for k in range(RANK_ROUNDS)
)


@query("graph_pagerank", f"WITH {EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS d FROM e GROUP BY src), v AS MATERIALIZED (SELECT node, coalesce(d, 0) AS d, 1.0::DOUBLE / (SELECT count(*) FROM n) AS h FROM n LEFT JOIN o ON o.src = node), s0 AS MATERIALIZED (SELECT node, h AS score FROM v), {RANKS} SELECT node, round(score, 10) AS score FROM s{RANK_ROUNDS}")
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(order_edges(spark, sf_dir), "src", "dst", rounds=RANK_ROUNDS, settled=0.0).select("node", F.round("score", 10).alias("score"))


#: Mass only moves on along customer, order, part and supplier, so four rounds are all.
PUSHES = ", ".join(
    f"q{k + 1} AS MATERIALIZED (SELECT node, sum(p) AS p, sum(r) AS r, any_value(d) AS d FROM (SELECT node, p + CASE WHEN r = 0 OR r < 1e-4 * d THEN 0 WHEN d = 0 THEN r ELSE 0.15 * r END AS p, CASE WHEN r < 1e-4 * d THEN r ELSE 0 END AS r, d FROM q{k} UNION ALL SELECT e.dst, 0, 0.85 * r / q{k}.d, coalesce(o.d, 0) FROM q{k} JOIN e ON e.src = q{k}.node LEFT JOIN o ON o.src = e.dst WHERE q{k}.d > 0 AND r > 0 AND r >= 1e-4 * q{k}.d) GROUP BY node)"
    for k in range(5)
)


@query("graph_ppr", f"WITH {EDGES}, o AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY src), q0 AS MATERIALIZED (SELECT n AS node, 0.0::DOUBLE AS p, 0.5::DOUBLE AS r, coalesce(d, 0) AS d FROM (VALUES (20::BIGINT), (28::BIGINT)) x(n) LEFT JOIN o ON o.src = n), {PUSHES} SELECT node, round(p, 10) AS score FROM q5 WHERE p > 0")
def graph_ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order_edges(spark, sf_dir)
    return forward_push(edges, graph.seeds(edges, [20, 28], "src"), epsilon=1e-4).select("node", F.round("score", 10).alias("score"))


@query("vector_top10", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS distance FROM embeddings, q ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), vec_id LIMIT 10")
def vector_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    one = rows.where("vec_id = 0").select("embedding").first()["embedding"]
    return retrieval.vector_topk(rows, one, "embedding", 10, "vec_id").select("vec_id", F.round("distance", 9).alias("distance"))


BM25_SQL = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z]+'), lambda t: length(t) >= 2) AS words FROM documents),
c AS (SELECT doc_id, len(words) AS l, len(list_filter(words, lambda x: x = 'ther')) AS t0, len(list_filter(words, lambda x: x = 'tion')) AS t1 FROM w),
s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c),
b AS (SELECT doc_id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * l / m)) AS score FROM c, s)"""


@query("bm25", f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM b WHERE score > 0")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), "ther tion", "text", "doc_id").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("hybrid_rrf", f"WITH {BM25_SQL}, t AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM b WHERE score > 0 QUALIFY rank < 50), k AS (SELECT doc_id, row_number() OVER (ORDER BY contains(lower(text), 'and')::INT + contains(lower(text), 'ther')::INT DESC, doc_id) - 1 AS rank FROM documents WHERE contains(lower(text), 'and') OR contains(lower(text), 'ther') QUALIFY rank < 50) SELECT doc_id AS id, round(sum(1.0 / (60 + rank)), 9)::DOUBLE AS rrf FROM (FROM t UNION ALL FROM k) GROUP BY doc_id")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two legs over the same rows: BM25, and how many words a text holds."""
    rows = table(spark, sf_dir, "documents")
    lexical = retrieval.ranked(retrieval.bm25(rows, "ther tion", "text", "doc_id"), [F.desc("score"), F.asc("id")], "text")
    words = rows.select(F.col("doc_id").alias("id"), memory.keyword_score("and ther", "text").alias("score")).where("score > 0")
    return retrieval.fuse([lexical, retrieval.ranked(words, [F.desc("score"), F.asc("id")], "words")]).select("id", F.round("rrf", 9).alias("rrf"))


@query("sql_vector_functions", "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 6) AS cosine, round(list_distance(embedding::DOUBLE[], v), 6) AS l2, round(list_inner_product(embedding::DOUBLE[], v), 6) AS inner_product FROM embeddings, q")
def sql_vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors.register(spark)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("oxbow_embeddings")
    return spark.sql("SELECT e.vec_id, round(cosine_distance(e.embedding, q.embedding), 6) AS cosine, round(l2_distance(e.embedding, q.embedding), 6) AS l2, round(inner_product(e.embedding, q.embedding), 6) AS inner_product FROM oxbow_embeddings e, (SELECT embedding FROM oxbow_embeddings WHERE vec_id = 0) q")


MEMORY_SQL = """m AS (SELECT doc_id::VARCHAR AS id, source AS title, text AS content, quality::DOUBLE AS importance FROM documents LEFT JOIN labels USING (doc_id)),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(title || ' ' || content), '[^0-9a-z]+'), lambda t: length(t) >= 2) AS words FROM m),
c AS (SELECT id, len(words) AS l, len(list_filter(words, lambda x: x = 'ther')) AS t0, len(list_filter(words, lambda x: x = 'tion')) AS t1 FROM w),
s AS (SELECT count(*) AS n, avg(l) AS a, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c),
b AS (SELECT id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / a)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * l / a)) AS score FROM c, s),
r AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id) - 1) AS rrf FROM b WHERE score > 0 ORDER BY score DESC, id LIMIT 50),
e AS (SELECT doc_id::VARCHAR AS src, next::VARCHAR AS dst FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next FROM documents) WHERE next IS NOT NULL),
g AS (SELECT DISTINCT dst AS id FROM (SELECT src, dst FROM (SELECT src, dst FROM e UNION SELECT dst, src FROM e) WHERE src IN (SELECT id FROM r ORDER BY rrf DESC, id LIMIT 10) ORDER BY src, dst LIMIT 200)),
f AS (SELECT id, rrf, CASE WHEN g.id IS NOT NULL THEN 1.0 END AS graph FROM r FULL JOIN g USING (id))"""


def document_memories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as memories (their label as importance), each linked to the next of its source."""
    documents = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    told = {"id": F.col("doc_id").cast("string"), "title": F.col("source"), "content": F.col("text"), "importance": F.col("quality").cast("double"), "version": F.lit(1)}
    fields = T.StructType.fromDDL(memory.NODE)
    nodes = documents.select(*[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    following = F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    edges = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("src"), following.cast("string").alias("dst")).where("dst is not null")
    return nodes, edges


@query("memory_retrieve", f"WITH {MEMORY_SQL} SELECT id, round(coalesce(rrf, 0) + 0.3 * (contains(lower(title || ' ' || content), 'ther')::INT + contains(lower(title || ' ' || content), 'tion')::INT) / 2 + 0.5 * coalesce(graph, 0) + 0.4 * coalesce(importance, 0) + 0.15, 9)::DOUBLE AS score FROM f JOIN m USING (id) ORDER BY 2 DESC, id LIMIT 20")
def memory_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = document_memories(spark, sf_dir)
    return recall.retrieve(nodes, edges, "ther tion", k=20, diverse=False).select("id", F.round("score", 9).alias("score"))


def source_leg(name: str, rows: str) -> str:
    return f"""SELECT '{name}' AS source, id::VARCHAR AS id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id::VARCHAR) - 1) AS rrf FROM (
WITH w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z]+'), lambda t: length(t) >= 2) AS words FROM ({rows})), c AS (SELECT id, len(words) AS l, len(list_filter(words, lambda x: x = 'tion')) AS t FROM w),
s AS (SELECT count(*) AS n, avg(l) AS a, count(*) FILTER (t > 0) AS d FROM c) SELECT id, ln(1 + (n - d + 0.5) / (d + 0.5)) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * l / a)) AS score FROM c, s WHERE t > 0) QUALIFY row_number() OVER (ORDER BY score DESC, id::VARCHAR) <= 50"""


@query("unified_search", f"SELECT source, id, round(rrf, 9) AS rrf FROM (({source_leg('benchmark', 'SELECT item_id AS id, text FROM benchmark')}) UNION ALL ({source_leg('documents', 'SELECT doc_id AS id, text FROM documents')})) ORDER BY rrf DESC, source, id LIMIT 30")
def unified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {"documents": (table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "benchmark": (table(spark, sf_dir, "benchmark"), "item_id")}
    return recall.unified_search(spark, "data", "tion", k=30, sources=sources).select("source", "id", F.round("rrf", 9).alias("rrf"))


@query("latest_version", "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts").select("user_id", "event_id", "ts", "event_type")


@query("memory_recall", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT doc_id, round(0.7 * list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) + 0.3 * quality, 9) AS score FROM embeddings JOIN documents ON doc_id = vec_id JOIN labels USING (doc_id), q WHERE lang = 'en'")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "documents").where("lang = 'en'").join(table(spark, sf_dir, "labels"), "doc_id").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    one = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()["embedding"]
    distance = cosine_distance(F.col("embedding"), F.array([F.lit(float(x)) for x in one]))
    return nodes.select("doc_id", F.round(retrieval.recall_score(distance, F.col("quality")), 9).alias("score"))


@query("tokens", "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^0-9a-z]+'), lambda t: length(t) >= 2))::INT AS n FROM documents")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n"))


@query("redaction", "SELECT doc_id, " + redaction_sql("text") + " AS text FROM documents")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact(F.col("text")).alias("text"))


@query("union_tables", "SELECT 'c' AS __database, c_acctbal AS balance, c_nationkey AS nation FROM customer UNION ALL SELECT 's', s_acctbal, s_nationkey FROM supplier")
def union_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name, p: table(spark, sf_dir, name).select(F.col(f"{p}_acctbal").alias("balance"), F.col(f"{p}_nationkey").alias("nation"))
    return records.union_tables({"c": t("customer", "c"), "s": t("supplier", "s")})


@query("json_lines", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    lines = events.select(F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("value"))
    return records.json_lines(lines, {"event_id": "long", "k": "long"})


@query("references_to", "SELECT 'customer' AS \"table\", 'c_mktsegment' AS \"column\" WHERE EXISTS (FROM customer WHERE c_mktsegment = 'BUILDING')")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.references_to({t: table(spark, sf_dir, t) for t in ("customer", "nation", "part", "orders")}, "BUILDING")


@query("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def sql_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("sql_semi_anti", "SELECT c_custkey, EXISTS (FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer")
def sql_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return customer.join(orders, "c_custkey", "left_semi").withColumn("buys", F.lit(True)).unionAll(customer.join(orders, "c_custkey", "left_anti").withColumn("buys", F.lit(False)))


@query("sql_set_all", "(SELECT l_quantity AS q FROM lineitem WHERE l_returnflag = 'A') EXCEPT ALL (SELECT l_quantity FROM lineitem WHERE l_returnflag = 'R')")
def sql_set_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.where("l_returnflag = 'A'").select(F.col("l_quantity").alias("q")).exceptAll(rows.where("l_returnflag = 'R'").select("l_quantity"))


@query("sql_page", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40")
def sql_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey").offset(40).limit(20)


@query("search_bar", "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE contains(lower(coalesce(event_type, '') || ' ' || coalesce(props, '')), 'k') AND value > 50 AND event_type <> 'click' AND user_id IS NOT NULL")
def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    condition, _ = search_bar.compiled(search_bar.parse("k value:>50 -event_type:click user_id:* nothing:1"), events.schema)
    return events.where(condition)


@query("ann_recall", "SELECT 10 AS found, true AS enough")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the rows that an index over all vectors returns, and whether they are nine tenths of the nearest."""
    rows = table(spark, sf_dir, "embeddings")
    cells = ivf.Cells.fit(rows, "vec_id", "embedding")
    one = rows.where("vec_id = 0").select("embedding").first()["embedding"]
    found = ivf.ann_topk(ivf.build_index(rows, cells, "vec_id", "embedding"), cells, one)
    best = retrieval.vector_topk(rows, one, "embedding", 10, "vec_id").select(F.col("vec_id").alias("id"), F.lit(True).alias("best"))
    return found.join(best, "id", "left").agg(F.count("*").cast("int").alias("found"), (F.count("best") >= 9).alias("enough"))


@query("keyword_score", "SELECT doc_id, (contains(lower(text), 'ther')::INT + contains(lower(text), 'tion')::INT) AS score FROM documents WHERE contains(lower(text), 'ther') OR contains(lower(text), 'tion')")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", memory.keyword_score("ther TION ther a", "text").alias("score")).where("score > 0")


@query("memory_blend", "SELECT doc_id, round(0.4 * coalesce(quality, 0) + 0.3 * exp(-ln(2) * (doc_id % 90) / 30.0) + 0.3 * contains(lower(text), 'tion')::INT, 9)::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)")
def memory_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    none = F.lit(None).cast("double")
    score = memory.blend(none, none, memory.keyword_score("tion", "text"), none, F.col("quality").cast("double"), (F.col("doc_id") % 90).cast("double"))
    return rows.select("doc_id", F.round(score, 9).alias("score"))


@query("memory_salience", "SELECT c_custkey, round(CASE WHEN c_nationkey = 0 THEN 1 ELSE exp(-ln(2) * c_nationkey / greatest(7.5, least(120, 30 * (1 + 0.3 * ln(1 + c_custkey % 50) - 0.3 * ln(1 + c_custkey % 31))))) END, 9)::DOUBLE AS salience FROM customer")
def memory_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(memory.salience(F.col("c_nationkey"), F.col("c_custkey") % 50, F.col("c_custkey") % 31), 9).alias("salience"))


@query(
    "chunks",
    "WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents), "
    "w(doc_id, i, c, n) AS (SELECT doc_id, 1::BIGINT, 0, length(line) FROM l WHERE i = 1 UNION ALL SELECT l.doc_id, l.i, CASE WHEN n + 1 + length(line) <= 1500 THEN c ELSE c + 1 END, CASE WHEN n + 1 + length(line) <= 1500 THEN n + 1 + length(line) ELSE length(line) END FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1), "
    "t AS (SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS chunk FROM w JOIN l USING (doc_id, i) GROUP BY doc_id, c) "
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1)::INT AS part, chunk FROM t WHERE length(trim(chunk, ' ')) > 0",
)
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(memory.chunks(F.col("text"))).alias("part", "chunk"))


@query("ranking_quality", "WITH j AS (SELECT user_id AS query, event_id AS id, value FROM events), r AS (SELECT query, id, value, row_number() OVER (PARTITION BY query ORDER BY id) AS rank FROM j) SELECT query, (count(*) FILTER (rank <= 10 AND value > 50) / count(*) FILTER (value > 50))::DOUBLE AS recall, coalesce(1.0 / min(rank) FILTER (rank <= 10 AND value > 50), 0)::DOUBLE AS mrr FROM r GROUP BY query")
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("id"), (F.col("value") > 50).cast("int").alias("grade"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id"))).where("rank <= 10")
    return evaluation.ranking_quality(ranked, rows).select("query", "recall", "mrr")


@query("percentiles", "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.percentiles(table(spark, sf_dir, "events"), "value")
