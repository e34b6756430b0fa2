"""Patterns, Cypher, communities, the search bar, the vector index, memories, storage: small fixtures and brute force."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from oxbow.operators import communities, evaluation, ivf, memory, stored_graph
from oxbow.operators.patterns import Graph
from oxbow.plans import search_bar
from oxbow.plans.cypher import CypherError, cypher, cypher_write
from oxbow.plans.kql import KqlError, kql
from oxbow.sources import storage


@pytest.fixture(scope="module")
def people(spark):
    nodes = spark.createDataFrame([("a", "P", 1.0), ("b", "P", 2.0), ("c", "P", None), ("x", "Q", 4.0)], "id string, label string, w double")
    edges = spark.createDataFrame([("a", "b", "K"), ("b", "c", "K"), ("c", "a", "K"), ("b", "x", "L"), ("a", "a", "K")], "src string, dst string, type string")
    return Graph(nodes, edges)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cypher_patterns(people):
    assert rows(cypher("MATCH (p)-[:K]->(q)-[:K]->(r), (r)-[:K]->(p) WHERE p.id <> q.id AND q.id <> r.id RETURN p.id, q.id, r.id", people)) == [("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")]
    assert rows(cypher("MATCH (p)-[:K]->(p) RETURN p", people)) == [("a", "P")]
    assert rows(cypher("MATCH (p {id: 'b'})-[e]-(q) RETURN q.id, e.type", people)) == [("a", "K"), ("c", "K"), ("x", "L")]
    assert rows(cypher("MATCH (p:P) OPTIONAL MATCH (p)-[:L]->(q) RETURN p.id, q.id", people)) == [("a", None), ("b", "x"), ("c", None)]
    assert rows(cypher("MATCH (p:P) WHERE p.w IS NULL RETURN count(*) AS n", people)) == [(1,)]
    assert cypher("MATCH (p:P) RETURN collect(p.w) AS l", people).first()["l"].count(None) == 1
    assert rows(cypher("MATCH (p)-[*2]->(q:Q) RETURN p.id, q.id", people)) == [("a", "x")]
    assert cypher("MATCH p = shortestPath((a {id: 'c'})-[*..5]->(b {id: 'x'})) RETURN length(p)", people).first()["depth"] == 3
    assert cypher("MATCH (p) RETURN p.id ORDER BY p.w DESC SKIP 1 LIMIT 1", people).collect() == [("x",)]
    for bad in ("MATCH (p) DELETE p", "OPTIONAL MATCH (p) RETURN p", "MATCH (p) RETURN *", "MATCH (p)<-[e]->(q) RETURN p", "MATCH (p)-[*]->(q)-[]->(r) RETURN p", "MATCH (p) RETURN q.id", "MATCH (p) RETURN p.w + 1", "MATCH p = shortestPath((a)-[*..5]->(b)) RETURN length(p)"):
        with pytest.raises(CypherError):
            cypher(bad, people)


def test_cypher_writes(people):
    nodes, edges = cypher_write("MERGE (p:P {id: 'a'})-[:K]->(q:P {id: 'new', w: 2.5})", people)
    assert rows(nodes) == [("new", "P", 2.5)] and rows(edges) == [("a", "new", "K")]
    nodes, edges = cypher_write("CREATE (p {id: 'a'})-[:L]->(q {id: 'b'})", people)
    assert rows(nodes) == [] and rows(edges) == [("a", "b", "L")]
    with pytest.raises(CypherError):
        cypher_write("CREATE (p:P {w: 1})", people)


def test_pipe_graph(people):
    tables = lambda t: {"e": people.edges, "n": people.nodes}[t]
    found = kql("e | make-graph src --> dst with n on id | graph-var-match (a)-[r:K]->(b) min-hops 2 max-hops 3 project a.id, b.id as to, r.depth", tables)
    assert rows(found) == [("a", "c", 2), ("b", "a", 2), ("c", "b", 2)]
    for bad in ("e | graph-match (a)-[]->(b) project a.id", "e | make-graph src --> dst with n on id | graph-var-match (a)-[r]->(b) project a.id"):
        with pytest.raises(KqlError):
            kql(bad, tables)


def test_communities_of_cliques(spark):
    cliques = [(10 * c + i, 10 * c + j) for c in range(4) for i in range(5) for j in range(i)]
    edges = spark.createDataFrame([*cliques, (0, 10), (10, 20), (20, 30), (None, 3)], "src int, dst int")
    found = {r["node"]: r["community"] for r in communities.detect_communities(edges, levels=2).collect()}
    assert found == {10 * c + i: 10 * c for c in range(4) for i in range(5)}
    assert communities.detect_communities(edges.limit(0)).collect() == []


def test_stored_graph(spark, people):
    assert rows(stored_graph.neighbors(people, "b", "forward").select("id")) == [("c",), ("x",)]
    assert rows(stored_graph.search_nodes(people, "q").select("id")) == [("x",)]
    dangling = Graph(people.nodes.unionAll(people.nodes), people.edges.unionAll(spark.createDataFrame([("a", "gone", "K")], people.edges.schema)))
    built = stored_graph.built(dangling)
    assert built.nodes.count() == 4 and built.edges.count() == 5
    one = spark.createDataFrame([(1,)], "user_id int")
    schema = stored_graph.schema_graph(spark, {"users": one, "orders": one, "g_nodes": one, "g_edges": one})
    assert rows(schema.edges) == [("orders", "users", "REFERENCES", "user_id")] and schema.nodes.count() == 2


def test_search_bar(spark):
    df = spark.createDataFrame([(1, "Auth failed", "a b", [0.5]), (2, "ok", None, None), (None, "auth", "x", None)], "n int, s string, t string, v array<float>")
    found = lambda text: search_bar.search(df, text)
    assert [r["n"] for r in found("auth")[0].collect()] == [1, None] and found("auth")[0].columns == ["n", "s", "t"]
    assert [r["n"] for r in found('"auth failed" n:<=1')[0].collect()] == [1]
    assert [r["n"] for r in found("-t:x")[0].collect()] == [1, 2]
    assert [r["n"] for r in found("t:* n:*")[0].collect()] == [1]
    assert [c.field for c in found("u:1 s:>3")[1]] == ["u", "s"]
    for bad in ('"open', "-", "-auth", 'a "open'):
        with pytest.raises(search_bar.SearchError):
            search_bar.parse(bad)
    broken = df.withColumn("s", F.raise_error(F.lit("gone")).cast("string"))
    frames = list(search_bar.fan_out({"good": df, "bad": broken}, "auth"))
    assert [f[0] for f in frames] == ["plan", "error", "rows", "source_done", "done"] or {f[:2] for f in frames} >= {("error", "bad"), ("source_done", "good"), ("done", None)}


def test_vector_index_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    data = (centres[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [1.0])], "id long, v array<float>").repartition(4)
    cells = ivf.Cells.fit(df.where("id < 9000"), "id", "v")
    index = ivf.build_index(df, cells, "id", "v").cache()
    assert index.count() == 4000
    unit = ivf.units(data.astype(np.float64))
    hits = 0
    for q in range(0, 4000, 400):
        best = set(np.argsort(1 - unit @ unit[q], kind="stable")[:10].tolist())
        hits += len(best & {r["id"] for r in ivf.ann_topk(index, cells, data[q].tolist()).collect()})
    assert hits >= 95
    assert [r["id"] for r in ivf.filtered_topk(index, cells, data[0].tolist(), "id % 7 = 0", 3).collect()] == sorted(range(0, 4000, 7), key=lambda i: 1 - unit[i] @ unit[0])[:3]
    bounds = ivf.part_bounds(index)
    least = {r["cell"]: r["b"] for r in bounds.withColumn("b", ivf.lower_bound(data[0].tolist())).collect()}
    for r in index.select("id", "cell").collect():
        assert 1 - unit[r["id"]] @ unit[0] >= least[r["cell"]] - 1e-6
    assert ivf.cells_for(10) == 16 and ivf.cells_for(10**9) == 256 and ivf.probes_for(16, 256) == 64


def memories(spark, *given):
    base = {"version": 1, "realm": "r", "kind": "fact", "importance": 0.5}
    names = [f.split()[0] for f in memory.NODE.split(", ")]
    return spark.createDataFrame([tuple((base | g).get(n) for n in names) for g in given], memory.NODE)


def test_memory_writes(spark):
    nodes = memories(spark, {"id": "a", "topic_key": "t", "vector": [1.0, 0.0]}, {"id": "b", "vector": [0.0, 1.0]}, {"id": "b", "version": 2, "vector": [0.0, 1.0], "content": "two"})
    new = memories(spark, {"id": "z", "topic_key": "t", "content": "see <private>pin</private> end <PRIVATE>rest"})
    assert [(r["id"], r["version"], r["content"]) for r in memory.saved(new, nodes).collect()] == [("a", 2, "see  end ")]
    moment = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz")
    verdicts = spark.createDataFrame([("a", "b", "supersedes"), ("b", "a", "merged"), ("a", "b", "related")], "src string, dst string, verdict string")
    versions, edges = memory.judged(nodes, verdicts, moment)
    assert rows(versions.select("id", "version", "status", F.col("invalid_at").isNotNull())) == [("b", 3, "archived", True)]
    assert rows(edges.select("src", "dst", "type")) == [("a", "b", "INVALIDATES"), ("a", "b", "RELATES_TO"), ("b", "a", "MERGED_INTO")]
    one = {"id": "n", "realm": "r", "kind": "fact", "content": "new", "vector": [0.1, 1.0]}
    versions, edges = memory.consolidated(nodes, one, lambda new, near: ("INVALIDATE", near[0]["id"]), moment)
    assert rows(versions.select("id", "version")) == [("b", 3), ("n", 1)] and rows(edges.select("src", "dst")) == [("n", "b")]
    assert rows(memory.consolidated(nodes, one, lambda new, near: ("UPDATE", "b"), moment)[0].select("id", "version", "content")) == [("b", 3, "new")]
    assert memory.consolidated(nodes, one, lambda new, near: ("NOOP", None), moment)[0].count() == 0
    assert rows(memory.consolidated(nodes, one, lambda new, near: 1 / 0, moment)[0].select("id")) == [("n",)]
    assert rows(memory.current(nodes).select("id", "version")) == [("a", 1), ("b", 2)]


def test_memory_reads(spark):
    nodes = memories(spark, {"id": "a", "space": "private:me", "tags": ["x", "y"]}, {"id": "b", "space": "public", "realm": "s"}, {"id": "c", "tags": ["x"], "importance": 0.9})
    assert rows(memory.visible(nodes, None).select("id")) == [("b",), ("c",)] and memory.visible(nodes, "me").count() == 3
    assert rows(memory.filtered(nodes, realms=["r"], importance=0.6, tags=("x",)).select("id")) == [("c",)]
    assert memory.query_words("Café, the THE a") == ["café", "the"]
    picked = memory.mmr([("a", 1.0, [1.0, 0.0]), ("b", 0.99, [1.0, 0.0]), ("c", 0.8, [0.0, 1.0])], 2)
    assert picked == ["a", "c"] and memory.mmr([("a", 1.0, None)], 2) == ["a"]
    found = spark.createDataFrame([("a", 1.0)], "id string, score double")
    edges = spark.createDataFrame([("a", "b"), ("c", "b")], "src string, dst string")
    assert rows(memory.expand(found, edges, 2)) == [("a", 0.5), ("b", 1.0), ("c", 0.5)]
    texts = spark.createDataFrame([("a\n" * 5 + "b" * 20,), (None,), ("",)], "t string").select(memory.chunks(F.col("t"), 6)).collect()
    assert texts[0][0] == ["a\na\na", "a\na", "b" * 20] and texts[1][0] is None and texts[2][0] == []
    blobs = spark.createDataFrame([(bytearray(b"text \xc3\xa9"),), (bytearray(b"a\x00b"),), (bytearray(b"\xff\xfe"),), (bytearray(b"x" * 8191 + "é".encode() * 9),)], "b binary")
    assert [r[0] for r in blobs.select(memory.is_text(F.col("b"))).collect()] == [True, False, False, True]


def test_ranking_quality(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, id string, rank int")
    judged = spark.createDataFrame([("q", "b", 3), ("q", "d", 1), ("p", "x", 0)], "query string, id string, grade int")
    found = {r["query"]: r for r in evaluation.ranking_quality(ranked, judged).collect()}
    assert found["q"]["recall"] == 0.5 and found["q"]["mrr"] == 0.5
    assert found["q"]["ndcg"] == pytest.approx((3 / np.log2(3)) / (3 + 1 / np.log2(3)))
    assert found["p"][1:] == (0.0, 0.0, 0.0)


def test_storage(spark, tmp_path):
    df = spark.sql("SELECT id, timestamp_ntz '2024-01-01' + make_dt_interval(cast(id AS int)) AS ts FROM range(10)").repartition(4)
    for _ in range(2):
        storage.written(df, str(tmp_path / "t"), "ts")
    storage.compacted(spark, str(tmp_path / "t"), str(tmp_path / "u"))
    both = spark.read.parquet(str(tmp_path / "u"))
    assert both.count() == 20 and both.where("day = '2024-01-03'").count() == 2
    kept = storage.retained(both, "ts", 2, F.lit(datetime.datetime(2024, 1, 10)).cast("timestamp"))
    assert rows(kept.select("id").distinct()) == [(7,), (8,), (9,)]
    statistics = storage.file_statistics(both, ["id"])
    assert statistics.agg(F.sum("rows")).first()[0] == 20 and storage.files_with(statistics, "id", 3, 3).count() >= 1
    target = spark.createDataFrame([], "id long, extra string").schema
    assert storage.promoted(df, target).columns == ["id", "extra"]
    with pytest.raises(ValueError):
        storage.promoted(df.withColumn("id", F.lit("x")), target)


def test_guard(spark):
    from oxbow.plans import guard
    from oxbow.plans.reader import QueryError

    page = guard.run_sql(spark, "SELECT id FROM range(10) ORDER BY id", 3)
    assert [r["id"] for r in page.rows] == [0, 1, 2] and page.truncated and page.columns == ["id"]
    assert not guard.run_sql(spark, "with t as (select 1 as x) select * from t").truncated
    for bad in ("DROP TABLE x", "", "insert into t values (1)"):
        with pytest.raises(QueryError):
            guard.checked(bad)


def test_tail_windows_tile(spark):
    from oxbow.streaming import tail

    day = lambda d: datetime.datetime(2024, 1, d)
    df = spark.sql("SELECT id, timestamp_ntz '2024-01-01' + make_dt_interval(cast(id AS int)) AS ts FROM range(6)")
    sources, cursor, seen = {"t": (df, "ts"), "untimed": (df, None)}, day(1), []
    for now in (day(3), day(3), day(4), day(9)):
        found, cursor = tail.tail_step(sources, cursor, now)
        seen += [r["id"] for d in found.values() for r in d.collect()]
    assert sorted(seen) == list(range(6)) and cursor == day(9)
