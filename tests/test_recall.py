"""Retrieval, search over sources, forward push, entities, and sources of other formats, on small tables."""

import datetime
import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from oxbow.functions import vectors
from oxbow.operators import communities, graph, memory, recall
from oxbow.operators.push import forward_push
from oxbow.plans import guard
from oxbow.plans.reader import QueryError
from oxbow.sources import records
from oxbow.streaming import ingest


def memories(spark, *rows):
    fields = [f.name for f in spark.createDataFrame([], memory.NODE).schema]
    return spark.createDataFrame([tuple({"version": 1, "realm": "default", "kind": "fact", "title": "", "content": "", **r}.get(f) for f in fields) for r in rows], memory.NODE)


def linked(spark, *pairs):
    return spark.createDataFrame([(a, b, "RELATES_TO", 1) for a, b in pairs], memory.EDGE)


def sequential_push(edges, seeds, alpha, epsilon):
    out = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
    p, r, queue = {}, {s: 1 / len(seeds) for s in seeds}, deque(seeds)
    while queue:
        u = queue.popleft()
        mass, near = r.get(u, 0.0), out.get(u, [])
        if not near:
            p[u], r[u] = p.get(u, 0) + mass, 0.0
        elif mass >= epsilon * len(near):
            p[u], r[u] = p.get(u, 0) + alpha * mass, 0.0
            for v in near:
                r[v] = r.get(v, 0) + (1 - alpha) * mass / len(near)
                queue.append(v)
    return p


def test_forward_push(spark):
    """As pushing one node at a time, up to the residuals that may stay; mass is kept."""
    r = random.Random(2)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(70)] + [(3, 3)]
    df = spark.createDataFrame(edges, "src int, dst int")
    seeds = spark.createDataFrame([(1,), (2,), (2,), (None,)], "n int")
    found = {x["node"]: x["score"] for x in forward_push(df, seeds, epsilon=1e-7).collect()}
    want = sequential_push(edges, [1, 2], 0.15, 1e-7)
    assert all(found.get(k, 0) == pytest.approx(want.get(k, 0), abs=1e-4) for k in {*found, *want})
    assert 0.99 < sum(found.values()) <= 1 + 1e-9
    alone = forward_push(df, spark.createDataFrame([(99,)], "n int")).collect()
    assert [tuple(x) for x in alone] == [(99, 1.0)]
    assert forward_push(df, seeds.limit(0)).count() == 0 and forward_push(df.limit(0), seeds).count() == 2


def test_pagerank_settles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    short = {r["node"]: r["score"] for r in graph.pagerank(df, "src", "dst", rounds=200, settled=1e-9).collect()}
    assert sum(short.values()) == pytest.approx(1.0) and short[3] == pytest.approx({r["node"]: r["score"] for r in graph.pagerank(df, "src", "dst", rounds=60, settled=0.0).collect()}[3], abs=1e-5)


def test_communities_of_two_cliques(spark):
    """Cliques joined by one edge come out whole, whatever the halves, and also without broadcasts."""
    edges = [(i, j) for k in (0, 10) for i in range(k, k + 6) for j in range(k, i)] + [(0, 10)]
    df = spark.createDataFrame(edges, "src int, dst int")
    want = {n: 0 if n < 10 else 10 for e in edges for n in e}
    assert {r["node"]: r["community"] for r in communities.detect_communities(df, levels=2).collect()} == want


def test_retrieve(spark):
    nodes = memories(
        spark, {"id": "a", "title": "rust build", "importance": 0.5}, {"id": "b", "content": "the rust compiler", "vector": [1.0, 0.0]}, {"id": "c", "content": "unrelated", "vector": [0.9, 0.1]},
        {"id": "d", "content": "rust", "space": "private:x"}, {"id": "e", "content": "linked only"}, {"id": "f", "content": "far away", "vector": [0.0, 1.0], "created_at": datetime.datetime(2024, 1, 1)},
    )
    edges = linked(spark, ("a", "e"), ("e", "f"))
    plain = [tuple(r) for r in recall.retrieve(nodes, edges, "rust", diverse=False).collect()]
    assert [i for i, _ in plain] == ["a", "e", "b"] and plain[1][1] == pytest.approx(0.5 + 0.15)  # a link counts more than a word
    with_vector = {r["id"]: r["score"] for r in recall.retrieve(nodes, edges, "rust", [1.0, 0.0], hops=2, walk=True, k=9).collect()}
    assert {*with_vector} == {"a", "b", "c", "e", "f"} and with_vector["c"] > 0.6
    assert [r["id"] for r in recall.retrieve(nodes, edges, "rust", k=1, rerank=lambda q, texts: [float("linked" in t) for t in texts], diverse=False).collect()] == ["e"]
    assert [r["id"] for r in recall.retrieve(nodes, edges, "rust", k=2, rerank=lambda q, texts: 1 / 0).collect()] == ["a", "e"]
    assert recall.retrieve(nodes, edges, "rust", agent="x", diverse=False).where("id = 'd'").count() == 1
    assert recall.retrieve(nodes.limit(0), edges.limit(0), "rust").count() == 0


def test_search_over_sources(spark):
    good = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "alpha alpha")], "n int, text string")
    bad = good.withColumn("text", F.raise_error(F.lit("down")))
    found, errors = recall.data_search(spark, {"good": (good, "n"), "bad": (bad, "n")}, "alpha")
    assert [tuple(r)[:2] for r in found.collect()] == [("good", "3"), ("good", "1")] and [*errors] == ["bad"]
    assert recall.unified_search(spark, "data", "alpha", sources={"good": (good, "n")}).count() == 2
    nodes = spark.createDataFrame([("x", "alpha"), ("y", "other"), ("z", "third")], "id string, name string")
    assert {r["id"]: r["score"] for r in recall.unified_search(spark, "graph", "alpha", nodes=nodes, edges=spark.createDataFrame([("x", "y")], "src string, dst string")).collect()} == {"x": 1.0, "y": 0.5}
    assert recall.row_text({"a": "é" * 1500, "b": 3}) == "é" * 1000


def test_entities(spark):
    nodes = memories(spark)
    new = spark.createDataFrame([("r", "service", " api ", "first"), (None, "repo", "x", "y"), ("r", "service", "", "no name")], "realm string, kind string, name string, content string")
    links = spark.createDataFrame([("r", "service", "api", "memory:1", "USES")], "realm string, kind string, name string, target string, type string")
    versions, edges = recall.entities_saved(new, nodes, links)
    rows = versions.collect()
    assert sorted((r["realm"], r["kind"], r["title"], r["version"]) for r in rows) == [("default", "repo", "x", 1), ("r", "service", "api", 1)]
    assert edges.first()["src"] in {r["id"] for r in rows} and edges.first()["dst"] == "memory:1"
    stored = spark.createDataFrame(rows, nodes.schema)
    assert recall.entities_saved(new, stored)[0].count() == 0
    again = recall.entities_saved(new.withColumn("content", F.lit("second")), stored)[0].collect()
    assert {r["version"] for r in again} == {2} and {r["id"] for r in again} == {r["id"] for r in rows}


def test_spans_and_logs(spark):
    at = str(int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp()) * 10**9)
    attributes = [{"key": "subject", "value": {"stringValue": "me"}}, {"key": "n", "value": {"intValue": "3"}}]
    resource = {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}
    trace = {"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "name": "op", "startTimeUnixNano": at, "endTimeUnixNano": at[:-3] + "250", "status": {"code": 2}, "attributes": attributes}, {"traceId": "t", "spanId": "u"}]}]}]}
    lines = spark.createDataFrame([(json.dumps(trace),), ("{}",), (None,)], "value string")
    first, second = records.otlp_traces(lines).orderBy("spanId").collect()
    assert (first["status"], first["duration_ns"], first["service_name"], first["subject"], first["tenant"], json.loads(first["attributes_json"])) == ("ERROR", 250, "svc", "me", None, {"n": "3"})
    assert (second["status"], second["attributes_json"]) == ("UNSET", "{}")
    log = {"resourceLogs": [{"resource": resource, "scopeLogs": [{"logRecords": [{"timeUnixNano": at, "severityNumber": 9, "severityText": "INFO", "body": {"stringValue": "hello"}}]}]}]}
    row = records.otlp_logs(spark.createDataFrame([(json.dumps(log),)], "value string")).first()
    assert (row["severity_number"], row["body"], row["service_name"]) == (9, "hello", "svc")


def test_scopes_and_graphs():
    names = ["a.x", "a.y", "b.x", "system.t"]
    assert records.in_scope(names) == ["a.x", "a.y", "b.x"]
    assert records.in_scope(names, ["*.x"]) == ["a.x", "b.x"] and records.in_scope(names, ["a.*", "b"]) == ["a.x", "a.y"] and records.in_scope(names, ["*.*"]) == names
    with pytest.raises(ValueError):
        records.in_scope([f"d.t{i}" for i in range(201)])
    assert records.chosen_graph({"db/g": 1}) == 1 and records.chosen_graph({"a/g": 1, "b/h": 2}, "h") == 2
    for graphs, name in (({}, None), ({"a/g": 1, "b/g": 2}, "g"), ({"a": 1, "b": 2}, None)):
        with pytest.raises(ValueError):
            records.chosen_graph(graphs, name)


def test_rows_of_any_graph(spark):
    df = spark.createDataFrame([(1, ["PullRequest", "X"], 5), (2, [], None)], "id int, labels array<string>, stars int")
    assert [tuple(r) for r in records.graph_rows(df, "github").orderBy("id").collect()] == [("1", "PullRequest", "github::pull_request", '{"stars":5}'), ("2", None, None, "{}")]


def test_guard_reads_the_plan(spark):
    spark.range(3).createOrReplaceTempView("three")
    for text in ("WITH x AS (SELECT 1) INSERT INTO three SELECT * FROM x", "EXPLAIN DROP TABLE three", "SELECT 1; DROP TABLE three"):
        with pytest.raises(Exception):
            guard.run_sql(spark, text)
    with pytest.raises(QueryError):
        guard.checked_plan(spark, "WITH x AS (SELECT 1) INSERT INTO three SELECT * FROM x")
    assert len(guard.run_sql(spark, "WITH x AS (SELECT id FROM three) SELECT * FROM x WHERE id IN (SELECT id FROM three)").rows) == 3
    assert guard.run_sql(spark, "EXPLAIN SELECT 1").rows and guard.run_sql(spark, "SHOW TABLES").rows is not None


def test_windows(spark):
    rows = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1, 0, m)) for m in (0, 1, 7, 30)], "k string, ts timestamp")
    assert sorted(r["count"] for r in ingest.windowed_counts(rows, "ts", "10 minutes", "1 hour", "k").collect()) == [1, 3]
    assert sorted(r["count"] for r in ingest.sliding_counts(rows, "ts", "10 minutes", "5 minutes", "1 hour", "k").collect()) == [1, 1, 1, 2, 3]
    assert sorted(r["count"] for r in ingest.session_counts(rows, "ts", "5 minutes", "1 hour", "k").collect()) == [1, 1, 2]


def test_vector_functions_in_sql(spark):
    vectors.register(spark)
    row = spark.sql("SELECT cosine_distance(array(1f, 0f), array(0f, 2f)) AS c, l2_distance(array(0D, 3D), array(4D, 0D)) AS l, inner_product(array(1D, 2D), array(3D, 4D)) AS i, cosine_distance(array(0D), array(1D)) AS z, l2_distance(array(1D), array(1D, 2D)) AS n").first()
    assert tuple(row) == (1.0, 5.0, 11.0, None, None)
