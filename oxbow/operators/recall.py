"""Memory retrieval in one call, search over many sources, reranking, and entities.

Legs rank at most LEG rows each; ranks are fused, the graph around the best adds candidates, signals are
blended, and at most POOL rows reach the reranker and the choice of diverse ones on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oxbow.operators import memory, retrieval
from oxbow.operators.push import forward_push

#: Rows of a leg, candidates reranked, bytes of a row's text, the walk of the proximity.
LEG, POOL, ROW_BYTES = 50, 50, 2000
ALPHA, EPSILON = 0.15, 1e-5
Scorer = Callable[[str, list[str]], list[float]]


def text_leg(rows: DataFrame, query: str, text: Column, id_col: str = "id") -> DataFrame:
    """(id, leg, rank) of the LEG best rows by BM25."""
    found = retrieval.bm25(rows.select(F.col(id_col).alias("id"), text.alias("body")), query, "body", "id")
    return retrieval.ranked(found, [F.desc("score"), F.asc("id")], "text", LEG)


def vector_leg(rows: DataFrame, vector: list[float], vector_col: str = "vector", id_col: str = "id") -> DataFrame:
    near = retrieval.vector_topk(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), vector, "v", LEG, "id")
    return retrieval.ranked(near, [F.asc("distance"), F.asc("id")], "vector", LEG)


def proximity(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, near): personalised PageRank around the seeds (one column), undirected, the largest being 1."""
    scores = forward_push(edges, seeds, alpha=ALPHA, epsilon=EPSILON, direction="both")
    most = scores.agg(F.max("score").alias("most"))  # one row
    return scores.crossJoin(F.broadcast(most)).select(F.col("node").alias("id"), (F.col("score") / F.col("most")).alias("near"))


def retrieve(
    nodes: DataFrame, edges: DataFrame, query: str, vector: list[float] | None = None, k: int = 10, hops: int = 1, walk: bool = False, agent: str | None = None, moment: Column | None = None,
    now: Column | None = None, rerank: Scorer | None = None, diverse: bool = True, **filters: object,
) -> DataFrame:
    """(id, score) of k memories, best first: legs, fusion, expansion of 1 or 2 hops, optionally the walk, blend, rerank, diversity.

    `nodes` and `edges` are versioned memories (see memory.py); `filters` are those of memory.filtered. Without a vector
    only the text leg is there; ties go to the smaller id; an unknown age counts one half.
    """
    rows = memory.filtered(memory.visible(memory.current(nodes, moment), agent), **filters)
    body = F.concat_ws(" ", "title", "content")
    legs = [text_leg(rows, query, body)] + ([vector_leg(rows, vector)] if vector else [])
    fused = retrieval.fuse(legs)
    seeds = fused.select("id", F.col("rrf").alias("score"))
    around = memory.expand(seeds, edges, min(2, max(1, hops)))
    if walk:
        best = seeds.orderBy(F.desc("score"), "id").limit(memory.SEEDS).select("id")
        around = around.unionByName(proximity(edges, best).withColumnRenamed("near", "graph")).groupBy("id").agg(F.max("graph").alias("graph"))
    found = fused.join(around, "id", "full_outer").join(rows, "id")
    words = max(1, len(memory.query_words(query)))
    far = retrieval.cosine_distance(F.col("vector"), F.array([F.lit(float(x)) for x in vector])) if vector else F.lit(None).cast("double")
    age = F.datediff(F.coalesce(now, F.current_date()) if now is not None else F.current_date(), F.col("created_at")).cast("double")
    score = memory.blend(F.col("rrf"), 1 - far, memory.keyword_score(query, "title", "content") / words, F.col("graph"), F.col("importance"), age)
    pool = found.withColumn("score", score).orderBy(F.desc("score"), "id").limit(POOL if rerank or diverse else k)
    if not rerank and not diverse:
        return pool.select("id", "score")
    kept = [(r["id"], float(r["score"]), list(r["vector"]) if r["vector"] else None, r["body"]) for r in pool.select("id", "score", "vector", body.alias("body")).collect()]  # POOL rows
    if rerank:
        kept = reranked(query, kept, rerank, lambda x: x[3])
    best = {i: s for i, s, _, _ in kept}
    chosen = memory.mmr([x[:3] for x in kept], k) if diverse else [x[0] for x in kept[:k]]
    kind = nodes.schema["id"].dataType.simpleString()
    return nodes.sparkSession.createDataFrame([(i, best[i]) for i in chosen], f"id {kind}, score double")


def row_text(columns: dict[str, object]) -> str:
    """What a reranker reads of a row: its strings in the order of its columns, ROW_BYTES bytes at most."""
    joined = " ".join(v for v in columns.values() if isinstance(v, str))
    return joined.encode()[:ROW_BYTES].decode("utf-8", "ignore")


def reranked(query: str, rows: list, scorer: Scorer, text: Callable[[object], str]) -> list:
    """At most POOL rows by a scorer's order; rows beyond and, where the scorer fails, all stay as they are."""
    head = rows[:POOL]
    try:
        scores = scorer(query, [text(r) for r in head])
        order = sorted(range(len(head)), key=lambda i: (-scores[i], i))
    except Exception:  # the scorer is a caller's; without one the order stays
        return rows
    return [head[i] for i in order] + rows[POOL:]


def data_search(spark: SparkSession, sources: dict[str, tuple[DataFrame, str]], query: str, k: int = 10) -> tuple[DataFrame, dict[str, str]]:
    """((source, id, rrf) of the k best rows of all sources, errors by source): each source is ranked by itself, then ranks are merged.

    `sources`: frame and id column by name; the text of a row is its string columns. A failing source is left out and named.
    """
    rows, errors = [], {}
    for name, (df, id_col) in sorted(sources.items()):
        try:
            texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != id_col]
            leg = retrieval.fuse([text_leg(df.withColumn("search_key", F.col(id_col).cast("string")), query, F.concat_ws(" ", *texts), "search_key")])
            rows += [(name, r["id"], r["rrf"]) for r in leg.collect()]  # LEG rows
        except Exception as error:  # isolated: named in the result
            errors[name] = str(error)
    best = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:k]
    return spark.createDataFrame(best, "source string, id string, rrf double"), errors


def unified_search(spark: SparkSession, mode: str, query: str, k: int = 10, **over: object) -> DataFrame:
    """One door to three searches: data (sources=), memory (nodes=, edges=, ..) and graph (nodes=, edges=, hops=)."""
    if mode == "data":
        return data_search(spark, over["sources"], query, k)[0]
    if mode == "memory":
        return retrieve(over.pop("nodes"), over.pop("edges"), query, k=k, **over)
    if mode == "graph":
        nodes, edges = over["nodes"], over["edges"]
        text = [f.name for f in nodes.schema if isinstance(f.dataType, T.StringType)]
        hits = nodes.withColumn("score", memory.keyword_score(query, *text).cast("double")).where("score > 0").select("id", "score")
        near = memory.expand(hits, edges, over.get("hops", 1)).select("id", (0.5 * F.col("graph")).alias("score"))
        return hits.unionByName(near).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)
    raise ValueError("mode is data, memory or graph")


def entities_saved(new: DataFrame, nodes: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(versions, edges) to append for entities (realm, kind, name, content): the same (realm, kind, name) is the same node, updated in place.

    `links` (realm, kind, name, target, type) wires them to other nodes. Names are trimmed; rows without a name are left out;
    of rows that repeat a key the last content by order counts.
    """
    key = F.sha2(F.concat_ws("\u001f", "realm", "kind", "name"), 256)
    named = lambda df: df.withColumns({"realm": F.coalesce("realm", F.lit("default")), "name": F.trim("name")}).where("name <> ''")
    one = named(new).groupBy("realm", "kind", "name").agg(F.max("content").alias("content")).withColumn("id", F.concat(F.lit("entity:"), F.substring(key, 1, 32)))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema if f.name not in ("id", "realm", "kind", "title", "content")]
    rows = one.select("id", "realm", "kind", F.col("name").alias("title"), "content", *blank).select(*nodes.columns)
    old = retrieval.latest(nodes, "id", "version")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("title", "content")]
    fresh = rows.alias("n").join(old.alias("o"), [F.col("o.id") == F.col("n.id"), *same], "left_anti")
    ends = nodes.sparkSession.createDataFrame([], memory.EDGE)
    if links is not None:
        ends = named(links).select(F.concat(F.lit("entity:"), F.substring(key, 1, 32)).alias("src"), F.col("target").alias("dst"), "type", F.lit(1).cast("bigint").alias("version")).distinct()
    return memory.saved(fresh, nodes), ends
