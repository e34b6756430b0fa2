"""Memories: versioned rows with edges. Every change appends a newer version; readers take the latest.

A node has id, version, realm, kind, title, content, tags, topic_key, importance, status, space,
created_at, valid_at, invalid_at, vector; an edge has src, dst, type, version. Functions return the rows to append.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oxbow.functions.text import without_private
from oxbow.operators.retrieval import latest, recency, valid_at, vector_topk

NODE = (
    "id string, version bigint, realm string, kind string, title string, content string, tags array<string>, topic_key string, importance double, "
    "status string, space string, created_at timestamp_ntz, valid_at timestamp_ntz, invalid_at timestamp_ntz, vector array<float>"
)
EDGE = "src string, dst string, type string, version bigint"
#: Weights of the blend, of usage, the candidates of a leg, the seeds and edges of an expansion, the bound of a precedent, the size of a chunk.
WEIGHTS = {"rrf": 1.0, "semantic": 0.6, "keyword": 0.3, "graph": 0.5, "importance": 0.4, "recency": 0.3}
HIT, MISS, HALF_LIFE = 0.3, 0.3, 30.0
SEEDS, EDGES_A_HOP, NEIGHBOURS = 10, 200, 5
NEAR_PRECEDENT = 0.15
CHUNK = 1500


# reading
def current(nodes: DataFrame, moment: Column | None = None, archived: bool = False) -> DataFrame:
    """The latest version of each memory that holds now, or held at `moment`."""
    rows = valid_at(latest(nodes, "id", "version"), moment)
    return rows if archived else rows.where("status is null or status <> 'archived'")


def visible(rows: DataFrame, agent: str | None) -> DataFrame:
    """Rows of no space, the public one, or the agent's own."""
    own = F.col("space") == f"private:{agent}" if agent else F.lit(False)
    return rows.where(F.col("space").isNull() | (F.col("space") == "public") | own)


def filtered(rows: DataFrame, realms: list[str] | None = None, kind: str | None = None, importance: float | None = None, since: Column | None = None, until: Column | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    for given, condition in (
        (realms, lambda: F.col("realm").isin(realms)), (kind, lambda: F.col("kind") == kind), (importance, lambda: F.col("importance") >= importance),
        (since, lambda: F.col("created_at") >= since), (until, lambda: F.col("created_at") <= until),
    ):
        if given is not None:
            rows = rows.where(condition())
    for tag in tags:
        rows = rows.where(F.array_contains("tags", tag))
    return rows


def query_words(query: str) -> list[str]:
    """Runs of letters and digits of any script, lower-cased, two characters or more, each once."""
    found = "".join(c.lower() if c.isalnum() else " " for c in query).split()
    return [w for w in dict.fromkeys(found) if len(w) >= 2]


def keyword_score(query: str, *columns: str) -> Column:
    """How many of the query's words the columns hold."""
    text = F.lower(F.concat_ws(" ", *columns))
    score = F.lit(0)
    for word in query_words(query):
        score = score + F.contains(text, F.lit(word)).cast("int")
    return score


def blend(rrf: Column, semantic: Column, keyword: Column, graph: Column, importance: Column, age_days: Column) -> Column:
    """The weighted sum of the signals; an absent signal counts nothing, an unknown age one half."""
    parts = {"rrf": rrf, "semantic": semantic, "keyword": keyword, "graph": graph, "importance": importance}
    score = WEIGHTS["recency"] * F.when(age_days.isNull(), 0.5).otherwise(recency(F.greatest(age_days, F.lit(0.0)), HALF_LIFE))
    for name, column in parts.items():
        score = score + WEIGHTS[name] * F.coalesce(column, F.lit(0.0))
    return score


def salience(age_days: Column, reinforced: Column, missed: Column, half_life: float = HALF_LIFE) -> Column:
    """Decay since the last use; use lengthens the half-life and misses shorten it, within a quarter and four times."""
    stretch = 1 + HIT * F.log1p(reinforced) - MISS * F.log1p(missed)
    life = F.greatest(F.lit(half_life / 4), F.least(F.lit(half_life * 4), half_life * stretch))
    return F.when(age_days <= 0, 1.0).otherwise(F.exp(-F.log(F.lit(2.0)) * age_days / life))


def expand(found: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(id, graph): nodes linked within `hops` to the SEEDS best rows of `found` (id, score), nearer ones higher.

    A search feature, so bounded: SEEDS starts and the first EDGES_A_HOP edges of each hop by name.
    """
    frontier = found.orderBy(F.desc("score"), "id").limit(SEEDS).select("id")
    out = None
    for k in range(1, hops + 1):
        ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).unionAll(edges.select("dst", "src"))
        step = ends.join(frontier, "id", "left_semi").distinct().orderBy("id", "to").limit(EDGES_A_HOP)
        frontier = step.select(F.col("to").alias("id")).distinct()
        one = frontier.withColumn("graph", F.lit(1.0 / k))
        out = one if out is None else out.unionAll(one)
    return out.groupBy("id").agg(F.max("graph").alias("graph"))


def mmr(candidates: list[tuple[object, float, list[float] | None]], k: int, trade: float = 0.7) -> list:
    """Ids of k diverse candidates (id, relevance, vector), chosen one by one; a bounded list after the rerank.

    No vector means similarity 0; k candidates or fewer stay as they are.
    """
    if len(candidates) <= k:
        return [c[0] for c in candidates]
    size = max((len(v) for _, _, v in candidates if v), default=1)
    rows = np.array([v if v else [0.0] * size for _, _, v in candidates], dtype=np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / np.where(norms > 0, norms, 1.0)
    relevance, near = np.array([c[1] for c in candidates]), np.zeros(len(candidates))
    left, chosen = np.ones(len(candidates), dtype=bool), []
    for _ in range(k):
        score = np.where(left, trade * relevance - (1 - trade) * near, -np.inf)
        best = int(np.argmax(score))
        left[best] = False
        likeness = rows @ rows[best]
        near = likeness if not chosen else np.maximum(near, likeness)
        chosen.append(candidates[best][0])
    return chosen


def precedent(activities: DataFrame, edges: DataFrame, vector: list[float]) -> DataFrame:
    """The memories derived from the nearest past activity, if it is near enough."""
    one = vector_topk(activities, vector, "vector", 1, "id").where(F.col("distance") <= NEAR_PRECEDENT).select(F.col("id").alias("dst"), "distance")
    return edges.where("type = 'DERIVED_FROM'").join(one, "dst").select(F.col("src").alias("id"), "distance")


def sources(nodes: DataFrame, provenance: str = "provenance") -> DataFrame:
    """(source, realm, n) of memories, most first."""
    source = F.coalesce(F.nullif(F.get_json_object(provenance, "$.source"), F.lit("")), F.lit("manual"))
    return nodes.groupBy(source.alias("source"), F.coalesce("realm", F.lit("default")).alias("realm")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "realm")


# writing
def saved(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """The versions to append for `new` rows: private parts go, a known (realm, topic_key) keeps its id, versions go up."""
    clean = new.withColumns({c: without_private(F.col(c)) for c in ("title", "content")}).withColumn("realm", F.coalesce("realm", F.lit("default")))
    old = latest(nodes, "id", "version")
    topics = old.where("topic_key is not null").groupBy("realm", "topic_key").agg(F.max_by("id", F.struct("version", "id")).alias("known"))
    named = clean.join(topics, ["realm", "topic_key"], "left").withColumn("id", F.coalesce("known", "id"))
    versions = old.select("id", F.col("version").alias("before"))
    return named.drop("version").join(versions, "id", "left").withColumn("version", F.coalesce("before", F.lit(0)) + 1).select(*nodes.columns)


def changed(nodes: DataFrame, ids: DataFrame, **values: Column) -> DataFrame:
    """Newer versions of the memories `ids` (one column), with some columns set."""
    rows = latest(nodes, "id", "version").join(ids.toDF("id").distinct(), "id", "left_semi")
    return rows.withColumns(values).withColumn("version", F.col("version") + 1).select(*nodes.columns)


def linked(pairs: DataFrame, kind: str) -> DataFrame:
    """Edges of one type for (src, dst) pairs."""
    a, b = pairs.columns[:2]
    return pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type"), F.lit(1).cast("bigint").alias("version")).distinct()


def judged(nodes: DataFrame, verdicts: DataFrame, moment: Column) -> tuple[DataFrame, DataFrame]:
    """(versions, edges) for verdicts (src, dst, verdict).

    supersedes ends dst and INVALIDATES it; merged archives src, MERGED_INTO dst; conflicts, related and compatible RELATE.
    """
    of = lambda *names: verdicts.where(F.col("verdict").isin(*names)).select("src", "dst")
    ended = of("supersedes").select(F.col("dst").alias("id"), F.lit(True).alias("ends"), F.lit(False).alias("goes"))
    archived = of("merged").select(F.col("src").alias("id"), F.lit(False).alias("ends"), F.lit(True).alias("goes"))
    # several verdicts on one memory make one version
    told = ended.unionAll(archived).groupBy("id").agg(F.max("ends").alias("ends"), F.max("goes").alias("goes"))
    rows = latest(nodes, "id", "version").join(told, "id").withColumns({"invalid_at": F.when(F.col("ends"), moment).otherwise(F.col("invalid_at")), "status": F.when(F.col("goes"), "archived").otherwise(F.col("status"))})
    versions = rows.withColumn("version", F.col("version") + 1).select(*nodes.columns)
    edges = linked(of("supersedes"), "INVALIDATES").unionAll(linked(of("merged"), "MERGED_INTO")).unionAll(linked(of("conflicts", "related", "compatible"), "RELATES_TO"))
    return versions, edges


def consolidated(nodes: DataFrame, new: dict, decide: Callable[[dict, list[dict]], tuple[str, str | None]], moment: Column) -> tuple[DataFrame, DataFrame]:
    """(versions, edges) for one new memory, by a decision over its nearest of the same realm and kind.

    `decide` returns (ADD | UPDATE | NOOP | INVALIDATE, target id); an error or an unknown target means ADD.
    """
    spark = nodes.sparkSession
    pool = current(nodes).where((F.col("realm") == new["realm"]) & (F.col("kind") == new["kind"]))
    near = [r.asDict() for r in vector_topk(pool, new["vector"], "vector", NEIGHBOURS, "id").collect()]  # NEIGHBOURS rows
    try:
        action, target = decide(new, near)
    except Exception:  # the decision is a caller's; without one the memory is added
        action, target = "ADD", None
    if target not in {r["id"] for r in near} and action != "NOOP":
        action, target = "ADD", None
    none = spark.createDataFrame([], EDGE)
    if action == "NOOP":
        return nodes.limit(0), none
    row = spark.createDataFrame([tuple(new.get(f) for f in nodes.columns)], nodes.schema)
    if action == "UPDATE":
        return saved(row.withColumns({"id": F.lit(target), "topic_key": F.lit(None).cast("string")}), nodes), none
    added = saved(row, nodes)
    if action == "INVALIDATE":
        pair = spark.createDataFrame([(new["id"], target)], "src string, dst string")
        return added.unionAll(changed(nodes, pair.select("dst"), invalid_at=moment)), linked(pair, "INVALIDATES")
    return added, none


# texts
def chunks(text: Column, size: int = CHUNK) -> Column:
    """Line-aligned chunks of about `size` characters; a longer line stays whole. All lines are kept."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(state: Column, line: Column) -> Column:
        fits = state["open"].isNotNull() & (F.length(state["open"]) + 1 + F.length(line) <= size)
        done = F.when(state["open"].isNull() | fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat(state["open"], F.lit("\n"), line)).otherwise(line).alias("open"))

    return F.filter(F.aggregate(F.split(text, "\n"), start, add, lambda s: F.concat(s["done"], F.array(s["open"]))), lambda c: F.length(F.trim(c)) > 0)


def is_text(content: Column) -> Column:
    """Whether bytes look like text: no NUL in the first 8 KiB, and valid UTF-8 there but for a character cut at the end."""
    head = F.substring(content, 1, 8192)
    whole = lambda cut: F.expr("true") if cut is None else F.is_valid_utf8(cut)
    cuts = [F.substring(content, 1, 8192 - k) for k in range(4)]
    valid = F.when(F.octet_length(content) <= 8192, whole(head)).otherwise(whole(cuts[0]) | whole(cuts[1]) | whole(cuts[2]) | whole(cuts[3]))
    return (F.instr(F.hex(head), "00") == 0) & valid
