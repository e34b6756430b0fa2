"""Record sources: JSON lines with evolving schemas, event times, metrics text, logs, unions of tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The names of column types.
TYPES = {"bool": "boolean", "int": "int", "long": "bigint", "real": "double", "string": "string", "timestamp": "timestamp_ntz", "dynamic": "string"}
MOST_NEW_COLUMNS = 32
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def spark_type(name: str) -> str:
    if re.fullmatch(r"vector\([1-9]\d*\)", name):
        return "array<float>"
    return TYPES[name]


def json_lines(lines: DataFrame, schema: dict[str, str], column: str = "value") -> DataFrame:
    """Columns of `schema` (name -> type name) from JSON text; unknown fields are dropped, wrong vector lengths are null."""
    fields = ", ".join(f"`{n}` {spark_type(t)}" for n, t in schema.items())
    parsed = lines.select(F.from_json(column, fields).alias("r")).select("r.*")
    for n, t in schema.items():
        if size := re.fullmatch(r"vector\((\d+)\)", t):
            parsed = parsed.withColumn(n, F.when(F.size(n) == int(size[1]), F.col(n)))
    return parsed


def evolved(schema: dict[str, str], lines: DataFrame, column: str = "value") -> dict[str, str]:
    """`schema` with the unknown top-level keys of JSON text as string columns, at most MOST_NEW_COLUMNS, by name."""
    known = {n.lower() for n in schema}
    keys = lines.select(F.explode(F.json_object_keys(column)).alias("k")).distinct().where(~F.lower("k").isin(list(known)) & F.col("k").rlike(f"^{NAME.pattern}$"))
    new = [r["k"] for r in keys.orderBy("k").limit(MOST_NEW_COLUMNS).collect()]
    return schema | {k: "string" for k in new}


def event_time(number: Column) -> Column:
    """A timestamp of a number of seconds, or by magnitude of milli-, micro- or nanoseconds."""
    micros = F.when(number >= 1e16, number / 1000).when(number >= 1e14, number).when(number >= 1e11, number * 1000).otherwise(number * 1_000_000)
    return F.timestamp_micros(micros.cast("long"))


def open_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, labels, value) of metric lines; comments are skipped, NaN and infinities null."""
    line = r'^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)'
    rows = lines.where(~F.col(column).startswith("#") & F.col(column).rlike(line))
    number = F.expr("try_cast(raw AS double)")
    pairs = F.map_from_arrays(F.regexp_extract_all("l", F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'), F.lit(1)), F.regexp_extract_all("l", F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'), F.lit(2)))
    parts = rows.select(*[F.regexp_extract(column, line, k).alias(n) for k, n in ((1, "name"), (2, "l"), (3, "raw"))])
    return parts.select("name", pairs.alias("labels"), F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number).alias("value"))


def union_tables(tables: dict[str, DataFrame], label: str = "__database") -> DataFrame:
    """All rows by column name, with the table's name; equal types stay, numbers meet as double, all else as string."""
    if any(label in df.columns for df in tables.values()):
        raise ValueError(f"{label} is a column already")
    kinds: dict[str, set] = {}
    for df in tables.values():
        for f in df.schema:
            kinds.setdefault(f.name, set()).add(f.dataType)
    common = {}
    for n, found in kinds.items():
        common[n] = next(iter(found)) if len(found) == 1 else T.DoubleType() if all(isinstance(k, T.NumericType) for k in found) else T.StringType()
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias(label), *[F.col(c).cast(common[c]).alias(c) for c in df.columns])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def otlp_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of exported OTLP log JSON: one per log record."""
    attribute = "array<struct<key: string, value: struct<stringValue: string, intValue: string>>>"
    schema = f"resourceLogs array<struct<resource: struct<attributes: {attribute}>, scopeLogs: array<struct<logRecords: array<struct<timeUnixNano: string, severityNumber: int, severityText: string, body: struct<stringValue: string>, traceId: string, spanId: string, attributes: {attribute}>>>>>>"
    one = lines.select(F.explode(F.from_json(column, schema)["resourceLogs"]).alias("r"))
    records = one.select("r.resource", F.explode(F.flatten(F.transform("r.scopeLogs", lambda s: s["logRecords"]))).alias("l"))
    service = F.filter("resource.attributes", lambda a: a["key"] == "service.name")[0]["value"]["stringValue"]
    return records.select(
        event_time(F.col("l.timeUnixNano").cast("double")).alias("timestamp"), F.col("l.severityNumber").alias("severity_number"), F.col("l.severityText").alias("severity_text"), F.col("l.body.stringValue").alias("body"),
        service.alias("service_name"), F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"), F.to_json("l.attributes").alias("attributes_json"),
    )


#: Labels of a span's status code.
STATUS = {1: "OK", 2: "ERROR"}


def otlp_traces(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of exported OTLP trace JSON: one per span; the attributes `subject` and `tenant` are columns, the rest JSON."""
    attribute = "array<struct<key: string, value: struct<stringValue: string, intValue: string, boolValue: boolean, doubleValue: double>>>"
    span = f"struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: int, message: string>, attributes: {attribute}>"
    schema = f"resourceSpans array<struct<resource: struct<attributes: {attribute}>, scopeSpans: array<struct<spans: array<{span}>>>>>"
    one = lines.select(F.explode(F.from_json(column, schema)["resourceSpans"]).alias("r"))
    spans = one.select("r.resource", F.explode(F.flatten(F.transform("r.scopeSpans", lambda s: s["spans"]))).alias("s"))
    plain = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))
    named = lambda of, name: F.get(F.transform(F.filter(of, lambda a: a["key"] == name), lambda a: plain(a["value"])), F.lit(0))
    rest = F.map_from_entries(F.transform(F.filter("s.attributes", lambda a: ~a["key"].isin("subject", "tenant")), lambda a: F.struct(a["key"], plain(a["value"]))))
    status = F.lit("UNSET")
    for code, label in STATUS.items():
        status = F.when(F.col("s.status.code") == code, label).otherwise(status)
    start, end = F.col("s.startTimeUnixNano").cast("decimal(20,0)"), F.col("s.endTimeUnixNano").cast("decimal(20,0)")
    return spans.select(
        event_time(start.cast("double")).alias("timestamp"), "s.traceId", "s.spanId", "s.parentSpanId", "s.name", "s.kind", status.alias("status"), (end - start).cast("long").alias("duration_ns"),
        named(F.col("resource.attributes"), "service.name").alias("service_name"), named(F.col("s.attributes"), "subject").alias("subject"), named(F.col("s.attributes"), "tenant").alias("tenant"),
        F.coalesce(F.to_json(rest), F.lit("{}")).alias("attributes_json"),
    )


def in_scope(names: list[str], patterns: list[str] | None = None, hidden: tuple[str, ...] = ("system", "information_schema"), most: int = 200) -> list[str]:
    """The `db.table` names that a pattern takes: `*` stands for one whole part; no patterns mean all but hidden databases.

    More than `most` names are an error, as a search over them would be.
    """
    fits = lambda pattern, name: all(p in ("*", part) for p, part in zip(pattern.split(".", 1), name.split(".", 1), strict=False)) and "." in pattern
    if patterns is None:
        found = [n for n in names if n.split(".", 1)[0] not in hidden]
    else:
        found = [n for n in names if any(fits(p, n) for p in patterns)]
    if len(found) > most:
        raise ValueError(f"the scope holds {len(found)} tables, more than {most}")
    return found


def graph_rows(df: DataFrame, vendor: str, labels: str = "labels", id_col: str = "id") -> DataFrame:
    """Nodes of any graph source as (id, label, type, props): the first label, `vendor::snake_case` of it, other columns as JSON."""
    label = F.get(F.col(labels), F.lit(0)) if isinstance(df.schema[labels].dataType, T.ArrayType) else F.col(labels)
    snake = F.lower(F.regexp_replace(F.regexp_replace(label, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"))
    others = [c for c in df.columns if c not in (labels, id_col)]
    return df.select(F.col(id_col).cast("string").alias("id"), label.alias("label"), F.concat(F.lit(f"{vendor}::"), snake).alias("type"), F.to_json(F.struct(*others)).alias("props") if others else F.lit("{}").alias("props"))


def chosen_graph(graphs: dict[str, object], name: str | None = None) -> object:
    """The graph called `name` (`db/graph`, or its last part where that is unique); the only one there is without a name."""
    found = [k for k in graphs if name is None or k == name or k.rsplit("/", 1)[-1] == name]
    if len(found) != 1:
        raise ValueError(f"{len(found)} graphs fit; there are: {', '.join(sorted(graphs))}")
    return graphs[found[0]]


def references_to(tables: dict[str, DataFrame], value: str, most: int = 200) -> DataFrame:
    """(table, column) of every string column that holds `value`; a report of `most` rows at most."""
    out = None
    for name, df in sorted(tables.items()):
        for f in df.schema:
            if isinstance(f.dataType, T.StringType):
                one = df.where(F.col(f.name) == value).select(F.lit(name).alias("table"), F.lit(f.name).alias("column")).limit(1)
                out = one if out is None else out.unionAll(one)
    return out.orderBy("table", "column").limit(most)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A live remote table; Spark pushes filters, columns and limits into it."""
    return spark.read.format("jdbc").options(url=url, dbtable=query, **options).load()
