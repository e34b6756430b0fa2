"""A corpus pipeline: quality, language, near duplicates, repeated strings, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; all but
the last return the columns of documents. The models are fitted on each stage's own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.llm import language, ngrams, packing, quality, repeats
from oxbow.session import collect_garbage, remove_folder, shared_folder, table

#: A document stays if its language is at least so certain.
CERTAIN = 0.4


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns as `document`, so that none clashes with what an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold."""
    model = quality.train_on(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(whole_rows(docs), model, keep=["document"]).where("predicted = 1").select("document.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: not without letters, and not below CERTAIN. If none can be learned nothing is known, so all stay."""
    model = language.train_on(docs)
    if not model.labels:
        return docs
    found = language.identify_documents(whole_rows(docs), model, keep=["document"])
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= CERTAIN)).select("document.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component. Rows without an id stay.

    Of rows that repeat an id the one of the greatest text stays, as that is the one compared (a null text is the least, ties by the other columns).
    """
    kept = ngrams.near_documents(docs).where("component_id = doc_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi")
    repeated = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    best = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", *others)).alias("row")).select("doc_id", "row.*")
    single = named.join(repeated, "doc_id", "left_anti")
    return single.select(*docs.columns).unionAll(best.select(*docs.columns)).unionAll(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat 100-byte strings of earlier ones."""
    cut = repeats.remove_repeats(whole_rows(docs), with_text=True, keep=["document"])
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return cut.select(*[new.get(c, F.col("document").getField(c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2048 ids, one row per piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near duplicates", without_near_duplicates),
    ("repeated strings", without_repeats),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet to the shared folder and read again.

    A stage's table goes once the next one is written; the last one stays, as the result is read from it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
        collect_garbage(spark)
    return docs
