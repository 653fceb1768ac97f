"""Training-corpus pipeline: language ID, near duplicates, decontamination, secrets, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. ``run`` applies them one after another, each reading what its predecessor wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrieval_jobs.llm import decontamination, jaccard_join, language_id, mixing, secrets
from retrieval_jobs.llm.common import settled, table, unused
from retrieval_jobs.shipping import ship


#: Spark's setting for the bytes of rows that a Python worker gets at a time, and the pipeline's value: 10,000 texts are tens of MB,
#: which stand beside each other in the executor and in each of its workers.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def prepared(spark: SparkSession) -> None:
    """The package is sent to the workers, and they get small batches from now on (stages are run after they return), unless the session sets that itself."""
    ship(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` in a table with a number for each row, as doc_id may be null or repeated; and that column's name."""
    name = unused(docs, "row_number")
    return settled(docs.withColumn(name, F.monotonically_increasing_id())), name


def own_columns(rows: DataFrame, docs: DataFrame) -> list:
    return [rows[f"`{c}`"] for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: null texts, texts without a letter and rejected ones go.

    Every row is judged by its own text, so that null and repeated doc_ids and repeated rows stay; extra columns of any name stay;
    an empty table gives no rows."""
    prepared(spark)
    names = tuple(unused(docs, c) for c in ("language_found", "language_score", "language_rejected"))
    found = language_id.identify(docs, language_id.train(docs), docs.columns, names)
    return found.where(~F.col(names[2])).select(*own_columns(found, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of smallest doc_id (null after all others; ties: the first row).

    Every row is a document of its own: rows that share a doc_id go only if their texts are near, and rows with a null doc_id are judged
    like others. Null and blank texts have no duplicates and stay. Extra columns of any name stay; an empty table gives no rows."""
    prepared(spark)
    rows, number = numbered(docs)
    found = jaccard_join.join_documents(rows.select(F.col(number).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias(number), F.col("component_id").alias("component"))
    ids = rows.select(number, F.col("doc_id").alias("id")).join(found, number)
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", number)).alias("first"))
    kept = rows.join(first.select(f"first.{number}"), number, "left_semi")
    return kept.select(*own_columns(kept, docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows that share a doc_id go together; rows with a null doc_id, null and empty texts stay; extra columns of any name stay; an
    empty table on either side drops nothing."""
    prepared(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets in their texts replaced by a mark. Other columns stay, but n_chars follows the text."""
    return secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows chosen for the target mixture with their domain, n_tokens and copies (how often each is read).

    Every row counts and is chosen for itself, also with a null or repeated doc_id; where ``docs`` has a column of such a name, the
    new one gets an underscore; rows without words are never chosen; an empty table gives no rows."""
    rows, number = numbered(docs)
    chosen = mixing.mix_sources(rows.select("doc_id", "text", "lang", "source", number), keep=(number,))
    added = [F.col(c).alias(unused(docs, c)) for c in ("domain", "n_tokens", "copies")]
    out = rows.join(chosen.select(number, F.struct(*added).alias(unused(rows, "mixed"))), number)
    return out.select(*own_columns(out, docs), f"{unused(rows, 'mixed')}.*")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("mixing", mix_to_weights),
]

#: The learned stages can't be written in SQL; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
