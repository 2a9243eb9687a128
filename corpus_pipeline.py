"""A corpus, cleaned and packed: five stages over ``documents``, each written and read again by the next.

Every stage works on all that the one before kept. Null or empty texts carry no language and go in the second stage. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import langid, ngram_join, packing, suffix_dedup, toxicity
from llm.spark_io import lean, numbered, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language prediction below this is no prediction.
LEAST_SCORE = 0.5
#: Rows that Spark hands to a Python worker at once. Texts are long, and a batch lies in memory twice, on either side.
BATCH = 1000
#: SQL can't express learned models, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with batches of at most BATCH rows for the session from then on; a smaller number that is set already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = int(spark.conf.get(name, "10000"))
        if not 0 < held <= BATCH:
            spark.conf.set(name, str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the toxicity model, learned from the labels of the rows that aren't held out, doesn't mark."""
    learning = ~langid.is_held_out()
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(learning)
    model = toxicity.train(docs.where(learning).select("doc_id", "text"), labels)
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known: neither undetermined nor below LEAST_SCORE."""
    model = langid.train(docs.where(~langid.is_held_out()).select("text", "lang"))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return langid.identify(docs, model).where(known).select(*COLUMNS)


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the document of smallest id."""
    groups = ngram_join.ngram_components(docs.select("doc_id", "text"))
    others = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def _whole_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept bytes as text, without the rests of characters cut in two; a U+FFFD of the document's own stays."""
    for batch in batches:
        texts = [kept.decode("utf-8", "ignore") for kept in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])


@small_batches
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the passages that an earlier document holds. A character cut in two goes."""
    docs = numbered(docs, "row")
    cut = suffix_dedup.without_repeats(docs.select("doc_id", "text", "row"), "row").select("key", "kept")
    cut = cut.mapInArrow(lean(_whole_characters), "key long, text string").withColumnRenamed("key", "row")
    return docs.select("doc_id", "lang", "source", "row").join(cut, "row").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.packed_documents(docs.select("doc_id", "text"), f.read())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them tables in the folder that spark.checkpoint.dir names."""
    docs, out = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        done.write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
    return docs
