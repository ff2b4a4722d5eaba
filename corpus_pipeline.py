"""From raw documents to token ids: the stages of a training corpus, each on all that the one before it kept.

Defined cases: a null or empty text has the classifier's score of its bias, one empty line, no shingles (so that it is no
near duplicate), no words and no ids; a null doc_id is kept as it is; of equal rows of one doc_id all stay or go together;
equal texts of other doc_ids are near duplicates, of which the least doc_id stays; an empty table gives an empty result;
columns beside doc_id and text are handed on whatever their names, n_chars as the length of the text that is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import byte_bpe, decontamination, jaccard, line_dedup, quality
from lociflow.llm.common import use_checkpoint_dir, without

#: Near duplicates: five-word shingles, a similarity of 0.8.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model, tuple(docs.columns)).where(F.col("score") >= 0.5).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents stay at their first place only; documents without any other line go."""
    rows = line_dedup.dedup_lines(docs, keep_first=True).where((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept"))
    rows = rows.withColumn("_text", text)
    changed = {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text"), F.lit(0)).cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the least doc_id stays."""
    groups = jaccard.jaccard_components(docs, SHINGLE_WORDS, SIMILARITY_PERCENT, links=False)
    return without(docs, groups.where(F.col("doc_id") != F.col("component_id")), "doc_id").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: A learned classifier can't be put in SQL; tests compare the stages with plain versions of them.
ORACLE_SQL = None


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as Parquet in a new folder below the checkpoint folder, read again from there; and the folder."""
    use_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder), folder


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents, each written as Parquet and read again by the next.

    A stage's folder goes once the next one is written; the last of them stays, as the result is read from it.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, folder = written(stage(spark, docs, sf_dir))
        if last:
            removed(spark, last)
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)
