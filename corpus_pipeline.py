"""A corpus from raw documents to packed sequences: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and handles nulls in any column, empty and very long texts, repeated rows and ids,
empty tables, and columns of any name: its operator sees the id, the text and numbered other columns, so that no name can
clash, and the columns come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import decontaminate, jaccard, lines, packing, quality
from verdigris.llm.common import load, narrow_batches, release, staged


def _with_plain_names(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`change` on docs with other columns than doc_id and text numbered; the columns of docs of its result."""
    names = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    return change(docs.toDF(*names)).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model takes for toxic or poor go.

    Null and wordless texts go (their probability is 0); rows of one text share their fate; without any rating all stay."""
    narrow_batches(spark)
    model = quality.train(docs, load(spark, sf_dir, "labels"), quality.grade(), 3)
    return _with_plain_names(docs, lambda d: quality.score(d, model).where("not rejected"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which no word is left goes with them; n_chars, if there, is counted again.

    Null and empty texts and rows without an id stay as they are; repeated rows lose the same lines and stay both."""
    narrow_batches(spark)
    kept = _with_plain_names(docs, lambda d: lines.deduplicated(d).where(r"lines_dropped = 0 or text rlike '[\\p{L}\\p{N}]'"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that with the smallest id, then text hash; of rows equal in both, one.

    Rows without words are in no group and stay; rows of one id and other texts are judged apart; null ids come last."""
    narrow_batches(spark)
    return _with_plain_names(docs, jaccard.representatives)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Null and wordless texts stay; repeated rows share their fate; an empty benchmark leaves all."""
    narrow_batches(spark)
    return _with_plain_names(docs, lambda d: decontaminate.contamination(d, load(spark, sf_dir, "benchmark")).where("size(hit_items) = 0"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets.

    A null or empty text is its end token alone; repeated rows are packed each; other columns are left out."""
    narrow_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the classifier, SimHash or the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
