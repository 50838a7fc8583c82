"""The corpus pipeline: documents go through five of the operators in workfeed.llm.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept;
all but the last return the columns of documents. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workfeed.llm import decontaminate, linededup, nearcopies, pieces, toxicity
from workfeed.llm.common import free_name, small_batches, small_broadcasts, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below 0.5; the model is trained as in op8_toxicity."""
    small_batches(spark)
    small_broadcasts(spark)
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).where("score < 0.5").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines (of six words or more) that an earlier one has, but for its copies and near copies; one that loses all its lines goes.

    Copies are the next stage's: cut down to the lines that differ, a near copy would not
    be known any more, and what is left of it would stay.
    """
    small_batches(spark)
    small_broadcasts(spark)
    total, removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    cut = linededup.dedup_lines(docs, n_lines=total, n_removed=removed, groups=nearcopies.near_groups(docs)).where((F.col(removed) < F.col(total)) | (F.col(removed) == 0))
    return cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by SimHash and a Jaccard similarity of five-word shingles of at least 0.8."""
    small_batches(spark)
    small_broadcasts(spark)
    return nearcopies.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window of 10 words."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether these decode to the text; columns called ids, n_tokens or round_trip are replaced."""
    small_batches(spark)
    back = free_name(docs, "decoded")
    coded = pieces.encode(docs, decoded=back)
    same = F.col(back) == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    own = [c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")]
    return coded.select(*own, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: The model, the hashes and the pieces are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
