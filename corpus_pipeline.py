"""The corpus pipeline: rated quality, toxicity, near duplicates, repeated passages, packing.

STAGES lists the stages. Each function takes (spark, docs, sf_dir) and returns a
DataFrame; run() applies them to documents, writing each result as Parquet in the
folder that all executors share and reading it again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conformix.llm import jobs, ngram_join, packing, quality, queries, substring_dedup, toxicity

#: A copy with up to 10 % of its words replaced, put in or left out is a near copy. Each
#: such edit costs a set of N word n-grams n of them at most and gives it n new ones at
#: most, so k edits leave a Jaccard index of (N - n k) / (N + n k) or more. By 3-grams this
#: is least for a text of 10 words with one replaced, 5/11; 0.45 lies just below it.
NEAR_WORDS, NEAR_JACCARD = 3, 0.45


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are poor by the quality classifier (op 1); all columns stay as they are.

    The classifier is fitted to the ratings of this stage's own documents. Where
    these have fewer than two grades, nothing can be learnt and all rows stay.
    """
    plain, (text,) = jobs.numbered(docs, "text")
    try:
        model = quality.fit(docs, quality.grades(queries.table(spark, sf_dir, "labels")))
    except jobs.NotEnoughLabels:
        return docs
    scored = quality.score(plain, model, text_col=text)
    return scored.where(F.col("tail") >= queries.KEEP_TAIL).select(*plain.columns).toDF(*docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the random field (op 2) finds toxic; all columns stay as they are.

    Unless both toxic and other documents are labelled, all rows stay.
    """
    plain, (text,) = jobs.numbered(docs, "text")
    try:
        model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    except jobs.NotEnoughLabels:
        return docs
    tagged = toxicity.tag(plain, model, text_col=text)
    return tagged.where(~F.col("is_toxic")).select(*plain.columns).toDF(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (op 4) only the document of the lowest id stays.

    Copies with up to 10 % of their words edited are near duplicates, wherever the
    edits are (see NEAR_JACCARD); in texts that repeat themselves, whose sets are
    smaller than their length says, a few may stay. Rows that repeat an id share one
    decision: they stay if one of them leads its group. Rows without id or text
    stay. All columns stay as they are.
    """
    plain, (own, _) = jobs.numbered(docs, "doc_id", "text")
    found = ngram_join.ngram_jaccard_join(docs, NEAR_JACCARD, NEAR_WORDS)
    drop = found.groupBy("doc_id").agg(F.max("group_id").alias("group_id")).where("group_id < doc_id").select(F.col("doc_id").alias("drop"))
    return plain.join(drop, plain[own].cast("long") == drop["drop"], "left_anti").toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that an earlier document has (op 8).

    Only `text` changes, and with it `n_chars` where there is such a column.
    """
    plain, (own, text) = jobs.numbered(docs, "doc_id", "text")
    chars = jobs.numbered(docs, "n_chars")[1][0] if "n_chars" in docs.columns else ""
    out = substring_dedup.substring_dedup(plain, id_col=own, text_col=text, chars_col=chars, removed_col="removed")
    return out.select(*plain.columns).toDF(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into windows (op 9)."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("packing", pack_windows),
]

#: The classifiers are fitted and packing is dynamic programming, so SQL can't express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents table. Tables of earlier stages are deleted."""
    docs = queries.table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        last, docs = docs, jobs.stored(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if n:
            jobs.discard(last)
    return docs
