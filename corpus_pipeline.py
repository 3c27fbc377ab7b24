"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import Scratch, table


def _packed(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns, and the others as one, so that none of them clashes with an operator's own."""
    return docs.select(*named, F.struct(*(c for c in docs.columns if c not in named)).alias("others"))


def _unpacked(packed: DataFrame, docs: DataFrame, *named: str) -> DataFrame:
    """The columns of docs from a table that _packed() made."""
    return packed.select(*(F.col(c if c in named else f"others.{c}") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the ordinal model on the labelled documents; what it finds toxic goes."""
    from pathloom.llm.toxicity import score, train

    scored = score(_packed(docs, "doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return _unpacked(scored.where(~F.col("is_toxic")), docs, "doc_id", "text")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frees texts of their source's boilerplate lines; n_chars follows. No document goes."""
    from pathloom.llm.line_dedup import drop_lines

    clean = drop_lines(_packed(docs, "text", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return _unpacked(clean.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)), docs, "text", "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 in five-word shingles, that of smallest doc_id stays."""
    from pathloom.llm.near_dup import keep_one

    return keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, re-parameterised items included."""
    from pathloom.llm.decontaminate import drop_leaks

    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, with their number and the digests of the ids and of the decoded bytes."""
    import public_tokenizers

    from pathloom.llm.bpe import encode_table

    return encode_table(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the fitted model nor the merges; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
