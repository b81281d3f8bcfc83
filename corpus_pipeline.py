"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs, and works on all
that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm import decontam, mixing, neardup, tokens, toxicity
from mizan.llm.common import Scratch, read


def apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with the columns that no stage reads named by number, so that none clashes with a stage's own, and what to
    select to have them back."""
    own = [c if c.lower() in ("doc_id", "text", "lang", "source") else f"own{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*own), [F.col(x).alias(c) for x, c in zip(own, docs.columns, strict=True)]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels of these documents, does not reject. Null and empty
    texts are scored like any other; every column comes back as it was, whatever its name."""
    labels = read(spark, sf_dir, "labels").filter(~toxicity.in_fold("doc_id", 4, 2)).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(spark, docs, labels)
    name = "score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return model.score(docs, *docs.columns, name=name).filter(F.col(name) < toxicity.REJECT).drop(name)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates (five words, Jaccard 0.8). Documents without
    words, and without a doc_id, are groups of their own; rows that share their doc_id stay together."""
    gone = neardup.near_duplicates(spark, docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found (five words, containment 0.8)."""
    docs, back = apart(docs)
    found = decontam.with_leaks(spark, docs, read(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that an 80 % token budget takes, by target weights; one epoch at most, so none is repeated."""
    docs, back = apart(docs)
    return mixing.mix(docs, mixing.source_domain(), max_epochs=1).filter("copies > 0").select(*back)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and the digest of each document read back from them."""
    return tokens.output(spark, docs)


STAGES = [
    ("toxicity", clean),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_output", tokenize),
]

#: SQL expresses neither the trees nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    docs = read(spark, sf_dir, "documents")
    tmp = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tmp.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
