"""A training corpus from the table documents: stages, each an operator of millrace.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the
last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, lines, simhash, toxicity
from millrace.llm.common import load, table
from millrace.llm.queries import remainder, vocabulary


def drop_toxic(spark, docs, sf_dir):
    """Documents that the network calls toxic go; it learns from the labels of documents that are not held out."""
    labels = load(spark, sf_dir, "labels").where(remainder() != 2)
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_lines(spark, docs, sf_dir):
    """Lines that stand in an earlier document, or nearly so, go; n_chars follows the text."""
    columns = docs.columns
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group stays, the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def drop_leaks(spark, docs, sf_dir):
    """Documents that hold a test item of the table benchmark go."""
    return decontam.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """Token counts, and digests of the ids and of the decoded text."""
    return bpe.round_trip(docs, vocabulary(), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

#: A trained network and token digests cannot be stated in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
