"""The corpus pipeline: five stages that are applied to the documents one after the other.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the
last return the columns of documents. Null and empty texts, null ids, repeated rows, further columns
and empty tables pass every stage; what each makes of them stands below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontamination, ngram_join, packing, pii, toxicity
from palimpsest.llm.common import save_shared, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op9 rejects go. Null and empty texts are scored as texts without words;
    repeated rows each get their score; null ids are never learned from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of op3 stays, the one with the least id; a null id is the least only where there
    is no other. Texts without words, null ones too, are linked to nothing and stay, repeated ones as well."""
    return ngram_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule of op4 calls contaminated go, each of repeated rows. Null and empty texts have no
    words and stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The spans of op7 are replaced in the texts; no document goes. Null and empty texts stay as they are."""
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces and sequences of op10. Null and empty texts are a piece of the end id alone, repeated rows are
    pieces of their own, an empty table has none."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: A trained network, tokenizers and a solver decide on rows, which SQL can't express; the stages
#: are tested against plain versions in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
