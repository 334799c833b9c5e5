"""A corpus from documents: quality, exact copies, near copies, test items, token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and calls one
operator of ``scriptorium.llm``. All but the last return the columns of ``documents``. ``run`` applies
them in order; between stages the rows are written to the shared folder and read again.

Stage by stage: documents that the quality classifier rejects go; of exact copies the row with the
largest identifier stays; of each group of near copies (five-word shingles with a similarity of 0.8 or
more, linked through others) the row with the smallest; documents that contain a
benchmark item go; the rest are encoded.

Rows with null identifiers have no group to lead in stages 2 and 3 where another row of the group has
one. Rows are told by identifier and text together, so rows that share an identifier, or have none, are
kept or dropped each by its own text; of rows with equal identifier and text one stays. Null texts count
as empty. Columns may have any names. Empty tables give empty results.

Texts are not shuffled from stage to stage: the first and last stage are maps, and the others send what
goes (groups of copies, keys) to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.byte_bpe import encode_documents
from scriptorium.llm.common import cut, table
from scriptorium.llm.decontaminate import decontaminate
from scriptorium.llm.exact_dedup import without_copies
from scriptorium.llm.near_copies import without_near_copies
from scriptorium.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest identifier."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest identifier.

    Links are those of SimHash fingerprints, checked, and then those that four bits miss.
    """
    return without_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of what they decode to."""
    return encode_documents(docs, ids=False)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("byte_bpe", encode)]

#: The first stage fits a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
