"""Documents to packed training windows: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and is written as Parquet in the shared
folder and read again before the next one. All but the last return the columns of documents, further columns of docs as
they are, whatever their names. An empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgate.llm import mixing, packing, pii, quality, simhash
from loomgate.llm.common import materialize, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts. Labels come from the labels table, texts of labelled rows from docs.

    Null and empty texts are judged as an empty text, very long ones whole. Repeated rows stay or go together.
    """
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "text")
    return quality.classify(whole, model).filter("predicted = 1").select("__row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, null last; of rows that repeat doc_id and text one.

    Null, empty and blank texts have no words: they are one group. Shorter texts than a shingle are one shingle.
    """
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets, n_chars counted anew. Null texts stay null, repeated rows change alike."""
    return pii.redact(docs, pii.fit(spark))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's rate. Null sources are one source; repeated rows get equal numbers of copies; texts without words have no say in the rates."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full windows. A null text is empty: one separator. Each repeated row is packed."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", simhash_stage), ("personal_data", pii_stage), ("mixing", mix_stage), ("packing", packing_stage)]
#: A compression classifier has no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
