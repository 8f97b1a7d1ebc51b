"""The tables of a store: those of keys as parts (see store), logs as folders that only grow, postings beside them."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import store
from .operators import ledger
from .schemas import SCHEMAS, conform, empty

#: Parents first, so that a reader between two writes finds no child without its parent; and what a table is dealt by.
KEYS = {
    "board": [],
    "post": ["board_id", "bizbox_art_no"],
    "attachment": ["post_id"],
    "attachment_page": ["attachment_id"],
    "regulation": ["source_post_id"],
    "clause": ["regulation_id"],
    "authority_matrix": ["regulation_id"],
    "chunk": ["source_post_id"],
    "glossary_synonym": [],
    "ingest_state": [],
    "eval_query": [],
    "eval_gold": [],
}
#: Ids that a table gives out: the store keeps the largest.
IDS = {"post": ["post_id"], "attachment": ["attachment_id"], "attachment_page": ["page_id"], "regulation": ["regulation_id"], "clause": ["clause_id"], "authority_matrix": ["authority_id"]}
LOGS = ("query_log", "acl_audit")
#: Postings of the chunks, sorted by gram inside each part: a search reads the row groups of its own grams.
POSTINGS = StructType([StructField("gram", StringType()), StructField("chunk_id", LongType()), StructField("tf", LongType()), StructField("source_post_id", LongType())])
#: Their dictionary, sorted by part: tokens that no text has any more do no harm.
TOKENS = StructType([StructField("part", StringType()), StructField("gram", StringType())])
#: Split words of chunks whose board asks for them, sorted by word; and the words themselves, with their uses.
WORDS = StructType([StructField("word", StringType()), StructField("chunk_id", LongType()), StructField("source_post_id", LongType())])
VOCABULARY = StructType([StructField("word", StringType()), StructField("uses", LongType())])


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables; those never written are empty."""
    out = {}
    for t in KEYS:
        found = store.read(spark, f"{root}/{t}", SCHEMAS[t])
        out[t] = empty(spark, t) if found is None else found
    for t in LOGS:
        out[t] = spark.read.schema(SCHEMAS[t]).parquet(f"{root}/{t}") if store.exists(spark, f"{root}/{t}") else empty(spark, t)
    return out


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Write the next version of each given table whole, parents first, and read them back."""
    out = {}
    for t in KEYS:
        if t in tables:
            store.write(spark, f"{root}/{t}", conform(tables[t], t), KEYS[t], track=IDS.get(t, ()))
            out[t] = store.read(spark, f"{root}/{t}", SCHEMAS[t])
    return out


def update(spark: SparkSession, root: str, table: str, rows: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Change the parts of a table that rows fall in, and read the table back."""
    store.update(spark, f"{root}/{table}", rows, KEYS[table], lambda old: conform(change(old), table), SCHEMAS[table], track=IDS.get(table, ()))
    found = store.read(spark, f"{root}/{table}", SCHEMAS[table])
    return empty(spark, table) if found is None else found


def failed(spark: SparkSession, root: str) -> DataFrame:
    """The ledger of posts that failed."""
    found = store.read(spark, f"{root}/failed", StructType.fromDDL(ledger.SCHEMA))
    return spark.createDataFrame([], ledger.SCHEMA) if found is None else found


def highest(spark: SparkSession, root: str, table: str) -> int:
    """The largest id that a table has given out, from its manifest."""
    m = store.manifest(spark, f"{root}/{table}")
    return (m.most.get(IDS[table][0]) or 0) if m else 0


def postings(spark: SparkSession, root: str) -> DataFrame | None:
    return store.read(spark, f"{root}/postings", POSTINGS)


def tokens(spark: SparkSession, root: str) -> DataFrame | None:
    return store.read(spark, f"{root}/tokens", TOKENS)


def words(spark: SparkSession, root: str) -> DataFrame | None:
    return store.read(spark, f"{root}/words", WORDS)


def vocabulary(spark: SparkSession, root: str) -> DataFrame | None:
    return store.read(spark, f"{root}/vocabulary", VOCABULARY)


def append(spark: SparkSession, root: str, table: str, rows: DataFrame) -> bool:
    """Add to a log. A failure to write never fails the request; it is logged, and False."""
    try:
        conform(rows, table).coalesce(1).write.mode("append").parquet(f"{root}/{table}")
        return True
    except Exception as e:
        logging.getLogger(__name__).warning("%s not written: %s", table, e)
        return False
