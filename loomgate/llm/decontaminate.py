"""Benchmark decontamination by winnowing: document spans that share a window of words with a benchmark item.

A window is WINDOW consecutive words of an item; an item of fewer words, but not none, is one window of its length.
Words are hashed in grams of GRAM; of every window of WINDOW words the smallest gram hash is kept (winnowing), so equal
windows keep equal fingerprints, and a shared span of WINDOW words can't be missed. Windows of shorter items are their
own fingerprint. Then

1. items give (fingerprint, digest of the window's words, item); their fingerprints also a bit map of FILTER_BITS;
2. documents are read once: runs of windows whose fingerprint is in the bit map leave with the digests of their words.
   The map only spares the shuffle what can't match: it is of one size, and a full one lets every window pass;
3. the fingerprints of both sides are joined, what matches is extended to its windows, and those are joined by digest
   (128 bits of the very words), one row a distinct window on the items' side: hits are never pairs of texts;
4. hit windows merge to spans. Items that share a window are a set with one id, documents with the same sets are one
   combination, so lists of items are made once a combination and not once a document.

Words are runs of what is no ASCII character but a letter or digit, A-Z lower-cased. Null and empty texts have no words:
no hits. Very long texts are read whole. Each repeated row of documents has a row of its own; items that repeat count
once by their item_id; an item without one marks words but is in no list. Ties (equal texts under two ids) list both ids.
Empty documents give no rows, an empty benchmark no hits. Further columns of either table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .common import discard, materialize, read, scored
from .tokens import Remembered

WINDOW, GRAM = 10, 5
#: Bits of the map of the items' fingerprints: 4 MB, whatever the tables' sizes.
FILTER_BITS = 1 << 25
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Byte by byte: what is no word becomes a blank, A-Z their lower case.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_WORDS).split()


def word_hashes() -> Remembered:
    from xxhash import xxh64_intdigest

    return Remembered(xxh64_intdigest, most=200_000)


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of size word hashes; none for fewer words."""
    n = max(0, len(x) - size + 1)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * _STEP + x[k : k + n]
    return (h ^ (h >> np.uint64(29))) * _MIX


def fingerprints(x: np.ndarray, length: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The fingerprint of each run of length words: its smallest gram hash, or, if shorter than a window, its own hash."""
    if length < window:
        return gram_hashes(x, length)
    h = gram_hashes(x, min(gram, window))
    n = max(0, len(x) - window + 1)
    least = h[:n].copy()
    for k in range(1, window - min(gram, window) + 1):
        np.minimum(least, h[k : k + n], out=least)
    return least


class Text:
    """Words of a text, joined, with the places where they start and end."""

    def __init__(self, text: str | None, of_word: Remembered):
        words = words_of(text)
        self.n = len(words)
        self.hashes = np.fromiter(map(of_word.__getitem__, words), np.uint64, self.n)
        self.joined = b" ".join(words)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, self.n) + 1) - 1
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64)

    def digests(self, starts: np.ndarray, length: int) -> list[bytes]:
        """128 bits of the words of windows."""
        from xxhash import xxh3_128_digest

        return [xxh3_128_digest(self.joined[i:j]) for i, j in zip(self.starts[starts].tolist(), self.ends[starts + length - 1].tolist())]


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """items: item_id, text. item_id, length, fp, digest of every window."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word = word_hashes()
        for batch in batches:
            for k in range(batch.num_rows):
                t = Text(batch.column(1)[k].as_py(), of_word)
                length = min(t.n, window)
                fp = fingerprints(t.hashes, length, window, gram) if length else np.zeros(0, np.uint64)
                for at in range(0, len(fp), 1 << 16):
                    part = fp[at : at + (1 << 16)]
                    ids = pa.array([batch.column(0)[k].as_py()] * len(part), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(part), length, np.int32)), pa.array(part.view(np.int64)), pa.array(t.digests(np.arange(at, at + len(part)), length), pa.binary())], ["item_id", "length", "fp", "digest"])

    rows = items.select("item_id", "text").filter("text is not null").distinct()
    return rows.mapInArrow(run, f"item_id {kind}, length int, fp long, digest binary")


def bit_map(fps: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """fps: fp. A bit for each value of the lowest bits of fp; blocks of bits are made by the executors."""
    place = F.col("fp").bitwiseAND(F.lit(bits - 1)) + 1
    made = fps.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in made.collect():  # bits / 32,768 rows at most
        m = np.frombuffer(bytes(r.m), np.uint8)
        at = (r.b - 1) * len(m)
        out[at : at + len(m)] = m[: len(out) - at]
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. One row per row of docs.

    doc_id, n_words, n_hit (words inside any occurrence of a window), spans (of hit words: first, and one after the
    last), item_ids (those with occurring windows, as sorted strings), contaminated.
    """
    spark = ship(docs.sparkSession)
    windows = materialize(item_windows(items, window, gram))
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # window numbers at most
    seen = spark.sparkContext.broadcast(bit_map(windows.select("fp"), bits))

    def make():
        of_word = word_hashes()

        def runs(text):
            t, out = Text(text, of_word), []
            for length in lengths:
                fp = fingerprints(t.hashes, length, window, gram)
                place = (fp & np.uint64(bits - 1)).astype(np.int64)
                may = np.flatnonzero(seen.value[place >> 3] >> (place & 7) & 1)
                if len(may):
                    new = np.flatnonzero((np.diff(may, prepend=-2) != 1) | (fp[may] != fp[may - 1]))
                    for i, j in zip(new.tolist(), [*new[1:].tolist(), len(may)]):
                        out.append({"fp": int(fp[may[i]].view(np.int64)), "length": length, "start": int(may[i]), "digests": t.digests(may[i:j], length)})
            return t.n, out

        def run(texts):
            found = [runs(t) for t in texts]
            return {"n_words": np.array([n for n, _ in found], np.int64), "runs": pa.array([r for _, r in found], pa.list_(pa.struct([("fp", pa.int64()), ("length", pa.int32()), ("start", pa.int32()), ("digests", pa.list_(pa.binary()))])))}

        return run

    one = scored(make, "n_words long, runs array<struct<fp: bigint, length: int, start: int, digests: array<binary>>>", F.col("text"))
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("at"), one.alias("s"))
    texts = materialize(texts.select("doc_id", "at", "s.n_words", "s.runs"))
    # windows with the same items: what they share is one set
    sets = windows.groupBy("digest").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    sets = materialize(sets.withColumn("set", F.xxhash64("ids")).withColumn("set", F.concat(F.hex("set"), F.md5(F.array_join("ids", ",")))))
    runs = texts.select("at", F.explode("runs").alias("r")).select("at", "r.*")
    matched = runs.join(windows.select("fp").distinct(), "fp", "left_semi")
    spread = matched.select("at", "length", "start", F.posexplode("digests").alias("i", "digest"))
    hits = spread.join(sets.select("digest", "set"), "digest").select("at", (F.col("start") + F.col("i")).alias("first"), (F.col("start") + F.col("i") + F.col("length")).alias("last"), "set")
    hits = materialize(hits)
    # spans: a window that starts beyond all that end before it begins a new one
    order = Window.partitionBy("at").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("new", F.coalesce(F.col("first") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("at", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set("set").alias("sets"))
    spans = islands.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"), F.sum(F.col("last") - F.col("first")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets"))
    spans = materialize(spans.withColumn("mix", F.md5(F.array_join("sets", ","))))
    mixes = spans.select("mix", "sets").distinct().select("mix", F.explode("sets").alias("set"))
    lists = mixes.join(sets.select("set", "ids").distinct(), "set").select("mix", F.explode("ids").alias("id"))
    lists = materialize(lists.groupBy("mix").agg(F.array_sort(F.collect_set("id")).alias("item_ids")))
    marked = spans.join(lists, "mix", "left").select("at", "n_hit", "spans", "item_ids")
    out = texts.select("doc_id", "at", "n_words").join(marked, "at", "left")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    discard(windows, sets, hits)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), none("spans").alias("spans"), none("item_ids").alias("item_ids"), (n_hit > 0).alias("contaminated"))


def op13_decontamination_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


_LOWERED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH i AS (SELECT item_id, {_LOWERED} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWERED} AS w FROM documents),
places AS (
  SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows))
), hits AS (SELECT r, p, places.k, item_id FROM places JOIN windows USING (k, s)),
words AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r),
lists AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(lists.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN lists USING (r)
"""
