"""SimHash near-duplicates through deletion variants.

A fingerprint has a bit for every bit that is set in over half of the XXH64 (seed 42) hashes of its word shingles.
Links join fingerprints at BITS or fewer differing bits. With BITS = 2 a fingerprint is cut into two segments: one of
them differs by one bit at most, so two linked fingerprints agree on a variant of that segment with one bit deleted.
Distinct fingerprints are indexed under their 2 * 32 variants, equal keys are joined, and the join itself verifies the
distance and keeps a pair under its first key only. Exact copies are one fingerprint and never become pairs.

Distinct fingerprints that share a variant are few (31 of 64 bits agree) unless they are near copies, of which the
radius allows any fingerprint 2,080 at most; there is no cap on buckets. Chance meetings are one in 2^31 for each of the
64 keys, so candidates outnumber the index only from some 10^9 distinct fingerprints on.

The pipeline's stage asks for a Jaccard similarity of STAGE_SIMILARITY of the distinct 5-word shingles. Fingerprints that
deletion variants link give its first pairs, each verified by all shingles. Not all similar texts are within their
reach: for the rest it is an exact join of sets: shingles have one order, frequent ones last, and two
texts that are similar enough share one of their first n - ceil(0.8 n) + 1 (prefix). Distinct texts are indexed under
those; lengths and places rule pairs out, and every pair left is verified by its shingles. What a sample says is
frequent only makes the buckets small: any order gives the same pairs. Buckets are compared with their first text
first, which a partial aggregation finds; then come pairs of a bucket that are not in one group yet. Pairs within a
group are never formed: texts outside a bucket's largest group meet all of it, and a bucket of many pairs is dealt to
parts of PAIRS. So a bucket of near copies that holds a third of all rows costs one comparison a row.

Null texts have no words: fingerprint zero, linked like any other; in the stage all texts without words are one group.
Fewer words than a shingle make one shingle of all. Repeated rows give a row each in near_duplicates; in the stage one
of those that repeat doc_id and text stays. An empty table gives no rows. Columns of docs named like added ones are
left alone in the stage; near_duplicates returns its own columns only.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read, scored, whole_rows
from .components import components

SHINGLE, BITS, SEED = 3, 2, 42
#: Of the pipeline's stage: words of a shingle and least Jaccard similarity.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
#: Of distinct texts one in so many is sampled; shingles of that many sampled texts are frequent; the most frequent are kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 3, 1 << 18
#: Bits of the map of rows whose texts are wanted; 16 a row, and these at least and at most (32 MB).
PLACES, MOST_PLACES = 1 << 22, 1 << 28
#: Pairs of a bucket in one part.
PAIRS = 1 << 22
#: Odd factors of a shingle's words, by place.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _shingles(text: str | None, size: int):
    """(lower-cased words joined by spaces, starts, ends) of the shingles; no words, no shingles."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()  # bytes are split at ASCII white space only
    if not words:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    return b" ".join(words), starts[:n].tolist(), last.tolist()


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned, of 64 bits. Repeated shingles count."""
    from xxhash import xxh64_intdigest

    joined, starts, last = _shingles(text, size)
    if not starts:
        return 0
    hashes = np.fromiter((xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, last)), "<u8", len(starts))
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 32768):  # a bit is a byte for a while: bounded memory for very long texts
        ones = np.unpackbits(hashes[a : a + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(ones, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs with fp, the fingerprint as a signed 64-bit number; a column of that name is replaced."""

    def make():
        return lambda texts: {"fp": np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)}

    from .common import with_struct

    return with_struct(docs, scored(make, "fp long", F.col("text")), ["fp"])


def _segment(x, s: int):
    return F.shiftrightunsigned(x, 32) if s else x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """distinct: fp. All pairs a < b at 1 to bits (3 at most) differing bits, once each."""
    if not 1 <= bits <= 3:
        raise ValueError("two segments and one deletion find 3 differing bits at most")
    keys = []
    for s in (0, 1):
        part = _segment(F.col("fp"), s)
        # the segment with bit i deleted (cleared), i, and which segment: 32 + 5 + 1 bits
        keys += [part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i)).cast("long")).bitwiseOR(F.lit(i << 32 | s << 37).cast("long")) for i in range(32)]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    a, b = index.select("key", F.col("fp").alias("a")), index.select("key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    low, high = _segment(differ, 0), _segment(differ, 1)
    first = F.bit_count(low) <= 1  # the low segment is the one to match on, else the high one
    # the one key that stands for the pair: the deleted bit is the differing one, or bit 0 where none differs
    bit = F.when(first, low).otherwise(high)
    at = F.when(bit == 0, 0).otherwise(F.bit_count(bit - 1)).cast("long")
    stands = F.shiftrightunsigned(F.col("key"), 32) == F.when(first, at).otherwise(at + 32)
    return a.join(whole_rows(b), "key").filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= bits) & stands).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, fp, fingerprint (hex), component_id (smallest doc_id reachable)."""
    fps = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), "text"), size).select("doc_id", "fp"))
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = materialize(components(links(reps.select("fp"))))
    of = reps.join(whole_rows(joined.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    of = materialize(of)
    least = materialize(of.groupBy("component").agg(F.min("rep").alias("component_id")))
    classes = materialize(of.join(whole_rows(least), "component").select("fp", "component_id"))
    discard(reps, joined, of, least)
    return fps.join(whole_rows(classes), "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def word_hashes():
    """A bounded memory of the hashes of words."""
    from xxhash import xxh64_intdigest

    from .tokens import Remembered

    return Remembered(lambda w: xxh64_intdigest(w, SEED), most=200_000)


def shingle_set(text: str | None, size: int, of_word) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted; fewer words than size are one shingle."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    n = max(1, len(words) - size + 1) if words else 0
    x = np.fromiter(map(of_word.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        h = h * np.uint64(3) + x[k : k + n] * _FACTORS[k % len(_FACTORS)]
    h = (h ^ (h >> np.uint64(32))) * _FACTORS[0]
    return np.unique(h ^ (h >> np.uint64(29)))


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; numbers of texts) of the shingles that are frequent in a sample. At most MOST_FREQUENT come to the driver."""

    def make():
        of_word = word_hashes()
        return lambda texts: {"h": [shingle_set(t, size, of_word).view(np.int64) for t in texts]}

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    every = some.select(F.explode(scored(make, "h array<long>", F.col("text"))["h"]).alias("h"))
    top = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    hashes, n = np.array([r.h for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefix(h: np.ndarray, least: Fraction, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of a set of hashes the first in the common order that a set of that similarity must share one of."""
    keys, counts = frequent
    rank = np.zeros(len(h), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        rank = np.where(keys[at] == h, counts[at], 0)
    return h[np.lexsort((h, rank))[: len(h) - -(-least.numerator * len(h) // least.denominator) + 1]] if len(h) else h


def _row():
    """Stands for a row's doc_id and text."""
    tagged = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.md5(F.concat(tagged(F.col("doc_id").cast("string")), tagged(F.col("text")))))


def _places(rows: DataFrame):
    """A test of the column row: true for all rows (column row) given, and for some more, more if the map is full.

    The map is put together in tasks; its bytes, MOST_PLACES / 8 at most, are all that comes to the driver.
    """
    bits = PLACES
    while bits < min(16 * rows.count(), MOST_PLACES):
        bits *= 2
    place = F.pmod(F.xxhash64("row"), F.lit(bits))
    maps = rows.groupBy(F.bitmap_bucket_number(place + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("m"))
    whole = np.zeros(bits // 8, np.uint8)
    for r in maps.toLocalIterator():
        part = np.frombuffer(r.m, np.uint8)
        whole[(r.b - 1) * len(part) : r.b * len(part)] = part
    shared = rows.sparkSession.sparkContext.broadcast(whole)

    def make():
        return lambda at: {"in": (lambda x: (shared.value[x >> 3] >> (x & 7) & 1).astype(bool))(np.array(at, np.int64))}

    return scored(make, "in boolean", place)


def _among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """row and text of docs, of rows whose hash is among those of wanted: all wanted ones and some more. Spares most texts a shuffle."""
    return docs.select(_row().alias("row"), "text").withColumn("s", _places(wanted)).filter("s.in").select("row", "text")


def bound(n: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """How many hashes two sets can share at most; n, spread: of both, sizes and numbers by the first byte, 255 at most."""
    rest = np.array(n) - spread.sum(-1, dtype=np.int64)
    return spread.min(0).sum(-1, dtype=np.int64) + rest.min(0)


def _verified(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, size: int, least: Fraction) -> DataFrame:
    """Those of pairs (a, b: nodes of sizes) whose texts have that similarity: none that can't by their spreads, and then by all their shingles."""

    def can():
        def run(an, a, bn, b):
            n, spread = np.array([an, bn], np.int64), np.stack([np.frombuffer(b"".join(x), np.uint8).reshape(-1, 256) for x in (a, b)])
            return {"can": bound(n, spread) * (least.numerator + least.denominator) >= n.sum(0) * least.numerator}

        return run

    def make():
        of_word = word_hashes()
        return lambda texts: {"h": [shingle_set(t, size, of_word).view(np.int64) for t in texts]}

    side = lambda c: whole_rows(sizes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("spread").alias(f"{c}_spread")))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("s", scored(can, "can boolean", "a_n", "a_spread", "b_n", "b_spread"))
    pairs = materialize(pairs.filter("s.can").select("a", "b"))
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(nodes.join(whole_rows(sizes.select("node", "row")), "node"))
    # rows that repeat a doc_id and text are one
    sets = _among(docs, wanted).join(whole_rows(wanted), "row").dropDuplicates(["row"]).select("node", scored(make, "h array<long>", F.col("text"))["h"].alias("h"))
    sets = materialize(sets)
    side = lambda c: whole_rows(sets.select(F.col("node").alias(c), F.col("h").alias(f"{c}_h")))
    both = F.size(F.array_intersect("a_h", "b_h"))
    enough = both * (least.numerator + least.denominator) >= (F.size("a_h") + F.size("b_h")) * least.numerator
    held = materialize(pairs.join(side("a"), "a").join(side("b"), "b").filter(enough).select("a", "b"))
    discard(pairs, wanted, sets)
    return held


def _apart(rest: DataFrame, may) -> DataFrame:
    """rest: key, node, n, pos, component. The pairs (a, b) of a key that are of different components and may hold.

    Of those outside a key's largest component each meets all of the key. Pairs that are formed outnumber those of
    different components twice at most; parts of PAIRS share the larger side, the smaller is copied to each.
    """
    tally = rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
    tally = tally.agg(F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("top"))
    tally = tally.select("key", "all", F.col("top.c").alias("top"), F.col("top.component").alias("most")).filter("top < all")
    parts = F.ceil(F.col("all") * (F.col("all") - F.col("top")) / F.lit(PAIRS)).cast("int")
    mixed = materialize(rest.join(whole_rows(tally.select("key", "most", parts.alias("parts"))), "key"))
    side = lambda c: [F.col(x).alias(f"{c}_{x}") for x in ("node", "n", "pos", "component")]
    a = mixed.filter("component <> most").select("key", "most", *side("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    b = mixed.select("key", *side("b"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    once = (F.col("b_component") == F.col("most")) | (F.col("a_node") < F.col("b_node"))
    pairs = a.join(whole_rows(b), ["key", "part"]).filter((F.col("a_component") != F.col("b_component")) & once & may(F.col("a_n"), F.col("a_pos"), F.col("b_n"), F.col("b_pos")))
    pairs = materialize(pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct())
    discard(mixed)
    return pairs


def _near(sizes: DataFrame) -> DataFrame:
    """sizes: node, fp. Pairs a < b of nodes that deletion variants link, through the first node of each fingerprint."""
    firsts = materialize(sizes.groupBy("fp").agg(F.min("node").alias("first")))
    same = sizes.join(whole_rows(firsts), "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    side = lambda c: whole_rows(firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")))
    met = links(firsts.select("fp")).join(side("a"), "a").join(side("b"), "b")
    return same.unionByName(met.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b")))


def near_copies(docs: DataFrame, size: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """doc_id and row (see _row) of what is not the first of its group: exact copies (in lower case, by words), and near copies.

    The first has the smallest doc_id; null comes last.
    """
    from xxhash import xxh3_128_digest

    least = Fraction(str(similarity))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, size))

    def make():
        import pyarrow as pa

        of_word = word_hashes()

        def run(texts):
            sets = [shingle_set(t, size, of_word) for t in texts]
            out = {"digest": pa.array([xxh3_128_digest(_shingles(t, 1)[0]) for t in texts], pa.binary()), "n": np.array([len(h) for h in sets], np.int32)}
            out["spread"] = pa.array([np.minimum(np.bincount(h >> np.uint64(56), minlength=256), 255).astype(np.uint8).tobytes() for h in sets], pa.binary())
            out["fp"] = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            return out | {"keys": [prefix(h, least, frequent.value).view(np.int64) for h in sets]}

        return run

    found = docs.select("doc_id", _row().alias("row"), F.monotonically_increasing_id().alias("at"), scored(make, "digest binary, n int, spread binary, fp long, keys array<long>", F.col("text")).alias("s"))
    found = materialize(found.select("doc_id", "row", "at", "s.digest", "s.n", "s.spread", "s.fp", "s.keys"))
    texts = found.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "at")).alias("f")).select("digest", "f.*")
    # nodes are numbers in the order of doc_id, so the first of a bucket is what its near copies were made of, if anything
    texts = materialize(texts.orderBy("no_id", "doc_id", "digest").withColumn("node", F.monotonically_increasing_id()))
    sizes = materialize(found.select("at", "n", "spread", "fp").join(whole_rows(texts.select("at", "node", "row")), "at").drop("at"))
    sets = materialize(found.select("at", "n", "keys").join(whole_rows(texts.select("at", "node")), "at").select("node", "n", "keys"))
    index = sets.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    # the first of each bucket, its size and place as one number; a bucket of one is none
    whole = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")
    first = index.groupBy("key").agg(F.min("node").alias("first"), F.min_by(whole, "node").alias("of"), F.count(F.lit(1)).alias("rows"))
    of = F.shiftright("of", 32).alias("first_n"), F.col("of").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("first_pos")
    first = materialize(first.filter("rows > 1").select("key", "first", *of))
    index = materialize(index.join(whole_rows(first), "key").filter(F.col("node") != F.col("first")))
    discard(sets, first)

    def may(an, ap, bn, bp):
        """Can hold at the first key that two texts share: lengths, and what is left of both from there on."""
        lengths = F.greatest(an, bn) * least.numerator <= F.least(an, bn) * least.denominator
        return lengths & (F.least(an - ap, bn - bp) * (least.numerator + least.denominator) >= (an + bn) * least.numerator)

    to_first = index.filter(may(F.col("n"), F.col("pos"), F.col("first_n"), F.col("first_pos")))
    # the deletion variants come first: what they link is verified, and the buckets are asked for other pairs only
    near = materialize(_near(sizes))
    linked = _verified(near, sizes, docs, size, least)
    pairs = materialize(to_first.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct().join(whole_rows(near), ["a", "b"], "left_anti"))
    held = _verified(pairs, sizes, docs, size, least)
    edges = materialize(linked.unionByName(held))
    discard(near, linked, held)
    groups = materialize(components(edges))
    rest = index.select("key", "node", "n", "pos").join(whole_rows(groups), "node", "left")
    rest = materialize(rest.withColumn("component", F.coalesce("component", "node")))
    left = _apart(rest, may)
    discard(pairs, index, rest, groups)
    more = _verified(left, sizes, docs, size, least)
    groups = materialize(components(edges.unionByName(more)))
    discard(left, edges, more, sizes)
    of = texts.join(whole_rows(groups), "node", "left").select("digest", "node", "row", F.coalesce("component", "node").alias("component"))
    of = materialize(of)
    stays = of.groupBy("component").agg(F.min(F.struct("node", "row")).alias("f")).select("component", F.col("f.row").alias("stays"))
    stays = materialize(of.join(whole_rows(stays), "component").select("digest", "stays"))
    discard(of, groups, texts)
    gone = materialize(found.select("doc_id", "row", "digest").join(whole_rows(stays), "digest").filter("row <> stays").select("doc_id", "row").distinct())
    discard(found, stays)
    return gone


def keep_one(docs: DataFrame, size: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """docs without near copies: of each group the row with the smallest doc_id stays, with the columns of docs.

    Rows are told apart by doc_id and text; of rows that repeat both one stays. A row without doc_id stays if its group
    has none with one.
    """
    gone = near_copies(docs, size, similarity).select("row")
    repeated = docs.select(_row().alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row")
    doubtful = materialize(gone.unionByName(repeated).distinct())
    whole = docs.select(_row().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")).withColumn("s", _places(doubtful))
    # most rows are seen to stay as they are read; only the others travel
    rest = whole.filter("s.in").select("row", "whole").join(whole_rows(gone), "row", "left_anti").groupBy("row").agg(F.first("whole").alias("whole"))
    return whole.filter("not s.in").select("whole.*").union(rest.select("whole.*"))
