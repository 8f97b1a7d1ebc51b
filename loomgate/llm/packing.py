"""Lexical retrieval packing: documents fill training windows together with what a BM25 index finds nearest to them.

Document frequencies, the number of documents and their mean length are those of the whole corpus: each task counts its
own while it encodes, and their sums, one number a token of the vocabulary, go back to all tasks.

The index is sharded by likeness, not by the place of a document in its files: documents are ordered along a Hilbert
curve of their token weights on AXES principal axes (fitted on FIT_DOCS documents; any order gives valid sequences, a good
one brings neighbours together), range-partitioned in that order, and cut into shards of SHARD_DOCS documents (or
SHARD_TOKENS tokens). A shard gets an inverted index of its token ids with BM25 weights. A document longer than a window
fills whole windows by itself; what is left of it seeds a window. The seed's whole document is the query, its unused
neighbours follow in the order of their score while they fit, and the best that does not fit is cut to fill the window
exactly; the rest of it seeds the next one. So every sequence is full, up to the last of a partition, whose tail is cut
into powers of two: no padding. Copies, however many, lie next to each other and fill shard after shard.

sequence_id is partition * 2^32 + a running number; it is unique in one result. Null texts are empty: one separator.
Repeated rows are packed each. An empty table gives no row. Only doc_id and text are read, so columns with other names
cannot clash. Very long texts are held by their task one at a time, as ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .ann import hilbert_keys
from .common import SLICE, materialize, read
from .tokens import Encoder, load, tokenizer_path

WINDOW = 1024
SEPARATOR = 0
SHARD_DOCS, SHARD_TOKENS = 512, 4_000_000
K1, B = 1.2, 0.75
#: Of the order of documents: axes, bits of each, and documents that the axes are fitted on at most (with at most FIT_BYTES of text).
AXES, BITS, FIT_DOCS, FIT_BYTES = 12, 4, 512, 16 << 20


class Corpus:
    """What BM25 needs of the whole corpus: its documents, their mean length, and an idf for each token id."""

    def __init__(self, n: int, tokens: int, terms: np.ndarray, df: np.ndarray, vocabulary: int):
        self.mean = tokens / max(n, 1)
        whole = np.zeros(vocabulary)
        whole[terms] = df
        self.idf = np.log1p((n - whole + 0.5) / (whole + 0.5)).astype(np.float32)

    def weights(self, terms: np.ndarray, tf: np.ndarray, length) -> np.ndarray:
        tf = tf.astype(np.float32)
        return self.idf[terms] * tf * np.float32(K1 + 1) / (tf + np.float32(K1) * (np.float32(1 - B) + np.float32(B) * (length / self.mean).astype(np.float32)))


def counted(docs: list[np.ndarray], vocabulary: int) -> Corpus:
    terms, df = np.unique(np.concatenate([np.unique(d) for d in docs]), return_counts=True) if docs else (np.zeros(0, int), np.zeros(0))
    return Corpus(len(docs), sum(map(len, docs)), terms, df, vocabulary)


class Order:
    """Places of documents on a Hilbert curve of their unit BM25 vectors on principal axes, fitted on a sample."""

    def __init__(self, docs: list[np.ndarray], vocabulary: int, axes: int = AXES, bits: int = BITS):
        self.corpus, self.bits = counted(docs, vocabulary), bits
        self.axes, self.mean = np.zeros((vocabulary, axes), np.float32), np.zeros(axes)
        self.width = np.ones(axes)
        if len(docs) < 2:
            return
        found = [self._unit(d) for d in docs]
        terms, of = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
        x = np.zeros((len(docs), len(terms)), np.float32)
        x[np.repeat(np.arange(len(docs)), [len(t) for t, _ in found]), of] = np.concatenate([w for _, w in found])
        mean = x.mean(0)
        x -= mean
        values, vectors = np.linalg.eigh(x @ x.T)
        top = vectors[:, ::-1][:, :axes]
        k = top.shape[1]
        self.axes[terms, :k] = x.T @ top / np.sqrt(np.maximum(values[::-1][:axes], 1e-12)).astype(np.float32)
        self.mean = mean @ self.axes[terms]
        self.width = 6 * np.concatenate([(x @ self.axes[terms, :k]).std(0), np.ones(axes - k)]) + 1e-9

    def _unit(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        terms, tf = np.unique(d, return_counts=True)
        w = self.corpus.weights(terms, tf, np.float64(len(d)))
        return terms, w / (np.sqrt((w * w).sum()) + np.float32(1e-9))

    def place(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct token ids, place on the axes)."""
        terms, w = self._unit(d)
        return terms, w @ self.axes[terms] - self.mean

    def keys(self, places: list[np.ndarray]) -> np.ndarray:
        side = 1 << self.bits
        cells = np.clip((np.array(places).reshape(-1, len(self.width)) / self.width + 0.5) * side, 0, side - 1)
        return hilbert_keys(cells.astype(np.int64), self.bits)


class Index:
    """BM25 over the token ids of a shard's documents: postings by term, a document's terms as a query. Weights are the corpus's."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        self.n = len(docs)
        found = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(t) for t, _ in found])
        doc = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        ids = np.concatenate([t for t, _ in found])
        terms, of = np.unique(ids, return_inverse=True)
        length = np.array([len(d) for d in docs], np.float64)
        w = corpus.weights(ids, np.concatenate([c for _, c in found]), length[doc])
        order = np.argsort(of, kind="stable")
        self.docs, self.weights, self.of = doc[order], w[order], of[order]
        self.count = len(terms)
        self.terms = np.split(of, np.cumsum(sizes)[:-1])
        self._starts()

    def _starts(self) -> None:
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.of, minlength=self.count))])

    def keep(self, unused: np.ndarray) -> None:
        """Leave out the postings of documents that are used up: their scores are never asked for again."""
        on = unused[self.docs]
        self.docs, self.weights, self.of = self.docs[on], self.weights[on], self.of[on]
        self._starts()

    def scores(self, d: int) -> np.ndarray:
        """Of all the shard's documents against document d."""
        at, n = self.start[self.terms[d]], self.start[self.terms[d] + 1] - self.start[self.terms[d]]
        rows = np.arange(n.sum()) + np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return np.bincount(self.docs[rows], self.weights[rows], self.n)


class Packer:
    """Packs one partition. Pieces are (key, start, length, ids, doc_tokens, sequence, offset), ids as bytes."""

    def __init__(self, window: int, corpus: Corpus):
        self.window, self.corpus, self.sequence, self.open, self.out, self.filled = window, corpus, 0, [], [], 0

    def put(self, doc_id, ids: memoryview, start: int, length: int) -> None:
        """Append a piece to the open window and close it when full."""
        self.open.append((doc_id, ids, start, length))
        self.filled += length
        if self.filled == self.window:
            self.close()

    def close(self) -> None:
        at = 0
        for doc_id, ids, start, length in self.open:
            self.out.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, self.sequence, at))
            at += length
        self.open, self.filled = [], 0
        self.sequence += 1

    def space(self) -> int:
        return self.window - self.filled

    def shard(self, keys: list, texts: list[bytes]) -> None:
        w = self.window
        views = [memoryview(t) for t in texts]
        total = np.array([len(t) // 4 for t in texts])
        carried, filled, self.open, self.filled = self.open, self.filled, [], 0
        for k, v, n in zip(keys, views, total):
            for at in range(0, n - w + 1, w):
                self.put(k, v, at, w)
        self.open, self.filled = carried, filled
        start = total - total % w
        left = total % w
        unused = left > 0
        index, indexed = None, 0
        for seed in np.lexsort((np.arange(len(left)), -left)):  # longest rest first; a cut one goes on as seed at once
            while unused[seed]:
                room = self.space()
                take = int(min(room, left[seed]))
                self.put(keys[seed], views[seed], int(start[seed]), take)
                start[seed] += take
                left[seed] -= take
                unused[seed] = left[seed] > 0
                if not self.open:
                    continue
                if index is None:
                    index, indexed = Index([np.frombuffer(t, "<u4") for t in texts], self.corpus), len(texts)
                elif 2 * (still := int(unused.sum())) < indexed:
                    index.keep(unused)
                    indexed = still
                order = np.argsort(-index.scores(int(seed)), kind="stable")
                order = order[unused[order]]
                best, room = None, self.space()
                fits = left[order]
                for d, n in zip(order.tolist(), fits.tolist()):
                    if n <= room:
                        self.put(keys[d], views[d], int(start[d]), n)
                        unused[d] = False
                        left[d] = 0
                        room = self.space() if self.open else 0
                        if not room:
                            break
                    elif best is None:
                        best = d
                if self.open and best is not None:
                    room = self.space()
                    self.put(keys[best], views[best], int(start[best]), room)
                    start[best] += room
                    left[best] -= room
                    seed = best

    def finish(self) -> None:
        """The open window in powers of two, largest first."""
        rest, self.open = self.open, []
        n = sum(p[3] for p in rest)
        for bit in range(n.bit_length() - 1, -1, -1):
            want = n & (1 << bit)
            while want:
                doc_id, ids, start, length = rest[0]
                take = min(want, length)
                self.open.append((doc_id, ids, start, take))
                rest[0] = (doc_id, ids, start + take, length - take)
                if length == take:
                    rest.pop(0)
                want -= take
            if self.open:
                self.close()


NAMES = ["doc_id", "row_id", "key", "salt", "ids", "counts", "terms", "n", "tokens"]


def encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, order: Order, vocabulary: int, wide: str, separator: int, kinds: list, first: int) -> Iterator[pa.RecordBatch]:
    """What _tokens writes of a task's batches of doc_id and text, SLICE rows at a time: a worker holds the ids of no more. first: row_id of the first row."""
    end = np.array([separator], "<u4").tobytes()
    df, n, tokens = np.zeros(vocabulary, np.int64), 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            places, raw = [], []
            for t in part.column(1):
                ids = np.frombuffer(encoder.encode(t.as_py()) + end, "<u4")
                terms, place = order.place(ids)
                df[terms] += 1
                tokens += len(ids)
                places.append(place)
                raw.append(ids.astype(wide).tobytes())
            m = len(raw)
            rows = np.arange(first + n, first + n + m)
            n += m
            salt = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).astype(np.int64)  # spreads equal keys
            none = pa.nulls(m)
            values = [part.column(0).cast(kinds[0]), pa.array(rows), pa.array(order.keys(places)), pa.array(salt), pa.array(raw, pa.binary()), pa.array(np.zeros(m, bool)), none.cast(kinds[6]), none.cast(kinds[7]), none.cast(kinds[8])]
            yield pa.RecordBatch.from_arrays(values, NAMES)
            del raw, values
        del batch
        pa.default_memory_pool().release_unused()
    if n:
        terms = np.flatnonzero(df)
        values = [None, None, None, None, None, True, terms.astype(np.int32), np.concatenate([[n], df[terms]]), tokens]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], NAMES)


def _tokens(docs: DataFrame, spec, separator: int, order) -> DataFrame:
    """Written: doc_id, row_id, key, salt, ids (unsigned, 16 bits where the vocabulary allows) of each row, and a row per task with what it counted."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema["doc_id"]
    kinds = [to_arrow_type(field.dataType), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches, Encoder(spec.value), *order.value, separator, kinds, TaskContext.get().partitionId() << 32)

    schema = f"doc_id {field.dataType.simpleString()}, row_id long, key long, salt long, ids binary, counts boolean, terms array<int>, n array<long>, tokens long"
    return materialize(docs.select("doc_id", "text").mapInArrow(run, schema))


def _corpus(tokens: DataFrame, vocabulary: int) -> Corpus:
    """Sums of what the tasks counted: a number a token id comes to the driver."""
    tasks = tokens.filter("counts")
    whole = tasks.agg(F.sum(F.element_at("n", 1)).alias("n"), F.sum("tokens").alias("tokens")).first()
    pairs = tasks.select(F.explode(F.arrays_zip("terms", F.slice("n", 2, F.size("terms")).alias("df"))).alias("x"))
    sums = pairs.groupBy("x.terms").agg(F.sum("x.df").alias("df")).toArrow()
    return Corpus(whole.n or 0, whole.tokens or 0, sums["terms"].to_numpy(), sums["df"].to_numpy(), vocabulary)


def _fitted(docs: DataFrame, encoder: Encoder, vocabulary: int, separator: int) -> Order:
    """An order fitted on the texts whose ids have the smallest hashes: FIT_DOCS and FIT_BYTES at most.

    Rows are counted first (Parquet footers know), so that each task passes on its share of about twice as many only.
    """
    share = min(1.0, 2.0 * FIT_DOCS / max(docs.count(), 1))
    some = docs.select("text", F.xxhash64("doc_id").alias("h")).filter(F.pmod("h", F.lit(1 << 31)) < share * (1 << 31))
    some = some.filter("text is not null").filter(F.octet_length("text") <= FIT_BYTES // FIT_DOCS).orderBy(F.pmod("h", F.lit(1 << 31))).limit(FIT_DOCS)
    texts = sorted({r.text for r in some.collect()})
    return Order([np.frombuffer(encoder.encode(t) + np.array([separator], "<u4").tobytes(), "<u4") for t in texts], vocabulary)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, separator: int = SEPARATOR, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row_id, ids. Reads doc_id and text only.

    The ids of a sequence's pieces in the order of their offsets are the sequence. row_id (partition * 2^32 + a running
    number) is of the row that a piece is from: it tells repeated documents apart. ids_crc32 is that of ids.
    """
    from pyspark import TaskContext

    spark = ship(docs.sparkSession)
    text = load(path or tokenizer_path("byte_bpe_50k.json"))
    encoder = Encoder(text)
    vocabulary = max(encoder.tok.get_vocab(with_added_tokens=True).values()) + 1
    wide = "<u2" if vocabulary <= 1 << 16 else "<u4"
    spec = spark.sparkContext.broadcast(text)
    order = spark.sparkContext.broadcast((_fitted(docs, encoder, vocabulary, separator), vocabulary, wide))
    tokens = _tokens(docs, spec, separator, order)
    corpus = spark.sparkContext.broadcast(_corpus(tokens, vocabulary))
    field = docs.schema["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        packer, base = Packer(window, corpus.value), TaskContext.get().partitionId() << 32
        kinds = [to_arrow_type(field.dataType)] + [pa.int64()] * 7

        def emit():
            of, starts, lengths, ids, totals, sequences, offsets = list(zip(*packer.out)) or [()] * 7
            packer.out = []
            cols = [[d for d, _ in of], starts, lengths, [zlib.crc32(x) for x in ids], totals, [base + s for s in sequences], offsets, [n for _, n in of]]
            ends = np.cumsum([0, *lengths]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), whole], names)

        keys, texts, size = [], [], 0
        for batch in batches:
            for k, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(raw.as_buffer(), wide).astype("<u4").tobytes()
                keys.append((k, n))
                texts.append(ids)
                size += len(ids) // 4
                if len(keys) >= shard_docs or size >= shard_tokens:
                    packer.shard(keys, texts)
                    yield emit()
                    keys, texts, size = [], [], 0
        if keys:
            packer.shard(keys, texts)
        packer.finish()
        yield emit()

    schema = f"doc_id {field.dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_id long, ids array<int>"
    placed = tokens.filter("not counts").select("key", "salt", "doc_id", "row_id", "ids").repartitionByRange("key", "salt").sortWithinPartitions("key", "salt")
    return placed.select("doc_id", "row_id", "ids").mapInArrow(run, schema)


def op9_packing_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("row_id", "ids")
