"""What the operators of this package share: table reads, written intermediates, Arrow helpers and a small logistic fit."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..runtime import ship

#: Rows whose values are Python objects at a time: Arrow batches are larger, and what a worker has once used it keeps.
SLICE = 256
#: Bytes of text that a fit takes of one class at most, and classes at most.
FIT_BYTES, FIT_CLASSES = 32 << 20, 256
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(sc, "_loomgate_shared", None) or "file://" + tempfile.mkdtemp(prefix="loomgate-")
        sc._loomgate_shared = found
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, and lost executors lose nothing.

    Later joins see the sizes of files, and both of their sides are plain exchanges, so AQE may split hot keys.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialize() wrote, once everything made from them is written itself."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_rows(df: DataFrame) -> DataFrame:
    """df, which a join sorts and merges and never broadcasts. For what grows with the input: Spark sizes a table by its files,
    which are compressed, and by its columns, and doesn't see the rows that explode() adds."""
    return df.hint("merge")


def scored(fn_factory: Callable[[], Callable[[list], dict]], schema: str, *cols: str | Column) -> Column:
    """A struct column computed by an Arrow UDF over batches of values.

    fn_factory runs once per task (models are unpacked there) and gives a function from one list per input column to
    {field: values}. Only the named inputs travel to Python. Non-deterministic on paper only, so that the optimizer
    never evaluates it twice.
    """
    from pyspark.sql.types import StructType

    ship(SparkSession.active())
    names = StructType.fromDDL(schema).fieldNames()

    def part(fn, columns):
        out = fn(*(c.to_pylist() for c in columns))
        return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)

    def arrays(fn, columns):
        n = len(columns[0])
        parts = [part(fn, [c.slice(at, SLICE) for c in columns]) for at in range(0, max(n, 1), SLICE)]
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    single = len(cols) == 1

    def run(batches):
        fn = fn_factory()
        for batch in batches:
            yield arrays(fn, [batch] if single else batch)
            pa.default_memory_pool().release_unused()

    run.__annotations__ = {"batches": Iterator[pa.Array] if single else Iterator[tuple[(pa.Array,) * len(cols)]], "return": Iterator[pa.Array]}
    return arrow_udf(run, returnType=schema).asNondeterministic()(*cols)


def with_struct(df: DataFrame, struct: Column, names: Iterable[str]) -> DataFrame:
    """df with the fields of a struct column; columns of df with those names (in any case) are replaced."""
    names = list(names)
    lowered = {n.lower() for n in names}
    kept = [f"`{c}`" for c in df.columns if c.lower() not in lowered]
    return df.withColumn("__struct", struct).select(*kept, *(F.col(f"__struct.{n}").alias(n) for n in names))


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the column as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def py_crc_mod(value, mod: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % mod


def class_sizes(rows: DataFrame, classes: int = FIT_CLASSES) -> dict:
    """rows: id, y. Distinct ids of each class, to a few per cent, of the so many largest classes."""
    n = rows.groupBy("y").agg(F.approx_count_distinct("id", 0.02).alias("n"))
    return {r.y: max(r.n, 1) for r in n.orderBy(F.desc("n"), "y").limit(classes).collect()}


def smallest_hashes(rows: DataFrame, per_class: int, sizes: dict | None = None) -> DataFrame:
    """rows: id, y. Of each class y at most per_class distinct ids, those with the smallest hash.

    Classes are counted first, by distinct ids; then only about twice as many as wanted pass on, so a hot class is no
    larger in its task than any other, and ids that repeat take no place of others. Classes beyond the FIT_CLASSES
    largest are left out.
    """
    from pyspark.sql import Window

    n = class_sizes(rows) if sizes is None else sizes
    if not n:
        return rows.limit(0)
    share = F.create_map(*(F.lit(x) for y, k in n.items() for x in (y, min(1.0, (2.2 * per_class + 100) / k))))
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    few = rows.filter(u < F.try_element_at(share, F.col("y")) * float(1 << 31)).distinct()
    w = Window.partitionBy("y").orderBy(u, "id")
    return few.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_class).select("id", "y")


def texts_of(docs: DataFrame, chosen: DataFrame, most_bytes: int = FIT_BYTES) -> list:
    """(text, y) of the chosen ids, in order of id, through a broadcast of them; of repeated rows the smallest text.

    The texts of a class come to most_bytes of UTF-8 at most: in order of the ids' hashes, one that is too long for what
    is left is passed over.
    """
    rows = docs.select(F.col("doc_id").alias("id"), "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")
    found = materialize(rows.groupBy("id", "y").agg(F.min("text").alias("text")))
    left, kept = {}, []
    for r in sorted(found.select("id", "y", F.octet_length("text").alias("size"), F.xxhash64("id").alias("h")).collect(), key=lambda r: (r.h, r.id)):
        if r.size <= left.setdefault(r.y, most_bytes):
            left[r.y] -= r.size
            kept.append((r.id, r.y))
    whole = found.count() == len(kept)
    if not whole:
        keys = docs.sparkSession.createDataFrame(kept, found.select("id", "y").schema)
    got = (found if whole else found.join(F.broadcast(keys), ["id", "y"])).select("id", "y", "text").collect()
    discard(found)
    return [(r.text, r.y) for r in sorted(got, key=lambda r: (r.id, r.y))]


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, held_mod: int, held_is: int, per_class: int, most_bytes: int = FIT_BYTES) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of at most per_class rows of each class 0 and 1, those with the smallest hash of doc_id, and the sizes of both classes.

    Rows held out (crc32(doc_id) mod held_mod = held_is), null texts and null labels are never taken. Repeated labels
    count once; a document with both labels is one of both classes. The bounds (rows, and bytes of text a class) limit
    the driver's share and the broadcast of ids.
    """
    rows = labels.select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("y"))
    rows = rows.filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (crc_mod("id", held_mod) != held_is))
    sizes = class_sizes(rows)
    return texts_of(docs, smallest_hashes(rows, per_class, sizes), most_bytes), sizes


class Logistic:
    """Ridge-penalised logistic regression on standardised features, by Newton's method."""

    def __init__(self, X: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 40):
        X, y = np.asarray(X, float), np.asarray(y, float)
        weight = np.ones(len(y)) if weight is None else weight / weight.mean()
        self.mu, self.sd = X.mean(0), X.std(0) + 1e-9
        Z = self._z(X)
        self.w = np.zeros(Z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(Z @ self.w, -35, 35)))
            hess = (Z * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ Z + l2 * len(X) * np.eye(len(self.w))
            step = np.linalg.solve(hess, Z.T @ (weight * (y - p)) - l2 * len(X) * self.w)
            self.w += np.clip(step, -5, 5)

    def _z(self, X):
        return np.c_[np.ones(len(X)), (np.asarray(X, float) - self.mu) / self.sd]

    def __call__(self, X) -> np.ndarray:
        z = (self._z(np.asarray(X, float)) * self.w).sum(1)  # row by row: equal rows get equal scores in any batch
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
