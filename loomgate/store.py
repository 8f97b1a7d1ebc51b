"""A table as parts on plain files, dealt by extendible hashing: a change writes the parts it falls in, and parts stay small.

The bits of a hash of the keys, from the highest, lead to a part: parts are the leaves of a binary tree, named
<depth>-<prefix>, and a directory over the first bits says which leaf a row is in. A part that would pass ROWS rows is
split by its next bits before it is written, whatever the table's size; compact() joins sparse neighbours again.

<root>/data/<folder>/part=<leaf>/ holds what one write made; <root>/manifest/<version>.json says for each leaf which folder
has it now, how many rows, and the largest values of tracked columns. The manifest comes last: a version is published
by putting its name in place, which fails if it is there already (compare and swap), so of two writers one goes again over
what the other left, and readers see one version or the next, never half of one. That needs a file system that can move
a file to a name only if it is free, at once (local, HDFS). Old data stays until vacuum().
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a part at most: some hundred MB of a usual table.
ROWS = 2_000_000
#: Rows that one task writes, about: a part that holds more is several files, dealt by the keys.
FILE_ROWS = 100_000
#: Bits that parts are told apart by at most: what shares so many is one key's, or nearly.
MOST_BITS = 40
#: Directory entries that stand in an expression; a larger directory is joined.
IN_PLACE = 1024


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@dataclass(frozen=True)
class Manifest:
    """of: leaf to folder. rows: leaf to rows. most: tracked column to its largest value so far. leaves: all of the tree, empty ones too."""

    version: int
    of: dict[str, str]
    rows: dict[str, int] = field(default_factory=dict)
    most: dict[str, int] = field(default_factory=dict)
    leaves: tuple[str, ...] = ("0-0",)

    def paths(self, root: str, only: Iterable[str] | None = None) -> list[str]:
        wanted = set(self.of if only is None else only)
        return [f"{root}/data/{f}/part={leaf}" for leaf, f in sorted(self.of.items()) if leaf in wanted]


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{root}/manifest") if n.endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest | None:
    """The last one, or that of a version."""
    found = _versions(spark, root)
    if not found or version is not None and version not in found:
        return None
    fs, p = _fs(spark, f"{root}/manifest/{version if version is not None else found[-1]:06d}.json")
    stream = fs.open(p)
    try:
        raw = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(raw["version"], raw["of"], raw["rows"], raw["most"], tuple(raw["leaves"]))


def _publish(spark: SparkSession, root: str, m: Manifest, replace: bool) -> bool:
    """Put a version in place; False if another writer has. replace: the version is the caller's own, written once more."""
    _, whole = _fs(spark, f"{root}/manifest/{m.version:06d}.json")
    fs, draft = _fs(spark, f"{root}/manifest/{m.version:06d}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps({"version": m.version, "of": m.of, "rows": m.rows, "most": m.most, "leaves": list(m.leaves)}).encode()))
    stream.close()
    jvm = spark._jvm
    if fs.getUri().getScheme() == "file":
        paths, options = [jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (draft, whole)], jvm.java.nio.file.StandardCopyOption
        try:
            if replace:
                how = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
                how[0] = options.ATOMIC_MOVE
                jvm.java.nio.file.Files.move(*paths, how)
            else:  # a link to a name that is taken fails, at once
                jvm.java.nio.file.Files.createLink(paths[1], paths[0])
                fs.delete(draft, False)
            return True
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, whole, how)
        return True
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


# ---- the tree of parts ----------------------------------------------------------------------------------------------


def _leaf(name: str) -> tuple[int, int]:
    depth, prefix = name.split("-")
    return int(depth), int(prefix)


def even(parts: int) -> tuple[str, ...]:
    """A tree of so many leaves of one depth (the next power of two)."""
    depth = max(0, math.ceil(math.log2(max(parts, 1))))
    return tuple(f"{depth}-{i}" for i in range(1 << depth))


def split(leaves: Iterable[str], expected: dict[str, int], most: int) -> dict[str, list[str]]:
    """The leaves that are expected to hold more than `most` rows, with those that take their place."""
    out = {}
    for name in leaves:
        depth, prefix = _leaf(name)
        more = min(MOST_BITS - depth, math.ceil(math.log2(max(expected.get(name, 0), 1) / most))) if expected.get(name, 0) > most else 0
        if more > 0:
            out[name] = [f"{depth + more}-{(prefix << more) + i}" for i in range(1 << more)]
    return out


def placed(df: DataFrame, keys: Iterable[str], leaves: Iterable[str]) -> DataFrame:
    """df with its part. The hash does not depend on the integer type of a key; without keys there is one part."""
    leaves = sorted(leaves, key=lambda n: (_leaf(n)[0], _leaf(n)[1]))
    depth = max(_leaf(n)[0] for n in leaves)
    if not keys or depth == 0:
        return df.withColumn("part", F.lit(leaves[0]))
    code = F.shiftrightunsigned(F.xxhash64(*(F.col(k).cast("string") for k in keys)), 64 - depth)
    if 1 << depth <= IN_PLACE:
        table = [""] * (1 << depth)
        for n in leaves:
            d, p = _leaf(n)
            for i in range(p << (depth - d), (p + 1) << (depth - d)):
                table[i] = n
        return df.withColumn("part", F.element_at(F.array(*map(F.lit, table)), (code + 1).cast("int")))
    spans = [(n, _leaf(n)[1] << (depth - _leaf(n)[0]), ((_leaf(n)[1] + 1) << (depth - _leaf(n)[0])) - 1) for n in leaves]
    # depths differ by a few: each leaf is met by the prefix of its own depth
    depths = sorted({_leaf(n)[0] for n in leaves})
    directory = df.sparkSession.createDataFrame([(n, _leaf(n)[0], _leaf(n)[1]) for n, _, _ in spans], "part string, __depth int, __prefix long")
    tried = df.withColumn("__code", code).withColumn("__at", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.shiftrightunsigned("__code", depth - d).alias("p")) for d in depths))))
    return tried.join(directory, (F.col("__at.d") == F.col("__depth")) & (F.col("__at.p") == F.col("__prefix"))).drop("__code", "__at", "__depth", "__prefix")


# ---- reading and writing --------------------------------------------------------------------------------------------


def read(spark: SparkSession, root: str, schema: StructType | None = None, only: Iterable[str] | None = None, version: int | None = None, of: Manifest | None = None) -> DataFrame | None:
    """The table, or some parts of it; None if it was never written."""
    m = of or manifest(spark, root, version)
    if m is None:
        return None
    paths = m.paths(root, only)
    if not paths:
        some = m.paths(root)
        schema = schema or (spark.read.parquet(some[0]).schema if some else None)
        return spark.createDataFrame([], schema) if schema else None
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def lookup(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], schema: StructType | None = None) -> DataFrame | None:
    """The table's rows with the keys of rows (few of them): only the parts that these keys lead to are read."""
    m = manifest(spark, root)
    if m is None:
        return None
    wanted = rows.select(*keys).distinct()
    parts = [r.part for r in placed(wanted, keys, m.leaves).select("part").distinct().collect()]
    return read(spark, root, schema, parts, of=m).join(wanted, keys, "left_semi")


def _write(spark: SparkSession, root: str, df: DataFrame, keys, leaves, version: int, sort, track, largest: int = 0) -> tuple[dict[str, str], dict[str, int], dict[str, int]]:
    """Writes df under a folder of its own: (folder, rows) by leaf, and largest values. largest: rows of the largest part, about."""
    folder = f"v{version:06d}-{uuid.uuid4().hex[:8]}"
    path = f"{root}/data/{folder}"
    dealt, files = placed(df, keys, leaves), -(-largest // FILE_ROWS) if keys else 1
    # a part's rows go to so many tasks, those of a key together; leaves are told by the highest bits of this hash, these by its rest
    by = ["part", F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(files))] if files > 1 else ["part"]
    dealt.repartition(*by).sortWithinPartitions("part", *sort).write.partitionBy("part").parquet(path)
    if not any(n.startswith("part=") for n in _names(spark, path)):
        return {}, {}, {}
    found = spark.read.schema(StructType([f for f in df.schema.fields if f.name in track]).add("part", "string")).parquet(path)
    rows = found.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *(F.max(c).alias(c) for c in track)).collect()
    most = {c: max((r[c] for r in rows if r[c] is not None), default=0) for c in track}
    return {r.part: folder for r in rows}, {r.part: r.n for r in rows}, most


def _merged(old: dict[str, int], new: dict[str, int]) -> dict[str, int]:
    return old | {c: max(v, old.get(c, v)) for c, v in new.items()}


def write(spark: SparkSession, root: str, df: DataFrame, keys: Iterable[str], parts: int | None = None, version: int | None = None, sort: Iterable[str] = (), track: Iterable[str] = (), rows: int = ROWS) -> None:
    """The next version, whole: of so many parts, or of as many as its rows need."""
    keys, track = list(keys), [c for c in track if c in df.columns]
    total = df.count() if keys else 0
    leaves = even(parts) if parts else even(-(-total // rows)) if keys else ("0-0",)
    for _ in range(100):
        before = manifest(spark, root)
        own = version is not None
        at = version if own else before.version + 1 if before else 0
        of, n, most = _write(spark, root, df, keys, leaves, at, sort, track, -(-total // len(leaves)))
        if _publish(spark, root, Manifest(at, of, n, _merged(before.most if before else {}, most), leaves), replace=own):
            return
        remove(spark, f"{root}/data/{next(iter(of.values()))}") if of else None
    raise RuntimeError(f"{root}: other writers came first a hundred times")


def update(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], change: Callable[[DataFrame], DataFrame], schema: StructType | None = None, parts: int | None = None, version: int | None = None, sort: Iterable[str] = (), track: Iterable[str] = (), most_rows: int = ROWS) -> list[str]:
    """The parts that rows (of the key columns at least) fall in become change(what they held). Returns these parts.

    rows are counted to tell how large parts become: where change makes several rows of one, give as many.
    change must keep to the keys of rows and to what it is given. A writer that was overtaken runs again over the newer parts;
    with a version of its own (a stream's batch) there is one writer, and the version replaces itself.
    """
    for _ in range(100):
        before = manifest(spark, root)
        if before and version is not None and before.version >= version:
            before = manifest(spark, root, version - 1)
        leaves = before.leaves if before else even(parts or 1)
        incoming = {r.part: r["count"] for r in placed(rows, keys, leaves).groupBy("part").count().collect()}
        if not incoming:
            return []
        touched = sorted(incoming)
        old = read(spark, root, schema, touched, of=before) if before else None
        old = spark.createDataFrame([], schema or rows.schema) if old is None else old
        known = before.rows if before else {}
        expected = {leaf: n + known.get(leaf, 0) for leaf, n in incoming.items()}
        deeper = split(touched, expected, most_rows) if keys else {}
        grown = tuple(x for leaf in leaves for x in deeper.get(leaf, [leaf]))
        own = version is not None
        at = version if own else before.version + 1 if before else 0
        new = change(old)
        of, n, most = _write(spark, root, new, keys, grown, at, sort, [c for c in track if c in new.columns], max(-(-n // len(deeper.get(leaf, [leaf]))) for leaf, n in expected.items()))
        mine = {x for leaf in touched for x in deeper.get(leaf, [leaf])}
        if not set(of) <= mine:
            raise ValueError(f"{root}: a change made rows outside the parts of its keys: {sorted(set(of) - mine)[:5]}")
        kept = {leaf: f for leaf, f in before.of.items() if leaf not in incoming} if before else {}
        counts = {leaf: c for leaf, c in known.items() if leaf not in incoming}
        if _publish(spark, root, Manifest(at, kept | of, counts | n, _merged(before.most if before else {}, most), grown), replace=own):
            return touched
        remove(spark, f"{root}/data/{next(iter(of.values()))}") if of else None
    raise RuntimeError(f"{root}: other writers came first a hundred times")


def compact(spark: SparkSession, root: str, keys: list[str], schema: StructType | None = None, sort: Iterable[str] = (), sparse: int = ROWS // 4) -> int:
    """Join neighbours that hold fewer than `sparse` rows together, as long as there are any. Returns how many parts went."""
    m = manifest(spark, root)
    if m is None or len(m.leaves) == 1:
        return 0
    rows, kept, joined = {leaf: m.rows.get(leaf, 0) for leaf in m.leaves}, set(m.leaves), {}
    for depth in range(max(_leaf(x)[0] for x in kept), 0, -1):
        for leaf in sorted(x for x in kept if _leaf(x)[0] == depth and _leaf(x)[1] % 2 == 0):
            prefix = _leaf(leaf)[1]
            other, above = f"{depth}-{prefix + 1}", f"{depth - 1}-{prefix >> 1}"
            if other in kept and rows[leaf] + rows[other] < sparse:
                kept -= {leaf, other}
                kept.add(above)
                rows[above] = rows[leaf] + rows[other]
                joined[above] = joined.pop(leaf, [leaf]) + joined.pop(other, [other])
    if not joined:
        return 0
    gone = [x for some in joined.values() for x in some]
    old = read(spark, root, schema, gone, of=m)
    leaves = tuple(sorted(kept, key=_leaf))
    of, n, _ = _write(spark, root, old, keys, leaves, m.version + 1, sort, [], max(rows[x] for x in joined)) if old is not None else ({}, {}, {})
    rest = {x: f for x, f in m.of.items() if x not in gone}
    if not _publish(spark, root, Manifest(m.version + 1, rest | of, {x: c for x, c in m.rows.items() if x not in gone} | n, m.most, leaves), replace=False):
        remove(spark, f"{root}/data/{next(iter(of.values()))}") if of else None
        return 0  # another writer came first; what it left can be joined next time
    return len(m.leaves) - len(leaves)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove data that none of the last `keep` versions refers to, while nobody writes. Returns the number of folders removed."""
    used = {p for v in _versions(spark, root)[-keep:] for p in manifest(spark, root, v).paths(root)}
    gone = 0
    for v in _names(spark, f"{root}/data"):
        parts = [n for n in _names(spark, f"{root}/data/{v}") if n.startswith("part=")]
        old = [n for n in parts if f"{root}/data/{v}/{n}" not in used]
        for n in old:
            remove(spark, f"{root}/data/{v}/{n}")
        gone += len(old)
        if len(old) == len(parts):
            remove(spark, f"{root}/data/{v}")
    return gone
