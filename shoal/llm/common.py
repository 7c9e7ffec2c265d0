"""Shared helpers: tables in the shared folder, vectorised word hashing, components.

Words are hashed over whole Arrow batches with NumPy: a chunk of rows is one
byte buffer, word bounds come from a byte class table, and a word's 64-bit hash
is a slice of a running polynomial sum, so no Python object is made per word.
Chunks hold at most ``CHUNK_BYTES`` of text or one document, which bounds a
task's memory by the longest single text.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import shoal
from shoal.session import checkpoint_dir

CHUNK_BYTES = 1 << 20
ARROW_ROWS = "512"
ARROW_BYTES = str(8 << 20)

# -- tables in the shared folder ---------------------------------------------


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, tag: str, release: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and reread it: the lineage ends there.

    ``release``: Spark deletes the shuffle files of this write when it is done,
    not when the driver's garbage happens to be collected.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(CLEANUP, "false")
    if release:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's modules, as Spark does with any job's Python files."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(shoal.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="shoal-code-")) / "shoal.zip"     # on the driver; Spark sends it out
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path("shoal") / f.relative_to(root)))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Before Python work: the package is on the executors, and Arrow batches are bounded in rows and bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def crc_remainder(doc_id) -> "F.Column":
    """crc32 of the id as text, mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def crc_of(value) -> int:
    """The same remainder's dividend for one Python value."""
    return zlib.crc32(b"" if value is None else str(value).encode())


PER_ID = 64


def bounded_rows(rows: DataFrame, most: int, per_id: int = PER_ID) -> DataFrame:
    """Distinct ``rows`` (with a column id) and their hash ``row``: about ``per_id`` of an id and ``most`` in all, chosen by hash.

    Without an id of more distinct rows, and up to ``most`` rows, all of them. Rows are
    counted and thinned before any is shuffled, so a hot id's rows are no large group.
    """
    keyed = rows.withColumn("row", F.xxhash64(*rows.columns))
    sizes, _ = write_table(keyed.select("id", "row").distinct().groupBy("id").agg(F.count("*").alias("of_id")), "sizes")
    total = sizes.agg(F.sum(F.least("of_id", F.lit(per_id)))).first()[0] or 0
    share = F.least(F.lit(1.0), per_id / F.col("of_id")) * min(1.0, most / max(1, total))
    some = keyed.join(F.broadcast(sizes), "id").filter(F.pmod(F.xxhash64("row", F.lit("share")), F.lit(1 << 20)) < share * (1 << 20))
    return some.dropDuplicates(["id", "row"]).select(*rows.columns, "row")


# -- vectorised words ----------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE = (_BASE & ~7) | 3          # 3 modulo 8: powers differ in as many low bits as possible
_INV = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: word bytes by rule: everything but blanks; or digits, a-z and every non-ASCII byte
WORD_NONBLANK = ~SPACE
WORD_ALNUM = np.zeros(256, bool)
WORD_ALNUM[0x30:0x3A] = WORD_ALNUM[0x41:0x5B] = WORD_ALNUM[0x61:0x7B] = True
WORD_ALNUM[0x80:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BYTE_LOWER = _BYTE[LOWER]
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        p, q = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
        p[0] = q[0] = 1
        p, q = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
        if size > 8 * CHUNK_BYTES:      # one giant text: don't keep its table
            return p, q
        _powers["p"], _powers["q"] = p, q
    return _powers["p"], _powers["q"]


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null reads as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    if len(array) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``most`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def hash_words(data: np.ndarray, offsets: np.ndarray, i: int, j: int, word: np.ndarray,
               lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows i..j-1: (hash uint64, first word of each row and the end, starts, ends).

    Starts and ends are byte positions in ``data``. The hash depends on the
    word's bytes alone (A-Z lower-cased when ``lower``).
    """
    base = int(offsets[i])
    buf = data[base:int(offsets[j])]
    rel = offsets[i:j + 1] - base
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64), z, z
    inside = word[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    inner = rel[1:-1]
    inner = inner[(inner > 0) & (inner < n)]        # a word never crosses rows
    begin[inner] = inside[inner]
    finish[inner - 1] = inside[inner - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    p, q = _power_table(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * p[:n], out=run[1:])
    h = (run[e] - run[s]) * q[s]
    h = mix64(h + (e - s).astype(np.uint64) * _GOLD)
    return h, np.searchsorted(s, rel), s + base, e + base


def hash_grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix64((out ^ h[k:k + m]) + np.uint64((k + 1) * int(_GOLD) % (1 << 64)))
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``key`` as tables of whole groups, with the groups' bounds in each table."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        k = held.column(key).to_numpy()
        if not len(k):
            continue
        cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        if len(cuts) > 1:                               # the last group may go on in the next batch
            yield held.slice(0, cuts[-1]).combine_chunks(), cuts
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


# -- connected components ------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node.

    Alternating large-star and small-star steps; each is a map-side combined
    minimum per node and one join on the node (AQE splits a hot node's rows),
    written to the shared folder, until the number and the sum of edges no
    longer change. Nothing but three numbers per step reaches the driver.
    """
    spark = edges.sparkSession
    e, path = write_table(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                          .filter("u is not null and v is not null and u <> v")
                          .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def sign(df):
        r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        return tuple(r)

    last = sign(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v")
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        new, new_path_ = write_table(small, "edges")
        now = sign(new)
        drop_path(spark, path)
        e, path = new, new_path_
        if now == last:
            break
        last = now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
