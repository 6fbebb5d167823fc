"""What the operators share: reading tables, tables in the shared folder, word hashing, fixed-size bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` finds the same ones.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local session may leave it unset; it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidings-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: list[str] = []  # the folders of written(), oldest first


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and that nothing reads any more."""
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for path in [p for p in _made if p.rsplit("/", 1)[-1] in names]:
        deleted(df.sparkSession, path)


def made() -> list[str]:
    """The tables that written() has made and nothing has dropped; pass it to dropped_since() later."""
    return list(_made)


def dropped_since(spark: SparkSession, before: list[str], keep: DataFrame) -> None:
    """Deletes the tables made since made() gave ``before``, but for the one that ``keep`` reads."""
    names = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()}
    for path in set(_made).difference(before):
        if path.rsplit("/", 1)[-1] not in names:
            deleted(spark, path)


def packed(docs: DataFrame) -> DataFrame:
    """docs with all columns in one struct ``row``, so that an operator's own columns can't clash with them; ``row.*`` unpacks."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def text_keys(text: Column, names: tuple[str, str] = ("ka", "kb")) -> list[Column]:
    """Two hashes of a text (96 bits together; null counts as empty): stand for the text where a row's id is null or repeated."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(t).alias(names[0]), F.crc32(t.cast("binary")).alias(names[1])]


@contextmanager
def small_batches(spark: SparkSession, megabytes: int = 8):
    """Arrow batches of at most so many megabytes for what is written inside: rows that carry arrays of whole texts are
    large, and a task holds a batch in the JVM, in its channel and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{megabytes}m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts(batch, name: str = "text") -> list[bytes]:
    """The UTF-8 texts of an Arrow batch; null becomes empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


class WordHash(dict):
    """word -> 64-bit hash of ``norm(word)``; 0 for a word that norm makes empty. Filled as words turn up."""

    LIMIT = 400_000

    def __init__(self, norm=None, limit: int = LIMIT):
        super().__init__()
        self.norm, self.limit = norm, limit

    def __missing__(self, word: bytes) -> int:
        key = self.norm(word) if self.norm else word
        value = self[word] = (xxhash.xxh64_intdigest(key) or 1) if key else 0
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:  # a cache only: starting afresh changes no result
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]), 1 << 14)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Spans:
    """Hashes of any span of a sequence of word hashes, in constant time a span."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def bitmap(values: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of 2**bits bits with two bits set for each value of a long column, built by Spark.

    At most 2**bits / 64 rows come to the driver, however many values there are: the size has a fixed bound. With
    too many values the map fills up and lets everything through; it never hides a value."""
    mask = (1 << bits) - 1
    # Spark's own 64-bit hash, so that Python only has to repeat integer arithmetic on the column's value
    v = F.col(column)
    spots = values.select(F.explode(F.array(v.bitwiseAND(mask), F.shiftrightunsigned(v, 64 - bits))).alias("s"))
    rows = (
        spots.groupBy(F.shiftright("s", 6).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
        .toArrow()  # 16 bytes a row; rows as Python objects would take some hundred
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.tobytes()


def in_bitmap(words: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Which of the 64-bit values may be in a bitmap (viewed as unsigned 64-bit words)."""

    def one(spot):
        return (words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) != 0

    hit = one(values & np.uint64((1 << bits) - 1))
    some = np.flatnonzero(hit)
    hit[some] = one(values[some] >> np.uint64(64 - bits))
    return hit
