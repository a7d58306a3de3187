"""Shared plumbing of the training-data operators: tables, shared scratch space, words and hashes.

Nothing here collects a corpus to the driver.  Lineage is cut by writing Parquet to the folder that the session names
in ``spark.checkpoint.dir`` (all executors see it), never to a local disk and never with ``localCheckpoint``.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: texts may be long, so a batch is bounded by both.
ARROW_ROWS, ARROW_BYTES = 2000, "4m"
#: A key with more than one in so many rows of a table is hot; so there are no more hot keys than this.
HOT_KEYS = 1000
#: Rows of a file, where materialize() knows how many rows there are at most.
ROWS_OF_FILE = 16384


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts stays within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; that setting is made only where it is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/inkstone/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that is no longer read, through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def collect_garbage(spark: SparkSession) -> None:
    """Lets go of shuffle files that no table needs any more; else they stay until the driver happens to collect."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, tag: str, free: bool = False, most: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there and survives lost executors.

    free: the step is a large one, so the shuffle files of the steps before it go first.  most: the number of rows at most,
    so that a small table doesn't become a file for every shuffle partition; the last stage runs in as many tasks.
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(most // ROWS_OF_FILE + 1)
    if free:
        collect_garbage(spark)
    path = f"{shared_dir(spark)}/{tag}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what materialize() wrote for ``df``."""
    remove(df.sparkSession, df.scratch_path)


def join_with_hot_keys(rows: DataFrame, unique: DataFrame, key: list[str], uses: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``unique``, which has one row per key and in ``uses`` how many rows have that key.

    Keys with more than one in HOT_KEYS of the ``total`` rows are fewer than HOT_KEYS, so they are broadcast; no other key
    can fill a task.  Both tables are read twice, so they should be written ones.
    """
    hot = F.col(uses) * HOT_KEYS > total
    some = unique.where(hot).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(some), key, "left")
    rest = marked.where("_hot is null").select(*rows.columns).join(unique.where(~hot), key, "left")
    return marked.where("_hot").drop("_hot").unionByName(rest)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Dealt by key to all shuffle partitions, however few bytes there are: for steps whose work is not in proportion to
    them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def group_columns(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each group of batches that are sorted by a key of numbers."""
    held: list[dict[str, np.ndarray]] = []
    joined = lambda: {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        change = np.zeros(batch.num_rows, bool)
        for c in key:
            change[1:] |= cols[c][1:] != cols[c][:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and any(held[-1][c][-1] != cols[c][0] for c in key):
            yield joined()
            held = []
        for a, b in pairwise(cuts):
            held.append({c: v[a:b] for c, v in cols.items()})
            if b < batch.num_rows:
                yield joined()
                held = []
    if held:
        yield joined()


def grouped(df: DataFrame, key: list[str], run: Callable[[dict[str, np.ndarray]], list[np.ndarray]], schema: str) -> DataFrame:
    """``run`` on the columns of each group of equal keys; it gives a row's columns, in order of the schema, as arrays.

    As a stream over sorted partitions, so very many small groups cost little more than their rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        for group in group_columns(batches, key):
            if len((rows := run(group))[0]):
                out.append(rows)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return spread(df, *key).sortWithinPartitions(*key).mapInArrow(every, schema)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """xxh3 of each word's bytes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; bytes.split() separates at just these bytes.

    lower: bytes.lower() changes A-Z only.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier for sequences of hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)


#: Its inverse modulo 2^64.
STEP_INVERSE = pow(int(STEP), -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of STEP and of its inverse modulo 2^64."""
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for i, base in enumerate((int(STEP), STEP_INVERSE)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(base, m, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k word hashes, in order; none if there are fewer.

    A run's value is a polynomial in STEP, taken from prefix sums, so the cost doesn't depend on k.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=sums[1:])
    return mix64((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def joined_spans(spans: Iterable[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined, in the given order."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def as_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, named doc_id and text; other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def hash_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows of a table, the same for the same rows: the one with the smallest hash of each bucket.

    Aggregated map-side, so no more than that reaches the driver however many partitions there are.
    """
    h = F.xxhash64(*key)
    picked = df.groupBy(F.pmod(h, F.lit(rows)).alias("_bucket")).agg(F.min(F.struct(F.xxhash64(F.lit(1), *key).alias("_h"), *df.columns)).alias("_row"))
    return picked.select("_bucket", "_row.*").orderBy("_bucket").drop("_bucket", "_h")
