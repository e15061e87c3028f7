"""Helpers shared by the operators: table access, shared scratch tables, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side whose rows are a few dozen bytes may be broadcast.
BROADCAST_ROWS = 500_000

#: The six ASCII characters that separate words.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch: a worker holds one batch of whole texts at a time.
BATCH_ROWS = 1000

def in_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of BATCH_ROWS rows at most from now on in its session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


#: Bytes of an Arrow batch, where rows are long; a single longer row is a batch of its own.
BATCH_BYTES = 64 << 20


def in_bounded_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df``, with Arrow batches of ``rows`` rows and BATCH_BYTES bytes at most from now on in its session."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = conf.get(key).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only on one machine where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more rows than needed to tell."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a count; beyond it the join shuffles and AQE splits hot keys."""
    return F.broadcast(df) if small(df, limit) else df


#: Pairs of one key that go to one task, beside the key's text.
SALT_ROWS = 256


def with_texts(pairs: DataFrame, texts: DataFrame, names: dict[str, str]) -> DataFrame:
    """``pairs`` with the texts of the nodes in the columns ``names``; ``texts``: node, text, one row each.

    A key in more than SALT_ROWS pairs is dealt over several tasks, and its text
    goes to each of these.  ``pairs`` should be a written table, it is read again.
    """
    parts = {}
    for key in names:
        times = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > SALT_ROWS)
        parts[key] = broadcast_if_small(materialize(times.select(key, F.ceil(F.col("times") / SALT_ROWS).cast("int").alias("parts")), "hot"))
    rows = pairs
    for key in names:
        other = next(k for k in names if k != key)
        salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), "parts")).cast("int")
        rows = rows.join(parts[key], key, "left").withColumn(f"salt_{key}", salt).drop("parts")
    for key, name in names.items():
        copies = texts.withColumnRenamed("node", key).join(parts[key], key, "left")
        copies = copies.withColumn(f"salt_{key}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
        rows = rows.join(copies.select(key, f"salt_{key}", F.col("text").alias(name)), [key, f"salt_{key}"])
    return rows.drop(*[f"salt_{key}" for key in names])


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def unit_hash(*parts: Column) -> Column:
    """A value in [0, 1) from the first 48 bits of the md5 of the joined parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def text_bytes(column):
    """UTF-8 bytes (uint8) and row offsets (int64) of an Arrow string column; null counts as empty."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets, max_bytes: int):
    """Ranges of whole rows of about ``max_bytes`` together; a longer row is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = lo + 1
        while hi < n and offsets[hi + 1] - offsets[lo] <= max_bytes:
            hi += 1
        yield lo, hi
        lo = hi


class SpanHash:
    """64-bit hashes of any spans of a byte array, equal for equal bytes wherever they stand.

    Prefix sums of a polynomial modulo 2**64 give a span's value, the inverse
    powers move it to position zero, and a finaliser mixes its bits.
    """

    BASE = 0x9E3779B97F4A7C15
    _powers: tuple = ()

    def __init__(self, data):
        import numpy as np

        n = len(data) + 1
        if not SpanHash._powers or len(SpanHash._powers[0]) < n:
            size = max(n, 1 << 18)
            up, down = np.full(size, self.BASE, np.uint64), np.full(size, pow(self.BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            SpanHash._powers = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        self.down = SpanHash._powers[1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * SpanHash._powers[0][: n - 1], out=self.sums[1:])

    def __call__(self, start, end, seed: int = 0):
        import numpy as np

        x = (self.sums[end] - self.sums[start]) * self.down[start] + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64))
        return mix64(x)


def mix64(x):
    """A bijection of 64-bit values that spreads every bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_table():
    """Byte table that lower-cases A-Z."""
    import numpy as np

    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_spans(data, offsets):
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of each row, and the first word of each row (one more at the end)."""
    import numpy as np

    inside = np.ones(256, bool)
    inside[list(ASCII_SPACE.encode())] = False
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(False, word[:-1]) if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.append(word[1:], False) if len(word) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
