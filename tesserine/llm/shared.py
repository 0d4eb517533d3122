"""What the operators share: cut lineage, read tables, walk Arrow texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a vectorised step handles at once, a little under 1 MB, as tables of powers come in sizes of two.
#: A longer document is a step of its own.
STEP_BYTES = (1 << 20) - 16
#: Whether Spark removes the shuffle files of a query when it ends, and not when the driver comes to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``; where that is unset, one under /tmp in a local session and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return "file:///tmp/tesserine-checkpoints"


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and survives lost executors.

    The files go when the application ends, what was shuffled for them as soon as they are written, and so does what the
    driver's allocator keeps of it.
    """
    path = f"{shared_folder(spark)}/tesserine/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    trim(spark)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = where
    return out


def trim(spark: SparkSession) -> bool:
    """Gives native memory that the driver's JVM has freed back to the system; whether the JVM can (HotSpot on glibc).

    The allocator keeps freed blocks for each of hundreds of threads. They stand beside the heap and grow with each query planned.
    """
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # by the interface's method, as the server's own class isn't open to Py4J
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = new(jvm.java.lang.Object, 4)
    given[0], given[1] = name, "systemTrimNativeHeap"
    try:
        invoke.invoke(server, given)
    except Py4JJavaError:  # another JVM or C library
        return False
    return True


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes the files of tables that cut() wrote, once nothing reads them any more, and lets the driver find the shuffle files that nothing refers to."""
    for df in tables:
        where = df.__dict__["_written"]
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row begins; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def bitmap(keys: DataFrame, column: str, count: int, most_bits: int = 1 << 30) -> np.ndarray:
    """A Bloom filter with one hash of the 64-bit keys: about 16 bits a key, ``most_bits`` (128 MB) at most.

    Its size is bounded whatever the data; a key of the set always passes, and others pass more often as it fills, which
    costs work and never rows. It is made in slices of the key space, one a task, so nothing but the bitmap itself reaches the driver.
    """
    from pyspark.sql import functions as F

    bits = 1 << min(most_bits.bit_length() - 1, max(16, (16 * max(1, count)).bit_length()))
    slices = min(256, max(1, bits >> 16))
    shift, width = 64 - bits.bit_length() + 1, bits // slices

    def fill(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(shift)).astype(np.int64)
            for s in np.unique(at // width):
                one = found.setdefault(int(s), np.zeros(width, bool))
                one[at[at // width == s] - s * width] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], ["slice", "bits"])

    sliced = keys.select(F.col(column).cast("long").alias("k")).repartition(min(slices, partitions(keys.sparkSession)), F.shiftright(F.shiftrightunsigned("k", shift), (width - 1).bit_length()))
    out = np.zeros(bits // 8, np.uint8)
    for row in sliced.mapInArrow(fill, "slice long, bits binary").toLocalIterator():
        out[row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] |= np.frombuffer(row["bits"], np.uint8)
    return out


def passes(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys the bitmap lets through."""
    shift = 64 - (len(filled) * 8).bit_length() + 1
    at = keys >> np.uint64(shift)
    return (filled[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0
