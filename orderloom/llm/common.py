"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The bytes that `[^\x20\x09-\x0D]+` excludes from words.
WHITE = " \t\n\x0b\x0c\r"
WORD_BYTE = np.array([chr(b) not in WHITE for b in range(256)])
LOWER_BYTE = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


#: Spark's setting to remove a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where none is named, in local mode, as in tests, a temporary folder is made and set; elsewhere that is an error, as
    executors would not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here.

    A lost executor then costs a re-read, not a recomputation, and the shuffle files of the job go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for a while; a double underscore in a name stands for a dot."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `staged` wrote, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part hold about `most` bytes (one row at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def words_of(texts: pa.Array, lower: bool = True, word_byte: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\x20\x09-\x0D]+` of each text (A-Z lowered): row offsets and the flat words. A null text has no words.

    word_byte: which bytes words are made of, if others than these; all or none of the bytes above 127.

    Done on bytes: white space is left out of the buffer and the words' offsets into what stays are set, so no word is
    copied by itself. (Arrow's own ASCII splitter also cuts at the bytes 0x85 and 0xA0, which end letters such as a-grave.)
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(1, np.int64), pa.array([], pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = word_byte[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = ends[:-1][ends[:-1] < len(data)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    before = np.cumsum(inside, dtype=np.int64)
    offsets = np.append(before[starts] - 1, before[-1] if len(before) else 0).astype(np.int64)
    kept = data[inside]
    if lower:
        kept = LOWER_BYTE[kept]
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes()))
    return np.searchsorted(starts, ends).astype(np.int64), flat


def release() -> None:
    """Gives freed memory back to the system: Python workers stay, idle, beside the tasks of later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory at the partition's end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, worked out once for each distinct word."""
    import xxhash

    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)
