"""What the operators share: scratch tables, and vectorised hashing of whole texts with numpy."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step takes, which holds some twenty words of 8 bytes for each; a longer text is a step of its own.
STEP_BYTES = 1 << 18
#: Rows and bytes in a batch that goes to Python, whichever is reached first; some rows are blocks of a MB.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
U64 = np.uint64
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Rows of long texts go to Python in batches that an executor's memory holds several times."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    # Python workers of a session whose driver found this package by its own path find it too
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is set, as in tests, one of this machine if it runs all of Spark."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            found = tempfile.mkdtemp(prefix="tidewell-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written once to the shared folder and read again, so that a lost executor costs no more than one step.

    ``drop`` removes a table as soon as nothing reads it; what is left goes when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        bounded_batches(spark)
        atexit.register(self._end)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        # the shuffles of a finished write serve nothing more
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEAN_UP) if before is None else self.spark.conf.set(CLEAN_UP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)

    def _end(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001  the session is gone; its folder is its owner's to clear
            pass


def texts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings, null as empty, one after another, and the n + 1 places where they begin and end."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + n + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return b, o - o[0]


def steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, ends) for runs of rows of a few MB."""
    b, o = texts(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + size, "right")) - 1)
        yield i, j, b[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j
    give_back()


def _trim():
    """The C library's function that gives free memory back to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


_TRIM = _trim()


#: What empties the caches of operators that keep some from task to task in a Python worker.
FORGET: list = []


def give_back() -> None:
    """What a batch's arrays have taken, and what other operators have kept, goes back to the system, so that workers are small beside the JVM."""
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Rolling:
    """Hashes of any substrings from prefix sums: sum of T[byte] * P**place, shifted back by P**-start, modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        p = (int(rng.integers(1 << 20, 1 << 62)) << 3 | 5) & (1 << 64) - 1
        self.p, self.inv = U64(p), U64(pow(p, -1, 1 << 64))
        self.pow = self.ipow = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.pow) <= n:
            size = max(n + 1, STEP_BYTES + 4096)
            one = np.full(size, self.p, U64)
            one[0] = 1
            self.pow = np.multiply.accumulate(one)
            one[1:] = self.inv
            self.ipow = np.multiply.accumulate(one)

    def prefix(self, b: np.ndarray) -> np.ndarray:
        self._grow(len(b))
        out = np.zeros(len(b) + 1, U64)
        np.cumsum(self.table[b] * self.pow[: len(b)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.ipow[start])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORDS = Rolling(11)


def words(b: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, and the n + 1 places in them where texts begin and end."""
    n = len(b)
    if not n:
        return np.zeros(0, U64), np.zeros(len(ends), np.int64)
    if lower:
        b = LOWER[b]
    solid = ~SPACE[b]
    first = np.zeros(n + 1, bool)
    first[ends] = True  # a text begins here
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return WORDS.of(WORDS.prefix(b), s, e), np.searchsorted(s, ends)


def shingles(h: np.ndarray, place: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; of all words as one run where there are fewer."""
    g = h.copy()
    for i in range(1, min(k, len(h))):
        g[: len(h) - i] = mix(g[: len(h) - i] * U64(0x9E3779B97F4A7C15) + h[i:])
    out = []
    for a, z in zip(place[:-1].tolist(), place[1:].tolist()):
        if z - a >= k:
            x = np.sort(g[a : z - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif z > a:
            x = h[a : a + 1]
            for i in range(a + 1, z):
                x = mix(x * U64(0x9E3779B97F4A7C15) + h[i : i + 1])
            out.append(mix(x ^ U64(0xA5A5 + z - a)))
        else:
            out.append(np.zeros(0, U64))
    return out
