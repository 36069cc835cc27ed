"""What the operators of this subpackage share: words, folds, reading tables and cutting lineage."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import partloom
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions sent to executors carry their code, so that executors need no copy of this repository. Broadcasts are pickled
# plainly; share() gives them the same treatment.
cloudpickle.register_pickle_by_value(partloom)

#: A word is a run of characters other than the six ASCII white-space characters (Java, Python and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give -1, which no fold holds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1).cast("long"))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_WINDOW = 1 << 17


class WordHashes:
    """64-bit hashes of the words of a text's lower-case bytes, in array operations only, a window of bytes at a time.

    A word's hash is sum(BYTE[b_k] * STEP ** k) mod 2**64 over its bytes, from running sums over the window: the sum up to
    its end less the sum up to its start, times STEP ** -start.
    """

    def __init__(self):
        self.powers = self.backs = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << n.bit_length()
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _STEP, np.uint64))])
            self.backs = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BACK, np.uint64))])

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the words of text (bytes in lower case)."""
        raw = np.frombuffer(b" " + text + b" ", np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[raw]))
        begin, end = edge[::2] + 1, edge[1::2] + 1
        out, at = [np.zeros(0, np.uint64)], 0
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(end, begin[at] + _WINDOW, side="right")))
            low, high = begin[at], end[to - 1]
            self._grow(int(high - low) + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[raw[low:high]] * self.powers[: high - low], out=total[1:])
            b, e = begin[at:to] - low, end[at:to] - low
            h = (total[e] - total[b]) * self.backs[b]
            out.append(h ^ (h >> np.uint64(29)))
            at = to
        return np.concatenate(out), begin - 1


def lower_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only


def share(spark: SparkSession, value: object):
    """Broadcasts value with the code of its classes; received() gives it to a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared) -> object:
    return pickle.loads(shared.value)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor can reach: under spark.checkpoint.dir, or a local one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-partloom-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get()
    return f"{root.rstrip('/')}/partloom-{uuid.uuid4().hex}"


ROW_GROUP = 16 << 20  # bytes of rows that a task's writer holds before they go to disk

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """At most so many rows, and about so many bytes, in an Arrow batch from here on: a batch of whole texts stands in a
    Python worker and in the executor's own memory several times over."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key).lower())
        if not now or not 0 < int(now.group(1)) <= most:
            spark.conf.set(key, most)


@contextmanager
def batches_of(spark: SparkSession, rows: int = 1000, size: int = 4 << 20):
    """small_batches() for what is run meanwhile; the session's own settings hold again afterwards."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    small_batches(spark, rows, size)
    try:
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written meanwhile are deleted once it is written; nothing may read the same frames again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


_recorders: list[list[str]] = []


@contextmanager
def stashes():
    """The list of the folders that stash() writes meanwhile."""
    _recorders.append(made := [])
    try:
        yield made
    finally:
        _recorders.pop()


def stash(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps neither recompute it nor depend on an executor.

    What was shuffled for it is deleted once it is written; nothing reads that again.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with shuffles_dropped(spark):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    for made in _recorders:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, stored once: numbers made anew by each scan follow the split of the files, which follows the cores."""
    return stash(df.withColumn(name, F.monotonically_increasing_id()))


def drop_stash(df: DataFrame) -> None:
    """Deletes what stash() wrote, once nothing reads it any more."""
    drop_folders(df.sparkSession, read_by(df))


def read_by(df: DataFrame) -> set[str]:
    """The folders whose files df reads."""
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def drop_folders(spark: SparkSession, paths: set[str] | list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
