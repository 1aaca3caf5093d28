"""What several operators share: reliable checkpoints, word hashing over byte strings, small Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are remembered with their hashes up to this many, then forgotten together; bounds a worker's memory.
MEMO_WORDS = 150_000
_own: dict[str, str] = {}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session without one, as in tests, gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and cuts its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables between the steps of one operator, as Parquet in the shared folder: lineage ends there, sizes are known to
    the optimizer, and what a later step replaces is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        """``df`` as a table of its own, with ``by`` in folders by the values of these columns."""
        path = f"{self.folder}/{len(self.kept)}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((read, path))
        return read

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of ``keep`` that no later step and no result reads."""
        context = self.spark.sparkContext
        for path in (p for read, p in self.kept if any(read is t for t in tables)):
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text; null stays null."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_memo = _WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all ``width`` consecutive entries; empty if there are fewer."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out, factor = np.full(count, seed & 0xFFFFFFFF, np.uint64), np.uint64(seed | 1)
    for k in range(width):
        out *= factor
        out += hashes[k : k + count]
    return mixed(out)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array for each row, without Python objects for the entries."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
