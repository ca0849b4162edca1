"""Word rules and batch helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BREAK = r"[\x20\x09-\x0D]+"
#: Rows handled at once inside a task and their bytes (one row may have more), so that many very long texts don't meet in memory.
ROWS, SLICE_BYTES = 200, 4 << 20
#: Characters of the longest key that a worker remembers; longer ones are worked out each time.
KEPT_KEY = 64
#: Stored (compressed) bytes for each partition when whole rows are shuffled, and the most partitions.
PARTITION_BYTES, MOST_PARTITIONS, UNKNOWN_BYTES = 16 << 20, 200_000, 1 << 55


def words(text: Column | str) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), BREAK), "")


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """True if crc32 of the id as text leaves ``remainder``; null ids count as the text ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into as many partitions as its size asks for, and not fewer than the session's setting.

    A size that Spark doesn't know (rows that come from no table) leaves the setting as it is.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = size // PARTITION_BYTES if size < UNKNOWN_BYTES else 0
    return df.repartition(min(MOST_PARTITIONS, max(least, asked)), *keys)


def by_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` that hands ``work`` at most ROWS rows and about SLICE_BYTES at once; rows stay in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                n = min(ROWS, batch.num_rows - start)
                while n > 1 and batch.slice(start, n).nbytes > SLICE_BYTES:
                    n = (n + 1) // 2
                yield work(batch.slice(start, n))
                start += n

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A dict that fills itself by ``make`` and holds ``limit`` entries at most, in two generations: when the younger is
    full it becomes the older, and entries in use move back to the younger. Keys longer than ``longest`` aren't kept."""

    def __init__(self, make: Callable, limit: int = 300_000, longest: int = KEPT_KEY):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit // 2, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
