"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word classes named by the operators' contracts: one for prose words, one for runs without white space.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text bytes that a Python kernel turns into arrays at a time; a longer text is taken alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_training(doc_id: Column) -> Column:
    """Whether a row's labels may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset, as in tests, a folder is made."""
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if there is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(there)
    return there


def gathered(df: DataFrame) -> DataFrame:
    """``df``, which should end in a shuffle, in an eighth of its partitions, three a core at least: fewer files are written.

    For every file in a local folder Hadoop starts processes that set its mode, and until such a process runs its own
    program it shows the whole memory of the executor that started it once more.
    """
    spark = df.sparkSession
    return df.coalesce(max(3 * spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)))


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; ``few``: see ``gathered``."""
    shared_folder(df.sparkSession)
    return (gathered(df) if few else df).checkpoint(eager=True)


class Workspace:
    """Tables written as Parquet under the shared folder, to cut lineage; they are deleted when the block ends.

    Inside the block the shuffle files of a write are dropped as soon as it is done, so disk holds the live tables and
    one job's shuffles, however many steps there are. What outlives the block must be read from it before (``cut``).
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Workspace:
        self.before = self.spark.conf.get(self._CLEANUP, "false")
        self.spark.conf.set(self._CLEANUP, "true")
        return self

    def cut(self, df: DataFrame, few: bool = False) -> DataFrame:
        path = f"{self.folder}/{len(self.tables)}"
        (gathered(df) if few else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that ``cut`` gave and nothing reads any more."""
        for path in [path for table, path in self.tables if any(table is frame for frame in frames)]:
            delete(self.spark, path)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self._CLEANUP, self.before)
        delete(self.spark, self.folder)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark wrote it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: Bytes up to which a table of ids is broadcast.
MOST_BROADCAST = 16 << 20


def counted(ids: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``ids`` (one column, written first), to be broadcast if it has at most MOST_BROADCAST bytes, else joined as any table."""
    ids = work.cut(ids, few=True) if work else cut(ids, few=True)
    kind = ids.schema[0].dataType
    width = F.lit(8) if isinstance(kind, T.NumericType) else F.coalesce(F.length(F.col(ids.columns[0]).cast("string")), F.lit(0))
    size = ids.agg(F.sum(width.cast("long") + 16)).first()[0] or 0
    return F.broadcast(ids) if size <= MOST_BROADCAST else ids


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold about ``limit`` characters each."""
    low, size = 0, 0
    for i, text in enumerate(texts):
        more = len(text or "")
        if i > low and size + more > limit:
            yield low, i
            low, size = i, 0
        size += more
    if low < len(texts):
        yield low, len(texts)
