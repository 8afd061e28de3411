"""Session settings and working tables of the corpus operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vacantia.session import pin_session
from vacantia.sources.workspace import new_path

#: Rows that a Python worker gets at once. Texts are long: a worker's memory is a multiple
#: of one batch, and stays with it while the JVM does the next stage.
ROWS_PER_BATCH = 1000


def corpus_session(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return pin_session(spark)


Batches = Iterator[pa.RecordBatch]


def released(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``function`` for a worker that serves one operator after the other.

    Before it runs, what tokenizers remember from earlier operators is forgotten; after it
    has run, memory that is free again goes back to the system.
    """

    def run(batches: Batches) -> Batches:
        tokenizers = sys.modules.get("vacantia.llm.byte_bpe")
        if tokenizers is not None:
            tokenizers.ByteBpe.shared.cache_clear()
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim is not None:
                trim(0)

    return run


class Scratch:
    """Working tables that can be dropped before the application ends.

    A table may go once everything that reads it has been written itself.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stage(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write once, read back."""
        path = new_path(self.spark, name)
        df.write.parquet(path, compression=compression)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.paths.clear()
