"""Annotate a folder's tables as they arrive: a file is a record, so no state is kept between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.annotate import run_cta
from ..sources.kb import KnowledgeBase
from ..sources.tables import decoded, read_cells


def annotate_folder(spark: SparkSession, folder: str, kb: KnowledgeBase, sink: Callable[[DataFrame, int], None], checkpoint: str, config: Config | None = None, files_a_batch: int = 1_000) -> StreamingQuery:
    """Start a query that gives sink(types, batch number) the column types of each batch of at most files_a_batch new files."""
    arrivals = spark.readStream.format("text").option("maxFilesPerTrigger", files_a_batch).option("wholetext", True).option("pathGlobFilter", "*.[cC][sS][vV]").load(folder)
    files = arrivals.select(decoded(F.col("_metadata.file_path")).alias("path"))

    def batch(found: DataFrame, number: int) -> None:
        # As many paths as maxFilesPerTrigger at most.
        paths = [r["path"] for r in found.distinct().collect()]
        if paths:
            sink(run_cta(read_cells(found.sparkSession, paths), kb, config).types, number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
