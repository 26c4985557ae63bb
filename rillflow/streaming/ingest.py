"""Replay-safe ingest by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators.collection import first_wins
from rillflow.operators.lineage import shared_folder

#: Where a row of a batch came from, in the order of arrival.
ARRIVAL = {"_at": "_metadata.file_modification_time", "_file": "_metadata.file_path", "_row": "_metadata.row_index"}


def ingest_available(spark: SparkSession, path: str, keys: tuple[str, ...], target: str | None = None) -> DataFrame:
    """Everything at `path` appended once to `target`, in micro-batches; rows whose keys are there already are left out.

    The first row of a key stays: that of the oldest file, and in a file the
    first one. The stream's checkpoint gives each file to one batch; a batch that
    runs again writes its own folders again, so a replay changes nothing. Beside
    the rows each batch leaves its keys alone, and only these are read again.
    """
    target = target or f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    names, arrival = schema.names, [F.asc(c) for c in ARRIVAL]

    def append(batch: DataFrame, epoch: int) -> None:
        done = spark.read.schema(batch.select(*keys).schema).parquet(*[f"{target}-keys/batch={i}" for i in range(epoch)]) if epoch else None
        batch_path = f"{target}/batch={epoch}"
        first_wins(batch, list(keys), arrival, done).select(*names).write.mode("overwrite").parquet(batch_path)
        spark.read.schema(schema).parquet(batch_path).select(*keys).write.mode("overwrite").parquet(f"{target}-keys/batch={epoch}")

    # As a pattern, so that a single file will do as well as a folder.
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").select("*", *(F.col(c).alias(name) for name, c in ARRIVAL.items()))
    stream = source.writeStream.foreachBatch(append).option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(target)
