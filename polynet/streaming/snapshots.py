"""Networks that arrive over time: each new file's pairs and features are appended as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.adjacency import neighbours
from ..operators.cells import cell_geometry, rings, with_solidity
from ..operators.features import FAMILIES, pair_features
from ..sources.networks import NETWORK, networks_of, snapshot_name


def arriving(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Network documents of a folder as a stream, at most `files` a batch."""
    docs = spark.readStream.schema(NETWORK).option("multiLine", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files).json(path)
    return docs.withColumn("snapshot_id", snapshot_name())


def write_features(docs: DataFrame, out: str, checkpoint: str, families: tuple[str, ...] = tuple(FAMILIES)) -> StreamingQuery:
    """Start a query that writes the pair features of arrived networks under `out`, one folder a batch, and stops when all is read.

    A batch that is run again after a failure replaces its own folder.
    """

    def batch(found: DataFrame, number: int) -> None:
        net, _ = networks_of(found)
        cells = with_solidity(cell_geometry(rings(net.vertices, net.polygons)))
        features = pair_features(neighbours(net.polygons), cells, families)
        features.withColumn("snapshot_id", F.col("snapshot_id").cast("string")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
