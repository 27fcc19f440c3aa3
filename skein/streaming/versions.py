"""Versions as micro-batches: a stream of file listings kept up by the same incremental writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import VersionedIndex


def index_stream(listings: DataFrame, index: VersionedIndex, checkpoint: str) -> StreamingQuery:
    """Index every version of a stream ``version, file_path, content``, each in one micro-batch, in order of label.

    A version that is indexed already is skipped, so a batch that is run again after a failure changes nothing.
    """

    def step(batch: DataFrame, _: int) -> None:
        batch.persist()
        for r in batch.select("version").distinct().orderBy("version").collect():  # a few labels per batch
            known = index.table("versions").where(F.col("version") == r["version"]).limit(1).count()
            if not known:
                files = batch.where(F.col("version") == r["version"]).where("content is not null")
                index.index_version(files.select("file_path", F.col("content").cast("binary").alias("content"), F.sha2(F.col("content").cast("binary"), 256).alias("file_hash")), r["version"])
        batch.unpersist()

    return listings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

