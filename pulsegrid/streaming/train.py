"""The kinetic table as a stream: its moments add up, so each batch of reads only adds to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators import train
from pulsegrid.operators.motifs import Motif


def moments_stream(reads: DataFrame, motifs: list[Motif]) -> DataFrame:
    """A streaming table of moments, for update or complete mode; its state is bounded by the key space."""
    return train.moments(reads, motifs)


def append_shards(reads: DataFrame, motifs: list[Motif], folder: str, checkpoint: str) -> StreamingQuery:
    """Writes one shard of moments per micro-batch; ``train.merge`` over the folder gives the table. A batch that is run again replaces its shard."""

    def write(batch: DataFrame, batch_id: int) -> None:
        train.moments(batch, motifs).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
