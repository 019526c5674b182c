"""Log templates on a stream: each micro-batch goes on from the registry that the one before left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from signalspark.operators.templates import cluster
from signalspark.session import spread
from signalspark.sinks.files import stream_batch
from signalspark.sinks.versions import before, read_state, write_state


def assign_batch(
    batch: DataFrame, name: str, registry: str, write: Callable[[DataFrame, str], None], keep: int = 3, **options
) -> None:
    """Give a batch's messages their pattern ids, hand them to ``write`` and store the registry after it.

    A batch that is repeated starts from the same registry as before and gives the same ids; ``write`` is
    called with the batch's name, under which it should replace what it wrote.
    """
    spark = batch.sparkSession
    start = before(spark, registry, name)
    seed = None if start is None else read_state(spark, registry, start)
    found = cluster(batch, seed=seed, **options)
    write(found.assigned, name)
    write_state(found.registry, registry, name, keep)


def pattern_stream(
    stream: DataFrame, registry: str, checkpoint: str, write: Callable[[DataFrame, str], None], keep: int = 3, **options
) -> DataStreamWriter:
    """A query that assigns pattern ids micro-batch by micro-batch; start it with the trigger of your choice.

    registry: folder of the registry's states, for this query only. write: takes the messages with
    their ids and the batch's name. options: those of ``cluster``. Batches that follow each other in time
    get the ids that one batch of all their messages would.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        kept = spread(batch).persist()
        try:
            assign_batch(kept, stream_batch(batch, batch_id), registry, write, keep, **options)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
