"""Services over a stream of blobs: each micro-batch runs them on keys that weren't seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from oakmill.session import Engine


def infer_stream(engine: Engine, service: str, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that feeds a stream (columns named as the service's inputs, without the table) to a service.

    A batch that is repeated after a failure finds its keys seen, so nothing is asked twice once its outputs are
    written.
    """
    inputs = [c.partition(".")[2] for c in engine.catalog.bound[service].binding.inputs]

    def each(batch: DataFrame, _: int) -> None:
        engine.inference.infer(service, batch.select(*inputs))

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
