"""Incremental indexing: a stream of documents feeds the same stored index as a batch does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators import stored

#: State on each executor's disk, in the checkpoint folder after each batch: the ids of all documents ever seen don't fit in memory.
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_stream(docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *, by: tuple[str, ...] = ()) -> StreamingQuery:
    """Chunks the documents of a stream that no earlier batch had (by doc_ord, null left out), and adds chunks and postings to the index at path; ends when all that is there is taken.

    Which documents are known is state of the stream, so a batch costs what is new, not what is stored. A batch that is repeated after a failure overwrites its own folders.
    """
    spark = docs.sparkSession

    def add(batch: DataFrame, batch_id: int) -> None:
        chunks = chunk(batch).persist()
        stored.append(chunks, path, batch_id, by=by)
        chunks.unpersist()

    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        new = docs.where("doc_ord is not null").dropDuplicates(["doc_ord"])
        return new.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STATE_PROVIDER)
        else:
            spark.conf.set(STATE_PROVIDER, before)
