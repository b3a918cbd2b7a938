"""Keeps a search index up to date with a folder of documents: each run takes the files that no earlier run has taken.

    python -m jobs.feed_index --documents FOLDER --out FOLDER --checkpoint FOLDER [--config FILE]

Documents (Parquet: doc_id, text, lang, source) are read as a stream of files. Texts become overlapping chunks, written by batch and language, and postings, written by batch and by a
hash of the term; `larkspur.operators.stored` searches them. Which files and which documents are known is in the checkpoint: a run without new files
writes nothing, a document that comes again in another file is left out, and a run that was cut off is taken up where it stood.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config_of, logger, session
from larkspur.operators import segment
from larkspur.sources import corpus
from larkspur.streaming import index

log = logger("feed_index")


def _watched(spark: SparkSession, path: str) -> str:
    """The path for a stream of files: of a single file a pattern that only it meets, since a stream reads folders or patterns."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if files.exists(at) and files.getFileStatus(at).isFile() else path


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Takes what is new in documents. Returns what the run read (documents, in how many batches); the chunks and postings are under out.

    Documents with a null or empty text have no chunks; those with a null doc_id are left out.
    """
    settings = config_of(__file__) | (config or {})
    files = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(_watched(spark, documents))
    docs = corpus.documents_as_docs(files, "lang")

    def chunk(batch: DataFrame) -> DataFrame:
        chunks = segment.chunk_fixed(batch, settings["size"], settings["overlap"])
        return chunks.withColumn("lang_key", F.coalesce(F.nullif("lang", F.lit("")), F.lit("none")))

    query = index.write_stream(docs, chunk, out, checkpoint, by=("lang_key",))
    query.awaitTermination()
    taken = [p["numInputRows"] for p in query.recentProgress]
    report = {"batches": sum(n > 0 for n in taken), "documents": sum(taken)}
    log.info("read %(documents)d documents in %(batches)d batches", report)
    for p in query.recentProgress:
        log.info("batch %s: %s rows, %s documents known", p["batchId"], p["numInputRows"], sum(s["numRowsTotal"] for s in p["stateOperators"]))
    log.info("wrote chunks and postings to %s", out)
    return report


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    spark = session("feed_index")
    try:
        run(spark, args.documents, args.out, args.checkpoint, config_of(__file__, args.config, spark))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
