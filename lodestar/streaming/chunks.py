"""Chunking of documents as they arrive: an extension, with the same chunkers as in batch.

Fixed, sentence and recursive chunkers are stateless, row by row, so they run
unchanged on a stream; the semantic chunker gathers sentences per document and
does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators import chunking
from lodestar.schemas import DOCUMENT

STATELESS = ("fixed", "sentence", "recursive", "chonkie_recursive", "chonkie_semantic")


def documents(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, in the documents' schema."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def chunks(docs: DataFrame, spec: dict) -> DataFrame:
    if spec.get("type") not in STATELESS:
        raise ValueError(f"this chunker does not run on a stream: {spec.get('type')}")
    return chunking.build(docs, spec)


def write(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now and stops; started again, it goes on where it ended."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
