"""The text job on a stream.

Masking is a chain of row-wise expressions, so the batch transformation runs
unchanged on ``readStream``: append mode, no state, no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkveil.operators.collate import first_seen, merged_counts
from inkveil.operators.detect import findings
from inkveil.plans.options import RedactOptions
from inkveil.plans.pipelines import redact_texts


def document_stream(spark: SparkSession, folder: str, files: str = "*.parquet", files_per_trigger: int = 64) -> DataFrame:
    """Parquet of ``documents`` as a stream of ``(doc_id, text)``.

    ``files`` is a glob of files in ``folder``, or of folders with part files.
    """
    glob = files if any(c in files for c in "*?[{") else f"[{files[0]}]{files[1:]}"
    return (
        spark.readStream.schema("doc_id bigint, text string")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder.rstrip('/')}/{glob}")
    )


def start_redaction(documents: DataFrame, options: RedactOptions, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write masked texts to ``out``; ``trigger`` as for ``writeStream.trigger``."""
    return (
        redact_texts(documents, options)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_counts(pages: DataFrame, options: RedactOptions, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Values per document, one folder per micro-batch; :func:`read_counts` gives the item counts.

    A batch overwrites its own folder, so a batch repeated after a failure does not count twice.  The values are kept,
    not their number, because pages of a document may arrive in different batches and hold the same value.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        found = findings(batch, "redact", options.enabled(), options.mask)
        first_seen(found).select("doc_id", "category", "value", "n").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """``(doc_id, category, n_items)`` of all batches so far, as the batch job counts them.

    Documents that stand in one generation only are read from its counts; values are summed again for documents that stand in
    several, or in batches that are not compacted yet.
    """
    from inkveil.streaming import generations

    return generations.read(spark, out)
