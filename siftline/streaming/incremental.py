"""Similarity search over a growing index: each batch of new records is looked up, then added."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.lsh import MinHash, bands, query, signatures


def add(records: DataFrame, path: str, p: MinHash = MinHash(), epoch: str | None = None) -> None:
    """Add records and their band entries to the index below ``path``; the same ``epoch`` again replaces what it added."""
    part = f"epoch={epoch or uuid.uuid4().hex}"
    records.select("id", "tokens").write.mode("overwrite").parquet(f"{path}/records/{part}")
    bands(signatures(records, p), p).write.mode("overwrite").parquet(f"{path}/buckets/{part}")


def lookup(queries: DataFrame, path: str, p: MinHash = MinHash(), metric: str = "jaccard", threshold: float = 0.1, without: str | None = None) -> DataFrame:
    """Matches among all records of the index but those of the epoch ``without``."""
    read = lambda name: queries.sparkSession.read.parquet(f"{path}/{name}").withColumn("epoch", F.col("epoch").cast("string"))
    kept = lambda name: (read(name) if without is None else read(name).where(F.col("epoch") != without)).drop("epoch")
    return query(kept("buckets"), kept("records"), queries, p, metric, threshold)


def follow(records: DataFrame, path: str, out: str, checkpoint: str, p: MinHash = MinHash()) -> StreamingQuery:
    """A streaming query: matches of each batch against the index so far go to ``out``; a batch that comes twice replaces its matches and entries."""

    def step(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            lookup(batch, path, p, without=f"b{epoch}").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        add(batch, path, p, f"b{epoch}")
        batch.unpersist()

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
