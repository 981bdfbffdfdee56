"""Sequence retrieval over a stream of scan descriptors, or of scan files.

Each micro-batch is appended to a table, and its queries are answered from the
table. A query's candidates lie more than `exclusion` ids before it, so the result
equals the batch query's as long as a scan comes at most `exclusion` ids late;
queries of a scan that comes later still see all that has arrived. From scan files
each micro-batch goes the whole way: points, descriptors, candidates, verification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KITTI, Config
from ..operators import retrieval
from ..plans import loops
from ..plans.store import cut
from ..sources import scans


def answer_stream(
    stream: DataFrame, table: str, out: str, checkpoint: str, k: int = retrieval.K, exclusion: int = retrieval.EXCLUSION
) -> None:
    """stream(id, vec): run over all that is there now. table: Parquet folder of the
    descriptors so far, out: of the candidates; each batch writes a folder of its own,
    so a batch that runs again replaces what it wrote."""
    schema = stream.schema

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
        known = spark.read.parquet(table).where(F.col("batch") <= number).select("id", "vec")
        fresh = spark.read.schema(schema).parquet(f"{table}/batch={number}")
        found = retrieval.candidates(known, k, exclusion, queries=fresh)
        padded = retrieval.padded(found, fresh, k, exclusion)
        padded.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run(stream, batch, checkpoint)


def _run(stream: DataFrame, batch, checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def answer_scan_stream(
    spark: SparkSession, cloud_dir: str, label_dir: str, folder: str, out: str, checkpoint: str, config: Config = KITTI,
    k: int = retrieval.K, exclusion: int = retrieval.EXCLUSION, files_per_batch: int = 16,
) -> None:
    """Verified candidates of the scans of a folder as their files arrive; a label file
    must be there before its scan. folder: of the points and descriptors so far."""

    def batch(files: DataFrame, number: int) -> None:
        spark = files.sparkSession
        labels = spark.read.format("binaryFile").option("pathGlobFilter", "*.label").load(label_dir)
        scans.decode(files, labels, config).write.mode("overwrite").parquet(f"{folder}/points/batch={number}")
        so_far = lambda name: spark.read.parquet(f"{folder}/{name}").where(F.col("batch") <= number)
        points = so_far("points")
        vectors = loops.scan_vectors(points.where(F.col("batch") == number).drop("batch"), config)
        vectors.write.mode("overwrite").parquet(f"{folder}/vectors/batch={number}")
        known = so_far("vectors")
        fresh = known.where(F.col("batch") == number).select("id", "vec")
        found = cut(retrieval.padded(retrieval.candidates(known.select("id", "vec"), k, exclusion, queries=fresh), fresh, k, exclusion))
        loops.verify(found, points.drop("batch"), config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run(scans.stream_scans(spark, cloud_dir, files_per_batch), batch, checkpoint)


def read_answers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).select("query_id", "rk", "cand_id", "d2")
