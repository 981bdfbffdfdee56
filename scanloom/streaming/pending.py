"""Frames that come late: queries wait until all their candidates are there.

A query's candidates lie more than `exclusion` ids before it. Arrivals are appended to a
table; of its ids alone keyed state holds the least that isn't there yet, those beyond it
that are, and the queries that wait. A query is answered from the table once every id
before it that it may be given has come, so its answer is the batch query's whatever the
order of arrival, and also if a micro-batch runs again. The state grows with the disorder,
not with the sequence: 16 bytes a frame that came early.

A frame that never comes keeps the queries behind it waiting; answer_waiting() answers
them from what there is. Ids are counted from `first` without gaps; repeated ids and ids
below `first` change nothing, a null id is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import retrieval

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Of ids in any order those whose candidates are all there, each once."""

    def __init__(self, exclusion: int, first: int = 0):
        self.exclusion, self.first = exclusion, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.missing = handle.getValueState("missing", "id bigint")
        self.early = handle.getMapState("early", "id bigint", "there boolean")
        self.waiting = handle.getMapState("waiting", "id bigint", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        missing = self.missing.get()[0] if self.missing.exists() else self.first
        ready = []
        for pdf in rows:
            for number in sorted({int(i) for i in pdf.id.dropna()}):
                if number < missing or self.early.containsKey((number,)):
                    continue
                self.early.updateValue((number,), (True,))
                self.waiting.updateValue((number,), (True,))
        while self.early.containsKey((missing,)):
            self.early.removeKey((missing,))
            missing += 1
        self.missing.update((missing,))
        if self.waiting.exists():
            ready = sorted(number for (number,) in self.waiting.keys() if number - self.exclusion <= missing)
            for number in ready:
                self.waiting.removeKey((number,))
        yield pd.DataFrame({"id": pd.Series(ready, dtype="int64")})

    def close(self) -> None:
        pass


def keep_stream(stream: DataFrame, table: str, checkpoint: str) -> None:
    """stream(id, vec), appended to the table: Parquet, a folder a micro-batch, which is
    replaced if that runs again."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _answer(table: str, ids: DataFrame, out: str, k: int, exclusion: int) -> None:
    spark = ids.sparkSession
    queries = _kept(spark, table).join(ids, "id", "left_semi")
    found = retrieval.candidates(_kept(spark, table), k, exclusion, queries=queries)
    retrieval.padded(found, queries, k, exclusion).write.mode("overwrite").parquet(out)


def _kept(spark: SparkSession, table: str) -> DataFrame:
    """A frame that came twice counts once."""
    return spark.read.parquet(table).select("id", "vec").dropDuplicates(["id"])


def answer_in_order(
    spark: SparkSession, table: str, out: str, checkpoint: str, k: int = retrieval.K, exclusion: int = retrieval.EXCLUSION, first: int = 0
) -> None:
    """Answers the queries of keep_stream()'s table whose candidates are all there, over all
    that is there now; the next call goes on where this one ended."""
    own = spark.newSession()  # where the state is kept is a setting of the session
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own.conf.set("spark.sql.shuffle.partitions", "1")  # of ids alone; answers are made in the caller's session
    arrived = own.readStream.schema("id bigint, batch int").option("basePath", table).parquet(table).select("id", F.lit(0).alias("sequence"))
    ready = arrived.groupBy("sequence").transformWithStateInPandas(InOrder(exclusion, first), "id bigint", "Append", "None")

    def batch(ids: DataFrame, number: int) -> None:
        released = f"{out}/released/batch={number}"
        ids.write.mode("overwrite").parquet(released)  # the state is asked once
        _answer(table, spark.read.schema("id bigint").parquet(released), f"{out}/answers/batch={number}", k, exclusion)

    ready.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def answer_waiting(spark: SparkSession, table: str, out: str, k: int = retrieval.K, exclusion: int = retrieval.EXCLUSION) -> None:
    """Answers, from all that has come, the queries that still wait for missing frames."""
    waiting = _kept(spark, table).select("id").join(spark.read.schema("id bigint, batch string").parquet(f"{out}/released").select("id"), "id", "left_anti")
    _answer(table, waiting, f"{out}/answers/batch=-1", k, exclusion)


def read_answers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/answers").select("query_id", "rk", "cand_id", "d2")
