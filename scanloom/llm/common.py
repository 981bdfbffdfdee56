"""Helpers that the training-data operators share: spooled tables, text
normalisation, let-bindings for higher-order expressions, and column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Fixed values of the text contract: what separates words, and the letters that
# are folded.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a
    local session without that setting gets a temporary folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="scanloom-")
    return _own_dir[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/scanloom-{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def spool(df: DataFrame, name: str, *parts: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that
    survives lost executors, and a result that later passes read but don't redo.
    parts: columns with a folder for each value."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_spool(df: DataFrame) -> None:
    """Remove a spooled table that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/scanloom-" in path:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs that start hand at most so many rows at a time to Python and take as
    many at a time from Parquet: for rows that are long."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, str(rows))
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def ascii_lower(text: Column) -> Column:
    """A-Z only; lower() is faster but also folds other alphabets, so it serves
    the texts that are pure ASCII."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def let(value: Column, body) -> Column:
    """body(value), with value computed once although body may use it in a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(name: str) -> str:
    """A column's name as one that may hold dots or spaces."""
    return "`" + name.replace("`", "``") + "`"


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle even where it is small, or is taken for small (Spark
    counts the bytes of files, compressed, and no rows that an explode adds): each broadcast
    takes several MB of the driver's heap and a thread, and rounds of joins would make
    hundreds."""
    return df.hint("merge")


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or a longer name if df already has such a column."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: A group of more than 1/HOT_SHARE of all rows is hot: there are fewer than
#: HOT_SHARE of them, so their summaries may be broadcast.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n_rows: int, how: str = "inner", many: bool = False) -> DataFrame:
    """rows joined to groups (a row for each key, with its group_size) by key; how:
    inner, or left to keep rows of no group. The few hot groups are broadcast, so
    that no task gets all rows of one; the others are joined by a shuffle, always if
    many: their number grows with the rows."""
    hot = groups.where(F.col("group_size") * HOT_SHARE > n_rows)
    cold = groups.where(F.col("group_size") * HOT_SHARE <= n_rows)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(shuffled(cold) if many else cold, key, how))


def split_by_keys(rows: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose column is certainly not among keys, and the rest, told apart by a
    Bloom filter; a null may be among them. rows isn't shuffled."""
    from . import bloom

    pages = bloom.pages_for(keys.count())
    cells = spool(bloom.build_windows(keys.where(F.col(key).isNotNull()), key, pages), "keys-filter")
    mark = free_name(rows, "maybe")
    value = F.col(quoted(column))
    marked = rows.withColumn(mark, value.isNull() | bloom.maybe_window(cells.scalar(), value, pages))
    return marked.where(~F.col(mark)).drop(mark), marked.where(F.col(mark)).drop(mark)


def least_of_components(nodes: DataFrame) -> DataFrame:
    """nodes(fp, first_id, group_size, root, ...), first_id the least id of a node: with
    component_id, the least id of the component, and keep_fp, the least node that has it.
    A null is the least id only where there is no other."""
    least = nodes.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), F.col("first_id").alias("id"), "fp")).alias("keep"))
    least = least.select("root", F.col("keep.id").alias("component_id"), F.col("keep.fp").alias("keep_fp"))
    return nodes.join(shuffled(least), "root").drop("root", "first_id")


def documents_kept(docs: DataFrame, id_col: str, text_col: str, prints: DataFrame, classes: DataFrame, key_of) -> DataFrame:
    """The rows of docs that stay, exactly one of each component, whatever ids are null
    or repeated. prints(doc_id, fp): a row for each of docs; classes: of
    least_of_components(); key_of: fp from a text. Rows whose id is certainly that of no
    row to drop are not shuffled."""
    n = prints.count()
    classes = classes.select("fp", "group_size", "component_id", "keep_fp")

    def is_kept(doc_id: Column) -> Column:
        return doc_id.eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("keep_fp"))

    members = spool(join_groups(prints, classes, "fp", n, many=True).select("doc_id", "fp", is_kept(F.col("doc_id")).alias("kept")), "members")
    tied = members.where("kept").groupBy("doc_id", "fp").agg(F.count("*").alias("rows")).where("rows > 1")
    going = spool(members.where("not kept").select("doc_id").unionByName(tied.select("doc_id")).distinct(), "going")
    stay, asked = split_by_keys(docs, id_col, going, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([key_of(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys], ["row", "fp"])

    packed = asked.select(whole_row(docs).alias("row"), F.col(quoted(text_col)).alias("text"))
    keyed = packed.mapInArrow(run, StructType([packed.schema["row"], StructField("fp", LongType())]))
    rest = join_groups(keyed, classes, "fp", n, many=True).where(is_kept(F.col("row")[id_col])).dropDuplicates(["fp"])
    return stay.select(*map(quoted, docs.columns)).unionByName(rest.select("row.*"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
