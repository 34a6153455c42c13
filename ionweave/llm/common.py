"""What the operators of this subpackage share: column roles, shared-folder tables, dense numbering."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share. The cluster names it in spark.checkpoint.dir; only where that
    is unset (tests, a single machine) a temporary folder is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else f"file://{tempfile.mkdtemp(prefix='ionweave-')}"
        if not kept.isDefined():
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, partition_by: str | None = None, slim: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, a lost executor costs nothing already written.
    slim: rows are a few numbers each; tasks hand them on to as few writers as their size asks for, so that files do
    not become many and tiny while the tasks that make the rows stay as many as they are."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if slim:
        df = df.hint("rebalance")
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Largest table, as the sum of its values' sizes, that is sent to the tasks.
BROADCAST_BYTES = 16 << 20


def _width(kind, col):
    """Bytes of a value, about; of arrays, all elements."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(col), F.lit(0)) * (16 if isinstance(kind.elementType, (T.StringType, T.BinaryType)) else 8 * (len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1))
    return F.coalesce(F.octet_length(col), F.lit(0)) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(8)


def sized(stored: DataFrame, limit: int | None = None) -> DataFrame:
    """A stored table, sent to the tasks if its values take at most `limit` bytes and joined by a shuffle otherwise."""
    limit = BROADCAST_BYTES if limit is None else limit
    width = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in stored.schema), F.lit(16))
    return F.broadcast(stored) if (stored.agg(F.sum(width.cast("long"))).first()[0] or 0) <= limit else stored


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a stored table that nothing reads any more."""
    jvm = spark._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches, rows: int = 256):
    """Arrow batches in small parts: a worker holds the Python objects of `rows` texts at a time."""
    for b in batches:
        for at in range(0, max(b.num_rows, 1), rows):
            yield b.slice(at, rows)


def role(df: DataFrame, name: str, kind: str | None = None):
    """Column of df by its exact name, so that other columns' names cannot clash."""
    col = df[f"`{name}`"]
    return col.cast(kind) if kind else col


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): only the two columns that count; a null text is empty."""
    return docs.select(role(docs, id_col, "long").alias("doc_id"), F.coalesce(role(docs, text_col, "string"), F.lit("")).alias("text"))


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def learn_mask(id_col="doc_id"):
    """True for rows that a model may learn from: crc32(doc_id as text) mod 3 is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def dense_offsets(numbered: DataFrame, key: str, part: str = "_pid") -> DataFrame:
    """(part, key, _base): how many rows of key lie in earlier parts. numbered has one row per item with the part
    that wrote it. Counts are combined before the shuffle, so a key with a third of all rows stays cheap."""
    counts = numbered.groupBy(part, key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, key, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_base"))


def per_process(key: tuple, make):
    """What make() gives, made once per worker process: tasks after the first find it again. Functions travel by value,
    so a global of this module would be a new one in every task."""
    held = sys.modules.setdefault("ionweave_worker_state", types.ModuleType("ionweave_worker_state")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
