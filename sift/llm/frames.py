"""Work on the shared folder, and Arrow helpers that several operators use."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sift.session import working_folder


#: Rows are handed to Python in batches of about so many bytes, however long they are.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let batches end by their bytes, which bounds the memory of workers and executors.

    The setting stays with the session: it is read when a query runs, after it was made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """A new folder below the one every executor shares.

    Where the session names none, a temporary folder stands in on a single machine only.
    """
    bound_batches(spark)
    return f"{working_folder(spark)}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, few: bool = False) -> DataFrame:
    """``df`` written below ``folder`` and read back, which ends its lineage.

    ``few`` is for narrow tables: an eighth of the shuffle partitions write them, so a
    small table is not thousands of files.
    """
    path = f"{folder}/{name}"
    if few:
        df = df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, keep: list[str] | None, text: str = "text") -> DataFrame:
    """``row``, the columns ``keep`` (all, if not given) as a struct, and ``text`` as a string."""
    bound_batches(df.sparkSession)
    row = F.struct(*(F.col(quoted(c)) for c in keep or df.columns))
    return df.select(row.alias("row"), F.col(quoted(text)).cast("string").alias("text"))


def with_row(rows: DataFrame, fields: str) -> StructType:
    """The schema of ``row`` as it is in ``rows``, and of ``fields`` (DDL)."""
    return StructType([rows.schema["row"], *StructType.fromDDL(fields)])


def annotated(df: DataFrame, keep: list[str], text: str, fn, fields: str) -> DataFrame:
    """``row`` (the columns ``keep`` as a struct) and what ``fn`` finds in each text.

    ``fn`` takes a ``Texts`` of about ``CHUNK_BYTES`` and gives one Arrow array for
    each of ``fields`` (DDL). The kept columns travel in a struct, so no name of
    theirs can clash with a result.
    """
    from sift.llm.words import chunks, texts_of

    rows = packed(df, keep, text)
    names = ["row", *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in chunks(texts_of(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *fn(part)], names=names)

    return rows.mapInArrow(run, with_row(rows, fields))
