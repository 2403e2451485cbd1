"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netgeo.session import ensure_checkpoint_dir

#: Text handled at once inside a task: a batch is cut into runs of about so many bytes.
RUN_BYTES = 8_000_000
#: Most bits of a map of wanted rows (8 MB), and bits for each wanted row below that.
MAP_BITS, BITS_A_ROW = 1 << 26, 32
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder of ``spark.checkpoint.dir``
    and read back: lineage ends there, and every later reader sees one version
    of the rows even if executors are lost in between.  The shuffle files of the
    write are deleted with its end, as nothing reads them any more."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``saved`` wrote, once nothing reads them any more."""
    for df in tables:
        if df is not None:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def narrowed(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The rows whose ``columns`` stand in ``wanted``, and few others, without a
    shuffle: ``wanted`` is sent as a bitmap of hashes of bounded size.  For wide
    rows before an exact join, which then shuffles those that can match only."""
    bits = min(max(BITS_A_ROW * wanted.count(), 1 << 15), MAP_BITS)
    mark = F.pmod(F.xxhash64(*columns), F.lit(bits))
    bucket, place = F.bitmap_bucket_number(mark), F.bitmap_bit_position(mark)
    maps = wanted.select(bucket.alias("_bucket"), place.alias("_place")).groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_map"))
    marked = rows.withColumns({"_bucket": bucket, "_place": place}).join(F.broadcast(maps), "_bucket")
    return marked.where("getbit(cast(conv(hex(substring(_map, cast(_place div 8 as int) + 1, 1)), 16, 10) as int), cast(_place % 8 as int)) = 1").select(*rows.columns)


def runs(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of the column
    ``text``, and one row at least: a long document is never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
