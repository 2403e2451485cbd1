"""request/response scoring re-aimed as an unbounded table of IPs.

A stream of ``(query_id, ts, ip)`` rows is resolved against the static lookup
table and scored every micro-batch.  The exact match is a stream-static join
on the level/block keys (no state); the nearest-range fallback and the model
transforms run per micro-batch inside ``foreachBatch``, where the batch is an
ordinary DataFrame - so the batch plan is the same one the batch API runs.
No streaming state is kept, so a lost executor only replays its batch.

``start_scored_stream`` scores with a published version of lookup table and
model.  A version is pinned for each epoch before the epoch is scored, and an
epoch's answers are one folder that is written whole: a batch that is replayed
after a failure scores the same input with the same version and replaces its own
answers, so each address is answered exactly once.  A version published while
the stream runs is taken up by the next epoch, without a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netgeo.operators import lookup
from netgeo.plans import families
from netgeo.sources import io


def resolve_batch_fn(lookup_df: DataFrame, sink: Callable[[DataFrame, int], None],
                     mode: str = "nearest", score: Callable[[DataFrame], DataFrame] | None = None):
    """foreachBatch callback: resolve (and optionally score) one micro-batch.
    The lookup table is prepared once, not for every batch."""
    lookup_df = lookup.prepare_lookup(lookup_df)

    def fn(batch: DataFrame, epoch_id: int) -> None:
        res = lookup.resolve(batch, lookup_df, mode)
        if score is not None:
            res = score(res)
        sink(res, epoch_id)
    return fn


def start_ip_stream(spark: SparkSession, source_dir: str, schema: str, lookup_df: DataFrame,
                    sink: Callable[[DataFrame, int], None], checkpoint: str,
                    mode: str = "nearest", max_files_per_trigger: int | None = None,
                    score: Callable[[DataFrame], DataFrame] | None = None):
    """Start the streaming query over parquet files of IPs in ``source_dir``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    return (stream.writeStream.foreachBatch(resolve_batch_fn(lookup_df, sink, mode, score))
            .option("checkpointLocation", checkpoint).start())


# --------------------------------------------------------------------------- versions and epochs

def _names(spark: SparkSession, folder: str) -> list[str]:
    """The complete entries of a folder of small files, by name; empty if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(f.getPath().getName() for f in fs.listStatus(path) if fs.exists(done(f.getPath(), "_SUCCESS")))


def publish(spark: SparkSession, versions: str, number: int, lookup_path: str, bundle_path: str) -> None:
    """Makes a lookup table and a bundle version ``number``; the largest is current."""
    io.write_feature_config(spark, f"{versions}/{number:012d}", {"version": number, "lookup": lookup_path, "bundle": bundle_path})


def _pinned(spark: SparkSession, versions: str, out: str, epoch: int) -> dict:
    """The version of an epoch: the one it had before, else the current one."""
    name = f"{epoch:012d}"
    pins = f"{out.rstrip('/')}-versions"
    if name not in _names(spark, pins):
        published = _names(spark, versions)
        if not published:
            raise ValueError(f"no version is published in {versions}")
        io.write_feature_config(spark, f"{pins}/{name}", io.read_feature_config(spark, f"{versions}/{published[-1]}"))
    return io.read_feature_config(spark, f"{pins}/{name}")


def score_epoch_fn(spark: SparkSession, versions: str, out: str, mode: str = "exact",
                   after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch callback: answers of one epoch in ``out/epoch=<n>``.  Lookup
    table and model are loaded when an epoch has another version than the last.
    ``after`` is called when the answers are written, before the epoch commits."""
    held: dict[int, tuple] = {}

    def fn(batch: DataFrame, epoch: int) -> None:
        version = _pinned(spark, versions, out, epoch)
        number = version["version"]
        if number not in held:
            held.clear()
            table = spark.read.parquet(version["lookup"])
            held[number] = (table, lookup.prepare_lookup(table), families.load(spark, version["bundle"]))
        table, prepared, bundle = held[number]
        answers = families.score_ips(bundle, families.resolved(batch, table, mode, prepared))
        answers.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if after:
            after(epoch)

    return fn


def start_scored_stream(spark: SparkSession, source_dir: str, schema: str, versions: str, out: str, checkpoint: str, mode: str = "exact",
                        max_files_per_trigger: int | None = None, available_now: bool = False, after: Callable[[int], None] | None = None):
    """Start scoring the parquet files of IPs in ``source_dir``; read the answers
    with ``spark.read.parquet(out)``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = reader.parquet(source_dir).writeStream.foreachBatch(score_epoch_fn(spark, versions, out, mode, after)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
