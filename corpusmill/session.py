"""Session settings and helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a context, unless their search path has it."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    found = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if getattr(context, "_corpusmill_shipped", False) or str(root) in found:
        return
    context._corpusmill_shipped = True
    folder = tempfile.mkdtemp(prefix="corpusmill-")  # Spark serves the file from here as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/corpusmill", "zip", root, "corpusmill"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, pruned to ``columns`` if any are named."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) a temporary one is made where that is unset;
    on a cluster its absence is an error, as executors don't share a machine's folders.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """What runs inside passes at most ``rows`` rows (None: as set) to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows is not None:
        spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """What runs inside broadcasts a table unasked only after its rows were measured in a shuffle.

    Spark takes the size of a stored table from its compressed files, which may be a hundredth of its
    rows: it would build a broadcast table that the driver can't hold.
    """
    key, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, measured = spark.conf.get(key), spark.conf.get(adaptive, None)
    spark.conf.set(adaptive, before if measured is None else measured)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)
        if measured is None:
            spark.conf.unset(adaptive)
        else:
            spark.conf.set(adaptive, measured)


def store(df: DataFrame, name: str = "part", batch: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Its lineage is cut and executors may be lost. The optimizer starts afresh: DataFrame.checkpoint
    keeps the constraints of its plan, whose number explodes in loops. ``batch`` bounds the rows of an
    Arrow batch on the way, for rows that may be very long.
    """
    path = f"{_shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _stored.append(path)
    with batches_of(df.sparkSession, batch):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


cut = store

#: Folders written by ``store`` since the last ``release``.
_stored: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes what ``store`` wrote in this process; results that still read it must have been written before. Gives the number of folders."""
    context, gone = spark.sparkContext, 0
    while _stored:
        path = context._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        gone += path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ascii_lower(column) -> F.Column:
    """Lower-case A-Z alone, as the word rules ask; other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


#: Bytes of a table that may be broadcast, and what a row takes beside its texts and numbers: a row of one number took 100 bytes
#: of a broadcast table that was joined by ``eqNullSafe`` (key, value, their lengths and places).
MOST_BROADCAST, ROW_BYTES = 32 * 2**20, 96


def broadcast_if_small(narrow: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``narrow`` marked for broadcast if it takes at most ``most`` bytes, else for a shuffled join, whatever its files take."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    texts = [f.name for f in narrow.schema if not isinstance(f.dataType, fixed)]
    row = ROW_BYTES + 8 * (len(narrow.columns) - len(texts))
    sizes = (F.sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))) for c in texts)
    count, *lengths = narrow.limit(most // row + 1).agg(F.count(F.lit(1)), *sizes).first()
    return F.broadcast(narrow) if count * row + sum(n or 0 for n in lengths) <= most else narrow.hint("merge")


#: Rows of one key from which on its group is joined by broadcast.
HOT = 1_000_000


def join_back(rows: DataFrame, groups: DataFrame, on: str | Sequence[str], count: str = "n", hot: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``groups``, one row for each value of ``on``; ``count`` tells its rows and goes.

    Groups of more than ``hot`` rows (there are at most rows / hot) are joined by broadcast, so no
    task gathers such a group. Both tables are read several times: store them first. Null values of ``on`` meet nothing.
    """
    hot = HOT if hot is None else hot
    on = [on] if isinstance(on, str) else list(on)
    large = groups.filter(F.col(count) > hot)
    if large.isEmpty():
        return rows.join(groups.drop(count), on)
    large = broadcast_if_small(large.drop(count))
    rest = rows.join(large.select(*on), on, "left_anti").join(groups.filter(F.col(count) <= hot).drop(count), on)
    return rows.join(large, on).unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
