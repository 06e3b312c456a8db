"""Session settings and the one place where a plan is cut to durable storage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter brings the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablewarden")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_STEPS = threading.local()
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(session: SparkSession) -> Iterator[None]:
    """What a job within shuffles leaves the disks when the job is done. Else it stays until the driver happens to
    collect its garbage, and the shuffles of all jobs of a load or a batch lie there together."""
    before = session.conf.get(_DROP_SHUFFLES, "false")
    session.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        session.conf.set(_DROP_SHUFFLES, before)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and go on from the written rows.

    Needed where two branches must see the same row positions, also after an executor is lost; and
    Spark knows the bytes of what it reads back, and chooses joins with it by them. It also ends a phase:
    the shuffles before it need no disk any more. The folder is in
    the one the cluster names in ``spark.checkpoint.dir``; only a local session without one gets a
    folder of its own.
    """
    session = df.sparkSession
    shared = session.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not session.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="tablewarden-")
        session.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/work/{uuid.uuid4().hex}"
    with shuffles_dropped(session):
        df.write.option("compression", "zstd").parquet(path)
    kept = session.read.schema(df.schema).parquet(path)
    kept._written_at = path
    for made in getattr(_STEPS, "made", []):
        made.append(kept)
    return kept


def forget(*written: DataFrame) -> None:
    """Remove what ``durable`` wrote for these frames, once nothing reads them any more."""
    for df in written:
        session = df.sparkSession
        folder = session._jvm.org.apache.hadoop.fs.Path(df._written_at)
        folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)


def alone(build: Callable[[], DataFrame]) -> DataFrame:
    """The rows that ``build`` gives, written, and all that was written on the way to them removed."""
    steps = _STEPS.made = getattr(_STEPS, "made", [])
    steps.append(made := [])
    try:
        kept = durable(build())
    finally:
        steps.pop()
    forget(*[df for df in made if df is not kept])
    return kept
