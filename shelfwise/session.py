"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every session built here gets. AQE re-plans joins and coalesces
# shuffle partitions at run time; skew-join splitting handles hot keys.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    master: str | None = None,
    app_name: str = "shelfwise",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; locally
    ``master="local[8]"``. ``shuffle_partitions`` defaults to Spark's own value,
    which AQE then coalesces.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None for a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        return None


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder
    and is used as is. When it is unset, a fresh folder under the system temp
    dir is created and registered for a ``local`` master only; elsewhere each
    executor would write to its own disk, so an error names the setting.
    """
    sc = _context(spark)
    current = spark.conf.get("spark.checkpoint.dir", None) or (
        sc.getCheckpointDir() if sc is not None else None
    )
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return (sc.getCheckpointDir() if sc is not None else None) or current
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(
            f"set spark.checkpoint.dir to a folder that all executors share (master {master!r})"
        )
    local = tempfile.mkdtemp(prefix="shelfwise-ckpt-", dir=os.environ.get("TMPDIR"))
    spark.conf.set("spark.checkpoint.dir", local)
    if sc is not None:
        sc.setCheckpointDir(local)
        return sc.getCheckpointDir() or local
    return local


_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Persist a frame that an operator reads more than once, until ``release``."""
    _HELD.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def release() -> int:
    """Unpersist every frame that operators hold; returns how many. A frame
    used again afterwards is computed again."""
    n = len(_HELD)
    while _HELD:
        _HELD.pop().unpersist()
    return n


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``shelfwise`` importable in Python workers (once per application).

    Grouped pandas UDFs reference functions of this package; workers import
    them by name. When the package is not installed on the executors (or
    passed with ``--py-files``), a zip of it is added with ``addPyFile``,
    which Spark distributes to every executor.
    """
    sc = _context(spark)
    key = sc.applicationId if sc is not None else spark.session_id
    if key in _SHIPPED:
        return
    if spark.conf.get("shelfwise.shipPackage", "true").lower() == "false":
        return  # installed on the executors, or passed with --py-files
    import zipfile
    from pathlib import Path

    pkg = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="shelfwise-pkg-")
    path = os.path.join(folder, "shelfwise.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(pkg.rglob("*.py")):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(key)
