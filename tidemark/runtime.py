"""Session-level helpers: table access, lineage cuts and partition counts."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session that names none, and runs in one process, gets a folder of its own.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    context.setCheckpointDir(named)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The copy survives the loss of executors; use it before loops and before a result is read twice.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that they need no path of the driver's."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    here, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    path = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    path.write_bytes(packed.getvalue())
    context.addPyFile(str(path))
    context._tidemark_shipped = True


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table of one run, below the shared checkpoint folder."""
    import uuid

    _checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
