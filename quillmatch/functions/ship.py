"""Python code and scratch folders for executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application; they may be on other machines."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="quillmatch-")) / f"{top.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(str(name))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of this machine only if Spark itself is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillmatch-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder: made once however often they are used, and of known size to the planner."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quillmatch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Sent:
    """The rows of df as Parquet files that Python workers read, without a copy in the driver.

    They are in the shared folder. Where that is mounted as files, workers read them there; from another store Spark sends them to
    each executor once.
    """

    def __init__(self, df: DataFrame):
        self.path = f"{shared_dir(df.sparkSession).rstrip('/')}/quillmatch-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.mounted = urlsplit(self.path).scheme in ("", "file")
        if not self.mounted:
            df.sparkSession.sparkContext.addFile(self.path, recursive=True)
        ship(df.sparkSession)

    def here(self) -> str:
        """The folder, for a worker."""
        return unquote(urlsplit(self.path).path) if self.mounted else SparkFiles.get(self.path.rsplit("/", 1)[1])
