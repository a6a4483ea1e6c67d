"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: list = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset and all runs on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        root = _own[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/pagemill-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((weakref.ref(spark), path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for ref, path in _made:
        spark = ref()
        try:
            if spark is not None and spark._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session is going down
            return


class Stash:
    """Tables written to the shared folder and read again, which cuts their lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, key: str, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{key}")
        schema = df.schema
        df.write.parquet(path)
        self.paths.setdefault(key, []).append(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *keys: str) -> None:
        """Delete tables that nothing reads any more."""
        for key in keys:
            for path in self.paths.pop(key, []):
                delete(self.spark, path)
