"""What the operators share: tables in the cluster's shared folder and bounded memos in Python workers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where a session on one machine names none (tests), a new local one is set.

    On a cluster without that setting it raises: executors don't share the folders of the driver's machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: later stages survive lost executors without its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or that with underscores behind it, so that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Length from which a key isn't kept in a memo, so that memos are bounded in bytes too; bytes of keys after which rows are emptied.
LONG, BYTES = 64, 1 << 26


class Memo(dict):
    """A function's values for the keys (texts, bytes or tuples) seen so far in this Python worker; emptied when it holds `most`, long keys are never held."""

    def __init__(self, of, most: int = 200_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(key) > LONG:
            return self.of(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.of(key)
        return value


class Recent(Memo):
    """A memo of two generations: when `most` keys are held, they become the older one, from which keys come back when they are met again."""

    def __init__(self, of, most: int = 200_000):
        super().__init__(of, most)
        self.older: dict = {}

    def __missing__(self, key):
        if len(key) > LONG:
            return self.of(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.of(key)
        self[key] = value
        return value


class Rows(dict):
    """Rows of numbers of a function for the keys seen so far in this Python worker, and their sums over lists of keys; emptied when `most` or BYTES are held."""

    def __init__(self, of, width: int, most: int = 200_000):
        super().__init__()
        self.of, self.most, self.table, self.held = of, most, np.zeros((most, width)), 0

    def __missing__(self, key):
        row = self.of(key)
        at = self[key] = len(self)
        self.table[at] = row
        self.held += len(key)
        return at

    def sum(self, keys: list) -> np.ndarray:
        total = np.zeros(self.table.shape[1])
        step = self.most // 4
        for start in range(0, len(keys), step):
            part = keys[start : start + step]
            if len(self) + len(part) > self.most or self.held > BYTES:
                self.clear()
                self.held = 0
            total += self.table[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return total
