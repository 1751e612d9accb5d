"""A table of batches, each replaced as a whole by a commit that readers see at once or not at all.

    <path>/data/version=<token>/<key>=<batch>/...   rows, written once and never changed
    <path>/commits/<number>                         one JSON line per batch that the commit replaces, with its version

The newest commit that names a batch says which version of it counts. A commit is written aside and renamed to the next number; a rename never
replaces a file, so of two writers that want the same number one sees the other's commit first. It then checks what that
commit replaced and is refused if a batch is among it. Rows of a failed or refused write are never named by a commit and so never read.
The rename has to be atomic in the store (HDFS and local folders are).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "__HIVE_DEFAULT_PARTITION__"  # how partition folders name a null
LOG = "batch string, version string, number long, empty boolean"


# The characters that partition folders write as % and two hexadecimal digits.
ESCAPED = frozenset("\"#%'*/:=?\\{[]^\x7f" + "".join(map(chr, range(1, 32))))


def folder_of(key: str, value) -> str:
    """Name of the partition folder of a value."""
    return f"{key}=" + "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in str(value))


class Refused(RuntimeError):
    """A commit that another writer, or a batch in work, stands against; the table is as it was."""


@dataclass(frozen=True)
class Written:
    """Rows in place under a version, not yet seen by readers; head is the last commit before they were worked out."""

    version: str
    batches: tuple[str, ...]
    empty: frozenset[str]
    head: int


class BatchTable:
    """Batches of rows under `path` by the column `key`. `most` bounds the batches of one commit, which pass through the driver by name."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str = "batch_id", most: int = 100_000):
        self.spark, self.path, self.key, self.most = spark, path, key, most
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # -- folders

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def head(self) -> int:
        """Number of the last commit; 0 before the first."""
        folder = self._at("commits")
        if not self._fs().exists(folder):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs().listStatus(folder) if f.getPath().getName().isdigit()), default=0)

    # -- reading

    def _log(self, after: int = 0) -> DataFrame:
        head = self.head()
        if head <= after:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json([f"{self.path}/commits/{n:012d}" for n in range(after + 1, head + 1)])

    def current(self, log: DataFrame | None = None) -> DataFrame:
        """(batch, version, number, empty) that count now."""
        last = F.max_by(F.struct("version", "number", "empty"), "number")
        return (self._log() if log is None else log).groupBy("batch").agg(last.alias("l")).select("batch", "l.*")

    def read(self, batches: Iterable | None = None) -> DataFrame:
        """The rows of all batches, or of those named, as of the last commit; what is committed later doesn't change them."""
        names, now = [f.name for f in self.schema], self.current().where("not empty")
        parts = T.StructType([*(f for f in self.schema if f.name != self.key), T.StructField("version", T.StringType()), T.StructField(self.key, T.StringType())])
        files = self.spark.read.schema(parts).option("basePath", f"{self.path}/data")
        if batches is not None:  # their folders alone
            found = now.where(F.col("batch").isin([str(b) for b in batches])).collect()
            folders = [f"{self.path}/data/version={r.version}/{folder_of(self.key, r.batch)}" for r in found]
            rows = files.parquet(*folders) if folders else None
        elif now.isEmpty():
            rows = None
        else:  # folders are pruned by the versions that count, known before the scan
            rows = files.parquet(f"{self.path}/data").join(now.select(F.col("batch").alias(self.key), "version"), ["version", self.key])
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        return rows.withColumn(self.key, F.col(self.key).cast(self.schema[self.key].dataType)).select(*names)

    # -- writing

    def write(self, rows: DataFrame, replaced: Iterable | None = None) -> Written:
        """Put rows in place. They replace the batches they hold and those named in `replaced`, which may hold no row any more."""
        head, version = self.head(), uuid.uuid4().hex
        path = f"{self.path}/data/version={version}"
        # a batch's rows come together, in few files; Spark splits a batch that is large
        rows.select(*[f.name for f in self.schema]).hint("rebalance", self.key).write.partitionBy(self.key).parquet(path)
        found = [f.getPath().getName() for f in self._fs().listStatus(self._hadoop.Path(path)) if f.isDirectory()]
        held = {unquote(name.partition("=")[2]) for name in found if name.startswith(f"{self.key}=")}
        if NULL in held:
            raise ValueError(f"rows without a {self.key}")
        named = held | {str(b) for b in replaced or ()}
        if len(named) > self.most:
            raise ValueError(f"{len(named)} batches in one commit, {self.most} at most")
        return Written(version, tuple(sorted(named)), frozenset(named - held), head)

    def commit(self, written: Written, in_work: DataFrame | None = None, tries: int = 100) -> int:
        """Make written rows the ones that count; the number of the commit. Refused if another commit has replaced one of the batches since
        the write began, or if one of them is among in_work(batch) now."""
        fs, folder = self._fs(), self._at("commits")
        fs.mkdirs(folder)
        seen = written.head
        for _ in range(tries):
            head = self.head()
            if head > seen:
                mine = self.spark.createDataFrame([(b,) for b in written.batches], "batch string")
                if taken := self._log(seen).join(mine, "batch", "left_semi").limit(5).collect():
                    raise Refused(f"batches {sorted({r.batch for r in taken})} were replaced by another writer")
                seen = head
            if in_work is not None:
                busy = in_work.where(F.col("batch").cast("string").isin(list(written.batches))).limit(5).collect()
                if busy:
                    raise Refused(f"batches {sorted(str(r.batch) for r in busy)} are in work")
            lines = "".join(json.dumps({"batch": b, "version": written.version, "number": head + 1, "empty": b in written.empty}) + "\n" for b in written.batches)
            aside = self._at(f"aside/{uuid.uuid4().hex}")
            out = fs.create(aside, False)
            out.write(bytearray(lines.encode()))
            out.close()
            if self._named(aside, self._at(f"commits/{head + 1:012d}")):
                return head + 1
        raise Refused(f"other writers were faster {tries} times")

    def _named(self, aside, target) -> bool:
        """Give a file written aside its number in one step; False if the number is taken."""
        fs = self._fs()
        try:
            if fs.getUri().getScheme() == "file":  # Hadoop renames a file and its checksum one after the other here; a link is one step
                os.link(aside.toUri().getPath(), target.toUri().getPath())
            else:
                options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
                how = self.spark.sparkContext._gateway.new_array(options, 1)
                how[0] = options.NONE  # an existing file is not replaced
                self._hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, how)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            return False
        finally:
            fs.delete(aside, False)

    def replace(self, rows: DataFrame, replaced: Iterable | None = None, in_work: DataFrame | None = None) -> int:
        return self.commit(self.write(rows, replaced), in_work)

    def vacuum(self) -> int:
        """Remove versions that no commit names or whose batches have all been replaced; how many went. Not while others read or write."""
        if not self._fs().exists(self._at("data")):
            return 0
        live = {r.version for r in self.current().where("not empty").select("version").distinct().toLocalIterator()}
        gone = [f.getPath() for f in self._fs().listStatus(self._at("data")) if f.getPath().getName().partition("=")[2] not in live]
        for path in gone:
            self._fs().delete(path, True)
        return len(gone)
