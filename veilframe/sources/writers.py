"""Outputs: protected texts, counts-only reports, rules and images."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.rules import Rules


def protected(df: DataFrame, path: str, *keys: str) -> None:
    """Protected texts as Parquet, without the originals that mappings hold."""
    df.select(*keys, "text", "status", "count").write.mode("overwrite").parquet(path)


def report(counts: DataFrame, path: str) -> None:
    """A counts-only report as CSV; it takes no column that could hold content."""
    safe = [c for c, t in counts.dtypes if t in ("bigint", "int") or c in ("kind", "lang", "source", "status")]
    counts.select(*safe).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _place(spark: SparkSession, path: str):
    """Hadoop's file context for a path, and a function that makes its paths."""
    jvm, p = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(p(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()), p


def rules(spark: SparkSession, r: Rules, path: str) -> None:
    """Rules as one JSON document at path, taken into use whole or not at all.

    Each write is a version of its own, a folder that Spark commits; then the pointer CURRENT, written aside, is renamed
    over the old one, which file systems do at once. A write that fails before that leaves the rules as they were; a
    version that nothing points to is removed by the next write.
    """
    body = json.dumps({"always": r.always, "never": r.never, "moneyDates": r.money_dates})
    version = f"v-{uuid.uuid4().hex}"
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{path}/{version}")
    files, p = _place(spark, path)
    jvm = spark.sparkContext._jvm
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    out = files.create(p(f"{path}/.{version}"), flags, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(version.encode())
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(p(f"{path}/.{version}"), p(f"{path}/CURRENT"), over)
    every = files.util().listStatus(p(path))
    for f in every:
        if f.getPath().getName().startswith("v-") and f.getPath().getName() != version:
            files.delete(f.getPath(), True)


@dataclass
class Attempt(WriterCommitMessage):
    """A task's attempt that is done: its folder and number of files."""

    folder: str
    files: int


class PngFiles(DataSource):
    """A sink of image files: rows (name, content) to files under path, through Spark's commit.

    Tasks write to a folder beside path, each attempt to one of its own. Once all are done the driver moves the attempts
    that count to a new folder, and that to path, in one rename; where a task fails the write is aborted and the folder
    goes. So path has all files or none, and what a lost attempt left isn't among them. path must not exist yet.
    """

    @classmethod
    def name(cls) -> str:
        return "png_files"

    def writer(self, schema: StructType, overwrite: bool) -> PngWriter:
        made = PngWriter(self.options["path"])
        store, root = made._store(made.aside)
        store.create_dir(root)  # by the driver only: a task that outlives an abort can't make it again
        return made


class PngWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.aside = f"{self.path}.aside-{uuid.uuid4().hex}"

    def _store(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def write(self, rows: Iterator[Row]) -> Attempt:
        store, root = self._store(self.aside)
        own = f"{root}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=False)
        names = []
        for r in rows:
            if r["content"] is None:
                continue
            name = checked_name(r["name"])
            with store.open_output_stream(f"{own}/{len(names)}") as out:
                out.write(r["content"])
            names.append(name)
        with store.open_output_stream(f"{own}/names") as out:
            out.write(json.dumps(names).encode())
        return Attempt(own, len(names))

    def commit(self, messages: list[Attempt | None]) -> None:
        store, root = self._store(self.aside)
        target = self._store(self.path)[1]
        if store.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(target)
        ready = f"{root}/ready"
        store.create_dir(ready)
        for m in messages:
            if m is None:
                continue
            with store.open_input_stream(f"{m.folder}/names") as f:
                names = json.loads(f.read())
            for i, name in enumerate(names):
                store.move(f"{m.folder}/{i}", f"{ready}/{name}")
        store.move(ready, target)
        store.delete_dir(root)

    def abort(self, messages: list[Attempt | None]) -> None:
        store, root = self._store(self.aside)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def checked_name(name: str | None) -> str:
    """A name that ends in .png, whatever its case, and names no folder."""
    if not name or not name.lower().endswith(".png") or "/" in name or "\\" in name or ".." in name:
        raise ValueError("an image's name must end in .png and name no folder")
    return name


def png_files(df: DataFrame, path: str) -> None:
    """Redacted images (name, content) as files under path, a new folder or URI of a store that pyarrow writes to: all of them or none. Images without content have no file; of images that share a name one stays."""
    wrong = ~F.coalesce(F.lower("name").endswith(".png"), F.lit(False)) | F.col("name").rlike(r"[/\\]|\.\.")
    if not df.where("content IS NOT NULL").where(wrong).isEmpty():
        raise ValueError("an image's name must end in .png and name no folder")
    df.sparkSession.dataSource.register(PngFiles)
    df.select("name", "content").write.format("png_files").mode("append").save(path)


def images(df: DataFrame, path: str) -> None:
    """Redacted images (name, content): names must end in .png, whatever its case. Written as a table of binary rows, so through Spark's commit."""
    wrong = df.where(~F.lower("name").endswith(".png")).limit(1).count()
    if wrong:
        raise ValueError("an image's name must end in .png")
    df.select("name", "content").write.mode("overwrite").parquet(path)
