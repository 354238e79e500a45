"""Alerts handed out in two phases: staged by tasks, published by one file.

A task writes its lines to a file of its own and says so in a message. Only when all tasks
have done that does the driver publish the batch: one small file that lists the staged
ones in printing order, and appears whole. What a task that failed, or ran twice, has
staged is in no list, so a reader never sees an alert twice or half a report; a run that
fails removes what it staged and leaves the earlier report of its batch as it was.

    <path>/staged/<run>/<partition>-<attempt>.txt
    <path>/batch_id=N.json

The folder is reached through ``pyarrow.fs``, by a path or a URI that every executor has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from sift.operators.routing import alert_lines, in_printing_order
from sift.params import Thresholds

FORMAT = "sift_outbox"


def _opened(path: str) -> tuple[filesystems.FileSystem, str]:
    return filesystems.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _report(root: str, batch_id: int) -> str:
    return f"{root}/batch_id={batch_id}.json"


@dataclass
class Staged(WriterCommitMessage):
    """What one task has staged."""

    partition: int
    file: str
    n_alerts: int


class OutboxWriter(DataSourceWriter):
    """Stages in tasks; publishes or removes in the driver."""

    def __init__(self, path: str, batch_id: int, run: str) -> None:
        self.path, self.batch_id, self.run = path, batch_id, run

    def write(self, iterator: Iterator[Row]) -> Staged:
        task = TaskContext.get()
        partition = task.partitionId()
        files, root = _opened(self.path)
        files.create_dir(f"{root}/staged/{self.run}", recursive=True)
        # The task's own id tells its tries apart, also two that run at the same time.
        name, n = f"{partition:06}-{task.taskAttemptId()}.txt", 0
        with files.open_output_stream(f"{root}/staged/{self.run}/{name}") as out:
            for row in iterator:
                out.write(row["text"].encode() + b"\n")
                n += row["is_alert"]
        return Staged(partition, name, n)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = _opened(self.path)
        staged = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        report = {"run": self.run, "files": [m.file for m in staged], "n_alerts": sum(m.n_alerts for m in staged)}
        files.create_dir(root, recursive=True)
        draft = f"{root}/.{self.run}.json"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps(report).encode())
        before = _published(files, root, self.batch_id)
        files.move(draft, _report(root, self.batch_id))
        if before is not None:
            _remove(files, root, before["run"])

    def abort(self, messages: list[Staged | None]) -> None:
        files, root = _opened(self.path)
        _remove(files, root, self.run)


def _published(files: filesystems.FileSystem, root: str, batch_id: int) -> dict | None:
    if files.get_file_info(_report(root, batch_id)).type != filesystems.FileType.File:
        return None
    with files.open_input_stream(_report(root, batch_id)) as report:
        return json.loads(report.read())


def _remove(files: filesystems.FileSystem, root: str, run: str) -> None:
    if files.get_file_info(f"{root}/staged/{run}").type == filesystems.FileType.Directory:
        files.delete_dir(f"{root}/staged/{run}")


class Outbox(DataSource):
    """``df.write.format("sift_outbox")`` with the options ``path``, ``batch_id`` and ``run``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "text string, is_alert int"

    def writer(self, schema: StructType, overwrite: bool) -> OutboxWriter:
        options = self.options
        return OutboxWriter(options["path"], int(options["batch_id"]), options["run"])


def write_outbox(routed: DataFrame, thresholds: Thresholds, path: str, batch_id: int) -> None:
    """Hand out the alerts of a batch; again, they take the place of its earlier report."""
    spark = routed.sparkSession
    spark.dataSource.register(Outbox)
    lines = in_printing_order(alert_lines(routed, thresholds)).select("text", "is_alert")
    options = {"path": path, "batch_id": str(batch_id), "run": uuid.uuid4().hex}
    lines.write.format(FORMAT).options(**options).mode("append").save()


def outbox_sink(path: str, thresholds: Thresholds) -> Callable[[DataFrame, int], None]:
    return lambda routed, batch_id: write_outbox(routed, thresholds, path, batch_id)


def read_outbox(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The report of a batch, as ``place`` of the file and ``text``; no rows if there is none."""
    files, root = _opened(path)
    report = _published(files, root, batch_id)
    if not report or not report["files"]:
        return spark.createDataFrame([], "place int, text string")
    paths = [f"{path.rstrip('/')}/staged/{report['run']}/{name}" for name in report["files"]]
    read = spark.read.text(paths, wholetext=True).selectExpr("value AS text", "_metadata.file_name AS name")
    return read.selectExpr("cast(split_part(name, '-', 1) AS int) AS place", "text")


def report_of(spark: SparkSession, path: str, batch_id: int) -> str:
    """The report of a batch as one text, for a short one."""
    return "".join(r.text for r in read_outbox(spark, path, batch_id).orderBy("place").collect())
