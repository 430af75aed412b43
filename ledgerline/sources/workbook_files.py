"""Result workbooks as files: a Spark data source that publishes all of a job's files or none."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "result_workbooks"
#: How often the removal of a job's folder is tried while its last tasks end.
TRIES = 20


def file_name(key: str | None) -> str:
    """A key as a file's name; characters that have a meaning in paths are percent-encoded."""
    return (quote(key, safe=" ()&,'+-_.") if key else "unnamed") + ".xlsx"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder's URI or path, and the folder's path there."""
    plain = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    store, root = fs.FileSystem.from_uri(plain)
    return store, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """The files of one task that succeeded, below the job's folder."""

    files: list[str]


class WorkbookWriter(DataSourceWriter):
    """Tasks write below a folder of the job's own, which readers of the target skip; commit
    moves the files of the attempts that count to their names, abort removes the folder. The
    job's folder is made before any task runs and never by one, so a task that abort comes
    too early for finds no place to write and fails too."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.job = f"_pending-{uuid.uuid4().hex}"
        store, root = self._target()
        store.create_dir(f"{root}/{self.job}", recursive=True)

    def _target(self) -> tuple[fs.FileSystem, str]:
        return opened(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self._target()
        own = f"task-{TaskContext.get().taskAttemptId()}"
        store.create_dir(f"{root}/{self.job}/{own}", recursive=False)
        files = []
        for number, row in enumerate(iterator):
            at = f"{own}/{number}/{file_name(row['key'])}"
            store.create_dir(f"{root}/{self.job}/{own}/{number}", recursive=False)
            with store.open_output_stream(f"{root}/{self.job}/{at}") as out:
                out.write(row["content"])
            files.append(at)
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._target()
        files = [f for m in messages if m is not None for f in m.files]
        names = [f.rsplit("/", 1)[1] for f in files]
        there = [i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.is_file and i.path.endswith(".xlsx")]
        again = sorted(n for n, k in Counter(names).items() if k > 1)
        taken = sorted(set(names) & {p.rsplit("/", 1)[1] for p in there}) if not self.overwrite else []
        if again or taken:
            raise ValueError(f"nothing was written: several workbooks of one name {again[:5]}, names in use {taken[:5]}")
        for f, n in zip(files, names, strict=True):
            store.move(f"{root}/{self.job}/{f}", f"{root}/{n}")
        if self.overwrite:
            for p in there:
                if p.rsplit("/", 1)[1] not in names:
                    store.delete_file(p)
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*self._target())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        for turn in range(TRIES):
            if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.Directory:
                return
            try:
                store.delete_dir(f"{root}/{self.job}")
            except OSError:  # a task that is being ended wrote into it just now
                if turn == TRIES - 1:
                    raise


class ResultWorkbooks(DataSource):
    """Writes key, content (as sinks.result_workbooks gives them) to one .xlsx a key:
    df.write.format("result_workbooks").mode("append").save(path). Any store that pyarrow
    knows, by its URI; executors and driver must share it. append refuses names in use,
    overwrite replaces them and removes the folder's other workbooks. A task or a name that
    fails leaves the folder as it was; a driver lost within commit may leave a part moved."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"key", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {sorted(missing)}")
        return WorkbookWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResultWorkbooks)
