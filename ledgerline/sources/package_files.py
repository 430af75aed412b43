"""Word documents and spreadsheets as Spark data sources, with input partitions packed by size.

    spark.read.format("submission_documents").load(folder)
    spark.read.format("submission_tables").option("sheets", "Recount").load(folder)

Options: pattern (of file names; *.docx, or *.xlsx), partitionBytes (32 MiB), fileCost
(256 KiB, what opening a file counts as), sheets (names divided by |, of workbooks only).
A schema given by the reader names the columns that are wanted, and only these are decoded:
.schema("doc_id string, controls array<...>"). Any store that pyarrow knows, by its URI, which
driver and executors must share; for others, readers.files reads by Spark's own source.

Files are found in all folders below; lock files of open documents, and hidden and pending
files and folders (names that begin with . or _), are left out. A folder that is not there
is an error, one without files gives no rows. Files of one name are a row each. A file that
cannot be decoded is a row with its error, also an empty one, which readers.files does not
find; one that has gone since it was found fails its task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ledgerline.sources.readers import DOCUMENT_TYPES, TABLE_TYPES, document_columns, table_columns
from ledgerline.sources.workbook_files import opened

PARTITION_BYTES, FILE_COST = 32 << 20, 256 << 10
#: What a task decodes at once, unless a single file is larger.
BATCH_BYTES, BATCH_FILES = 8 << 20, 256


@dataclass
class Files(InputPartition):
    """Paths, and sizes, of the files of one partition."""

    found: list[tuple[str, int]]


def packed(found: list[tuple[str, int]], limit: int, cost: int) -> list[list[tuple[str, int]]]:
    """Files (path, size) in parts of at most limit, each file counting cost more than its
    size: the largest first, so a file beyond limit is a part of its own and small ones fill
    up the rest."""
    parts: list[list[tuple[str, int]]] = []
    room = 0
    for path, size in sorted(found, key=lambda f: (-f[1], f[0])):
        if not parts or size + cost > room:
            parts.append([])
            room = limit
        parts[-1].append((path, size))
        room -= size + cost
    return parts


def batches(found: list[tuple[str, int]]) -> Iterator[list[str]]:
    """Paths in groups of at most BATCH_FILES and of about BATCH_BYTES."""
    group: list[str] = []
    held = 0
    for path, size in found:
        if group and (len(group) == BATCH_FILES or held + size > BATCH_BYTES):
            yield group
            group, held = [], 0
        group.append(path)
        held += size
    if group:
        yield group


class PackageReader(DataSourceReader):
    """Finds and packs files on the driver (names and sizes only) and decodes them in tasks."""

    def __init__(self, options: dict[str, str], pattern: str, wanted: list[str]) -> None:
        self.path, self.wanted = options["path"], wanted
        self.pattern = options.get("pattern", pattern)
        self.limit = int(options.get("partitionBytes", PARTITION_BYTES))
        self.cost = int(options.get("fileCost", FILE_COST))
        self.sheets = frozenset(options["sheets"].split("|")) if options.get("sheets") else None

    def _is_wanted(self, below: str) -> bool:
        name = below.rpartition("/")[2]
        hidden = any(part.startswith((".", "_")) for part in below.split("/"))
        return fnmatchcase(name, self.pattern) and not name.startswith("~$") and not hidden

    def partitions(self) -> list[Files]:
        store, root = opened(self.path)
        infos = store.get_file_info(fs.FileSelector(root, recursive=True))
        found = [(i.path, i.size) for i in infos if i.is_file and self._is_wanted(i.path.removeprefix(root).lstrip("/"))]
        return [Files(part) for part in packed(found, self.limit, self.cost)] or [Files([])]

    def decode(self, contents: list[bytes]) -> dict[str, pa.Array]:
        raise NotImplementedError

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        for group in batches(partition.found):
            contents = []
            for path in group if len(self.wanted) > 1 or self.wanted != ["doc_id"] else ():
                with store.open_input_stream(path) as source:
                    contents.append(source.read())
            columns = {"doc_id": pa.array([p.rpartition("/")[2] for p in group]), **(self.decode(contents) if contents else {})}
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.wanted], self.wanted)


class DocumentReader(PackageReader):
    def decode(self, contents: list[bytes]) -> dict[str, pa.Array]:
        return document_columns(contents, self.wanted)


class TableReader(PackageReader):
    def decode(self, contents: list[bytes]) -> dict[str, pa.Array]:
        return table_columns(contents, self.sheets)


class SubmissionDocuments(DataSource):
    """doc_id (file name) and what readers.decode_documents gives."""

    TYPES, PATTERN, READER = DOCUMENT_TYPES, "*.docx", DocumentReader

    @classmethod
    def name(cls) -> str:
        return "submission_documents"

    def schema(self) -> StructType:
        return from_arrow_schema(pa.schema({"doc_id": pa.string(), **self.TYPES}))

    def reader(self, schema: StructType) -> DataSourceReader:
        whole = self.schema()
        wrong = [f.name for f in schema if f.name not in whole.names or f.dataType != whole[f.name].dataType]
        if wrong or not schema.names:
            raise ValueError(f"columns and types must be among {whole.simpleString()}; not {wrong}")
        return self.READER(self.options, self.PATTERN, schema.names)


class SubmissionTables(SubmissionDocuments):
    """doc_id (file name), cells, error, as readers.decode_tables gives them."""

    TYPES, PATTERN, READER = TABLE_TYPES, "*.xlsx", TableReader

    @classmethod
    def name(cls) -> str:
        return "submission_tables"


def register(spark: SparkSession) -> None:
    for source in (SubmissionDocuments, SubmissionTables):
        spark.dataSource.register(source)
