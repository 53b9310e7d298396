"""Result files in order: a folder for each client, in it files of lines.

Rows (client_id, file, line) come ordered over all tasks. A task writes what it has of each file apart, under names that
no other attempt shares. Committing moves them to their places: a file that one task wrote whole is <client>/<file>, one
that several tasks share is <client>/<file>.00001 and so on, in order. The manifest is written last; files that it does
not name do not count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST, PENDING = "_manifest.json", "_pending"
ROWS = "client_id string, file string, n long, line string"
#: Lines that a reader sends on together.
BATCH = 20_000


def filesystem(folder: str):
    """(filesystem, path) of a folder named by a path or by an address such as file:// or hdfs://."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def client_folder(client_id: str | None) -> str:
    """A folder's name for any client: marks that paths can't hold are written in hex; none and empty have names of their own."""
    return "_none" if client_id is None else "_empty" if client_id == "" else "c-" + quote(client_id, safe="")


@dataclass
class Piece:
    """Some lines of a file, and which task wrote them."""

    client_id: str | None
    file: str
    path: str
    lines: int = 0
    task: int = 0
    nth: int = 0


@dataclass
class Pieces(WriterCommitMessage):
    pieces: list[Piece] = field(default_factory=list)


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, batches: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = filesystem(self.folder)
        fs.create_dir(f"{root}/{PENDING}", recursive=True)
        task, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        pieces: list[Piece] = []
        out, now = None, None
        for b in batches:
            for client_id, file, line in zip(*(b[c].to_pylist() for c in ("client_id", "file", "line"))):
                if (client_id, file) != now:
                    if out is not None:
                        out.close()
                    now = (client_id, file)
                    pieces.append(Piece(client_id, file, f"{PENDING}/{mine}-{len(pieces)}", 0, task, len(pieces)))
                    out = fs.open_output_stream(f"{root}/{pieces[-1].path}")
                out.write(((line or "") + "\n").encode())
                pieces[-1].lines += 1
        if out is not None:
            out.close()
        return Pieces(pieces)

    def commit(self, messages) -> None:
        fs, root = filesystem(self.folder)
        fs.create_dir(root, recursive=True)
        before = _manifest(fs, root)
        if before and not self.overwrite:
            raise ValueError(f"{self.folder} already holds results")
        files: dict[tuple, list[Piece]] = {}
        for p in sorted((p for m in messages if m is not None for p in m.pieces), key=lambda p: (p.task, p.nth)):
            files.setdefault((p.client_id, p.file), []).append(p)
        body = []
        for (client_id, file), pieces in files.items():
            folder = client_folder(client_id)
            fs.create_dir(f"{root}/{folder}")
            for k, p in enumerate(pieces, 1):
                path = f"{folder}/{file}" if len(pieces) == 1 else f"{folder}/{file}.{k:05d}"
                fs.move(f"{root}/{p.path}", f"{root}/{path}")
                p.path = path
            body.append({"client_id": client_id, "file": file, "parts": [[p.path, p.lines] for p in pieces]})
        with fs.open_output_stream(f"{root}/{MANIFEST}.new") as out:
            out.write(json.dumps(body).encode())
        fs.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
        kept = {path for f in body for path, _ in f["parts"]}
        for path in {path for f in before or [] for path, _ in f["parts"]} - kept:
            fs.delete_file(f"{root}/{path}")
        fs.delete_dir_contents(f"{root}/{PENDING}", missing_dir_ok=True)  # what failed attempts left

    def abort(self, messages) -> None:
        fs, root = filesystem(self.folder)
        for m in messages:
            for p in m.pieces if m is not None else ():
                fs.delete_file(f"{root}/{p.path}")


def _manifest(fs, root: str) -> list[dict] | None:
    if not fs.get_file_info(f"{root}/{MANIFEST}").is_file:
        return None
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


class Part(InputPartition):
    def __init__(self, client_id: str | None, file: str, path: str, before: int):
        self.client_id, self.file, self.path, self.before = client_id, file, path, before


class LinesReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list:
        fs, root = filesystem(self.folder)
        parts = []
        for f in _manifest(fs, root) or []:
            before = 0
            for path, lines in f["parts"]:
                parts.append(Part(f["client_id"], f["file"], path, before))
                before += lines
        return parts or [Part(None, "", "", 0)]

    def read(self, partition: Part) -> Iterator:
        import pyarrow as pa

        if not partition.path:
            return
        fs, root = filesystem(self.folder)
        n, rows = partition.before, []

        def batch():
            m = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([partition.client_id] * m, pa.string()), pa.array([partition.file] * m, pa.string()), pa.array(range(n - m + 1, n + 1), pa.int64()), pa.array(rows, pa.string())], ["client_id", "file", "n", "line"])

        rest = b""
        with fs.open_input_stream(f"{root}/{partition.path}") as f:
            while some := f.read(1 << 20):
                *whole, rest = (rest + some).split(b"\n")
                for line in whole:
                    rows.append(line.decode())
                    n += 1
                    if len(rows) == BATCH:
                        yield batch()
                        rows = []
        if rows:
            yield batch()


class ResultFiles(DataSource):
    """The format result_files: writes (client_id, file, line) in order, reads (client_id, file, n, line), n from 1."""

    @classmethod
    def name(cls) -> str:
        return "result_files"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"], overwrite)


def write_lines(lines: DataFrame, order: list[str], folder: str) -> None:
    """(client_id, file, line) and the columns of order: each file's lines in this order, whatever tasks they come from.

    Replaces what the folder held. A client's large file is cut between tasks, which need not hold it whole. Lines are
    put down once before they are dealt, as finding the ranges takes a pass of its own over them.
    """
    spark = lines.sparkSession
    spark.dataSource.register(ResultFiles)
    keys = ["client_id", "file", *order, "line"]
    unordered = f"{folder}/_unordered-{uuid.uuid4().hex}"
    lines.select(*keys).write.parquet(unordered)
    lines = spark.read.schema(lines.select(*keys).schema).parquet(unordered)
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("client_id", "file", "line").write.format("result_files").mode("overwrite").save(folder)
    fs, root = filesystem(unordered)
    fs.delete_dir(root)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(client_id, file, n, line) of all result files, n the line's number in its file."""
    spark.dataSource.register(ResultFiles)
    return spark.read.format("result_files").load(folder)
