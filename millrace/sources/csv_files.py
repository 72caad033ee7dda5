"""A data source that writes text lines to files with exact names, by its commit protocol.

``df.write.format("csv_files")`` takes (chunk long, line string) whose chunks 0, 1, ... are each whole in one partition and in
order there (``repartition("chunk").sortWithinPartitions(...)``). A task writes each chunk beside its place and moves it to
``<base>_<chunk + 1>.csv`` when it is whole, so a second attempt of a task replaces a file by an equal one, and the driver
renames nothing. The commit checks that every chunk came once and none is missing, and writes ``_<base>.manifest``: one line of
JSON (chunk, path, rows, bytes) for each file, in order. What the manifest does not list is not part of the output; an aborted
job takes away what its finished tasks wrote and the manifest, if there was one of an earlier write under the same names. Files go through pyarrow's file systems: a plain path,
``file:``, ``hdfs:`` or ``s3a:``.

Defined cases: without rows there is no file and the manifest is empty; a chunk that is split over tasks, comes twice or is
missing is an error; null lines are empty.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LINE_END = "\r\n"


def file_system(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri("s3://" + path[len("s3a://") :] if path.startswith("s3a://") else path)


@dataclass
class Written(WriterCommitMessage):
    files: list  # (chunk, path, rows, bytes)


class CsvWriter(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.folder, self.base, self.header = options["path"].rstrip("/"), options["base"], options.get("head")

    def path(self, chunk: int) -> str:
        return f"{self.folder}/{self.base}_{chunk + 1}.csv"

    def manifest(self) -> str:
        return f"{self.folder}/_{self.base}.manifest"

    def write(self, iterator: Iterator) -> Written:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        beside, files, out = f"{folder}/.{self.base}-{uuid.uuid4().hex}", [], None

        def close() -> None:
            out.close()
            fs.move(beside, file_system(self.path(files[-1][0]))[1])

        try:
            for batch in iterator:
                chunks, lines = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)] if len(chunks) else [0]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    chunk, text = int(chunks[a]), ""
                    if not files or files[-1][0] != chunk:
                        if out is not None:
                            close()
                        out = fs.open_output_stream(beside)
                        files.append([chunk, self.path(chunk), 0, 0])
                        text = self.header + LINE_END if self.header is not None else ""
                    data = (text + "".join((line or "") + LINE_END for line in lines.slice(a, b - a).to_pylist())).encode()
                    out.write(data)
                    files[-1][2] += b - a
                    files[-1][3] += len(data)
            if out is not None:
                close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
                fs.delete_file(beside)
            raise
        return Written(files)

    def commit(self, messages: list) -> None:
        files = sorted(list(f) for m in messages if m is not None for f in m.files)
        if [f[0] for f in files] != list(range(len(files))):
            raise ValueError(f"chunks of {self.base} are missing, or are split over tasks")
        fs, path = file_system(self.manifest())
        fs.create_dir(file_system(self.folder)[1], recursive=True)
        staged = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(staged) as out:
            out.write("".join(json.dumps(dict(zip(("chunk", "path", "rows", "bytes"), f, strict=True))) + "\n" for f in files).encode())
        fs.move(staged, path)

    def abort(self, messages: list) -> None:
        remove_files([self.manifest(), *(f[1] for m in messages if m is not None for f in m.files)])


class CsvFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_files"

    def writer(self, schema, overwrite: bool) -> CsvWriter:
        return CsvWriter(self.options)


def write_chunks(rows: DataFrame, folder: str, base: str, head: str | None) -> list[dict]:
    """Write (chunk, line) and return the manifest."""
    spark = rows.sparkSession
    spark.dataSource.register(CsvFiles)
    options = {"path": folder, "base": base} | ({"head": head} if head is not None else {})
    rows.write.format("csv_files").mode("append").options(**options).save()
    return read_manifest(folder, base)


def read_manifest(folder: str, base: str) -> list[dict]:
    """What the last committed write of ``base`` consists of, one entry a file."""
    fs, path = file_system(f"{folder.rstrip('/')}/_{base}.manifest")
    with fs.open_input_stream(path) as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def remove_files(paths: list[str]) -> None:
    """Delete files of any file system; those that are gone already are no fault."""
    for path in paths:
        fs, inside = file_system(path)
        if fs.get_file_info(inside).is_file:
            fs.delete_file(inside)
