"""A data source that writes one text file per document, and reads them back.

Rows (name, text) of a partition become files in one staging folder per task, one open
file at a time; rows of the same name in a row are one file. The driver then moves each
task's folder into place, a rename per task however many documents there are, so a
failed or repeated task leaves nothing behind, and neither does a failed job.

Reading, a task takes one such folder, which it lists itself: the driver sees the folders,
never the files, and a million small files are a few hundred tasks.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

#: File names, without suffix, of documents whose name is null or empty.
NO_NAME, EMPTY_NAME = "%00", "%01%"
#: Documents and characters that a task reads at a time; one longer document goes alone.
BATCH_ROWS, BATCH_CHARS = 1_000, 8_000_000


@dataclass
class Staged(WriterCommitMessage):
    folder: str | None
    number: int


def file_name(name: str | None, suffix: str) -> str:
    """A name that no file system minds; ``url_decode`` gives the document's name back."""
    safe = NO_NAME if name is None else quote(name, safe="") or EMPTY_NAME
    return f"{re.sub('^[._]', lambda m: f'%{ord(m[0]):02X}', safe)}.{suffix}"


def open_folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub("^file:", "file://", path))


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite, self.job = path.rstrip("/"), suffix, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = open_folder(self.path)
        task = TaskContext.get()
        number = task.partitionId()
        folder = f"{root}/_temporary/{self.job}/{number}-{task.taskAttemptId()}"
        name, out = None, None
        for batch in iterator:
            for key, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                if out is None or key != name:
                    if out is None:
                        files.create_dir(folder, recursive=True)
                    else:
                        out.close()
                    name, out = key, files.open_output_stream(f"{folder}/{file_name(key, self.suffix)}")
                out.write((text or "").encode("utf-8"))
        if out is None:
            return Staged(None, number)
        out.close()
        return Staged(folder, number)

    def commit(self, messages: list[Staged]) -> None:
        from pyarrow import fs

        files, root = open_folder(self.path)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.Directory and old.base_name.startswith("part-"):
                    files.delete_dir(old.path)
        for m in messages:
            if m is not None and m.folder:
                files.move(m.folder, f"{root}/part-{m.number:05d}-{self.job}")
        self._clean(files, root)
        files.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[Staged]) -> None:
        self._clean(*open_folder(self.path))

    def _clean(self, files, root: str) -> None:
        from pyarrow import fs

        job = f"{root}/_temporary/{self.job}"
        if files.get_file_info(job).type == fs.FileType.Directory:
            files.delete_dir(job)
        if not files.get_file_info(fs.FileSelector(f"{root}/_temporary", allow_not_found=True)):
            if files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
                files.delete_dir(f"{root}/_temporary")


@dataclass
class Folder(InputPartition):
    """A folder of documents, or without ``deep`` only the files beside the folders."""

    path: str
    deep: bool

    def __post_init__(self):
        super().__init__(self.path)


def hidden(path: str) -> bool:
    return any(part.startswith(("_", ".")) for part in path.split("/"))


class Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path.rstrip("/"), suffix

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        files, root = open_folder(self.path)
        found = files.get_file_info(fs.FileSelector(root))
        folders = sorted(f.path for f in found if f.type == fs.FileType.Directory and not hidden(f.base_name))
        return [Folder(root, False), *[Folder(f, True) for f in folders]]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = open_folder(self.path)
        names, texts, size = [], [], 0
        for info in files.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep)):
            inside = info.path[len(partition.path):].lstrip("/")
            if info.type != fs.FileType.File or not info.size or hidden(inside) or not inside.endswith(f".{self.suffix}"):
                continue
            with files.open_input_stream(info.path) as file:
                text = file.read().decode("utf-8", "replace")
            if names and (len(names) >= BATCH_ROWS or size + len(text) > BATCH_CHARS):
                yield pa.RecordBatch.from_pydict({"name": names, "text": texts})
                names, texts, size = [], [], 0
            names.append(info.base_name[: -len(self.suffix) - 1])
            texts.append(text)
            size += len(text)
        if names:
            yield pa.RecordBatch.from_pydict({"name": names, "text": texts})


class TextDocuments(DataSource):
    """``df.write.format("text_documents").option("suffix", "srt").save(path)`` of (name, text), and ``load``.

    Read names are those of the files; empty files are left out, as by Spark's readers.
    """

    @classmethod
    def name(cls) -> str:
        return "text_documents"

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("suffix", "txt"))

    def writer(self, schema, overwrite: bool) -> Writer:
        if sorted(schema.names) != ["name", "text"]:
            raise ValueError(f"columns name and text expected, not {schema.names}")
        return Writer(self.options["path"], self.options.get("suffix", "txt"), overwrite)


# The source travels with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
