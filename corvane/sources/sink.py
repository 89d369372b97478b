"""Markdown files as a Spark data source that is written whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class _Staged(WriterCommitMessage):
    """The folder in which a task has left its files."""

    folder: str


class NotesSink(DataSource):
    """Rows (file, content) as a file each below the option ``path``.

    Tasks write into a staging folder of their own, and the driver moves what the
    successful ones wrote into place, so a task that fails or runs twice leaves no
    file; where the job fails, the staging folder goes.
    """

    @classmethod
    def name(cls) -> str:
        return "markdown_notes"

    def schema(self) -> str:
        return "file string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], uuid.uuid4().hex)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, token: str):
        self._path, self._staging = path.rstrip("/"), f".staging-{token}"

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self._path if ":/" in self._path else f"file://{self._path}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, base = self._store()
        own = f"{base}/{self._staging}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        for row in iterator:
            name = row["file"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name!r} is no file below the folder")
            if "/" in name:
                store.create_dir(f"{own}/{name.rsplit('/', 1)[0]}", recursive=True)
            with store.open_output_stream(f"{own}/{name}") as f:
                f.write((row["content"] or "").encode())
        return _Staged(own)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, base = self._store()
        made = set()
        for message in messages:
            for info in store.get_file_info(fs.FileSelector(message.folder, recursive=True)):
                if info.type == fs.FileType.File:
                    target = f"{base}{info.path[len(message.folder) :]}"
                    parent = target.rsplit("/", 1)[0]
                    if parent not in made:
                        store.create_dir(parent, recursive=True)
                        made.add(parent)
                    store.move(info.path, target)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, base = self._store()
        if store.get_file_info(f"{base}/{self._staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self._staging}")
