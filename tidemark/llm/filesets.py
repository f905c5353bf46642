"""Sets of files that Python data sources write and read, with a manifest that makes them visible."""

from __future__ import annotations

import json
import mmap
import uuid

from pyarrow import fs

MANIFEST = "_manifest.json"


class FileSet:
    """Files below one folder, on any file system that Arrow opens (local, HDFS, object stores).

    Tasks write files of fresh names. Only the driver's commit lists them in the manifest, and readers
    see nothing else; so a task that was lost and repeated leaves at most a file nobody reads.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def _open(self):
        system, folder = fs.FileSystem.from_uri(self.path)
        return system, folder.rstrip("/")

    def create(self, suffix: str):
        """A new file's name and stream."""
        system, folder = self._open()
        system.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex + suffix
        return name, system.open_output_stream(f"{folder}/{name}", compression=None)

    def open(self, name: str):
        system, folder = self._open()
        return system.open_input_file(f"{folder}/{name}")

    def put(self, name: str, data: bytes) -> None:
        system, folder = self._open()
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
            out.write(data)

    def get(self, name: str) -> bytes:
        with self.open(name) as stream:
            return stream.read()

    def publish(self, entries: list[dict]) -> None:
        self.put(MANIFEST, json.dumps(entries).encode())

    def entries(self) -> list[dict]:
        return json.loads(self.get(MANIFEST))

    def remove(self, names: list[str]) -> None:
        system, folder = self._open()
        for name in names:
            system.delete_file(f"{folder}/{name}")

    def mapped(self, name: str):
        """A file's bytes: mapped into memory where the folder is a local or mounted one, else read."""
        system, folder = self._open()
        if isinstance(system, fs.LocalFileSystem):
            with open(f"{folder}/{name}", "rb") as file:
                return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        return self.get(name)
