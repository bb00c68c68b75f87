"""Files in the shared folder, from executors' Python: local or mounted paths by the operating system, others by pyarrow."""

from __future__ import annotations

import os
import uuid
from pathlib import Path
from typing import BinaryIO
from urllib.parse import urlparse


class Store:
    """A folder given by a path or a URI."""

    def __init__(self, uri: str):
        self.uri = uri
        scheme = urlparse(uri).scheme
        self.local = scheme in ("", "file")
        if self.local:
            self.root = urlparse(uri).path if scheme else uri
        else:
            from pyarrow.fs import FileSystem

            self.fs, self.root = FileSystem.from_uri(uri)
        self.root = self.root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def files(self) -> list[tuple[str, int]]:
        """Names under the folder (or '' for the one file that the path is) and sizes, sorted; hidden ones left out."""
        if self.local:
            if os.path.isfile(self.root):
                return [("", os.path.getsize(self.root))]
            found = [(str(p.relative_to(self.root)), p.stat().st_size) for p in Path(self.root).rglob("*") if p.is_file()] if os.path.isdir(self.root) else []
        else:
            from pyarrow.fs import FileSelector, FileType

            if self.fs.get_file_info(self.root).type == FileType.File:
                return [("", self.fs.get_file_info(self.root).size)]
            found = [(x.path[len(self.root) + 1 :], x.size) for x in self.fs.get_file_info(FileSelector(self.root, recursive=True, allow_not_found=True)) if x.type == FileType.File]
        return sorted(x for x in found if not any(part[0] in "._" for part in x[0].split("/")))

    def open(self, name: str) -> BinaryIO:
        return open(self.path(name), "rb") if self.local else self.fs.open_input_file(self.path(name))

    def create(self, name: str) -> BinaryIO:
        if self.local:
            os.makedirs(os.path.dirname(self.path(name)), exist_ok=True)
            return open(self.path(name), "wb")
        self.fs.create_dir(os.path.dirname(self.path(name)), recursive=True)
        return self.fs.open_output_stream(self.path(name))

    def move(self, a: str, b: str) -> None:
        os.replace(self.path(a), self.path(b)) if self.local else self.fs.move(self.path(a), self.path(b))

    def delete(self, name: str) -> None:
        try:
            os.remove(self.path(name)) if self.local else self.fs.delete_file(self.path(name))
        except FileNotFoundError:
            pass

    @staticmethod
    def unique() -> str:
        return uuid.uuid4().hex
