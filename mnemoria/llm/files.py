"""Binary files of executors in the shared folder, by whatever file system its address names."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def file_system(address: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; plain paths are local."""
    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:/") else f"file://{os.path.abspath(address)}")


class Attempt:
    """A file that appears under its name only when it is whole, so a lost or repeated task leaves no half file."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.final = f"{base}/{name}"
        self.temporary = f"{base}/_{name}.{uuid.uuid4().hex}"

    def __enter__(self):  # noqa: ANN204
        self.out = self.fs.open_output_stream(self.temporary)
        return self.out

    def __exit__(self, kind: object, *_: object) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.temporary, self.final)
        else:
            self.fs.delete_file(self.temporary)
