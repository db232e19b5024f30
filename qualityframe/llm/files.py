"""Binary files that tasks write to the shared folder and read back.

Any store that Arrow's file systems reach will do. A file carries the number of its
task attempt, and only files named in the stored manifest are ever read, so files of
lost or repeated tasks do no harm.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


def write(folder: str, name: str, data: bytes, same: bool = False) -> str:
    """Write a file of this task; returns its place. It appears whole or not at all.

    With `same` every attempt writes the same content, so the name needs no number.
    """
    store, path = place(folder)
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else 0
    full = f"{path}/{name}-{attempt}"
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{full}.tmp") as out:
        out.write(data)
    store.move(f"{full}.tmp", f"{path}/{name}" if same else full)
    return f"{folder}/{name}" if same else f"{folder}/{name}-{attempt}"


def read(uri: str) -> bytes:
    store, path = place(uri)
    with store.open_input_stream(path) as file:
        return file.read()


def read_part(uri: str, start: int, size: int) -> bytes:
    store, path = place(uri)
    with store.open_input_file(path) as file:
        return file.read_at(size, start)


def length(uri: str) -> int:
    store, path = place(uri)
    return store.get_file_info(path).size
