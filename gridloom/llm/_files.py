"""Raw files in the shared folder, from Python workers, by URI (local, HDFS, S3, ... as pyarrow knows them)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str):
    """A file that appears under its name when it is whole; a task that is run again replaces it by equal bytes."""
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)


def open_file(uri: str):
    system, path = _open(uri)
    return system.open_input_file(path)
