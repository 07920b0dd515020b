"""Binary files in shared folders, from inside tasks: any store that pyarrow's file systems know."""

from __future__ import annotations

import os
import uuid


def _store(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), os.path.abspath(url))


def new_file(folder: str, suffix: str):
    """(url, output stream) of a file with a name of its own: a task that runs twice never writes to the same file."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)


def read_from(url: str):
    store, path = _store(url)
    return store.open_input_stream(path, compression=None)
