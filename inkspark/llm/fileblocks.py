"""Shared-folder files that Python workers write and Spark reads back.

A file's name holds a fresh random part for every attempt, and only names that
come back as rows of the finished job are ever read: a task that is run twice
leaves an unread file behind, never a double record.
"""

from __future__ import annotations

import uuid


def opened(uri):
    """(file system, path) of a URI in any store that pyarrow knows; local ones need no library of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(folder, name, parts):
    """Writes byte strings as ``folder/name-<random>`` and returns its URI and length."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}"
    store, path = opened(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    size = 0
    with store.open_output_stream(path) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    return uri, size
