"""Files for Python data sources: local paths by the operating system, stores by pyarrow where it knows them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlsplit


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def local(path: str) -> str | None:
    """The operating system's name of a path, or None for one in a store."""
    at = urlsplit(path)
    if at.scheme in ("", "file"):
        return unquote(at.path) if at.scheme else path
    return None


def open_input(path: str) -> BinaryIO:
    name = local(path)
    if name is not None:
        return open(name, "rb")
    store, at = _store(path)
    return store.open_input_file(at)


def open_output(path: str) -> BinaryIO:
    name = local(path)
    if name is not None:
        os.makedirs(os.path.dirname(name), exist_ok=True)
        return open(name, "wb")
    store, at = _store(path)
    return store.open_output_stream(at)


def remove(path: str) -> None:
    name = local(path)
    if name is not None:
        if os.path.exists(name):
            os.unlink(name)
        return
    store, at = _store(path)
    store.delete_file(at)


def listing(path: str, hidden: bool = False) -> Iterator[tuple[str, int]]:
    """(path, size) of the files in a folder, in order, or of the one file; hidden and marker files only if asked for."""
    name = local(path)
    if name is not None:
        found = [name] if os.path.isfile(name) else [os.path.join(name, x) for x in sorted(os.listdir(name))] if os.path.isdir(name) else []
        for x in found:
            if os.path.isfile(x) and (hidden or os.path.basename(x)[0] not in "._"):
                yield x, os.path.getsize(x)
        return
    from pyarrow import fs

    store, at = _store(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else f"{urlsplit(path).scheme}://"
    info = store.get_file_info(at)
    for f in [info] if info.type == fs.FileType.File else sorted(store.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda f: f.path):
        if f.type == fs.FileType.File and (hidden or f.base_name[0] not in "._"):
            yield scheme + f.path, f.size
