"""Whole files on shared storage, for formats that Spark has no writer for."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


def save(path: str, content: bytes) -> None:
    """The whole file or none: a draft with a name of its own is moved in place, so attempts of one task don't meet."""
    fs, at = store(path)
    folder, name = at.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(content)
    fs.move(draft, at)


def prepare(path: str, mode: str) -> None:
    """Applies a save mode to a folder before tasks write to it."""
    fs, at = store(path)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        if mode == "overwrite":
            fs.delete_dir(at)
        elif mode != "append":
            raise ValueError(f"{path} exists")
    fs.create_dir(at, recursive=True)


def names(path: str, ending: str) -> list[str]:
    """The file itself, or a folder's files of that ending, in order."""
    fs, at = store(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    base = path.rstrip("/")
    found = fs.get_file_info(pafs.FileSelector(at))
    return sorted(f"{base}/{f.base_name}" for f in found if f.type == pafs.FileType.File and f.base_name.lower().endswith(ending) and not f.base_name.startswith((".", "_")))
