"""Files in the shared folder, by URI, from the driver and from tasks."""

from __future__ import annotations

import os
import posixpath
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    if "://" not in uri:
        uri = uri[5:] if uri.startswith("file:") else uri
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def listed(uri: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path under the folder, bytes) of its files, at any depth, in order of path; hidden ones and those of _folders aren't data."""
    system, root = opened(uri)
    infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    found = ((posixpath.relpath(x.path, root), x.size) for x in infos if x.type == fs.FileType.File)
    return sorted((p, n) for p, n in found if p.endswith(suffix) and not any(part[0] in "._" for part in p.split("/")))


def replaced(uri: str, write) -> None:
    """Writes a file under a passing name, then moves it to its own: a retried or doubled task leaves one whole file."""
    system, path = opened(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    passing = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(passing, compression=None) as out:
            write(out)
        system.move(passing, path)
    except BaseException:
        if system.get_file_info(passing).type != fs.FileType.NotFound:
            system.delete_file(passing)
        raise


def created(spark, uri: str, content: bytes) -> bool:
    """Creates a file atomically, whole, unless it exists: then False."""
    system, path = opened(uri)
    folder = posixpath.dirname(path)
    system.create_dir(folder, recursive=True)
    passing = f"{folder}/.{uuid.uuid4().hex}.part"
    with system.open_output_stream(passing, compression=None) as out:
        out.write(content)
    try:
        if isinstance(system, fs.LocalFileSystem):
            try:
                os.link(passing, path)
                return True
            except FileExistsError:
                return False
        jvm = spark._jvm
        there = jvm.org.apache.hadoop.fs.Path(uri)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(jvm.org.apache.hadoop.fs.Path(posixpath.join(posixpath.dirname(uri), posixpath.basename(passing))), there, options)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
    finally:
        if system.get_file_info(passing).type != fs.FileType.NotFound:
            system.delete_file(passing)
