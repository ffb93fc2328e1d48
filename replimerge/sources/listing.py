"""The full listing of a tree, level by level, by the executors."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

LISTED = "path string, kind string, size long, mtime_ns long, ctime_ns long, exec boolean, target string, fault string"
#: Directories that a task lists, about.
PER_TASK = 200


def _local(base: str, directory: str) -> list[tuple]:
    out = []
    with os.scandir(os.path.join(base, directory) if directory else base) as found:
        for e in found:
            path = f"{directory}/{e.name}" if directory else e.name
            try:
                s = e.stat(follow_symlinks=False)
                target = os.readlink(e.path) if stat.S_ISLNK(s.st_mode) else None
            except OSError as err:  # gone or not to be looked at meanwhile
                out.append((path, None, None, None, None, None, None, f"unreadable: {err.strerror}"))
                continue
            kind = "symlink" if target is not None else "dir" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else None
            plain = kind == "file"
            fault = None if kind else "unsupported kind"
            out.append((path, kind, s.st_size if plain else 0, s.st_mtime_ns, s.st_ctime_ns, plain and bool(s.st_mode & 0o111), target, fault))
    return out


def _remote(fs: pafs.FileSystem, base: str, directory: str) -> list[tuple]:
    found = fs.get_file_info(pafs.FileSelector(f"{base}/{directory}" if directory else base))
    kinds = {pafs.FileType.File: "file", pafs.FileType.Directory: "dir"}
    at = lambda f: f"{directory}/{f.base_name}" if directory else f.base_name
    return [(at(f), kinds.get(f.type), f.size if f.is_file else 0, f.mtime_ns, None, None, None, None if f.type in kinds else "unsupported kind") for f in found]


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, kind, size, mtime_ns, ctime_ns, exec, target, fault`` of everything beneath ``root``: empty and hidden files, directories and links among them.

    ``root`` is a local path or a URI that Arrow opens, the same tree wherever tasks run (a mount, a
    store). A level's directories are a table, listed by as many tasks as it has hundreds of them;
    what they hold is written, and its directories are the next level: as many jobs as the tree is
    deep, and no list of names on the driver. Links are not followed. What can't be listed or
    looked at has a ``fault`` and no less: whether absence means deletion is for the caller to say.
    Stores that know no ctime, exec bit or link have null there. A root that can't be listed is an error.
    """
    fs, base = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(root))
    local = isinstance(fs, pafs.LocalFileSystem)
    uri = root

    def listed(directory: str) -> list[tuple]:
        return _local(base, directory) if local else _remote(pafs.FileSystem.from_uri(uri)[0], base, directory)

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in LISTED.split(", ")]
        for frame in frames:
            for directory in frame["path"]:
                try:
                    rows = listed(directory)
                except OSError as err:
                    if not directory:
                        raise
                    rows = [(directory, None, None, None, None, None, None, f"unlistable: {err.strerror or err}")]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"size": "Int64", "mtime_ns": "Int64", "ctime_ns": "Int64", "exec": "boolean"})

    level, every = spark.createDataFrame([("",)], "path string"), None
    while True:
        n = max(1, -(-level.count() // PER_TASK))
        here = written(level.repartition(n).mapInPandas(look, LISTED), "listing")
        every = here if every is None else every.unionByName(here)
        level = here.where("kind = 'dir'").select("path")
        if level.isEmpty():
            unlisted = every.where(F.startswith("fault", F.lit("unlistable"))).select("path", F.col("fault").alias("__f"))
            shown = every.where(F.col("fault").isNull() | ~F.startswith("fault", F.lit("unlistable")))
            return shown.join(unlisted, "path", "left").withColumn("fault", F.coalesce("__f", "fault")).drop("__f")
