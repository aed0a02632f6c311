"""Files of a folder as a table.

Tasks list the folders and read the files; Spark's own listing would leave out names that begin with a dot or an
underscore, and passes through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.config import IndexConfig
from quarrystone.functions.frames import cut, has_at_most, ship
from quarrystone.operators.ignore import IgnoreRule, rules_of, without_ignored

#: Bytes at the beginning of a file in which a NUL marks it as binary: for taking it in, and for searching it.
SNIFF_CRAWL, SNIFF_SEARCH = 1024, 8192
SCHEMA = "doc_id long, relative_path string, byte_count long, modified_at_epoch_seconds long, content binary"


def visible(path: Column, config: IndexConfig) -> Column:
    """No part of the path is hidden or a skipped folder; ignore files themselves are visible."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & ~p.isin(*config.ignore_files)) if not config.include_hidden else F.lit(False)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return ~hidden & ~F.arrays_overlap(folders, F.array(*map(F.lit, config.skipped_directories or ("",))))


def has_nul(content: Column, within: int) -> Column:
    """Whether the first bytes hold a NUL."""
    return F.decode(F.substring(content, 1, within), "ISO-8859-1").contains("\u0000")


def relative_to(path: Column, root: str) -> Column:
    """The path without the root; its last part if it is not below the root."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(F.element_at(F.split(path, "/"), -1))


#: Entries of folders that a task lists before it hands what is left to other tasks, and bytes of contents that a task
#: holds at once besides one file.
WALK, READ_BYTES = 20_000, 16 << 20
ENTRY = "relative_path string, byte_count long, modified_at_epoch_seconds long"


class Folder:
    """A folder on a mounted file system or, by its address, on any that pyarrow knows. Lives in the tasks."""

    def __init__(self, root: str, follow_symlinks: bool = False):
        self.follow = follow_symlinks
        self.remote = None
        if "://" in root and not root.startswith("file:"):
            from pyarrow import fs

            self.remote, self.root = fs.FileSystem.from_uri(root)
        else:
            self.root = root.removeprefix("file://").removeprefix("file:")

    def at(self, path: str) -> str:
        return f"{self.root.rstrip('/')}/{path}" if path else self.root

    def entries(self, path: str) -> Iterator[tuple[str, bool, int, int]]:
        """(path from the root, is it a folder, bytes, seconds of change) of what a folder holds; links only if they
        are followed, those to a folder above themselves never."""
        below = f"{path}/" if path else ""
        if self.remote is not None:
            from pyarrow import fs

            for i in self.remote.get_file_info(fs.FileSelector(self.at(path))):
                yield below + i.base_name, i.type == fs.FileType.Directory, i.size or 0, max(0, round((i.mtime_ns or 0) / 1e9))
            return
        with os.scandir(self.at(path)) as found:
            for e in found:
                if e.is_symlink() and not self.follow:
                    continue
                if e.is_dir():
                    if not e.is_symlink() or not f"{os.path.realpath(self.at(path))}/".startswith(f"{os.path.realpath(e.path)}/"):
                        yield below + e.name, True, 0, 0
                elif e.is_file():
                    s = e.stat()
                    yield below + e.name, False, s.st_size, max(0, round(s.st_mtime))

    def read(self, path: str, most: int | None = None) -> bytes | None:
        """The first bytes of a file; None if it is gone."""
        try:
            with self.remote.open_input_stream(self.at(path)) if self.remote is not None else open(self.at(path), "rb") as f:
                return f.read() if most is None else f.read(most)
        except FileNotFoundError:
            return None


def _walker(root: str, config: IndexConfig):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, left = Folder(root, config.follow_symlinks), WALK
        for b in batches:
            todo, rows = list(b.relative_path), []
            while todo:
                path = todo.pop()
                if left <= 0:
                    rows.append((path, True, 0, 0))
                    continue
                try:
                    for name, is_folder, size, changed in folder.entries(path):
                        left -= 1
                        base = name.rpartition("/")[2]
                        if not is_folder:
                            rows.append((name, False, size, changed))
                        elif base not in config.skipped_directories and (config.include_hidden or not base.startswith(".")):
                            todo.append(name)
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["relative_path", "folder", "byte_count", "modified_at_epoch_seconds"])
                            rows = []
                except (FileNotFoundError, PermissionError):
                    continue
            yield pd.DataFrame(rows, columns=["relative_path", "folder", "byte_count", "modified_at_epoch_seconds"])

    return walk


def listing(spark: SparkSession, root: str, config: IndexConfig) -> DataFrame:
    """relative_path, byte_count, modified_at_epoch_seconds of what a crawl would look at.

    Tasks walk the folders. One that has listed WALK entries hands the folders that it has not been in yet to the next
    round, where they are spread over all tasks; so no tree, however deep or lopsided, is one task's or the driver's.
    """
    ship(spark)
    found, todo = None, spark.createDataFrame([("",)], "relative_path string")
    while True:
        got = cut(todo.mapInPandas(_walker(root, config), "relative_path string, folder boolean, byte_count long, modified_at_epoch_seconds long"))
        files = got.where("NOT folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        if has_at_most(got.where("folder"), 0):
            return found
        todo = got.where("folder").select("relative_path").repartition(spark.sparkContext.defaultParallelism)


def _reader(root: str, sniff: int | None):
    """Adds content to entries: the whole of it, or its first bytes. A file that is gone is left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder(root)
        for b in batches:
            rows, size = [], 0
            for row in b.itertuples(index=False):
                content = folder.read(row.relative_path, sniff)
                if content is None:
                    continue
                rows.append((*row, content))
                size += len(content)
                if size >= READ_BYTES:
                    yield pd.DataFrame(rows, columns=[*b.columns, "content"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=[*b.columns, "content"])

    return read


def ignore_rules(files: DataFrame, root: str, config: IndexConfig) -> list[IgnoreRule]:
    """The rules of the ignore files among files. They are settings, so the driver holds them."""
    if not config.respect_ignore_files:
        return []
    named = files.where(F.element_at(F.split("relative_path", "/"), -1).isin(*config.ignore_files))
    texts = named.mapInPandas(_reader(root, None), f"{ENTRY}, content binary").select("relative_path", F.decode("content", "UTF-8").alias("text"))
    return rules_of([(r.relative_path.rpartition("/")[0], r.text) for r in texts.toLocalIterator()])


def head_commit(root: str) -> str | None:
    """The commit that is checked out in a mounted folder, read from its repository, also one of a linked work tree
    and of packed references; None if there is none."""
    if "://" in root and not root.startswith("file:"):
        return None
    git = os.path.join(root.removeprefix("file://"), ".git")

    def text(*path: str) -> str | None:
        try:
            with open(os.path.join(*path)) as f:
                return f.read().strip()
        except OSError:
            return None

    if (link := text(git)) is not None and link.startswith("gitdir: "):
        git = os.path.join(os.path.dirname(git), link[8:])
    common = os.path.join(git, text(git, "commondir") or "")
    head = text(git, "HEAD")
    if head is None or not head.startswith("ref: "):
        return head or None
    for place in (git, common):
        if found := text(place, *head[5:].split("/")):
            return found
    packed = (line.partition(" ") for line in (text(common, "packed-refs") or "").splitlines())
    return next((commit for commit, _, name in packed if name == head[5:]), None)


def write_files(rows: DataFrame, root: str) -> None:
    """Writes relative_path, text as files below a folder, in the tasks; what is there is replaced."""
    ship(rows.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, text in zip(b.relative_path, b.text, strict=True):
                where.create_dir(f"{base}/{path}".rpartition("/")[0])
                with where.open_output_stream(f"{base}/{path}") as f:
                    f.write(text.encode())
            yield b[["relative_path"]]

    rows.select("relative_path", "text").mapInPandas(write, "relative_path string").count()


def crawl(spark: SparkSession, root: str, config: IndexConfig = IndexConfig()) -> DataFrame:
    """doc_id (by path, from 0), relative_path, byte_count, modified_at_epoch_seconds, content of the text files.

    The folder is one that all tasks can read: mounted, or addressed in a way that pyarrow knows. Files are numbered
    before their contents are read, so these are never shuffled, and they are kept as they were read. A file that goes
    away meanwhile is left out.
    """
    from quarrystone.operators.records import numbered

    found = listing(spark, root, config)
    rows = found.where(visible(F.col("relative_path"), config) & (F.col("byte_count") <= config.max_file_bytes))
    if rules := ignore_rules(found, root, config):
        rows = without_ignored(rows, rules)
    heads = rows.mapInPandas(_reader(root, SNIFF_CRAWL), f"{ENTRY}, content binary")
    ids = numbered(heads.where(~has_nul(F.col("content"), SNIFF_CRAWL)).drop("content"), ["relative_path"], "doc_id")
    return cut(ids.select("doc_id", "relative_path", "byte_count", "modified_at_epoch_seconds").mapInPandas(_reader(root, None), SCHEMA))
