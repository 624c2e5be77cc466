"""Metadata calls on the Hadoop file system below a path: no file content passes through here."""

from __future__ import annotations

import os
import stat
import threading
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

from pyspark.sql import SparkSession

from packwright.errors import MaintenanceError, PromotionError

RENAME_THREADS = 16

# Targets of renames under way in this process: looking and renaming are two calls, and not every file system
# refuses a rename onto an existing file.
_claimed: set[str] = set()
_claims = threading.Lock()


def normalise(path: str) -> str:
    """Drop trailing slashes; refuse a path that names nothing or a file system root."""
    trimmed = (path or "").strip().rstrip("/")
    name = trimmed.rsplit("/", 1)[-1]
    if not name or name.endswith(":") or "/" not in trimmed or trimmed.endswith("://" + name):
        raise MaintenanceError(f"not a usable directory path: {path!r}")
    return trimmed


def literal(path: str) -> str:
    """Escape the characters Hadoop would take for a glob pattern."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


class Storage:
    """The file system that holds one path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._path_class = spark._jvm.org.apache.hadoop.fs.Path
        self._file_util = spark._jvm.org.apache.hadoop.fs.FileUtil
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path_class(path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._path_class(path)

    def qualified(self, path: str) -> str:
        """Scheme and path as a listing shows them, names decoded."""
        return self._fs.makeQualified(self._path(path)).toString()

    def uri(self, path: str) -> str:
        """Scheme and path as `_metadata.file_path` shows them, names percent-encoded."""
        return self._path(self.qualified(path)).toUri().toString()

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def child_dirs(self, path: str) -> list[str]:
        """Names of the direct sub-directories, hidden ones included."""
        statuses = self._fs.listStatus(self._path(path))
        return sorted(s.getPath().getName() for s in statuses if s.isDirectory())

    def child_files(self, path: str) -> list[str]:
        statuses = self._fs.listStatus(self._path(path))
        return sorted(s.getPath().getName() for s in statuses if s.isFile())

    def directories(self, path: str) -> tuple[list[str], list[str]]:
        """Below a directory, relative to it: all visible directories (itself is ""), and the hidden ones."""
        visible, hidden, level = [""], [], [""]
        while level:
            below = in_threads(lambda d: [f"{d}/{n}".lstrip("/") for n in self.child_dirs(f"{path}/{d}".rstrip("/"))], level)
            found = [d for names in below for d in names]
            hidden += [d for d in found if d.rsplit("/", 1)[-1].startswith(("_", "."))]
            level = [d for d in found if not d.rsplit("/", 1)[-1].startswith(("_", "."))]
            visible += level
        return visible, hidden

    def copy_rights(self, source: str, target: str) -> None:
        """Give a directory the permissions, the group and, where the file system has them, the access lists of
        another one."""
        if self._fs.getUri().getScheme() == "file":
            # Hadoop's view of a local file system leaves out set-group-ID.
            old = os.stat(self._path(source).toUri().getPath())
            name = self._path(target).toUri().getPath()
            if os.stat(name).st_gid != old.st_gid:
                os.chown(name, -1, old.st_gid)
            os.chmod(name, stat.S_IMODE(old.st_mode))
            return
        old, new = (self._fs.getFileStatus(self._path(p)) for p in (source, target))
        if new.getGroup() != old.getGroup():
            self._fs.setOwner(self._path(target), None, old.getGroup())
        self._fs.setPermission(self._path(target), old.getPermission())
        if old.hasAcl():
            spec = self._jvm.org.apache.hadoop.fs.permission.AclUtil.getAclFromPermAndEntries(
                old.getPermission(), self._fs.getAclStatus(self._path(source)).getEntries()
            )
            self._fs.setAcl(self._path(target), spec)

    def write_new(self, path: str, text: str) -> None:
        """A small file that is there as a whole or not at all; its name must be free."""
        out = self._fs.create(self._path(path + ".tmp"), True)
        try:
            out.write(bytearray(text.encode()))
            out.hsync() if self._fs.getUri().getScheme() != "file" else out.flush()
        finally:
            out.close()
        self.rename(path + ".tmp", path)

    def parquet_columns(self, path: str) -> tuple[str, ...]:
        """The column names of a Parquet file, in its own order."""
        hadoop = self._jvm.org.apache.parquet.hadoop
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(self._path(path), self._conf))
        try:
            return tuple(f.getName() for f in reader.getFileMetaData().getSchema().getFields())
        finally:
            reader.close()

    def orc_columns(self, path: str) -> tuple[str, ...]:
        """The column names of an ORC file, in its own order."""
        orc = self._jvm.org.apache.orc.OrcFile
        reader = orc.createReader(self._path(path), orc.readerOptions(self._conf))
        try:
            return tuple(reader.getSchema().getFieldNames())
        finally:
            reader.close()

    def read_text(self, path: str) -> str:
        source = self._fs.open(self._path(path))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def mkdirs(self, path: str) -> None:
        if not self._fs.mkdirs(self._path(path)):
            raise MaintenanceError(f"could not create {path}")

    def rename(self, source: str, target: str) -> None:
        """Rename to a name that must be free: a rename onto a directory would nest the source in it.

        Of two threads that want one name, only one gets it.
        """
        name = self.qualified(target)
        with _claims:
            if name in _claimed:
                raise PromotionError(f"{target} is in the way of {source}")
            _claimed.add(name)
        try:
            if self.exists(target):
                raise PromotionError(f"{target} is in the way of {source}")
            if not self._fs.rename(self._path(source), self._path(target)):
                raise PromotionError(f"could not rename {source} to {target}")
        finally:
            with _claims:
                _claimed.discard(name)

    def delete(self, path: str) -> None:
        if self.exists(path) and not self._fs.delete(self._path(path), True):
            raise MaintenanceError(f"could not delete {path}")

    def copy_file(self, source: str, target: str) -> None:
        if not self._file_util.copy(
            self._fs, self._path(source), self._fs, self._path(target), False, self._conf
        ):
            raise MaintenanceError(f"could not copy {source} to {target}")

    def move_into(self, moves: Iterable[tuple[str, str, str]]) -> None:
        """Bring the visible files of each (source, target, mark) directory into its target directory.

        Without a mark the source is the target's only one: the directory itself is renamed, unless the target
        is there already. Otherwise its files are renamed one by one, the mark put into their names, since
        several sources may hold files of one name. Targets go by depth, so that a directory comes before those
        inside it.
        """

        def move(one: tuple[str, str, str]) -> None:
            source, target, mark = one
            if not mark and not self.exists(target):
                self.mkdirs(target.rsplit("/", 1)[0])
                self.rename(source, target)
                return
            self.mkdirs(target)
            for name in self.child_files(source):
                if not name.startswith(("_", ".")):
                    self.rename(f"{source}/{name}", f"{target}/{mark}{name}")

        for _, level in groupby(sorted(moves, key=_depth), key=_depth):
            in_threads(move, level)


def in_threads(call: Callable, items: Iterable) -> list:
    """`call` of every item, many at a time. All have ended when this returns or raises."""
    with ThreadPoolExecutor(RENAME_THREADS) as pool:
        return list(pool.map(call, items))


def _depth(move: tuple[str, str, str]) -> int:
    return move[1].count("/")
