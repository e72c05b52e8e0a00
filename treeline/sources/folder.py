"""A folder tree as a relation: a Python data source that reads metadata only."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .. import model as M
from ..functions.ignore import compiled
from ..functions.paths import STATE_DIRECTORY

FORMAT = "folder_tree"
_SPECIAL = ((stat.S_ISFIFO, "fifo"), (stat.S_ISSOCK, "socket"), (stat.S_ISBLK, "block_device"), (stat.S_ISCHR, "character_device"))
#: Directories that a scan is split into, about, so that one large directory isn't one task.
SPLITS = 64
#: The file of the user's own rules, which no rule can hide.
IGNORE_FILE = ".treelineignore"


def token(folder: str) -> tuple:
    """What a plan depends on besides the entries: the root's identity and the state of its rules and protocol files. See seal.fenced()."""
    out = []
    for name in ("", IGNORE_FILE, f"{STATE_DIRECTORY}/manifest.json", f"{STATE_DIRECTORY}/head"):
        try:
            facts = os.lstat(os.path.join(folder, name))
            out.append((facts.st_dev, facts.st_ino, *((facts.st_size, facts.st_mtime_ns) if name else ())))
        except FileNotFoundError:
            out.append(None)
    return tuple(out)


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool, identity: tuple | None = None):
        self.folder, self.deep, self.identity = folder, deep, identity


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.splits = options["path"], int(options.get("splits", SPLITS))
        lines = [compiled(line) for line in options.get("rules", "").split("\n")]
        self.rules = [(re.compile(regex), negated, only) for regex, negated, only in filter(None, lines)]
        self.kept = {p for p in options.get("keep", IGNORE_FILE).split("\n") if p}

    def partitions(self) -> list[_Part]:
        """Upper directories listed for themselves, and whole trees below them; widened level by level."""
        shallow, level = [], [("", None)]
        while level and len(level) < self.splits and len(shallow) < self.splits:
            shallow += level
            level = [(row[0], identity) for folder in level for row, identity in self._children(*folder) if identity]
        return [_Part(f, False, i) for f, i in shallow] + [_Part(f, True, i) for f, i in level]

    def read(self, partition: _Part) -> Iterator[tuple]:
        stack = [(partition.folder, partition.identity)]
        while stack:
            for row, identity in self._children(*stack.pop()):
                yield row
                if partition.deep and identity:
                    stack.append((row[0], identity))

    def _ignored(self, path: str, directory: bool) -> bool:
        if path in self.kept:
            return False
        for regex, negated, only in reversed(self.rules):
            if (directory or not only) and regex.search(path):
                return not negated
        return False

    def _children(self, folder: str, identity: tuple | None) -> Iterator[tuple[tuple, tuple | None]]:
        """Rows of a directory, and of those that are walked into their device and inode. identity: what the directory was when its parent listed it; another one in its place is an error."""
        at = os.open(os.path.join(self.root, folder), os.O_RDONLY | os.O_DIRECTORY | (os.O_NOFOLLOW if folder else 0))
        try:
            facts = os.fstat(at)
            if identity and (facts.st_dev, facts.st_ino) != identity:
                raise ValueError(f"{folder}: another directory took its place during the scan")
            for name in sorted(os.listdir(at)):
                if name.lower() == STATE_DIRECTORY:
                    if name != STATE_DIRECTORY:
                        raise ValueError(f"{folder}/{name}: the protocol's directory under another name")
                    continue
                path = f"{folder}/{name}" if folder else name
                facts = os.stat(name, dir_fd=at, follow_symlinks=False)
                yield self._row(path, name, facts, at), (facts.st_dev, facts.st_ino) if self._walked(path, name, facts, at) else None
        finally:
            os.close(at)

    def _walked(self, path: str, name: str, facts: os.stat_result, at: int) -> bool:
        return stat.S_ISDIR(facts.st_mode) and not self._ignored(path, True) and not self._nested(name, at)

    @staticmethod
    def _nested(name: str, at: int) -> bool:
        try:
            os.stat(f"{name}/{STATE_DIRECTORY}", dir_fd=at, follow_symlinks=False)
        except OSError:
            return False
        return True

    def _row(self, path: str, name: str, facts: os.stat_result, at: int) -> tuple:
        directory = stat.S_ISDIR(facts.st_mode)
        if self._ignored(path, directory):
            return path, None, None, None, None, M.IGNORED_REASON
        if directory:
            return (path, M.NESTED, None, None, None, M.NESTED_REASON) if self._nested(name, at) else (path, M.DIRECTORY, None, None, None, None)
        if stat.S_ISLNK(facts.st_mode):
            return path, M.SYMLINK, None, None, os.readlink(name, dir_fd=at), None
        if not stat.S_ISREG(facts.st_mode):
            kind = next((k for test, k in _SPECIAL if test(facts.st_mode)), "special")
            return path, kind, None, None, None, M.UNSUPPORTED_REASON
        if facts.st_nlink > 1:
            return path, "hard_link", None, None, None, M.UNSUPPORTED_REASON
        return path, M.FILE, facts.st_size, bool(facts.st_mode & 0o111), None, None


class FolderWatch(SimpleDataSourceStreamReader):
    """Entries whose own time of change is later than what was read before; a removed entry shows by its directory. Rows are hints to scan again, as times can lie."""

    def __init__(self, options: dict):
        self.scan = FolderReader(options)

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _since(self, after: int, upto: int | None = None) -> tuple[list[tuple], int]:
        found, last = [], after
        for row in self.scan.read(_Part("", True)):
            at = os.lstat(os.path.join(self.scan.root, row[0])).st_mtime_ns
            if at > after and (upto is None or at <= upto):
                found.append(row)
                last = max(last, at)
        return found, last

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found, last = self._since(start["at"])
        return iter(found), {"at": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._since(start["at"], end["at"])[0])


class FolderSource(DataSource):
    """Options: path (a folder that all executors see), rules (ignore rules, one a line), keep (paths that rules can't hide, one a line), splits.

    One row per path: entries have no reason; exclusions (nested roots, hard links, special nodes) and ignored paths have
    one. Nothing below an ignored directory or a nested root is visited, and no file is opened.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, kind string, bytes long, executable boolean, symlink_target string, reason string"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def simpleStreamReader(self, schema) -> FolderWatch:
        return FolderWatch(self.options)


def scan(spark: SparkSession, folder: str, rules: list[str] = ()):
    """The rows of a folder; see FolderSource."""
    spark.dataSource.register(FolderSource)
    return spark.read.format(FORMAT).option("rules", "\n".join(rules)).load(folder)


def watch(spark: SparkSession, folder: str, rules: list[str] = ()):
    """A stream of the entries of a folder that change; see FolderWatch."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format(FORMAT).option("rules", "\n".join(rules)).load(folder)
