"""Numbered states of a lake, each a small file that is created only if its number is free.

A writer reads the latest state, changes it and tries to create the next number. If another writer was faster, it reads
again and changes that one. A change that stands on something another writer has replaced raises Conflict."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

KEPT = 200  # numbers below the latest that stay; a listing is never longer by much
TRIES = 50


class Conflict(RuntimeError):
    """What a change was computed from is no longer the latest state."""


class Files:
    """Small text files next to the tables, through the session's Hadoop file system."""

    def __init__(self, spark: SparkSession):
        context = spark.sparkContext
        self._jvm, self._gateway = context._jvm, context._gateway
        self._conf = context._jsc.hadoopConfiguration()

    def _open(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._open(path)
        return fs.exists(p)

    def has_data(self, path: str) -> bool:
        """The folder holds a file or partition that is not hidden."""
        p, fs = self._open(path)
        return fs.exists(p) and any(c.getPath().getName()[0] not in "._" for c in fs.listStatus(p))

    def make_dir(self, path: str) -> None:
        p, fs = self._open(path)
        fs.mkdirs(p)

    def read(self, path: str) -> str | None:
        p, fs = self._open(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        return [name for name, _ in self.listed(path)]

    def listed(self, path: str) -> list[tuple[str, int]]:
        """(name, milliseconds of its last change) of what a folder holds."""
        p, fs = self._open(path)
        return [(c.getPath().getName(), c.getModificationTime()) for c in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p, fs = self._open(path)
        fs.delete(p, True)

    def create(self, path: str, text: str) -> bool:
        """Make a whole file appear under a free name; False if the name is taken.

        On a local disk by a hard link, elsewhere by a rename that does not overwrite: both are one step for all who look."""
        tmp, fs = self._open(f"{path}.{uuid.uuid4().hex}.tmp")
        final, _ = self._open(path)
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                self._jvm.java.nio.file.Files.createLink(self._local(fs, final), self._local(fs, tmp))
            else:
                options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
                context.rename(fs.makeQualified(tmp), fs.makeQualified(final), options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(tmp, False)
        return True

    def _local(self, fs, path):
        return self._jvm.java.io.File(fs.makeQualified(path).toUri().getPath()).toPath()


class CommitLog:
    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json"))

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def latest(self) -> tuple[int, dict]:
        """The number and the state; 0 and an empty one before the first commit."""
        for _ in range(TRIES):
            numbers = self._numbers()
            if not numbers:
                return 0, {}
            if (text := self.files.read(self._path(numbers[-1]))) is not None:  # else removed since it was listed
                return numbers[-1], json.loads(text)
        raise Conflict(f"{self.folder} changes faster than it can be read")

    def commit(self, change: Callable[[dict], dict]) -> dict:
        """Put change(latest state) in its place. change may run several times and raises Conflict to give up."""
        for _ in range(TRIES):
            number, state = self.latest()
            after = change(state)
            if after == state:
                return state
            if not self.files.create(self._path(number + 1), json.dumps(after, sort_keys=True)):
                continue
            numbers = self._numbers()
            if numbers[-1] > number + 1 + KEPT // 2:  # this writer slept so long that its number had been taken and removed
                self.files.delete(self._path(number + 1))
                continue
            for old in numbers:
                if old < numbers[-1] - KEPT:
                    self.files.delete(self._path(old))
            return after
        raise Conflict(f"no free number in {self.folder} after {TRIES} tries")

    def claim(self, least: int) -> int:
        """A number from `least` on that no other writer has or will have; numbers below `least` are forgotten."""
        for _ in range(TRIES):
            numbers = self._numbers()
            number = max([least, *[n + 1 for n in numbers]])
            if self.files.create(self._path(number), "{}"):
                for old in numbers:
                    if old < least:
                        self.files.delete(self._path(old))
                return number
        raise Conflict(f"no free number in {self.folder} after {TRIES} tries")
