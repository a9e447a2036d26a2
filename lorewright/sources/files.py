"""Markdown files as the truth behind the entries table: changes that are all made or all taken back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class FileChanges:
    """Writes and removals below one root. A file is staged, synced and renamed into place; what it replaces is kept under
    `.changes/<run>/old/<number>` until `done`, a file that is new leaves a mark under `made`, and `undo` puts all back in
    reverse order, by `recover` also after the process was lost. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, run: str | None = None):
        self._context, self.root = spark.sparkContext, root.rstrip("/")
        self.run = f"{self.root}/.changes/{run or uuid.uuid4().hex}"
        self._made: list[tuple[str, str | None]] = []  # path, where the file that was there is kept

    def _path(self, path: str):
        return self._context._jvm.org.apache.hadoop.fs.Path(path)

    @property
    def _fs(self):
        fs = self._path(self.root).getFileSystem(self._context._jsc.hadoopConfiguration())
        # people edit these files, so that local ones get no checksum beside them
        return fs.getRawFileSystem() if self._path(self.root).toUri().getScheme() in (None, "file") and hasattr(fs, "getRawFileSystem") else fs

    def _move(self, old: str, new: str) -> None:
        fs, target = self._fs, self._path(new)
        fs.mkdirs(target.getParent())
        if not fs.rename(self._path(old), target):
            raise OSError(f"{old} can't become {new}")

    def _aside(self, path: str) -> None:
        final = f"{self.root}/{path}"
        kept = f"{self.run}/old/{len(self._made)}/{path}" if self._fs.exists(self._path(final)) else None
        if kept:
            self._move(final, kept)
        else:
            self._fs.create(self._path(f"{self.run}/made/{len(self._made)}/{path}"), True).close()
        self._made.append((path, kept))

    def write(self, path: str, content: str) -> None:
        staged = f"{self.run}/new/{len(self._made)}"
        out = self._fs.create(self._path(staged), True)
        out.write(bytearray(content.encode()))
        out.hsync()
        out.close()
        self._aside(path)
        self._move(staged, f"{self.root}/{path}")

    def remove(self, path: str) -> None:
        self._aside(path)

    def undo(self) -> None:
        for path, kept in reversed(self._made):
            self._fs.delete(self._path(f"{self.root}/{path}"), False)
            if kept:
                self._move(kept, f"{self.root}/{path}")
        self.done()

    def done(self) -> None:
        self._made.clear()
        self._fs.delete(self._path(self.run), True)

    @classmethod
    def recover(cls, spark: SparkSession, root: str) -> int:
        """Take back the changes of runs that never ended; gives how many runs."""
        probe = cls(spark, root)
        top = probe._path(f"{probe.root}/.changes")
        runs = [s.getPath().getName() for s in probe._fs.listStatus(top)] if probe._fs.exists(top) else []
        for run in runs:
            lost, found = cls(spark, root, run), {}
            for part in ("old", "made"):
                folder = lost._path(f"{lost.run}/{part}")
                files = lost._fs.listFiles(folder, True) if lost._fs.exists(folder) else None
                while files is not None and files.hasNext():
                    number, path = files.next().getPath().toUri().getPath().split(f"/.changes/{run}/{part}/", 1)[1].split("/", 1)
                    found[int(number)] = (path, f"{lost.run}/old/{number}/{path}" if part == "old" else None)
            lost._made = [found[n] for n in sorted(found)]
            lost.undo()
        return len(runs)
