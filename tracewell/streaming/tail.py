"""A streaming source over growing text files: whole new lines since the last batch, with offsets of inode and byte by path."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class TailSource(DataSource):
    """Rows (path, line). Options: path (a glob pattern), start ('end' as a tail does, or 'beginning'), maxBytes a file and batch.

    Offsets move to the last line end only, so that a line that is being written comes whole in a later batch. A file
    that was replaced or cut is read from its beginning. Offsets are kept in the stream's checkpoint: a restart goes on
    where it stopped.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


class Stretch(InputPartition):
    def __init__(self, path: str, begin: int, end: int) -> None:
        self.path, self.begin, self.end = path, begin, end


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.pattern, self.most = options["path"], int(options.get("maxbytes", options.get("maxBytes", 64 << 20)))
        self.from_end = options.get("start", "beginning") == "end"
        self.at: dict = {}

    def _files(self) -> Iterator[tuple[str, int, int]]:
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            try:
                stat = os.stat(path)
            except OSError:
                continue
            yield path, stat.st_ino, stat.st_size

    def initialOffset(self) -> dict:
        return {p: [inode, self._last_line_end(p, 0, size)] for p, inode, size in self._files()} if self.from_end else {}

    @staticmethod
    def _last_line_end(path: str, begin: int, end: int) -> int:
        """The place after the last line end between begin and end, or begin."""
        with open(path, "rb") as f:
            at = end
            while at > begin:
                step = min(1 << 16, at - begin)
                f.seek(at - step)
                found = f.read(step).rfind(b"\n")
                if found >= 0:
                    return at - step + found + 1
                at -= step
        return begin

    def latestOffset(self) -> dict:
        out = {}
        for path, inode, size in self._files():
            known = self.at.get(path)
            begin = known[1] if known and known[0] == inode and known[1] <= size else 0
            end = self._last_line_end(path, begin, min(size, begin + self.most))
            if end == begin and size - begin >= self.most:  # one line longer than a batch
                end = self._last_line_end(path, begin, size)
            out[path] = [inode, end]
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for path, (inode, to) in end.items():
            known = start.get(path)
            begin = known[1] if known and known[0] == inode and known[1] <= to else 0
            if to > begin:
                parts.append(Stretch(path, begin, to))
        self.at = dict(end)
        return parts

    def read(self, partition: Stretch) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.begin)
            for line in f.read(partition.end - partition.begin).split(b"\n")[:-1]:
                yield partition.path, line.decode("utf-8", "ignore").rstrip("\r")

    def commit(self, end: dict) -> None:
        self.at = dict(end)
