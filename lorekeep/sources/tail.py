"""A stream of the lines that files of a folder gain: `spark.readStream.format("tail")`.

The offset of a batch is, for each file, how many bytes were read and a digest of the bytes around
that place, so Spark's own checkpoint is the watermark and a restarted query goes on where the last
committed batch ended. Only complete lines are read: what is behind the last line break waits until
its line is whole. A file whose earlier bytes have changed or that has become shorter is read again
from its start. A batch takes at most `maxBytes` (null: no limit), the oldest file first; a file whose
new part is over `maxFileBytes` is left as it is, and is read once the limit is raised. Lines that are
not UTF-8 come with replacement characters and `bad` set.

Options: path (a folder with its file system, or a local one), glob (names, default *.jsonl), maxBytes,
maxFileBytes, and positions: a folder in which the last offset that was handed out is kept, so that
`maxBytes` also holds for the first batch after a restart.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes at the start and before the offset that tell whether a file is still the same; bytes read at once.
AROUND, STEP = 4096, 8 << 20
LINES = "path string, at long, line string, bad boolean"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and "://" not in path:
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def digest(fs: pafs.FileSystem, path: str, end: int) -> str:
    """Of the file's first bytes and of those before `end`."""
    sha = hashlib.sha1()
    with fs.open_input_file(path) as f:
        sha.update(f.read_at(min(AROUND, end), 0))
        low = max(0, end - AROUND)
        sha.update(f.read_at(end - low, low))
    return sha.hexdigest()[:16]


def last_break(fs: pafs.FileSystem, path: str, low: int, high: int) -> int:
    """The place behind the last line break in [low, high); `low` if there is none."""
    with fs.open_input_file(path) as f:
        while high > low:
            start = max(low, high - STEP)
            at = f.read_at(high - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            high = start
    return low


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    stop: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        number = lambda k: int(options[k]) if options.get(k) else None
        self.most, self.file_most, self.positions = number("maxbytes"), number("maxfilebytes"), options.get("positions")
        self.at: dict[str, list] | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def _known(self) -> dict[str, list]:
        if self.at is None and self.positions:
            fs, folder = file_system(self.positions)
            if fs.get_file_info(f"{folder}/offset.json").type == pafs.FileType.File:
                with fs.open_input_stream(f"{folder}/offset.json") as f:
                    self.at = json.loads(f.read())
        return self.at or {}

    def _same(self, fs: pafs.FileSystem, path: str, size: int, place: list | None) -> bool:
        return place is not None and place[0] <= size and digest(fs, path, place[0]) == place[1]

    def latestOffset(self) -> dict:
        fs, folder = file_system(self.path)
        known, room = self._known(), self.most
        out = dict(known)
        files = [i for i in fs.get_file_info(pafs.FileSelector(folder, recursive=True)) if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob)]
        for info in sorted(files, key=lambda i: (i.mtime_ns or 0, i.path)):
            place = known.get(info.path)
            low = place[0] if self._same(fs, info.path, info.size, place) else 0
            if place is not None and low == info.size and low:
                continue
            high = info.size if room is None else min(info.size, low + room)
            stop = last_break(fs, info.path, low, high)
            if stop == low and high < info.size and low < high:  # a line longer than the limit is taken whole
                stop = self._next_break(fs, info.path, high, info.size) or low
            if stop == low and low == (place or [0])[0] or self.file_most is not None and stop - low > self.file_most:
                continue
            out[info.path] = [stop, digest(fs, info.path, stop)]
            if room is not None:
                room -= stop - low
                if room <= 0:
                    break
        self.at = out
        if self.positions:
            where, folder = file_system(self.positions)
            where.create_dir(folder, recursive=True)
            with where.open_output_stream(f"{folder}/offset.json") as f:
                f.write(json.dumps(out).encode())
        return out

    @staticmethod
    def _next_break(fs: pafs.FileSystem, path: str, low: int, high: int) -> int | None:
        with fs.open_input_file(path) as f:
            for start in range(low, high, STEP):
                at = f.read_at(min(STEP, high - start), start).find(b"\n")
                if at >= 0:
                    return start + at + 1
        return None

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, _ = file_system(self.path)
        self.at = dict(end)
        out: list[InputPartition] = []
        for path, (stop, _) in end.items():
            place = start.get(path)
            if place == end[path]:
                continue
            size = fs.get_file_info(path).size or 0
            low = place[0] if self._same(fs, path, size, place) and place[0] <= stop else 0
            # a long stretch is read by several tasks, cut at line breaks
            while low < stop:
                cut = stop if stop - low <= STEP else last_break(fs, path, low, low + STEP)
                cut = cut if cut > low else self._next_break(fs, path, low + STEP, stop) or stop
                out.append(Stretch(path, low, cut))
                low = cut
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as f:
            raw = f.read_at(partition.stop - partition.start, partition.start)
        at, places, lines, bad = partition.start, [], [], []
        for line in raw.split(b"\n")[:-1]:
            text = line.rstrip(b"\r")
            try:
                lines.append(text.decode())
                bad.append(False)
            except UnicodeDecodeError:
                lines.append(text.decode(errors="replace"))
                bad.append(True)
            places.append(at)
            at += len(line) + 1
        for i in range(0, len(lines), 10_000):
            part = slice(i, i + 10_000)
            n = len(lines[part])
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(places[part], pa.int64()), pa.array(lines[part], pa.string()), pa.array(bad[part])], names=["path", "at", "line", "bad"])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail(spark: SparkSession, path: str, **options):
    """A streaming table (path, at, line, bad) of the complete lines that files below `path` have and gain."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tail").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
