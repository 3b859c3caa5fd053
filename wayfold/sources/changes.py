"""A streaming source of changed files.

Spark's own file source remembers paths only, so a file that changes is never read again. This one
keeps listings of (path, modification time, size) in a folder of its own; a stream's offset is the
number of a listing, and a batch is the difference of two: files added, changed and removed. Large
files are read in ranges of whole lines."""

from __future__ import annotations

import gzip
import io
import json
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "file STRING, modified BIGINT, change STRING, value STRING"
#: Bytes of one range of a file, and bytes one task reads.
RANGE = 64 << 20


class Ranges(InputPartition):
    """Ranges of files: (path, modified, change, first byte, end byte or None)."""

    def __init__(self, ranges: list[tuple]):
        self.ranges = ranges


class ChangedFilesReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.listings = options["path"], options["listings"]
        self.suffix, self.range = options.get("suffix", ""), int(options.get("range", RANGE))

    def at(self, path: str):
        """The file system of a path, and the path on it."""
        from pyarrow import fs
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def current(self) -> dict[str, list]:
        from pyarrow import fs
        system, folder = self.at(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
        return {f.path: [f.mtime_ns, f.size] for f in found if f.is_file and f.path.endswith(self.suffix) and not any(part.startswith((".", "_")) for part in f.path[len(folder):].split("/"))}

    def listing(self, number: int) -> dict[str, list]:
        if not number:
            return {}
        system, folder = self.at(self.listings)
        with system.open_input_stream(f"{folder}/{number}.json.gz", compression=None) as f:
            return json.loads(gzip.decompress(f.read()))

    def newest(self) -> int:
        from pyarrow import fs
        system, folder = self.at(self.listings)
        known = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return max((int(f.base_name.split(".")[0]) for f in known if f.base_name.endswith(".json.gz")), default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        number, now = self.newest(), self.current()
        if now != self.listing(number):
            system, folder = self.at(self.listings)
            system.create_dir(folder)
            number += 1
            with system.open_output_stream(f"{folder}/_{number}", compression=None) as f:
                f.write(gzip.compress(json.dumps(now).encode()))
            system.move(f"{folder}/_{number}", f"{folder}/{number}.json.gz")
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self.listing(start["listing"]), self.listing(end["listing"])
        tasks, held, room = [], [], self.range
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) == new.get(path):
                continue
            change = "removed" if path not in new else "changed" if path in old else "added"
            modified, size = new.get(path) or old[path]
            for lo in range(0, max(size, 1), self.range) if change != "removed" else [0]:
                hi = min(lo + self.range, size)
                held.append((path, modified, change, lo, hi))
                room -= hi - lo + 4096
                if room <= 0:
                    tasks.append(Ranges(held))
                    held, room = [], self.range
        return tasks + ([Ranges(held)] if held else [])

    def read(self, partition: Ranges):
        system, _ = self.at(self.folder)
        for path, modified, change, lo, hi in partition.ranges:
            if lo == 0:
                yield path, modified, change, None  # a file without lines is news too
            if change == "removed":
                continue
            with system.open_input_file(path) as raw:
                f = io.BufferedReader(raw, 1 << 20)
                f.seek(max(lo - 1, 0))
                if lo:
                    f.readline()  # the line that began before belongs to the range before
                while f.tell() < hi:
                    line = f.readline()
                    if not line:
                        break
                    yield path, modified, change, line.rstrip(b"\r\n").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        """Listings before ``end`` are not needed again, but the one a restart begins from is."""
        from pyarrow import fs
        system, folder = self.at(self.listings)
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.endswith(".json.gz") and int(f.base_name.split(".")[0]) < end["listing"] - 1:
                system.delete_file(f.path)


class ChangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangedFilesReader(self.options)


def changed_lines(spark: SparkSession, folder: str, listings: str, suffix: str = "", range_bytes: int = RANGE) -> DataFrame:
    """Stream of (file, modified, change, value): a row without value per file added, changed or
    removed since the listing before, and a row per line of those added or changed. Files whose
    name or folder starts with a dot or an underscore are left out."""
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format("changed_files").option("listings", listings).option("suffix", suffix).option("range", str(range_bytes)).load(folder)
