"""A sink for numbered part files that commits: Spark's Python Data Source writer.

Rows are (part, data): bytes for the file of that number, in the order of the rows. Each task writes its parts into a
staging folder, under names of its own attempt; only the driver's commit, after all tasks, moves the files of the attempts
that count to their names and removes the folder. So a task that fails, runs twice or is lost leaves nothing behind, and
a job that fails leaves what was there before. The index lists the committed parts with their rows and bytes; earlier parts
of the same prefix that the job has not written anew are removed. No row passes through the driver.

Paths are those that ``pyarrow.fs`` can write: local and shared folders, HDFS where its client is there, object stores.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "numbered_parts"


def opened(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    if match := re.match(r"file:/*(/.*)", path):
        path = match[1]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    #: (part, staged name, rows, bytes before compression)
    files: list[tuple[int, str, int, int]]


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, prefix: str, suffix: str, level: int | None, single: bool = False):
        self.path, self.prefix, self.suffix, self.level, self.single = path, prefix, suffix, level, single
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def name_of(self, part: int) -> str:
        return f"{self.prefix}{self.suffix}" if self.single else f"{self.prefix}-{part:05d}{self.suffix}"

    def write(self, iterator: Iterator) -> Written:
        """The rows of a task, sorted by part; one file is open at a time."""
        import zstandard

        files, root = opened(self.path)
        folder = posixpath.join(root, self.staging)
        files.create_dir(folder, recursive=True)
        done: list[tuple[int, str, int, int]] = []
        part, closing, sink = None, [], None

        def close():
            while closing:
                closing.pop().close()

        try:
            for batch in iterator:
                for number, data in zip(batch.column(0), batch.column(1), strict=True):
                    if number.as_py() != part:
                        close()
                        part, name = number.as_py(), uuid.uuid4().hex
                        sink = files.open_output_stream(posixpath.join(folder, name), compression=None)
                        closing.append(sink)
                        if self.level is not None:
                            sink = zstandard.ZstdCompressor(level=self.level).stream_writer(sink, closefd=False)
                            closing.append(sink)
                        done.append((part, name, 0, 0))
                    sink.write(data.as_buffer())
                    at, name, rows, size = done[-1]
                    done[-1] = at, name, rows + 1, size + data.as_buffer().size
        finally:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        files, root = opened(self.path)
        parts = sorted(f for m in messages if m is not None for f in m.files)
        names = {self.name_of(p) for p, *_ in parts}
        if len(names) != len(parts):
            self.abort(messages)
            raise ValueError("rows of one part came from several tasks")
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: files.move(posixpath.join(root, self.staging, f[1]), posixpath.join(root, self.name_of(f[0]))), parts))
        own = re.compile(re.escape(self.name_of(0)) if self.single else rf"{re.escape(self.prefix)}-\d{{5,}}{re.escape(self.suffix)}")
        for path in _names(files, root):
            if own.fullmatch(path) and path not in names:
                files.delete_file(posixpath.join(root, path))
        index = [{"file": self.name_of(p), "rows": rows, "bytes": size} for p, _, rows, size in parts]
        files.create_dir(root, recursive=True)
        with files.open_output_stream(posixpath.join(root, f"{self.prefix}.index.json")) as f:
            f.write(json.dumps(index).encode())
        self.abort(messages)

    def abort(self, messages) -> None:
        """Removes the staging folder; nothing else has been touched."""
        from pyarrow import fs

        files, root = opened(self.path)
        if files.get_file_info(posixpath.join(root, self.staging)).type != fs.FileType.NotFound:
            files.delete_dir(posixpath.join(root, self.staging))


def _names(files, root: str) -> list[str]:
    from pyarrow import fs

    return [f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File]


class NumberedParts(DataSource):
    """``df.write.format("numbered_parts")`` of (part, data), each part in one task and sorted; see ``write_parts``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "part long, data binary"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        level = self.options.get("level")
        return PartsWriter(self.options["path"], self.options["prefix"], self.options["suffix"], None if level is None else int(level), "single" in self.options)


def write_parts(rows: DataFrame, path: str, prefix: str, suffix: str, level: int | None = None, single: bool = False) -> list[dict]:
    """Writes (part, at, data), ``data`` in the order of ``at``, as ``{prefix}-{part:05d}{suffix}``; the index of the parts.

    With ``level``, files are compressed by zstd. With ``single``, there is only one part, whose name has no number.
    """
    rows.sparkSession.dataSource.register(NumberedParts)
    sorted_ = rows.repartition("part").sortWithinPartitions("part", "at").selectExpr("cast(part AS long) AS part", "data")
    out = sorted_.write.format(FORMAT).options(prefix=prefix, suffix=suffix, path=path)
    out = out if level is None else out.option("level", level)
    (out.option("single", "yes") if single else out).mode("append").save()
    files, root = opened(path)
    with files.open_input_stream(posixpath.join(root, f"{prefix}.index.json")) as f:
        return json.loads(f.read())
