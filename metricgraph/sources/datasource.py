"""format("matrix"): delimited number files as a Spark data source, split by file and byte range (A1 to A4).

A path is a file, a folder whose files, by name, are the parts of one matrix, or a pattern of files such as
`root/sim_*/Graph-*.csv`, each a matrix of its own. It may have any scheme that pyarrow.fs knows.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Bytes of a range that one task reads, bytes of a file from which the kinds of columns are inferred, lines of an Arrow batch.
RANGE_BYTES, SAMPLE_BYTES, BATCH_LINES = 64 << 20, 64 << 10, 4096
#: What a line of every layout has: its file, the number of its byte range there, its number in that range, and its text if it
#: does not fit the layout.
PLACE = StructType([StructField("file", StringType()), StructField("part", IntegerType()), StructField("line", LongType()), StructField("reject", StringType())])


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"\w+:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, str, int]]:
    """(matrix, file, bytes) of the files that a path means; hidden ones and those that start with _ do not count."""
    system, at = _located(path)

    def below(root: str) -> list[fs.FileInfo]:
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [f for f in found if f.type == fs.FileType.File and not any(p[0] in "._" for p in posixpath.relpath(f.path, root).split("/"))]

    if "*" in at:
        root = at[: at.index("*")].rsplit("/", 1)[0]
        deep = at.count("/")
        return sorted((f.path, f.path, f.size) for f in below(root) if f.path.count("/") == deep and fnmatch(f.path, at))
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, at, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted((at, f.path, f.size) for f in below(at))


def _numbers(line: bytes, delimiter: bytes) -> list[float] | None:
    """The numbers of a line; None if a cell is none."""
    try:
        return None if b"_" in line else [float(x) for x in line.split(delimiter)]
    except ValueError:
        return None


@dataclass
class _Range(InputPartition):
    matrix: str
    file: str
    part: int
    start: int
    end: int


class MatrixSource(DataSource):
    """Options: path; delimiter (,); layout: `matrix` (values array<double> of a line) or `table` (columns by the header that
    each file has), by default what the first line of the first file looks like; range_bytes. Written files: `files`, a
    pattern with a column in braces, makes one file of the rows of each of its values (rows of one value must be in one
    task, side by side), else each task writes a part of one matrix in the order of the partitions."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def _delimiter(self) -> bytes:
        return self.options.get("delimiter", ",").encode()

    def schema(self) -> StructType:
        """Columns of a table are double if all of their cells in the first SAMPLE_BYTES are numbers, else string. A later
        line that does not fit goes to `reject` as a whole."""
        place, found = PLACE, _files(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        system, _ = _located(self.options["path"])
        with system.open_input_file(found[0][1]) as f:
            head = f.read(SAMPLE_BYTES)
        lines = head.split(b"\n")
        lines = [x for x in (lines if len(head) < SAMPLE_BYTES else lines[:-1] or lines) if x.strip()]
        first = lines[0].split(self._delimiter()) if lines else []
        layout = self.options.get("layout") or ("matrix" if not lines or _numbers(lines[0], self._delimiter()) is not None else "table")
        if layout == "matrix":
            return StructType([*place.fields, StructField("values", ArrayType(DoubleType()))])
        cells = [x.split(self._delimiter()) for x in lines[1:]]
        cells = [c for c in cells if len(c) == len(first)]
        kinds = [DoubleType() if cells and all(_numbers(c[i], b"\0") is not None for c in cells) else StringType() for i in range(len(first))]
        return StructType([*place.fields, *(StructField(n.decode().strip(), k) for n, k in zip(first, kinds, strict=True))])

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options["path"], self._delimiter(), int(self.options.get("range_bytes", RANGE_BYTES)), schema)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], self._delimiter(), self.options.get("files"), schema, overwrite)


class MatrixReader(DataSourceReader):
    """Every line belongs to the range in which it starts; blank lines count for nothing."""

    def __init__(self, path: str, delimiter: bytes, range_bytes: int, schema: StructType):
        self.path, self.delimiter, self.range_bytes, self.schema = path, delimiter, range_bytes, schema

    def partitions(self) -> list[_Range]:
        out, part = [], {}
        for matrix, file, size in _files(self.path):
            for start in range(0, max(size, 1), self.range_bytes):
                part[matrix] = part.get(matrix, -1) + 1
                out.append(_Range(matrix, file, part[matrix], start, min(size, start + self.range_bytes)))
        return out

    def _lines(self, p: _Range) -> Iterator[bytes]:
        system, _ = _located(self.path)
        with system.open_input_file(p.file) as raw:
            raw.seek(max(0, p.start - 1))
            f = io.BufferedReader(raw, 1 << 20)
            at = p.start - 1 + len(f.readline()) if p.start else 0
            while at < p.end and (line := f.readline()):
                at += len(line)
                if line.strip():
                    yield line.rstrip(b"\r\n")

    def read(self, p: _Range) -> Iterator[pa.RecordBatch]:
        kinds = [f.dataType for f in self.schema.fields[4:]]
        table = not (len(kinds) == 1 and isinstance(kinds[0], ArrayType))
        arrow = pa.schema([("file", pa.string()), ("part", pa.int32()), ("line", pa.int64()), ("reject", pa.string()), *((f.name, pa.list_(pa.float64()) if isinstance(k, ArrayType) else pa.float64() if isinstance(k, DoubleType) else pa.string()) for f, k in zip(self.schema.fields[4:], kinds, strict=True))])

        def parsed(line: bytes) -> list | None:
            if not table:
                values = _numbers(line, self.delimiter)
                return None if values is None else [values]
            cells = line.split(self.delimiter)
            try:
                return [_numbers(c, b"\0")[0] if isinstance(k, DoubleType) else c.decode().strip() for c, k in zip(cells, kinds, strict=True)]
            except (TypeError, ValueError):
                return None

        rows, n, skip = [], 0, table and p.start == 0
        for line in self._lines(p):
            if skip:
                skip = False
                continue
            found = parsed(line)
            rows.append([p.matrix, p.part, n, None, *found] if found is not None else [p.matrix, p.part, n, line.decode(errors="replace"), *(None for _ in kinds)])
            n += 1
            if len(rows) == BATCH_LINES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


@dataclass
class _Written(WriterCommitMessage):
    #: (file in the temporary folder, name it gets, lines).
    files: list[tuple[str, str, int]]


class MatrixWriter(DataSourceArrowWriter):
    """Tasks write under _temporary; a commit moves what successful tasks have written, so a repeated task leaves nothing."""

    def __init__(self, path: str, delimiter: bytes, files: str | None, schema: StructType, overwrite: bool):
        self.path, self.delimiter, self.files, self.schema, self.overwrite = path, delimiter.decode(), files, schema, overwrite
        self.key = re.search(r"{(\w+)}", files)[1] if files else None
        self.run = uuid.uuid4().hex

    def _line(self, cells: list) -> str:
        if len(cells) == 1 and isinstance(cells[0], list):
            cells = cells[0]
        out = [repr(float(c)) if isinstance(c, int | float) and not isinstance(c, bool) else "" if c is None else str(c) for c in cells]
        if any(self.delimiter in c or "\n" in c or "\r" in c for c in out):
            raise ValueError(f"a cell holds the delimiter or a line break: {out}")
        return self.delimiter.join(out) + "\n"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, at = _located(self.path)
        folder, done, out, key = f"{at}/_temporary-{self.run}", [], None, None
        system.create_dir(folder)
        names = [f.name for f in self.schema.fields if f.name != self.key]
        table = not (len(names) == 1 and isinstance(self.schema[names[0]].dataType, ArrayType))
        part = TaskContext.get().partitionId()
        try:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
                keys = batch.column(batch.schema.get_field_index(self.key)).to_pylist() if self.key else [part] * batch.num_rows
                for k, *cells in zip(keys, *columns, strict=True):
                    if out is None or k != key:
                        if out is not None:
                            out.close()
                        key, temporary = k, f"{folder}/{uuid.uuid4().hex}.csv"
                        name = re.sub(r"{\w+}", str(k), self.files) if self.files else f"part-{part:06d}-{self.run}.csv"
                        done.append([temporary, name, 0])
                        out = io.BufferedWriter(system.open_output_stream(temporary), 1 << 20)
                        if table:
                            out.write((self.delimiter.join(names) + "\n").encode())
                    out.write(self._line(cells).encode())
                    done[-1][2] += 1
        finally:
            if out is not None:
                out.close()
        if len({d[1] for d in done}) < len(done):
            raise ValueError(f"rows of one value of {self.key} do not lie side by side")
        return _Written([tuple(d) for d in done])

    def commit(self, messages: list[_Written | None]) -> None:
        system, at = _located(self.path)
        written = [f for m in messages if m is not None for f in m.files]
        if len({name for _, name, _ in written}) < len(written):
            raise ValueError(f"rows of one value of {self.key} were written by several tasks")
        if self.overwrite:
            for _, file, _ in _files(self.path):
                system.delete_file(file)
        for temporary, name, _ in written:
            system.create_dir(posixpath.dirname(f"{at}/{name}"))
            system.move(temporary, f"{at}/{name}")
        with system.open_output_stream(f"{at}/_lines-{self.run}.json") as f:
            f.write(json.dumps({name: n for _, name, n in written}).encode())
        system.delete_dir(f"{at}/_temporary-{self.run}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, at = _located(self.path)
        if system.get_file_info(f"{at}/_temporary-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_temporary-{self.run}")


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows format("matrix") from now on."""
    spark.dataSource.register(MatrixSource)
    return spark
