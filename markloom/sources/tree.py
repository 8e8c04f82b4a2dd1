"""Trees of documents as a data source of Spark: batch and stream readers, and a writer of HTML trees.

    spark.dataSource.register(DocumentTree)
    spark.read.format("markloom").load("/docs")
    spark.readStream.format("markloom").load("/docs")
    compiled.select("doc_id", "html").write.format("markloom").mode("append").save("/site")

Reading: doc_id (the path below the folder), text, size, is_mdx; one row a file, bytes that are no UTF-8 become U+FFFD.
Files are dealt to partitions by size, the largest first, each to the partition that has least, so that many small
files share a task and a large one has its own. With option `pushdown` comparisons of doc_id, size and is_mdx choose files
before any is opened (spark.sql.python.filterPushdown.enabled must be set, too). A stream goes through files by (time of change, path).

Writing: doc_id and html (or text) to a file each, `.md` and the like replaced by `.html`. Tasks write to a folder of their job
below the target; when all have ended their files are moved to their places and `_SUCCESS` is written, and when
the job fails the folder is removed, so failed or repeated tasks leave nothing. In `overwrite` mode what was there goes
after all tasks have succeeded. Two rows with one name fail the job. The file system is the one that pyarrow finds
for the path (local, HDFS, S3, ...).

The driver holds the names of LISTED files at most. A batch over a larger tree has partitions that are shares of folders: the driver
goes through the names once and keeps sizes by folder, and a task lists its folder and takes the names that fall to its share
(files that come or go meanwhile may be read or not). Writing tasks keep names in files of the job's folder, by GROUPS hashes; the driver
takes one group at a time, first to find names that are there twice, then to move. Names of folders, and those of a stream's files, are held whole.

Options: `suffixes` (.md,.mdx,.markdown), `partitionBytes` (16m of text), `maxFilesPerTrigger`, `settleSeconds` (a stream leaves files
that changed so recently for later, since another of the same instant may still come).
"""

from __future__ import annotations

import heapq
import json
import os
import posixpath
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "doc_id string, text string, size long, is_mdx boolean"
#: Bytes of text in a batch, and files that are moved at once.
HELD, MOVERS = 4_000_000, 16
#: Files whose names a batch's driver holds, files of a share, and the most shares that a folder has for their number alone.
LISTED, SHARE, SHARES = 20_000, 2000, 64
#: Groups of names of written files, and names that a task holds.
GROUPS, NAMES = 64, 100_000


@dataclass(frozen=True)
class File:
    path: str
    doc_id: str
    size: int
    ns: int

    def value(self, column: str):
        return {"doc_id": self.doc_id, "size": self.size, "is_mdx": self.doc_id.endswith(".mdx")}[column]


class Tree:
    """A folder in the file system of its path."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.suffixes = tuple(x.strip() for x in options.get("suffixes", ".md,.mdx,.markdown").split(","))
        self.limit = int(options.get("partitionBytes", 16 << 20))
        self.files_per_trigger = int(options.get("maxFilesPerTrigger", 0))
        self.settle = float(options.get("settleSeconds", 0))

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{posixpath.abspath(self.path)}")

    def folders(self) -> Iterator[str]:
        """The tree's folders, its own as ''; those whose names start with _ or . are not read."""
        where, base = self.open()
        left = [""]
        while left:
            here = left.pop()
            yield here
            left += [posixpath.join(here, name) for name, is_file, _ in _listed(where, posixpath.join(base, here), False) if not is_file and name[0] not in "_."]

    def within(self, folder: str, share: tuple[int, int] = (0, 1)) -> Iterator[File]:
        """Documents of a folder, or of one of its shares by name."""
        where, base = self.open()
        k, n = share
        for name, is_file, facts in _listed(where, posixpath.join(base, folder), True):
            if is_file and name[0] not in "_." and name.endswith(self.suffixes) and (n == 1 or zlib.crc32(name.encode("utf-8", "surrogateescape")) % n == k):
                yield File(posixpath.join(base, folder, name), posixpath.join(folder, name), *facts())

    def found(self) -> Iterator[File]:
        for folder in self.folders():
            yield from self.within(folder)

    def files(self) -> list[File]:
        """Documents of the tree."""
        return list(self.found())


def _listed(where: fs.FileSystem, folder: str, files: bool) -> Iterator[tuple[str, bool, Callable[[], tuple[int, int]]]]:
    """Name, whether a file, and what gives size and time of what is in a folder; of local folders one name at a time."""
    if isinstance(where, fs.LocalFileSystem):
        if not os.path.isdir(folder):
            return
        with os.scandir(folder) as found:
            for x in found:
                is_folder = x.is_dir()
                if is_folder or (files and x.is_file()):
                    yield x.name, not is_folder, lambda x=x: (x.stat().st_size, x.stat().st_mtime_ns)
        return
    for x in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if x.is_file or x.type == fs.FileType.Directory:
            yield x.base_name, x.is_file, lambda x=x: (x.size, x.mtime_ns or 0)


class Bin(InputPartition):
    def __init__(self, files: list[File]):
        super().__init__(files)
        self.files = files

    def found(self, tree: Tree) -> Iterable[File]:
        return self.files


@dataclass(frozen=True)
class Share:
    """One of the shares of a folder, by hashes of names."""

    path: str
    share: tuple[int, int]
    size: int


class Shares(Bin):
    def found(self, tree: Tree) -> Iterator[File]:
        for x in self.files:
            yield from tree.within(x.path, x.share)


def bins(files: list[File] | list[Share], limit: int) -> list[Bin]:
    """Files in as many bins as their bytes need, the largest first and each to the emptiest bin."""
    if not files:
        return []
    n = min(len(files), max(1, -(-sum(f.size for f in files) // limit)))
    heap, out = [(0, k) for k in range(n)], [[] for _ in range(n)]
    for f in sorted(files, key=lambda f: (-f.size, f.path)):
        held, k = heapq.heappop(heap)
        out[k].append(f)
        heapq.heappush(heap, (held + f.size + 1, k))
    return [Bin(x) for x in out]


def _batches(tree: Tree, files: Iterable[File]) -> Iterator[pa.RecordBatch]:
    where, _ = tree.open()
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        a, b, c, d = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.bool_())], ["doc_id", "text", "size", "is_mdx"])

    for f in files:
        with where.open_input_stream(f.path) as x:
            rows.append((f.doc_id, x.read().decode("utf-8", "replace"), f.size, f.value("is_mdx")))
        held += f.size
        if held > HELD:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


_TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b),
}


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.tree, self.filters = Tree(options), []

    def _keep(self, x: File) -> bool:
        return all(_TESTS[type(f)](x.value(f.attribute[0]), f.value) for f in self.filters)

    def partitions(self) -> list[InputPartition]:
        files: list[File] | None = []
        sizes: dict[str, list[int]] = {}
        for f in filter(self._keep, self.tree.found()):
            of = sizes.setdefault(posixpath.dirname(f.doc_id), [0, 0])
            of[0] += 1
            of[1] += f.size
            if files is not None:
                files.append(f)
                if len(files) > LISTED:
                    files = None
        if files is not None:
            return bins(files, self.tree.limit) or [Bin([])]
        weight = self.tree.limit // SHARE  # so that a task has SHARE small files or so
        parts = []
        for folder, (n, size) in sizes.items():
            shares = max(-(-size // self.tree.limit), min(SHARES, -(-n // SHARE)), 1)
            parts += [Share(folder, (k, shares), (size + weight * n) // shares) for k in range(shares)]
        return [Shares(b.files) for b in bins(parts, self.tree.limit)]

    def read(self, partition: Bin) -> Iterator[pa.RecordBatch]:
        return _batches(self.tree, filter(self._keep, partition.found(self.tree)))


class ChoosingReader(TreeReader):
    """The reader of option `pushdown`, which Spark refuses to use where its setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes those that the name and size of a file decide; gives back the others."""
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in ("doc_id", "size", "is_mdx") and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f


class TreeStream(DataSourceStreamReader):
    """Offsets are the last file's time of change and path."""

    def __init__(self, options: dict[str, str]):
        self.tree, self.known = Tree(options), None

    def initialOffset(self) -> dict:  # noqa: N802
        self.known = {"ns": -1, "path": ""}
        return self.known

    def _after(self, start: dict | None, end: dict | None = None) -> list[File]:
        place = lambda x: (x["ns"], x["path"])
        found = [f for f in self.tree.files() if (start is None or (f.ns, f.path) > place(start)) and (end is None or (f.ns, f.path) <= place(end))]
        return sorted(found, key=lambda f: (f.ns, f.path))

    def latestOffset(self) -> dict:  # noqa: N802
        """The last file that is there, or that a trigger may take once it is known where the stream stands."""
        before = time.time_ns() - int(self.tree.settle * 1e9)
        found = [f for f in self._after(self.known) if f.ns <= before]
        if self.known is not None and self.tree.files_per_trigger:
            found = found[: self.tree.files_per_trigger]
        return {"ns": found[-1].ns, "path": found[-1].path} if found else self.known or {"ns": -1, "path": ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = end
        return bins(self._after(start, end), self.tree.limit) or [Bin([])]

    def read(self, partition: Bin) -> Iterator[pa.RecordBatch]:
        return _batches(self.tree, partition.files)

    def commit(self, end: dict) -> None:
        self.known = end


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, and where in its file of names each group of each run begins and ends."""

    folder: str
    runs: list[list[int]]

    def names(self, where: fs.FileSystem, group: int) -> Iterator[str]:
        with where.open_input_file(f"{self.folder}.names") as f:
            for ends in self.runs:
                f.seek(ends[group])
                yield from map(json.loads, f.read(ends[group + 1] - ends[group]).splitlines())


def _put_names(out, names: list[str]) -> list[int]:
    """Writes names by group, one a line; where each group begins, and the end."""
    groups: list[list[str]] = [[] for _ in range(GROUPS)]
    for n in names:
        groups[zlib.crc32(n.encode("utf-8", "surrogateescape")) % GROUPS].append(json.dumps(n) + "\n")
    ends = [out.tell()]
    for g in groups:
        out.write("".join(g).encode())
        ends.append(out.tell())
    return ends


def target(doc_id: str, suffixes: tuple[str, ...]) -> str:
    """The file of a document below the target: no scheme, no leading slash, .html."""
    name = doc_id.split("://", 1)[-1].lstrip("/")
    name = next((name[: -len(x)] for x in suffixes if name.endswith(x)), name)
    if not name or any(p in ("", ".", "..") for p in name.split("/")):
        raise ValueError(f"no file name: {doc_id!r}")
    return name + ".html"


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.tree, self.overwrite, self.job = Tree(options), overwrite, f"_job-{uuid.uuid4().hex}"
        names = set(schema.names)
        self.column = next((c for c in ("html", "text") if c in names), None)
        if "doc_id" not in names or self.column is None:
            raise ValueError("a tree is written from doc_id and html (or text)")
        where, base = self.tree.open()
        where.create_dir(f"{base}/{self.job}", recursive=True)

    @staticmethod
    def _folders(where: fs.FileSystem, above: str, name: str, made: set[str]) -> None:
        """The folders of a file below one that must be there: a task that outlives its job makes none."""
        for k in range(len(name.split("/"))):
            here = posixpath.join(above, *name.split("/")[:k])
            if here not in made:
                where.create_dir(here, recursive=False)
                made.add(here)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, base = self.tree.open()
        folder = f"{base}/{self.job}/{uuid.uuid4().hex}"
        names, made, runs = [], set(), []
        with where.open_output_stream(f"{folder}.names") as listed:
            for batch in iterator:
                for doc_id, html in zip(batch.column("doc_id"), batch.column(self.column)):
                    if doc_id.as_py() is None:
                        raise ValueError("a document without doc_id has no file name")
                    name = target(str(doc_id.as_py()), self.tree.suffixes)
                    self._folders(where, folder, name, made)
                    with where.open_output_stream(f"{folder}/{name}") as out:
                        out.write((html.as_py() or "").encode())
                    names.append(name)
                    if len(names) >= NAMES:
                        runs.append(_put_names(listed, names))
                        names = []
            if names:
                runs.append(_put_names(listed, names))
        return Written(folder, runs)

    def commit(self, messages: list[Written | None]) -> None:
        where, base = self.tree.open()
        done = [m for m in messages if m is not None and m.runs]
        for group in range(GROUPS):
            seen = set()
            for n in (n for m in done for n in m.names(where, group)):
                if n in seen:
                    self.abort(messages)
                    raise ValueError(f"two documents have the file {n}")
                seen.add(n)
        where.create_dir(base, recursive=True)
        if self.overwrite:
            for name, is_file, _ in _listed(where, base, True):
                if name != self.job:
                    where.delete_file(f"{base}/{name}") if is_file else where.delete_dir(f"{base}/{name}")
        made = {""}
        with ThreadPoolExecutor(MOVERS) as pool:
            for group in range(GROUPS):
                moves = {n: f"{m.folder}/{n}" for m in done for n in m.names(where, group)}
                for d in {posixpath.dirname(n) for n in moves} - made:
                    where.create_dir(f"{base}/{d}", recursive=True)
                    made.add(d)
                list(pool.map(lambda x: where.move(x[1], f"{base}/{x[0]}"), moves.items()))
        with where.open_output_stream(f"{base}/_SUCCESS"):
            pass
        self._clear(where, base)

    def abort(self, messages: list[Written | None]) -> None:
        where, base = self.tree.open()
        self._clear(where, base)

    def _clear(self, where: fs.FileSystem, base: str) -> None:
        for _ in range(40):  # tasks that are being stopped may still write
            if where.get_file_info(f"{base}/{self.job}").type != fs.FileType.Directory:
                return
            try:
                where.delete_dir(f"{base}/{self.job}")
            except OSError:
                time.sleep(0.25)


class DocumentTree(DataSource):
    """Trees of Markdown documents and of their HTML, by the name of markloom."""

    @classmethod
    def name(cls) -> str:
        return "markloom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        options = dict(self.options)
        return (ChoosingReader if options.get("pushdown", "false") == "true" else TreeReader)(options)

    def streamReader(self, schema: StructType) -> TreeStream:  # noqa: N802
        return TreeStream(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(dict(self.options), schema, overwrite)
