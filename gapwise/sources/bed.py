"""BED as a source of Spark: spark.dataSource.register(BedSource), then spark.read.format("bed").load(path), or readStream.

Rows are those of text.read_bed. Files are read in splits of bytes, each by its own task, in Arrow batches. A filter on chrom is pushed
down: other rows are dropped as bytes, before any field is cut; with sorted=true (chromosomes in byte order in each file) splits that
can't hold what is asked for are not read at all. Paths are whatever pyarrow's file systems open, local or remote.

Options: path (a file, or a folder of which each file is read, in order of names), splitbytes, onbad ("error", "zero" or "skip"; a
coordinate that is no number), sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "chrom string, start long, stop long, name string, score string, strand string, rest array<string>, ord long"
#: Bytes of a split, bytes read at once; a row's ord is the number of its file times this, and its place in the file.
SPLIT, CHUNK, FILE = 64 << 20, 4 << 20, 1 << 44


@dataclass
class Split(InputPartition):
    """Lines of a file that begin in [lo, hi)."""

    path: str
    number: int
    lo: int
    hi: int


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of each file of the folder that does not begin with "_" or "."."""
    store, inner = fs.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner))
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    rows = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "_."]
    return sorted((scheme + p if scheme and "://" not in p else p, n) for p, n in rows)


def _open(path: str):
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _lines(split: Split) -> Iterator[tuple[list[bytes], list[int]]]:
    """Lines that begin in the split, with their places, in runs of about CHUNK bytes."""
    with _open(split.path) as f:
        at = split.lo
        if at:  # a line that began before belongs to the split before
            f.seek(at - 1)
            rest = b""
            at -= 1
            while b"\n" not in rest:
                more = f.read(CHUNK)
                if not more:
                    return
                rest += more
            cut = rest.index(b"\n") + 1
            at, rest = at + cut, rest[cut:]
        else:
            rest = f.read(CHUNK)
        while at < split.hi:
            more = f.read(CHUNK)
            whole = rest + more
            end = whole.rfind(b"\n") + 1 if more else len(whole)
            if not end and more:
                rest = whole
                continue
            lines, places = whole[:end].split(b"\n"), []
            rest = whole[end:]
            for x in lines:
                places.append(at)
                at += len(x) + 1
            at -= 1 if end and whole[end - 1 : end] == b"\n" else 0  # nothing follows the last line's end
            keep = sum(p < split.hi for p in places)
            yield lines[:keep], places[:keep]
            if keep < len(lines) or not more:
                return


def _batch(lines: list[bytes], places: list[int], number: int, chroms: set[bytes] | None, on_bad: str) -> pa.RecordBatch:
    """The rows of some lines, as text.parse_bed takes them."""
    kept = []
    for x, p in zip(lines, places, strict=True):
        x = x.removesuffix(b"\r")
        if (chroms is None or x[: max(x.find(b"\t"), 0)] in chroms) and x.strip() and not x.startswith((b"#", b"track", b"browser")) and x.count(b"\t") >= 2:
            kept.append((x, p))
    text = pa.array([x for x, _ in kept], pa.binary()).cast(pa.string())
    cells = pc.split_pattern(text, "\t")
    column = lambda i: pc.list_slice(cells, i, i + 1, return_fixed_size_list=True).flatten()

    def coordinate(i: int) -> pa.Array:
        cell = column(i)
        fine = pc.match_substring_regex(cell, r"^\+?[0-9]{1,18}$")
        if on_bad == "error" and not pc.all(fine, min_count=0).as_py():
            raise ValueError(f"no coordinate: {text.filter(pc.invert(fine))[0]}")
        number = pc.cast(pc.utf8_ltrim(pc.if_else(fine, cell, pa.scalar(None, pa.string())), "+"), pa.int64())
        return pc.fill_null(number, 0) if on_bad == "zero" else number

    start, stop = coordinate(1), coordinate(2)
    ords = pa.array([number * FILE + p for _, p in kept], pa.int64())
    out = pa.RecordBatch.from_arrays([column(0), start, stop, column(3), column(4), column(5), pc.list_slice(cells, 3), ords], names=["chrom", "start", "stop", "name", "score", "strand", "rest", "ord"])
    return out.filter(pc.and_(pc.is_valid(start), pc.is_valid(stop)))


class _Reads:
    """What the reader of a table and that of a stream have in common."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.split, self.on_bad = options["path"], int(options.get("splitbytes", SPLIT)), options.get("onbad", "error")
        self.sorted, self.chroms = options.get("sorted", "false").lower() == "true", None
        if self.on_bad not in ("error", "zero", "skip"):
            raise ValueError("onbad: error, zero or skip")

    def splits(self, files: Iterable[tuple[int, str, int]]) -> list[Split]:
        out = []
        for number, path, size in files:
            own = [Split(path, number, lo, min(lo + self.split, size)) for lo in range(0, size, self.split)]
            out += self._asked(own) if self.sorted and self.chroms is not None else own
        return out

    def _asked(self, own: list[Split]) -> list[Split]:
        """Those splits of a sorted file that may hold the chromosomes asked for: from one's first line to the next one's."""
        first = []
        for s in own:
            found = (x.split(b"\t")[0] for lines, _ in _lines(Split(s.path, 0, s.lo, 1 << 62)) for x in lines if x.strip() and not x.startswith((b"#", b"track", b"browser")))
            first.append(next(found, None))
        ends = [*first[1:], None]
        return [s for s, a, b in zip(own, first, ends, strict=True) if a is not None and any(a <= c and (b is None or c <= b) for c in self.chroms)]

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        for lines, places in _lines(partition) if partition else []:  # None: no file
            yield _batch(lines, places, partition.number, self.chroms, self.on_bad)


class BedReader(_Reads, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("chrom",):
                yield f
                continue
            own = {v.encode() for v in values if v is not None}
            self.chroms = own if self.chroms is None else self.chroms & own

    def partitions(self) -> list[Split]:
        return self.splits((i, p, n) for i, (p, n) in enumerate(_files(self.path)))


class BedStream(_Reads, DataSourceStreamReader):
    """Files of a folder as they come; a new one's name must be after all before it. Offsets are numbers of files."""

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return self.splits((i, p, n) for i, (p, n) in enumerate(_files(self.path)) if start["files"] <= i < end["files"])


class BedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BedReader:
        return BedReader(self.options)

    def streamReader(self, schema) -> BedStream:
        return BedStream(self.options)
