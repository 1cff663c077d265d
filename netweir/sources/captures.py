"""Capture files as a data source whose tasks read ranges of a file: classic captures and the next-generation blocks.

A range need not begin at a record.  Its task looks for the first place from which a run of headers holds together
(lengths that chain, sizes and times that are possible) and reads every record that begins within the range, past
its end if need be; so each record is read once, whatever the ranges.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .readers import PACKET, decoded

#: Bytes of a range; bytes read at a time; the longest record; headers that must chain for a place to be a record's.
RANGE, CHUNK, LONGEST, CHAIN = 64 << 20, 4 << 20, 1 << 18, 4
#: Ranges smaller than ``RANGE`` that a read is cut into; a task for each has its price, so of a larger read they are larger.
MOST = 256
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6), b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}
#: Block types and the byte-order mark of the next-generation format.
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
MARK = 0x1A2B3C4D


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    size: int


def is_ip(frame: bytes) -> bool:
    """Whether a frame begins like one of IP, with up to two VLAN tags."""
    at = 12
    while frame[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
        at += 4
    version = frame[at + 2] >> 4 if len(frame) > at + 2 else 0
    return (frame[at : at + 2], version) in ((b"\x08\x00", 4), (b"\x86\xdd", 6))


class Window:
    """A file's bytes by absolute place, a chunk at a time."""

    def __init__(self, file, size: int, chunk: int = CHUNK):
        self.file, self.size, self.chunk, self.at, self.held = file, size, chunk, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes at ``at``; fewer at the end of the file."""
        n = max(0, min(n, self.size - at))
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, self.chunk))
        return self.held[at - self.at : at - self.at + n]


class Classic:
    """Records with a header of 16 bytes after a file header of 24."""

    first = 24

    def __init__(self, window: Window, magic: bytes):
        self.window = window
        self.order, self.unit = CLASSIC[magic]
        head = window.get(0, 24)
        limit = struct.unpack_from(self.order + "I", head, 16)[0] if len(head) == 24 else 0
        self.limit = min(limit or LONGEST, LONGEST)

    def header(self, at: int) -> tuple[int, int, int, int] | None:
        """Seconds, fraction, bytes held and size of the record at ``at``, if it can be one."""
        raw = self.window.get(at, 16)
        if len(raw) < 16:
            return None
        sec, frac, held, size = struct.unpack(self.order + "IIII", raw)
        return (sec, frac, held, size) if held <= self.limit and size <= LONGEST and frac * self.unit < 1 else None

    def chains(self, at: int) -> bool:
        """Whether headers follow one another from ``at``, within a day of each other, for some records or up to the end,
        and at least one of the frames is IP.

        Where none is, nothing is lost by going on.  A file may end within a record, but not within the first.
        """
        last, known = None, False
        for _ in range(CHAIN):
            if at + 16 > self.window.size:
                break
            head = self.header(at)
            if head is None or not head[2] or not head[3] or (last is not None and abs(head[0] - last) > 86_400):
                return False
            frame = self.window.get(at + 16, min(head[2], 24))
            at += 16 + head[2]
            if at > self.window.size:
                break
            last, known = head[0], known or is_ip(frame)
        return known

    def start(self, begin: int, end: int) -> int | None:
        if begin <= self.first:
            return self.first
        return next((at for at in range(begin, min(end, self.window.size)) if self.chains(at)), None)

    def records(self, begin: int, end: int) -> Iterator[tuple[float, int, bytes]]:
        at = self.start(begin, end)
        while at is not None and at < end:
            head = self.header(at)
            if head is None or at + 16 + head[2] > self.window.size:
                return
            sec, frac, held, size = head
            yield sec + frac * self.unit, size, self.window.get(at + 16, held)
            at += 16 + held


class Blocks:
    """Blocks whose length stands at both ends; interfaces give the units of time.

    A range reads the descriptions before a file's first packet, then seeks its own first block.  Interfaces that are
    described among the packets of an earlier range are not known to it: their times count as microseconds.
    """

    first = 0

    def __init__(self, window: Window):
        self.window, self.order, self.units = window, "<", []

    def block(self, at: int) -> tuple[int, int] | None:
        raw = self.window.get(at, 12)
        if len(raw) < 12:
            return None
        order = self.order
        if struct.unpack_from("<I", raw)[0] == SECTION:
            order = "<" if struct.unpack_from("<I", raw, 8)[0] == MARK else ">"
        kind, length = struct.unpack_from(order + "II", raw)
        if length < 12 or length % 4 or at + length > self.window.size:
            return None
        tail = self.window.get(at + length - 4, 4)
        return (kind, length) if len(tail) == 4 and struct.unpack(order + "I", tail)[0] == length else None

    def _described(self, at: int, kind: int, length: int) -> None:
        if kind == SECTION:
            self.order = "<" if struct.unpack("<I", self.window.get(at + 8, 4))[0] == MARK else ">"
            self.units = []
        elif kind == INTERFACE:
            body, unit, k = self.window.get(at + 16, length - 20), 1e-6, 0
            while k + 4 <= len(body):
                code, n = struct.unpack_from(self.order + "HH", body, k)
                if code == 0:
                    break
                if code == 9 and n >= 1:
                    unit = 2.0 ** -(body[k + 4] & 0x7F) if body[k + 4] & 0x80 else 10.0 ** -body[k + 4]
                k += 4 + (n + 3) // 4 * 4
            self.units.append(unit)

    def chains(self, at: int) -> bool:
        for _ in range(CHAIN):
            if at >= self.window.size:
                return True
            head = self.block(at)
            if head is None:
                return False
            at += head[1]
        return True

    def start(self, begin: int, end: int) -> int | None:
        """The first block of a range; what stands before the first packet is read in any case."""
        at = 0
        while at < begin and (head := self.block(at)) and head[0] not in (SIMPLE, ENHANCED):
            self._described(at, *head)
            at += head[1]
        return at if at >= begin else next((x for x in range(-(-begin // 4) * 4, min(end, self.window.size), 4) if self.chains(x)), None)

    def records(self, begin: int, end: int) -> Iterator[tuple[float, int, bytes]]:
        at = self.start(begin, end)
        while at is not None and at < end and (head := self.block(at)):
            kind, length = head
            if kind in (SECTION, INTERFACE):
                self._described(at, kind, length)
            elif at >= begin and kind == ENHANCED and length >= 32:
                which, high, low, held, size = struct.unpack(self.order + "IIIII", self.window.get(at + 8, 20))
                unit = self.units[which] if which < len(self.units) else 1e-6
                yield ((high << 32) + low) * unit, size, self.window.get(at + 28, min(held, length - 32))
            elif at >= begin and kind == SIMPLE and length >= 16:
                size = struct.unpack(self.order + "I", self.window.get(at + 8, 4))[0]
                yield 0.0, size, self.window.get(at + 12, min(size, length - 16))
            at += length


def records(window: Window, begin: int, end: int) -> Iterator[tuple[float, int, bytes]]:
    """Time, size and bytes of the frames that begin in a range; none of a file of another kind."""
    magic = window.get(0, 4)
    if magic in CLASSIC:
        yield from Classic(window, magic).records(begin, end)
    elif len(magic) == 4 and struct.unpack("<I", magic)[0] == SECTION:
        yield from Blocks(window).records(begin, end)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class CaptureReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self) -> list[Range]:
        found = []
        for path in self.paths:
            fs, inner = opened(path)
            info = fs.get_file_info(inner)
            files = fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if info.type == pafs.FileType.Directory else [info]
            for f in files:
                if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")):
                    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
                    found.append((prefix + f.path, f.size))
        step = max(self.size, min(RANGE, sum(size for _, size in found) // MOST))
        out = [Range(path, b, min(b + step, size), size) for path, size in found for b in range(0, size, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.size:
            return
        fs, inner = opened(part.path)
        with fs.open_input_file(inner) as file:
            for ts, size, frame in records(Window(file, part.size, min(CHUNK, part.end - part.begin)), part.begin, part.end):
                if (packet := decoded(frame)) is not None:
                    yield (ts, *packet[:5], size, *packet[5:])


@dataclass
class Written(WriterCommitMessage):
    path: str


class CaptureWriter(DataSourceWriter):
    """A file for each task, of rows with ts (seconds), length and frame; files of tasks that failed are taken away."""

    def __init__(self, path: str, form: str):
        if form not in ("classic", "blocks"):
            raise ValueError(f"unknown form of captures: {form}")
        self.path, self.form = path, form

    def write(self, rows: Iterator[Row]) -> Written:
        fs, inner = opened(self.path)
        fs.create_dir(inner, recursive=True)
        name = f"part-{uuid.uuid4().hex}.{'pcap' if self.form == 'classic' else 'pcapng'}"
        with fs.open_output_stream(f"{inner}/{name}") as out:
            out.write(self._head())
            for row in rows:
                out.write(self._record(round(row["ts"] * 1_000_000), row["length"], bytes(row["frame"])))
        return Written(f"{inner}/{name}")

    def _head(self) -> bytes:
        if self.form == "classic":
            return b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, LONGEST, 1)
        section = struct.pack("<IIIHHqI", SECTION, 28, MARK, 1, 0, -1, 28)
        return section + struct.pack("<IIHHII", INTERFACE, 20, 1, 0, LONGEST, 20)

    def _record(self, micros: int, size: int, frame: bytes) -> bytes:
        if self.form == "classic":
            return struct.pack("<IIII", *divmod(micros, 1_000_000), len(frame), size) + frame
        pad = -len(frame) % 4
        length = 32 + len(frame) + pad
        return struct.pack("<IIIIIII", ENHANCED, length, 0, micros >> 32, micros & 0xFFFFFFFF, len(frame), size) + frame + b"\0" * pad + struct.pack("<I", length)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)


class CaptureSource(DataSource):
    """``spark.read.format("capture").load(path)``; option ``rangeBytes`` sets the least bytes of a task's range.

    ``rows.write.format("capture").mode("append").save(path)`` writes frames; option ``form`` is classic or blocks.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return PACKET

    def reader(self, schema) -> CaptureReader:
        return CaptureReader([self.options["path"]], int(self.options.get("rangeBytes", RANGE)))

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        if overwrite:
            raise ValueError("captures are only appended")
        return CaptureWriter(self.options["path"], self.options.get("form", "classic"))


def captures(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """Packets of a capture file, or of all those in a folder, in tasks of ``range_bytes``, or of more where that makes too many.

    Files of other kinds hold none.  A path is local or a URI of a store that the executors reach by themselves; of
    any other store, ``packets_of`` reads what Spark's binary files give it, a whole file in each row.
    """
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("rangeBytes", range_bytes).load(path)


def write_captures(frames: DataFrame, path: str, form: str = "classic") -> None:
    """Append ``frames`` (ts in seconds, length, frame) to a folder, a file for each task."""
    frames.sparkSession.dataSource.register(CaptureSource)
    frames.select("ts", "length", "frame").write.format("capture").option("form", form).mode("append").save(path)


def packets_of(contents: DataFrame) -> DataFrame:
    """Packets of the captures in column ``content``, each a whole file's bytes; a null holds none."""
    names = [c.split()[0] for c in PACKET.split(", ")]

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in files:
            for content in pdf["content"]:
                raw = bytes(content or b"")
                found = ((ts, *p[:5], size, *p[5:]) for ts, size, frame in records(Window(io.BytesIO(raw), len(raw)), 0, len(raw)) if (p := decoded(frame)) is not None)
                yield pd.DataFrame(found, columns=names).astype({"icmp_type": "Int32"})

    return contents.select("content").mapInPandas(run, PACKET)
