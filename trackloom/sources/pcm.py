"""WAV files as sample blocks, read by byte ranges: a long file is many partitions.

Planning lists names and sizes only. A partition owns the blocks that start in its byte
range and reads just the file's head and those blocks, so no task holds a whole file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "path string, sample_rate int, channels int, sample_width int, frames long, "
    "block_idx long, samples array<double>, reason string"
)
BLOCK = 65_536
SPLIT_BYTES = 64 << 20
# Opening a file costs more than reading a short one: a task has so many ranges at most.
SPLIT_RANGES = 1024
# Rows go to Spark together, up to so many rows or samples.
BATCH_ROWS, BATCH_SAMPLES = 4096, 1 << 19
# Fixed values of the format: PCM as such, and in the extensible form.
PLAIN, EXTENSIBLE = 1, 0xFFFE


class _BadWav(Exception):
    pass


def wav_head(file, size: int) -> tuple[int, int, int, int, int]:
    """(rate, channels, bytes a sample, place of the data, their length) from the chunks of a WAV file."""
    if size < 12 or (head := file.read_at(12, 0))[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise _BadWav("not a RIFF/WAVE file")
    at, facts = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", file.read_at(8, at))
        at += 8
        if name == b"fmt ":
            if length < 16 or at + 16 > size:
                raise _BadWav("short format chunk")
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read_at(16, at))
            if kind not in (PLAIN, EXTENSIBLE):
                raise _BadWav(f"unknown format: {kind}")
            if not channels or not bits:
                raise _BadWav("bad format chunk")
            facts = rate, channels, (bits + 7) // 8
        elif name == b"data":
            if facts is None:
                raise _BadWav("data before format")
            return (*facts, at, length)
        at += length + length % 2
    raise _BadWav("no data chunk" if facts else "no format chunk")


def _mono(raw: bytes, channels: int) -> np.ndarray:
    """24-bit little-endian frames as the mean of their channels, in [-1, 1)."""
    packed = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
    value = packed[:, 0] | (packed[:, 1] << 8) | (packed[:, 2] << 16)
    value = np.where(value >= 1 << 23, value - (1 << 24), value)
    return value.reshape(-1, channels).mean(axis=1) / float(1 << 23)


@dataclass
class Ranges(InputPartition):
    """(path, file size, first byte, byte behind the last) of the ranges of one task."""

    parts: list[tuple[str, int, int, int]]

    def __post_init__(self):
        super().__init__(None)


KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.string())
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def _row(path: str, facts: tuple, index, samples, reason) -> tuple:
    return (path, *facts, index, samples, reason)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows by column: a batch has up to BATCH_ROWS rows and closes with BATCH_SAMPLES samples."""

    def closed() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, KINDS, strict=True)], NAMES)

    held, samples = [], 0
    for row in rows:
        held.append(row)
        samples += 0 if row[-2] is None else len(row[-2])
        if len(held) >= BATCH_ROWS or samples >= BATCH_SAMPLES:
            yield closed()
            held, samples = [], 0
    if held:
        yield closed()


class PcmReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.block = int(options.get("block", BLOCK))
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri if ":/" in self.uri else f"file://{self.uri}")

    def partitions(self) -> list[Ranges]:
        system, root = self._system()
        selector = fs.FileSelector(root, recursive=True)
        files = [system.get_file_info(root)]
        if files[0].type == fs.FileType.Directory:
            files = system.get_file_info(selector)
        out, group, held = [], [], 0
        for info in sorted(files, key=lambda f: f.path):
            if info.type != fs.FileType.File or not info.path.lower().endswith(".wav"):
                continue
            for lo in range(0, max(info.size, 1), self.split_bytes):
                hi = min(info.size, lo + self.split_bytes)
                if group and (held + hi - lo > self.split_bytes or len(group) >= SPLIT_RANGES):
                    out.append(Ranges(group))
                    group, held = [], 0
                group.append((info.path, info.size, lo, hi))
                held += hi - lo
        return [*out, Ranges(group)] if group else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _batches(self._rows(partition))

    def _rows(self, partition: Ranges) -> Iterator[tuple]:
        system, _ = self._system()
        for path, size, lo, hi in partition.parts:
            with system.open_input_file(path) as file:
                yield from self._blocks(file, path, size, lo, hi)

    def _blocks(self, file, path: str, size: int, lo: int, hi: int) -> Iterator[tuple]:
        try:
            rate, channels, width, start, length = wav_head(file, size)
        except _BadWav as problem:
            if lo == 0:
                yield _row(path, (None,) * 4, None, None, f"invalid_wav: {problem}")
            return
        frame = channels * width
        facts = (rate, channels, width, length // frame)
        if width != 3:
            if lo == 0:
                yield _row(path, facts, None, None, "not_24_bit")
            return
        step = self.block * frame
        end = start + min(length, size - start) // frame * frame  # whole frames that are there
        index = max(0, -(-(lo - start) // step))
        while (at := start + index * step) < min(hi, end):
            yield _row(path, facts, index, _mono(file.read_at(min(step, end - at), at), channels), None)
            index += 1


class PcmSource(DataSource):
    """``spark.read.format("pcm_blocks")`` with the options ``block`` (samples) and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "pcm_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PcmReader:
        return PcmReader({k.lower(): v for k, v in self.options.items()})


def read_pcm(spark: SparkSession, path: str, block: int = BLOCK, split_bytes: int = SPLIT_BYTES):
    """24-bit WAV files (``.wav`` in any letter case) as mono sample blocks with the header facts.

    One row for each (path, block_idx); a file that is no PCM WAV, or not of 24 bits, has one
    row with its reason. Of a file cut short, the whole frames that are there are read.
    """
    spark.dataSource.register(PcmSource)
    return (
        spark.read.format("pcm_blocks").option("block", str(block)).option("splitBytes", str(split_bytes)).load(path)
    )
