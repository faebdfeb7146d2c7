"""Alignment files as DataFrames: SAM text, gzip and xz whatever they are called, BAM.

Plain and ``.gz`` files go through Spark's own text reader (splittable when plain). What that can't read - xz, gzip
without its ending, BAM - comes through a Python data source, one partition a file.
"""

from __future__ import annotations

import gzip
import lzma
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

XZ, GZ = b"\xfd7zXZ\x00", b"\x1f\x8b"
# Fixed values of the BAM format: letters of operations and of bases by code.
CIGAR_OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"


def detect(path: str) -> str:
    """sam, sam.gz, sam.xz, bam or cram: by the ending, then by the first bytes."""
    name = path.lower()
    for ending in ("sam.gz", "sam.xz", "sam", "bam", "cram"):
        if name.endswith("." + ending):
            return ending
    with open(path, "rb") as f:
        head = f.read(6)
    if head.startswith(b"CRAM"):
        return "cram"
    if head.startswith(XZ):
        return "sam.xz"
    if head.startswith(GZ):
        with gzip.open(path) as g:
            return "bam" if g.read(4) == b"BAM\x01" else "sam.gz"
    return "sam"


def open_plain(path: str):
    """The file's bytes, decompressed by what its first bytes say; gzip may have several members."""
    with open(path, "rb") as f:
        head = f.read(6)
    return lzma.open(path) if head.startswith(XZ) else gzip.open(path) if head.startswith(GZ) else open(path, "rb")


def bgzf_blocks(f) -> Iterator[bytes]:
    """The decompressed blocks of a BGZF stream, each a gzip member of its own."""
    while head := f.read(12):
        if len(head) < 12 or head[:2] != GZ:
            raise ValueError("not a BGZF block")
        extra = f.read(struct.unpack_from("<H", head, 10)[0])
        at, size = 0, None
        while at < len(extra):
            tag, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + n
        if size is None:
            raise ValueError("a BGZF block without its size")
        rest = f.read(size - 12 - len(extra))
        yield zlib.decompress(rest[:-8], -15)


class _Stream:
    def __init__(self, blocks: Iterator[bytes]) -> None:
        self.blocks, self.buffer = blocks, bytearray()

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n and (block := next(self.blocks, None)) is not None:
            self.buffer += block
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.read(4))[0]


def bam_lines(path: str) -> Iterator[str]:
    """A BAM file as SAM lines: the reference lines of its header, then the records (positions are 1-based)."""
    with open(path, "rb") as f:
        s = _Stream(bgzf_blocks(f))
        if s.read(4) != b"BAM\x01":
            raise ValueError(f"{path} isn't BAM")
        s.read(s.number())
        names = []
        for _ in range(s.number()):
            name = s.read(s.number())[:-1].decode()
            names.append(name)
            yield f"@SQ\tSN:{name}\tLN:{s.number()}"
        while len(size := s.read(4)) == 4:
            yield _bam_record(s.read(struct.unpack("<i", size)[0]), names)


def _bam_record(data: bytes, names: list[str]) -> str:
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + n_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    packed = data[at : at + (n_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
    rname = names[ref] if ref >= 0 else "*"
    rnext = "*" if mate < 0 else "=" if mate == ref else names[mate]
    cigar = "".join(f"{o >> 4}{CIGAR_OPS[o & 15]}" for o in ops) or "*"
    # an empty sequence stays empty: such a record counts as a read without alignment
    return "\t".join(map(str, (data[32 : 31 + n_name].decode(), flag, rname, pos + 1, mapq, cigar, rnext, mate_pos + 1, tlen, seq, "*")))


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part) -> Iterator[tuple]:
        path = partition.path
        if detect(path) == "bam":
            for i, line in enumerate(bam_lines(path)):
                yield (line, path, i)
            return
        with open_plain(path) as f:
            for i, raw in enumerate(f):
                yield (raw.decode("utf-8", "replace").rstrip("\r\n"), path, i)


class AlignmentFiles(DataSource):
    """``spark.read.format("alignment_files").option("paths", "a.bam;b.sam.xz")``: (value, file, line_no)."""

    @classmethod
    def name(cls) -> str:
        return "alignment_files"

    def schema(self) -> str:
        return "value string, file string, line_no long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options["paths"].split(";") if p])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ordinal): the non-blank lines of one alignment file, right-trimmed, in a reproducible order."""
    kind = detect(path)
    if kind == "cram":
        raise ValueError("CRAM needs its reference and isn't read; convert it to BAM or SAM")
    by_spark = kind == "sam" or (kind == "sam.gz" and path.endswith(".gz"))
    if by_spark:
        # files are split in the order of their bytes, so the number grows with the place in the file
        lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ordinal"))
    else:
        spark.dataSource.register(AlignmentFiles)
        lines = spark.read.format("alignment_files").option("paths", path).load().select("value", F.col("line_no").alias("ordinal"))
    return lines.select(F.rtrim(F.regexp_replace("value", r"[\r\t ]+$", "")).alias("value"), "ordinal").where(F.col("value") != "")


def header_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").startswith("@SQ"))


def record_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("value").startswith("@"))


def choose_alignment(prefix: str, reuse_sam: str | None = None, resume: bool = False) -> str | None:
    """An alignment file that needn't be made again: the one to reuse, else with ``resume`` the run's own."""
    if reuse_sam:
        if not os.path.exists(reuse_sam):
            raise FileNotFoundError(reuse_sam)
        return reuse_sam
    candidates = [f"{prefix}.sam", f"{prefix}.sam.gz"] if resume else []
    return next((p for p in candidates if os.path.exists(p)), None)
