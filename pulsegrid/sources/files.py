"""Readers and a writer for sequencing files as Spark data sources.

``fastq``, ``fasta``, ``maf`` and ``bam`` read files or folders, on local disks or by
any address that Arrow's file systems know (s3, gs, hdfs, file), or the files that a
list names (``@list``).  Plain FASTQ and MAF files, and BAM files by their BGZF blocks,
are cut into pieces of SPLIT bytes; gzip files and FASTA files are one partition each.
Rows are streamed in bounded Arrow batches; ``ord`` rises with the place in the file.
With the option ``errors=rows`` a file that cannot be read gives a row with its
``error`` instead of an end to the job.  ``bam`` also writes: one BGZF file per task in
a folder, or, with the option ``single=true``, one file in the order of the partitions.
Register them with ``register(spark)``.
"""

from __future__ import annotations

import fnmatch
import glob
import gzip
import io
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BATCH = 2000
SPLIT = 64 << 20  # bytes of a file in one partition
NIBBLES = "=ACMGRSVTWYHKDBN"
_LETTER = np.frombuffer(NIBBLES.encode(), np.uint8)
_NIBBLE = np.full(256, 15, np.uint8)
for _i, _c in enumerate(NIBBLES):
    _NIBBLE[ord(_c)] = _NIBBLE[ord(_c.lower())] = _i
#: The end-of-file block of a BGZF file.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it; without a scheme, the local one."""
    path = path.removeprefix("file://")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def paths(spec: str, endings: tuple[str, ...]) -> list[str]:
    """The files of a folder (by their endings), a pattern, a list (``@file``, a path a line) or a single path."""
    if spec.startswith("@"):
        with opened(spec[1:]) as f:
            return [x.strip() for x in f if x.strip()]
    spec = spec.removeprefix("file://")
    if "://" not in spec:
        if os.path.isdir(spec):
            return sorted(os.path.join(spec, n) for n in os.listdir(spec) if n.endswith(endings))
        return sorted(glob.glob(spec)) or [spec]
    where, inner = filesystem(spec)
    scheme = spec.split("://", 1)[0] + "://"
    back = lambda p: scheme + spec.split("://", 1)[1][: -len(inner) or None] + p
    folder, name = inner.rsplit("/", 1) if "*" in inner else (inner, "")
    if name or where.get_file_info(inner).type == pafs.FileType.Directory:
        found = where.get_file_info(pafs.FileSelector(folder))
        return sorted(back(x.path) for x in found if (fnmatch.fnmatch(x.base_name, name) if name else x.base_name.endswith(endings)))
    return [spec]


def opened_bytes(path: str):
    """A file for reading bytes, with seek."""
    path = path.removeprefix("file://")
    if "://" not in path:
        return open(path, "rb")
    where, inner = filesystem(path)
    return where.open_input_file(inner)


def opened(path: str):
    """A file's lines; gzip by its ending."""
    raw = opened_bytes(path)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)


def size_of(path: str) -> int:
    where, inner = filesystem(path)
    return where.get_file_info(os.path.abspath(inner) if isinstance(where, pafs.LocalFileSystem) else inner).size or 0


def _piece(path: str, lo: int, hi: int, starts: Callable[[list[bytes]], bool], ahead: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines from the first record that starts in [lo, hi) on; ``starts`` tells whether a record starts at the first of ``ahead`` lines.

    The reader stops by itself when a record starts at ``hi`` or behind.
    """
    with opened_bytes(path) as f:
        at = lo
        if lo:
            f.seek(lo - 1)
            at = lo - 1 + len(f.readline())  # the first line that starts at lo or behind
            held: list[bytes] = []
            while True:
                while len(held) < ahead and (line := f.readline()):
                    held.append(line)
                if not held or at >= hi:
                    return
                if starts(held):
                    break
                at += len(held.pop(0))
            for line in held:
                yield at, line
                at += len(line)
        while line := f.readline():
            yield at, line
            at += len(line)


def _four(lines: list[bytes]) -> bool:
    """Whether a record starts here: a quality line may start with @, but no + stands two lines below it."""
    return lines[0].startswith(b"@") and len(lines) > 2 and lines[2].startswith(b"+")


def fastq(path: str, lo: int = 0, hi: int | None = None) -> Iterator[tuple]:
    """(read_name, seq, qual, ord) of four-line records that start in [lo, hi); the name is the first token after @."""
    if path.endswith(".gz"):
        lines: Iterator = ((0, x) for x in opened(path))
    else:
        lines = ((at, x.decode()) for at, x in _piece(path, lo, hi or 1 << 62, _four, 3))
    n = (lo // SPLIT) << 40
    for at, head in lines:
        if hi is not None and at >= hi:
            return
        if not head.strip():
            continue
        seq, _, qual = (next(lines, (0, ""))[1].strip() for _ in range(3))
        yield head[1:].split()[0] if head[1:].split() else "", seq, qual, n
        n += 1


def fasta(path: str) -> Iterator[tuple]:
    """(contig, seq, ord), upper-case; text before the first header is dropped."""
    name, parts, n = None, [], 0
    with opened(path) as f:
        for line in f:
            if line.startswith(">"):
                if name is not None:
                    yield name, "".join(parts).upper(), n
                    n += 1
                name, parts = (line[1:].split() or [""])[0], []
            elif name is not None:
                parts.append(line.strip())
    if name is not None:
        yield name, "".join(parts).upper(), n


def maf(path: str, lo: int = 0, hi: int | None = None) -> Iterator[tuple]:
    """(read_name, ref_name, ref_start, ref_strand, ref_src_size, ord) of the blocks that start in [lo, hi): the first s line of a block is the reference, the second the read, later ones are passed."""
    ref, seen, n = None, 0, (lo // SPLIT) << 40
    if path.endswith(".gz"):
        lines: Iterator = ((0, x) for x in opened(path))
    else:
        lines = ((at, x.decode()) for at, x in _piece(path, lo, hi or 1 << 62, lambda x: x[0].startswith(b"a"), 1))
    for at, line in lines:
        if line.startswith("a"):
            if hi is not None and at >= hi:
                return
            ref, seen = None, 0
        elif line.startswith("s"):
            p = line.split()
            seen += 1
            if seen == 1 and len(p) >= 6:
                ref = (p[1], int(p[2]), p[4], int(p[5]))
            elif seen == 2 and ref and len(p) >= 2:
                yield p[1], *ref, n
                n += 1


_SIZE = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_STRUCT = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _tags(data: bytes) -> dict:
    """Integer arrays, integers and strings among a record's tags; all types are passed over rightly."""
    out, i = {}, 0
    while i + 3 <= len(data):
        tag, kind = data[i : i + 2].decode(), chr(data[i + 2])
        i += 3
        if kind in _SIZE:
            if kind in _STRUCT:
                out[tag] = struct.unpack_from("<" + _STRUCT[kind], data, i)[0]
            i += _SIZE[kind]
        elif kind in "ZH":
            end = data.index(b"\0", i)
            out[tag], i = data[i:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[i]), struct.unpack_from("<I", data, i + 1)[0]
            i += 5
            if sub != "f":
                out[tag] = list(struct.unpack_from(f"<{n}{_STRUCT[sub]}", data, i))
            i += n * _SIZE[sub]
        else:
            raise ValueError(f"unknown tag type {kind}")
    return out


_MAGIC = b"\x1f\x8b\x08\x04"


def _block_size(buf: bytes, i: int) -> int:
    """The size of the BGZF block whose header stands at ``i``; 0 if none does."""
    if buf[i : i + 4] != _MAGIC or i + 12 > len(buf):
        return 0
    j, end = i + 12, i + 12 + struct.unpack_from("<H", buf, i + 10)[0]
    while j + 6 <= min(end, len(buf)):
        if buf[j : j + 4] == b"BC\x02\0":
            return struct.unpack_from("<H", buf, j + 4)[0] + 1
        j += 4 + struct.unpack_from("<H", buf, j + 2)[0]
    return 0


def blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the BGZF blocks from the first one that starts at ``at`` or behind: a header whose size leads to another or to the end."""
    f.seek(at)
    held = f.read(3 << 16)  # a block has 64 KB at most
    i = held.find(_MAGIC)
    while i >= 0:
        n = _block_size(held, i)
        if n and (held[i + n : i + n + 4] == _MAGIC or (i + n == len(held) < 3 << 16)):
            break
        i = held.find(_MAGIC, i + 1)
    if i < 0:
        if at == 0 and held:
            raise ValueError("no BGZF file")
        return
    at += i
    f.seek(at)
    while len(head := f.read(12)) == 12:
        head += f.read(struct.unpack_from("<H", head, 10)[0])
        n = _block_size(head, 0)
        body = f.read(max(0, n - len(head)))
        if not n or len(head) + len(body) < n:
            raise ValueError("a broken BGZF block")
        yield at, zlib.decompress(body[:-8], -15)
        at += n


def _plausible(data: bytes, i: int) -> int:
    """Where the record at ``i`` ends if one may start there (behind the data, where it cannot be told); -1 if not."""
    if i + 36 > len(data):
        return len(data) + 1
    size, ref, _, l_name, _, _, n_cigar, _, l_seq, mate, _, _ = struct.unpack_from("<iiiBBHHHiiii", data, i)
    need = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if size < need or size > 1 << 28 or ref < -1 or mate < -1 or l_name < 1 or l_seq < 0:
        return -1
    name = data[i + 36 : i + 36 + l_name]
    if any(c < 33 or c > 126 for c in name[:-1]) or (len(name) == l_name and name[-1]):
        return -1
    tags = i + 36 + need - 32
    if need < size and tags + 3 <= len(data) and not (data[tags : tags + 2].isalnum() and chr(data[tags + 2]) in "AcCsSiIfZHB"):
        return -1
    return i + 4 + size


def _first_record(data: bytes, limit: int, whole: bool) -> int | None:
    """The first place before ``limit`` from which records follow each other: four, or up to the end of the file (``whole``).

    None if more data is needed to tell, -1 if there is no such place.
    """
    b = np.frombuffer(data, np.uint8)
    n = max(0, len(b) - 35)
    ones = lambda o: (b[o : o + n] == 255) & (b[o + 1 : o + 1 + n] == 255) & (b[o + 2 : o + 2 + n] == 255) & (b[o + 3 : o + 3 + n] == 255)
    small = lambda o: b[o + 3 : o + 3 + n] < 16  # a positive number of 28 bits
    for i in np.flatnonzero(small(0) & (ones(4) | small(4)) & (ones(24) | small(24)) & small(20) & (b[12 : 12 + n] > 0)).tolist() if n else []:
        if i >= limit:
            return -1
        at, chain = i, 0
        while 0 <= at < len(data) and chain < 4:
            at, chain = _plausible(data, at), chain + 1
        if chain == 4 and at >= 0 or whole and at == len(data):
            return i
        if at >= len(data) and not whole:
            return None
    return -1 if whole or limit <= n else None


def bam(path: str, lo: int = 0, hi: int | None = None) -> Iterator[tuple]:
    """(read_name, flag, seq, qual, fi, fp, ri, rp, rg, ord) of the records that start in BGZF blocks of [lo, hi)."""
    number = (lo // SPLIT) << 40
    end = 1 << 62 if hi is None else hi
    with opened_bytes(path) as f:
        held, starts, n = b"", [], None if lo else -1  # bytes, (place in them, offset) of their blocks, the next record's place once it is known
        for at, data in blocks(f, lo):
            starts.append((len(held), at))
            held += data
            if lo and n is None:
                n = _first_record(held, next((p for p, o in starts if o >= end), len(held)), False)
                if n == -1:
                    return
            elif not lo and n == -1:
                n = _header(held)
                if n is None:
                    n = -1
            if n is None or n < 0:
                continue
            while len(held) >= n + 4 and len(held) >= n + 4 + (size := struct.unpack_from("<i", held, n)[0]):
                if _block_of(starts, n) >= end:
                    return
                yield *_fields(held[n + 4 : n + 4 + size]), number
                n, number = n + 4 + size, number + 1
            starts = [(0, _block_of(starts, n))] + [(p - n, o) for p, o in starts if p > n] if n < len(held) else []
            held, n = held[n:], 0
            if starts and starts[0][1] >= end:
                return
        if lo and n is None:  # the file ended before a start was certain
            n = _first_record(held, next((p for p, o in starts if o >= end), len(held)), True)
            while 0 <= n < len(held) and _block_of(starts, n) < end:
                size = struct.unpack_from("<i", held, n)[0]
                yield *_fields(held[n + 4 : n + 4 + size]), number
                n, number = n + 4 + size, number + 1
        elif n == -1 or held:
            raise ValueError(f"{path} ends within a record" if n != -1 else f"{path} has no whole header")


def _block_of(starts: list[tuple[int, int]], n: int) -> int:
    """Offset of the block in which place ``n`` lies."""
    return next(o for p, o in reversed(starts) if p <= n)


def _header(data: bytes) -> int | None:
    """Where the first record starts; None if more is needed."""
    if len(data) >= 4 and data[:4] != b"BAM\1":
        raise ValueError("no BAM file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        count, at = struct.unpack_from("<i", data, at)[0], at + 4
        for _ in range(count):
            at += 8 + struct.unpack_from("<i", data, at)[0]
    except struct.error:
        return None
    return at if at <= len(data) else None


def _fields(rec: bytes) -> tuple:
    _, _, l_name, _, _, n_cigar, flag, l_seq, _, _, _ = struct.unpack_from("<iiBBHHHiiii", rec, 0)
    i = 32 + l_name
    name = rec[32 : i - 1].decode()
    i += 4 * n_cigar
    packed = np.frombuffer(rec, np.uint8, (l_seq + 1) // 2, i)
    seq = _LETTER[np.stack((packed >> 4, packed & 15), 1).ravel()[:l_seq]].tobytes().decode()
    i += (l_seq + 1) // 2
    q = rec[i : i + l_seq]
    qual = None if not l_seq or q[0] == 255 else (np.frombuffer(q, np.uint8) + np.uint8(33)).tobytes().decode("latin-1")
    t = _tags(rec[i + l_seq :])
    arr = lambda k: t[k] if isinstance(t.get(k), list) else None
    return name, flag, seq or None, qual, arr("fi"), arr("fp"), arr("ri"), arr("rp"), t.get("RG")


def record(name: str, seq: str | None, qual: str | None, fi, fp, rg: str | None, flag: int = 4) -> bytes:
    """An unaligned BAM record with the signals as unsigned byte arrays."""
    seq, tags = seq or "", b""
    for tag, v in (("fi", fi), ("fp", fp)):
        if v is not None:
            tags += tag.encode() + b"BC" + struct.pack("<I", len(v)) + bytes(v)
    if rg:
        tags += b"RGZ" + rg.encode() + b"\0"
    codes = _NIBBLE[np.frombuffer(seq.encode("ascii", "replace") + b"=" * (len(seq) % 2), np.uint8)]
    packed = (codes[::2] << 4 | codes[1::2]).tobytes()
    quals = (np.frombuffer(qual.encode("latin-1"), np.uint8) - np.uint8(33)).tobytes() if qual and len(qual) == len(seq) else b"\xff" * len(seq)
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 255, 4680, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed + quals + tags
    return struct.pack("<i", len(body)) + body


def header(groups: list[str] | None = None, order: str = "unknown") -> bytes:
    text = f"@HD\tVN:1.6\tSO:{order}\n" + "".join(f"@RG\tID:{g}\tSM:{g}\n" for g in groups or [])
    return b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", 0)


class BgzfWriter:
    """Writes bytes as BGZF blocks of less than 64 KB; ``close`` adds the end-of-file block unless told not to."""

    def __init__(self, file):
        self.file, self.held = file, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= 65_000:
            self._block(bytes(self.held[:65_000]))
            del self.held[:65_000]

    def _block(self, data: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
        if len(body) > 65_500:
            for i in range(0, len(data), 32_000):
                self._block(data[i : i + 32_000])
            return
        self.file.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data)))

    def close(self, end: bool = True) -> None:
        if self.held:
            self._block(bytes(self.held))
        if end:
            self.file.write(EOF_BLOCK)
        self.file.close()


_SPECS = {
    "fastq": (fastq, (".fq", ".fastq", ".fq.gz", ".fastq.gz"), "read_name string, seq string, qual string, ord bigint", [pa.string()] * 3 + [pa.int64()]),
    "fasta": (fasta, (".fa", ".fna", ".fasta", ".fa.gz", ".fna.gz", ".fasta.gz", ".ref"), "contig string, seq string, ord bigint", [pa.string()] * 2 + [pa.int64()]),
    "maf": (maf, (".maf", ".maf.gz"), "read_name string, ref_name string, ref_start bigint, ref_strand string, ref_src_size bigint, ord bigint", [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]),
    "bam": (
        bam, (".bam",), "read_name string, flag int, seq string, qual string, fi array<int>, fp array<int>, ri array<int>, rp array<int>, rg string, ord bigint",
        [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * 4, pa.string(), pa.int64()],
    ),
}


class _File(InputPartition):
    def __init__(self, path: str, lo: int = 0, hi: int | None = None):
        self.path, self.lo, self.hi = path, lo, hi


class _Reader(DataSourceReader):
    def __init__(self, kind: str, spec: str, errors: bool):
        self.kind, self.spec, self.errors = kind, spec, errors

    def partitions(self):
        out = []
        for p in paths(self.spec, _SPECS[self.kind][1]):
            if self.kind == "fasta" or p.endswith(".gz"):
                out.append(_File(p))
            else:
                out += [_File(p, lo, lo + SPLIT) for lo in range(0, max(1, size_of(p)), SPLIT)]
        return out

    def read(self, partition):
        parse, _, schema, types = _SPECS[self.kind]
        names = [x.split()[0] for x in schema.split(", ")] + ["file"] + ["error"] * self.errors
        rows: list[tuple] = []

        def batch(error=None):
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            n = len(rows) + (error is not None)
            more = [pa.array([partition.path] * n)] + ([pa.array([None] * len(rows) + [error] * (error is not None), pa.string())] if self.errors else [])
            return pa.RecordBatch.from_arrays([pa.array([*c, None] if error is not None else c, t) for c, t in zip(cols, types, strict=True)] + more, names=names)

        try:
            for row in parse(partition.path) if partition.hi is None else parse(partition.path, partition.lo, partition.hi):
                rows.append(row)
                if len(rows) == BATCH:
                    yield batch()
                    rows = []
        except Exception as e:
            if not self.errors:
                raise
            yield batch(f"{type(e).__name__}: {e}")
            return
        if rows:
            yield batch()


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls):
        return cls.kind

    def _errors(self) -> bool:
        return self.options.get("errors", "raise") == "rows"

    def schema(self):
        return _SPECS[self.kind][2] + ", file string" + ", error string" * self._errors()

    def reader(self, schema):
        return _Reader(self.kind, self.options["path"], self._errors())


class FastqSource(_Source):
    kind = "fastq"


class FastaSource(_Source):
    kind = "fasta"


class MafSource(_Source):
    kind = "maf"


class _Wrote(WriterCommitMessage):
    def __init__(self, path: str, place: int):
        self.path, self.place = path, place


class _BamWriter(DataSourceWriter):
    """One file per task in a folder, or one file: tasks write record blocks beside it, and the commit puts them behind one header in order."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.target, self.names, self.overwrite = options["path"], names, overwrite
        self.groups = [g for g in options.get("groups", "").split(",") if g]
        self.order, self.single = options.get("order", "unknown"), options.get("single", "false") == "true"

    def write(self, iterator):
        import uuid

        from pyspark import TaskContext

        where, path = filesystem(self.target)
        folder = path + ".parts" if self.single else path
        where.create_dir(folder, recursive=True)
        place = TaskContext.get().partitionId()
        part = f"{folder}/part-{place:05d}-{uuid.uuid4().hex}.bam.tmp"
        out = BgzfWriter(where.open_output_stream(part))
        if not self.single:
            out.write(header(self.groups, self.order))
        for row in iterator:
            r = row.asDict() if hasattr(row, "asDict") else dict(zip(self.names, row, strict=True))
            out.write(record(r["read_name"], r.get("seq"), r.get("qual"), r.get("fi"), r.get("fp"), r.get("rg"), r.get("flag") or 4))
        out.close(end=not self.single)
        return _Wrote(part, place)

    def commit(self, messages):
        where, path = filesystem(self.target)
        done = sorted((m for m in messages if m), key=lambda m: m.place)
        if not self.single:
            if self.overwrite and where.get_file_info(path).type == pafs.FileType.Directory:
                mine = {m.path for m in done}
                for x in where.get_file_info(pafs.FileSelector(path)):
                    if x.type == pafs.FileType.File and x.path not in mine and x.base_name.startswith("part-"):
                        where.delete_file(x.path)
            for m in done:
                where.move(m.path, m.path.removesuffix(".tmp"))
            return
        head = io.BytesIO()
        first = BgzfWriter(head)
        first.write(header(self.groups, self.order))
        first._block(bytes(first.held))
        with where.open_output_stream(path + ".tmp") as out:
            out.write(head.getvalue())
            for m in done:
                with where.open_input_stream(m.path) as f:
                    while chunk := f.read(8 << 20):
                        out.write(chunk)
            out.write(EOF_BLOCK)
        where.move(path + ".tmp", path)
        if where.get_file_info(path + ".parts").type == pafs.FileType.Directory:
            where.delete_dir(path + ".parts")

    def abort(self, messages):
        where, _ = filesystem(self.target)
        for m in messages:
            if m and where.get_file_info(m.path).type == pafs.FileType.File:
                where.delete_file(m.path)


class BamSource(_Source):
    kind = "bam"

    def writer(self, schema, overwrite):
        return _BamWriter(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    for s in (FastqSource, FastaSource, MafSource, BamSource):
        spark.dataSource.register(s)
