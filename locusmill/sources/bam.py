"""BAM files, read and written without whole files in any one place.

A BAM file is a row of compressed blocks (BGZF). Reading, the blocks' fixed head is the separator of a text scan, so
that any file system that Spark reads will do and large files are split; a split's first alignment is found by its
fields, and what lies across a split's end is put together from the pieces and has to be one alignment exactly.
Writing, every block ends with the zero byte of its length's highest place, which is the separator of a text sink.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusmill.operators.index import dense_index

# Fixed values of the format: a block's head, the last block, the letters of operations and bases, and types of numbers.
HEAD = bytes([31, 139, 8, 4, 0, 0, 0, 0, 0, 255, 6, 0, 66, 67, 2, 0])
LAST_BLOCK = HEAD + bytes([27, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
CIGAR_LETTERS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
TAG_TYPES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
FIXED = struct.Struct("<iiBBHHHiiii")

#: Bytes of a written block before compression, and alignments in a batch.
BLOCK_BYTES, BATCH = 0xFF00, 5000
#: Alignments in a row by which a split's first is recognised.
CHAIN = 5

NAMES = ("qname", "flag", "ref", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags")
KINDS = pa.schema(
    [("qname", pa.string()), ("flag", pa.int32()), ("ref", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("rnext", pa.string()), ("pnext", pa.int32()), ("tlen", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))]
)
SQL_KINDS = "qname string, flag int, ref string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"


@dataclass
class Header:
    """Text and references (name, length) of a BAM file; size is where its first alignment begins."""

    text: str = ""
    names: list[str] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    size: int = 0

    @classmethod
    def parse(cls, data: bytes) -> Header | None:
        """None if data ends before the header does."""
        if data[:4] != b"BAM\x01"[: len(data)]:
            raise ValueError("not a BAM file")
        out = cls()
        try:
            n = struct.unpack_from("<i", data, 4)[0]
            out.text = data[8 : 8 + n].rstrip(b"\0").decode()
            at = 8 + n
            count = struct.unpack_from("<i", data, at)[0]
            at += 4
            for _ in range(count):
                size = struct.unpack_from("<i", data, at)[0]
                if at + 8 + size > len(data):
                    return None
                out.names.append(data[at + 4 : at + 3 + size].decode())
                out.lengths.append(struct.unpack_from("<i", data, at + 4 + size)[0])
                at += 8 + size
        except struct.error:
            return None
        out.size = at
        return out if at <= len(data) else None

    def bytes(self) -> bytes:
        text = self.text.encode()
        refs = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", x) for n, x in zip(self.names, self.lengths, strict=True))
        return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.names)) + refs


def inflate(block: bytes) -> bytes:
    """Contents of a block without its head, checked against its sizes and checksum."""
    if len(block) < 10 or struct.unpack_from("<H", block)[0] + 1 != len(block) + len(HEAD):
        raise ValueError("a block's length is not what it says; is the file cut, or not BGZF?")
    data = zlib.decompress(block[2:-8], wbits=-15)
    if struct.unpack("<II", block[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError("a block's checksum or size is wrong")
    return data


def deflate(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return HEAD + struct.pack("<H", len(body) + len(HEAD) + 9) + body + struct.pack("<II", zlib.crc32(data), len(data))


def tags_of(data: bytes, at: int, end: int) -> list[tuple[str, str]]:
    out = {}
    while at < end:
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out[tag], at = chr(data[at]), at + 1
        elif kind in "ZH":
            stop = data.index(b"\0", at)
            out[tag], at = data[at:stop].decode(), stop + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            step = struct.calcsize(TAG_TYPES[sub])
            out[tag] = ",".join([sub, *(str(struct.unpack_from(TAG_TYPES[sub], data, at + 5 + k * step)[0]) for k in range(n))])
            at += 5 + n * step
        else:
            out[tag], at = str(struct.unpack_from(TAG_TYPES[kind], data, at)[0]), at + struct.calcsize(TAG_TYPES[kind])
    return list(out.items())


def alignment(data: bytes, at: int, refs: list[str]) -> tuple:
    """The alignment whose size stands at `at`, as values of NAMES."""
    size = struct.unpack_from("<i", data, at)[0]
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, rnext, pnext, tlen = FIXED.unpack_from(data, at + 4)
    p = at + 36 + l_name
    ops = struct.unpack_from(f"<{n_ops}I", data, p)
    p += 4 * n_ops
    seq = "".join([BASES[b >> 4] + BASES[b & 15] for b in data[p : p + (l_seq + 1) // 2]])[:l_seq]
    p += (l_seq + 1) // 2
    qual = data[p : p + l_seq]
    name = lambda i: refs[i] if i >= 0 else "*"
    return (
        data[at + 36 : at + 35 + l_name].decode(), flag, name(ref), pos + 1, mapq, "".join([f"{o >> 4}{CIGAR_LETTERS[o & 15]}" for o in ops]) or "*", "=" if rnext == ref and rnext >= 0 else name(rnext), pnext + 1, tlen,
        seq or "*", "*" if not qual or qual[0] == 255 else bytes([q + 33 for q in qual]).decode(), tags_of(data, p + l_seq, at + 4 + size),
    )


def plausible(data: bytes, at: int, refs: int) -> int | None:
    """Where the alignment at `at` ends, if its fields can be an alignment's; None if they can't."""
    if at + 36 > len(data):
        return None
    size = struct.unpack_from("<i", data, at)[0]
    ref, pos, l_name, _, _, n_ops, _, l_seq, rnext, pnext, _ = FIXED.unpack_from(data, at + 4)
    if not (-1 <= ref < refs and -1 <= rnext < refs and pos >= -1 and pnext >= -1 and l_name >= 2 and l_seq >= 0):
        return None
    if size < 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq or size > 1 << 28:
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def first_alignment(data: bytes, refs: int, whole: bool) -> int | None:
    """Where the first alignment begins, by CHAIN plausible ones in a row or up to the end; None if more data is needed."""
    for at in range(len(data) - 36):
        end, n = plausible(data, at, refs), 0
        while end is not None and end < len(data) and n < CHAIN:
            nxt = plausible(data, end, refs)
            if nxt is None and end + 36 > len(data):
                break
            end, n = nxt, n + 1
        if end is not None and (whole or n >= CHAIN or end < len(data)):
            return at
    return None


def splits(headers: dict[str, Header]):
    """Blocks (path, start, block) in order to alignments, with `n`, and one row more per split, without a name: whether
    an alignment begins in it, its bytes before the first (lead), and after the last whole one (tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_split: tuple | None = None
        held, lead, started, n = bytearray(), b"", False, 0
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            k = len(rows)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(NAMES)
            arrays = [pa.array([at_split[0]] * k, pa.string()), pa.array([at_split[1]] * k, pa.int64()), pa.array(range(n - k, n), pa.int64())]
            arrays += [pa.array(c, f.type) for c, f in zip(cols, KINDS, strict=True)] + [pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*PLACE, *NAMES, "begins", "lead", "tail"])

        def take(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal lead, started, n
            head = headers[at_split[0]]
            if not started:
                if at_split[1] == 0:
                    if len(held) < head.size:
                        if last:
                            raise ValueError("a file's first split is smaller than its header")
                        return
                    begin = head.size
                    del held[:begin]
                else:
                    if len(held) < 1 << 20 and not last:
                        return
                    begin = first_alignment(bytes(held), len(head.names), last)
                    if begin is None:
                        return
                    lead = bytes(held[:begin])
                    del held[:begin]
                started = True
            data, at = bytes(held), 0
            while at + 4 <= len(data) and at + 4 + struct.unpack_from("<i", data, at)[0] <= len(data):
                rows.append(alignment(data, at, head.names))
                n += 1
                at += 4 + struct.unpack_from("<i", data, at)[0]
                if len(rows) >= BATCH:
                    yield out()
            del held[:at]

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, lead, started, n
            yield from take(True)
            if rows:
                yield out()
            pieces = (lead, bytes(held)) if started else (bytes(held), b"")
            arrays = [pa.array([at_split[0]]), pa.array([at_split[1]], pa.int64()), pa.array([n], pa.int64()), *(pa.nulls(1, f.type) for f in KINDS), pa.array([started]), pa.array([pieces[0]], pa.binary()), pa.array([pieces[1]], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*PLACE, *NAMES, "begins", "lead", "tail"])
            held, lead, started, n = bytearray(), b"", False, 0

        for batch in batches:
            for path, start, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, start) != at_split:
                    if at_split is not None:
                        yield from done()
                    at_split = (path, start)
                held += inflate(block)
                if len(held) >= 1 << 21:
                    yield from take(False)
        if at_split is not None:
            yield from done()

    return run


PLACE = ("path", "start", "n")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, block): blocks without their heads in the order of their splits, each split's in its own order."""
    text = spark.read.option("encoding", "ISO-8859-1").option("lineSep", HEAD.decode("latin-1")).text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("block")).where(F.octet_length("block") > 0)


def headers(spark: SparkSession, path: str, most: int = 64) -> dict[str, Header]:
    """Headers by file; a file's first blocks are read, more of them where a header is longer."""
    first = blocks(spark, path).where("start = 0").withColumn("at", F.monotonically_increasing_id())
    while True:
        few = first.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("at"))).where(F.col("nth") <= most)
        found: dict[str, bytes] = {}
        for p, block in few.orderBy("path", "at").select("path", "block").collect():  # `most` blocks a file
            found[p] = found.get(p, b"") + inflate(bytes(block))
        out = {p: Header.parse(data) for p, data in found.items()}
        if all(out.values()):
            return out
        if few.groupBy("path").count().where(F.col("count") == most).isEmpty():
            raise ValueError("a header ends before it is complete")
        most *= 8


def pieced(headers_: dict[str, Header]):
    """Alignments (path, start, n, data) that lie across splits, each put together; raises if data isn't one exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, start, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(data) < 36 or struct.unpack_from("<i", data)[0] + 4 != len(data):
                    raise ValueError(f"{path}: an alignment at the end of a split isn't whole; the file is damaged or cut")
                rows.append((path, start, n, *alignment(data, 0, headers_[path].names)))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), *(f.type for f in KINDS)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*PLACE, *NAMES])

    return run


def bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files (SAM's columns, file_seq numbering them in file order, files by name)."""
    heads = headers(spark, path)
    found = blocks(spark, path).mapInArrow(splits(heads), f"path string, start long, n long, {SQL_KINDS}, begins boolean, lead binary, tail binary")
    ends = found.where("begins is not null").select(*PLACE, "begins", "lead", "tail")  # one small row for each split
    order = Window.partitionBy("path").orderBy("start")
    ends = ends.withColumn("g", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.col("g") - F.col("begins").cast("int")
    pieces = ends.select("path", "g", F.lit(None).cast("long").alias("s"), *PLACE[1:], F.col("tail").alias("data")).where("begins").drop("s")
    pieces = pieces.unionByName(ends.select("path", before.alias("g"), "start", F.lit(-1).cast("long").alias("n"), F.col("lead").alias("data")))
    joined = pieces.groupBy("path", "g").agg(F.array_sort(F.collect_list(F.struct("start", F.when(F.col("n") < 0, 0).otherwise(1).alias("side"), "data"))).alias("p"), F.max(F.when(F.col("n") >= 0, F.struct("start", "n"))).alias("of"))
    whole = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"]))
    joined = joined.select("path", F.coalesce("of.start", F.lit(0)).alias("start"), F.coalesce("of.n", F.lit(0)).alias("n"), whole.alias("data")).where(F.octet_length("data") > 0)
    rest = joined.mapInArrow(pieced(heads), f"path string, start long, n long, {SQL_KINDS}")
    rows = found.where("begins is null").select(*PLACE, *NAMES).unionByName(rest)
    return dense_index(rows, list(PLACE)).withColumn("file_seq", F.col("idx")).drop(*PLACE, "idx")


def header_rows(spark: SparkSession, path: str) -> DataFrame:
    """References (ref, length) of BAM files, in order."""
    refs = {(n, x) for h in headers(spark, path).values() for n, x in zip(h.names, h.lengths, strict=True)}
    return spark.createDataFrame(sorted(refs), "ref string, length long")


def bin_of(begin: int, end: int) -> int:
    """The format's bin of a half-open interval."""
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return offset + (begin >> shift)
    return 0


def encoded(row: tuple, refs: dict[str, int]) -> bytes:
    """An alignment's bytes. Tags that are integers are written as such, all others as text."""
    qname, flag, ref, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags = row
    ops = []
    for n, letter in cigar_ops(cigar):
        ops.append(n << 4 | CIGAR_LETTERS.index(letter))
    span = sum(o >> 4 for o in ops if CIGAR_LETTERS[o & 15] in "MDN=X") or 1
    seq = "" if seq == "*" else seq
    codes = [max(BASES.find(c), 0) if c in BASES else 15 for c in seq.upper()]
    codes += [0] * (len(codes) % 2)
    quals = b"\xff" * len(seq) if qual == "*" else bytes(ord(c) - 33 for c in qual)
    rid = refs.get(ref, -1)
    parts = []
    for tag, value in sorted(tags):
        try:
            number = int(value) if str(int(value)) == value and abs(int(value)) < 1 << 31 else None
        except ValueError:
            number = None
        parts.append(tag.encode() + (b"i" + struct.pack("<i", number) if number is not None else b"Z" + value.encode() + b"\0"))
    name = qname.encode() + b"\0"
    fixed = FIXED.pack(rid, pos - 1, len(name), mapq, bin_of(max(pos - 1, 0), max(pos - 1, 0) + span), len(ops), flag, len(seq), rid if rnext == "=" else refs.get(rnext, -1), pnext - 1, tlen)
    body = fixed + name + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + quals + b"".join(parts)
    return struct.pack("<i", len(body)) + body


def cigar_ops(cigar: str) -> Iterator[tuple[int, str]]:
    n = 0
    for c in cigar if cigar != "*" else "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            yield n, c
            n = 0


def packed(refs: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()

        def out(all_: bool) -> pa.RecordBatch:
            done = []
            while len(held) >= BLOCK_BYTES or (all_ and held):
                done.append(deflate(bytes(held[:BLOCK_BYTES]))[:-1])
                del held[:BLOCK_BYTES]
            return pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["value"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = encoded(row, refs)
                if len(held) + len(data) > BLOCK_BYTES and held:  # an alignment begins a block if it doesn't fit the last
                    held_block = bytes(held)
                    held.clear()
                    for k in range(0, len(held_block), BLOCK_BYTES):
                        yield pa.RecordBatch.from_arrays([pa.array([deflate(held_block[k : k + BLOCK_BYTES])[:-1]], pa.binary())], names=["value"])
                held += data
        yield out(True)

    return run


def write_bam(rows: DataFrame, head: Header, path: str, order: list[str] | None = None) -> None:
    """One BAM file of SAM's columns in order: tasks write their parts, which are then joined within the file system.

    The parts are in a folder beside the file until they are joined; only bytes pass through the driver, as a stream.
    """
    spark = rows.sparkSession
    refs = {n: i for i, n in enumerate(head.names)}
    parts = f"{path}.parts"
    body = rows.orderBy(*(order or ["file_seq"])).select(*NAMES).mapInArrow(packed(refs), "value binary")
    body.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\0").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    out = fs.create(target, True)
    try:
        data = head.bytes()
        for k in range(0, len(data), BLOCK_BYTES):
            out.write(bytearray(deflate(data[k : k + BLOCK_BYTES])))
        for name in names:
            part = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            part.close()
        out.write(bytearray(LAST_BLOCK))
    finally:
        out.close()
    fs.delete(folder, True)


def sam_header(spark: SparkSession, path: str) -> Header:
    """Header of a SAM text file: its lines up to the first alignment, in order."""
    rows = spark.read.text(path).where(F.col("value").startswith("@")).select("value", F.monotonically_increasing_id().alias("at")).orderBy("at").select("value").collect()  # as many as references
    out = Header("".join(f"{r.value}\n" for r in rows))
    for r in rows:
        fields = dict(x.split(":", 1) for x in r.value.split("\t")[1:] if ":" in x)
        if r.value.startswith("@SQ"):
            out.names.append(fields["SN"])
            out.lengths.append(int(fields.get("LN", 0)))
    return out


def header_of(spark: SparkSession, path: str) -> Header:
    """Header of a SAM or BAM file."""
    return next(iter(headers(spark, path).values())) if path.endswith(".bam") else sam_header(spark, path)
