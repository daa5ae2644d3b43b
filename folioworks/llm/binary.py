"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a run of zstandard frames (each with the content checksum that zstandard
defines), then two skippable frames.  The first has the documents: 8-byte id, 4-byte
frame number, 4-byte first id in the frame, 8-byte number of ids each.  The second is
the seek table in the public seekable format: compressed size, plain size and the low
32 bits of XXH64 of the plain bytes for each frame, then the number of frames, a
descriptor byte and the magic number.  Frames hold whole documents; ids are 16-bit
where the vocabulary fits, else 32-bit, little-endian.  A reader takes the tail, then
only the frames of the documents it wants.
"""

import struct
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_dir, n_partitions, table
from .tokens import word_ids

#: Plain bytes at which a frame is closed; a document is never split, so a long one makes a longer frame.
FRAME = 1 << 18
#: Plain bytes and documents at which a file is closed, so its tables stay small.
MOST_PLAIN, MOST_DOCS = 1 << 30, 4_000_000
#: Fixed values of the public zstandard seekable format.
SKIPPABLE_SEEK, SKIPPABLE_DOCS, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_DOC = struct.Struct("<qIIQ")
_ENTRY = struct.Struct("<III")


class FrameWriter:
    """Writes one file to an open binary sink."""

    def __init__(self, sink, width: int, frame: int = FRAME):
        self.sink, self.width, self.frame = sink, width, frame
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.parts: list[bytes] = []
        self.held = self.plain = self.n_docs = 0
        self.first = self.last = None
        self.entries: list[bytes] = []
        self.docs: list[bytes] = []

    @property
    def n_tokens(self) -> int:
        return self.plain // self.width

    def full(self) -> bool:
        return self.plain >= MOST_PLAIN or self.n_docs >= MOST_DOCS

    def add(self, doc: int, ids: bytes) -> None:
        """Documents come in ascending order of id."""
        if self.held and self.held + len(ids) > self.frame:
            self.close_frame()
        self.docs.append(_DOC.pack(doc, len(self.entries), self.held // self.width, len(ids) // self.width))
        self.parts.append(ids)
        self.held += len(ids)
        self.plain += len(ids)
        self.n_docs += 1
        self.first, self.last = doc if self.first is None else self.first, doc

    def close_frame(self) -> None:
        plain = b"".join(self.parts)
        packed = self.packer.compress(plain)
        self.sink.write(packed)
        self.entries.append(_ENTRY.pack(len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.parts, self.held = [], 0

    def finish(self) -> None:
        if self.parts:
            self.close_frame()
        docs = b"".join([struct.pack("<B", self.width), *self.docs])
        self.sink.write(struct.pack("<II", SKIPPABLE_DOCS, len(docs)) + docs)
        foot = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(foot)) + foot)


class FrameReader:
    """Reads documents of one file; only the frames that are asked for are read and decompressed."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        foot = n * _ENTRY.size + 9
        self.entries = [*_ENTRY.iter_unpack(source.read_at(n * _ENTRY.size, size - foot))]
        self.starts = [0, *np.cumsum([e[0] for e in self.entries], dtype=np.int64).tolist()]
        docs = source.read_at(size - foot - 8 - self.starts[-1] - 8, self.starts[-1] + 8)
        self.width = docs[0]
        self.docs = np.frombuffer(docs, np.dtype([("id", "<i8"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u8")]), offset=1)
        self.before = np.cumsum(self.docs["n"]) - self.docs["n"]
        self.unpacker = zstandard.ZstdDecompressor()
        self.now, self.plain = -1, b""
        self.opened: list[int] = []

    def __len__(self) -> int:
        return len(self.docs)

    def find(self, doc: int) -> range:
        """Numbers of the documents with an id."""
        return range(int(np.searchsorted(self.docs["id"], doc, side="left")), int(np.searchsorted(self.docs["id"], doc, side="right")))

    def frame(self, i: int) -> bytes:
        if i != self.now:
            packed, plain, check = self.entries[i]
            self.plain = self.unpacker.decompress(self.source.read_at(packed, self.starts[i]), max_output_size=plain)
            if len(self.plain) != plain or xxhash.xxh64_intdigest(self.plain) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {i} fails its checksum")
            self.now = i
            self.opened.append(i)
        return self.plain

    def ids(self, nth: int) -> np.ndarray:
        """The ids of the file's nth document."""
        _, frame, at, n = self.docs[nth].item()
        return np.frombuffer(self.frame(frame), "<u2" if self.width == 2 else "<u4", n, at * self.width)

    def row(self, nth: int, start: int) -> tuple:
        """doc_id, start, n_tokens, ids_crc32, ids (unsigned 32-bit) of the nth document."""
        doc, raw = int(self.docs["id"][nth]), self.ids(nth).astype("<u4").tobytes()
        return None if doc == NO_ID else doc, start, len(raw) // 4, crc32(raw), raw


MANIFEST = "file string, part int, nth int, first_id long, last_id long, docs long, tokens long"
#: What a null id is in a file.
NO_ID = -(1 << 63)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every whole text and end_id in ascending id order; returns the manifest, itself written beside them.

    Manifest: file, part and nth (its place in the order), first_id, last_id, docs,
    tokens, start (ids of all files before).  A null text has only end_id; rows with one
    id are in order of a hash of their texts, and may lie in several parts; a null id is
    written as the least number, and comes first; an empty table writes no file; other
    columns are ignored.  A part is one task's range of the order, and its files are
    closed at MOST_PLAIN bytes or MOST_DOCS documents.  A task writes under names of its
    own and the manifest names only files of tasks that ended well, so lost executors
    and second attempts do no harm.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def save(batches):
        import os

        enc = word_ids(tokenizer)
        system, folder = pafs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        part, nth, writer, done = TaskContext.get().partitionId(), 0, None, []

        def close():
            writer.finish()
            writer.sink.close()
            done.append((name, part, nth, writer.first, writer.last, writer.n_docs, writer.n_tokens))

        for batch in batches:
            at = 0
            for ids in enc.encode_column(batch["text"], end_id):
                for doc, one in zip(batch["doc"].slice(at, len(ids)).to_numpy().tolist(), ids, strict=True):
                    if writer and writer.full():
                        close()
                        writer, nth = None, nth + 1
                    if not writer:
                        name = f"ids-{part:06d}-{nth:04d}-{os.urandom(6).hex()}.zst"
                        writer = FrameWriter(system.open_output_stream(f"{folder}/{name}", compression=None), enc.dtype.itemsize)
                    writer.add(doc, one.as_buffer().to_pybytes())
                at += len(ids)
        if writer:
            close()
        columns = list(zip(*done, strict=True)) or [[]] * 7
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    keyed = rows.select("doc", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("p"), "text")
    dealt = keyed.repartitionByRange(n_partitions(spark), "doc", "h", "p").sortWithinPartitions("doc", "h").select("doc", "text")
    dealt.mapInArrow(save, MANIFEST).write.parquet(f"{path}/manifest-files")
    kept = spark.read.schema(MANIFEST).parquet(f"{path}/manifest-files")
    before = F.sum("tokens").over(W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1))  # a row per file
    return kept.withColumn("start", F.coalesce(before, F.lit(0)))


NAMES = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _frame(rows: list[tuple], with_ids: bool = True) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES if with_ids else NAMES[:4]).astype({"doc_id": "Int64"})


def read_ids(manifest: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (with_ids) ids of every document, read from the files of the manifest."""

    def load(batches):
        system, folder = pafs.FileSystem.from_uri(path)
        for pdf in batches:
            for name, start in zip(pdf["file"], pdf["start"], strict=True):
                with system.open_input_file(f"{folder}/{name}") as f:
                    reader, out, at = FrameReader(f), [], int(start)
                    for nth in range(len(reader)):
                        row = reader.row(nth, at)
                        out.append(row if with_ids else row[:4])
                        at += row[2]
                        if len(out) == 1000:
                            yield _frame(out, with_ids)
                            out = []
                    yield _frame(out, with_ids)

    files = manifest.repartition(n_partitions(manifest.sparkSession))
    return files.mapInPandas(load, SCHEMA if with_ids else SCHEMA.rpartition(", ")[0])


def read_documents(manifest: DataFrame, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of read_ids for the documents whose id is wanted; only the frames that hold them are read and decompressed.

    A null id finds the documents without one, an unknown id none; an id that is asked
    for several times comes as often as the files have it.
    """
    bounds = manifest.orderBy("part", "nth").select("file", "first_id", "last_id", "start").collect()  # a row per file of MOST_PLAIN bytes
    first, last = (np.array([b[c] for b in bounds], np.int64) for c in ("first_id", "last_id"))

    @F.pandas_udf("array<int>")
    def places(doc: pd.Series) -> pd.Series:
        x = doc.to_numpy(np.int64)
        lo, hi = np.searchsorted(last, x, side="left"), np.searchsorted(first, x, side="right")
        return pd.Series([list(range(a, b)) for a, b in zip(lo, hi, strict=True)])

    asked = wanted.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
    dealt = asked.withColumn("place", F.explode(places("doc"))).repartition("place").sortWithinPartitions("place", "doc")

    def load(batches):
        system, folder = pafs.FileSystem.from_uri(path)
        now, reader = None, None
        for pdf in batches:
            out = []
            for doc, place in zip(pdf["doc"], pdf["place"], strict=True):
                if place != now:
                    if reader:
                        reader.source.close()
                    now, reader = place, FrameReader(system.open_input_file(f"{folder}/{bounds[place]['file']}"))
                out += [reader.row(nth, int(bounds[place]["start"] + reader.before[nth])) for nth in reader.find(doc)]
            yield _frame(out)
        if reader:
            reader.source.close()

    return dealt.mapInPandas(load, SCHEMA)


def op8_binary(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_dir(spark, "ids")
    manifest = write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(manifest, path, with_ids=False)
