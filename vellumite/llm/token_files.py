"""Token ids in binary files of patched frame-of-reference blocks.

A file holds documents in ascending doc_id order (nulls last, equal ids by a hash of the text):

    header    8 bytes "VPFOR001", then u64: documents, ids, blocks
    documents i64 doc_id each, u8 is_null each, u32 number of ids each
    index     u64 start of each block from the beginning of the block area, and the end of the last
    blocks    of 128 ids (the last is filled up with its own minimum): u32 minimum, u8 width, u8 exceptions,
              128 differences of `width` bits (the low bits, where they do not fit), most significant first,
              then u8 place of each exception and its whole u32 difference

A task closes a file after ROLL ids at the end of a document and begins the next, so neither writing nor reading
holds more than that and one document. All numbers are little-endian. The width is the number of bits of the 90th percentile of a block's
differences, so a few large ids do not widen it. Files are written by the tasks to the shared folder, under
a name of the attempt first and renamed when whole, so a repeated or lost task leaves one whole file.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm._common import fresh_path, give_back
from vellumite.llm.tokens import encoder

MAGIC, BLOCK, PERCENTILE = b"VPFOR001", 128, 0.9
_AT = int(np.ceil(PERCENTILE * BLOCK)) - 1
_SOME = 1 << 12  # blocks at a time
#: Ids after which a file ends.
ROLL = 1 << 22


def _widths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def _wide(width: int) -> tuple[str, int]:
    return (">u2", 16) if width <= 16 else (">u4", 32)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(block area, starts of the blocks and its end) of u32 ids."""
    n = -(-len(ids) // BLOCK)
    parts, starts, base = [], [np.zeros(0, np.int64)], 0
    for at in range(0, n, _SOME):
        some = ids[at * BLOCK : (at + _SOME) * BLOCK]
        rows = -(-len(some) // BLOCK)
        if len(some) < rows * BLOCK:
            last = some[(rows - 1) * BLOCK :]
            some = np.concatenate([some, np.full(rows * BLOCK - len(some), last.min(), some.dtype)])
        table = some.reshape(rows, BLOCK)
        least = table.min(1)
        diff = table - least[:, None]
        width = _widths(np.partition(diff, _AT, axis=1)[:, _AT])
        over = diff > ((np.int64(1) << width) - 1)[:, None]
        count = over.sum(1)
        size = 6 + 16 * width + 5 * count
        end = np.cumsum(size)
        begin = end - size
        out = np.zeros(int(end[-1]), np.uint8)
        out[begin[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
        out[begin + 4] = width
        out[begin + 5] = count
        for w in np.unique(width):
            if w == 0:
                continue
            mine = np.flatnonzero(width == w)
            kind, whole = _wide(w)
            low = (diff[mine] & np.uint32((1 << int(w)) - 1)).astype(kind)
            bits = np.unpackbits(low.view(np.uint8).reshape(len(mine), BLOCK, whole // 8), axis=2)[:, :, whole - w :]
            out[begin[mine, None] + 6 + np.arange(16 * w)] = np.packbits(bits.reshape(len(mine), -1), axis=1)
        row, place = np.nonzero(over)
        if len(row):
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            tail = (begin + 6 + 16 * width)[row]
            out[tail + nth] = place
            out[(tail + count[row] + 4 * nth)[:, None] + np.arange(4)] = diff[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        parts.append(out.tobytes())
        starts.append(begin + base)
        base += int(end[-1])
    return b"".join(parts), np.concatenate([*starts, [base]]).astype("<u8")


def decode_blocks(area: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The u32 ids of whole blocks: `area` as bytes, `starts` of the wanted blocks in it."""
    done = []
    for at in range(0, len(starts), _SOME):
        begin = starts[at : at + _SOME].astype(np.int64)
        least = area[begin[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
        width, count = area[begin + 4].astype(np.int64), area[begin + 5].astype(np.int64)
        diff = np.zeros((len(begin), BLOCK), np.uint32)
        for w in np.unique(width):
            if w == 0:
                continue
            mine = np.flatnonzero(width == w)
            kind, whole = _wide(w)
            bits = np.unpackbits(area[begin[mine, None] + 6 + np.arange(16 * w)], axis=1).reshape(len(mine), BLOCK, w)
            full = np.zeros((len(mine), BLOCK, whole), np.uint8)
            full[:, :, whole - w :] = bits
            diff[mine] = np.packbits(full, axis=2).reshape(len(mine), -1).view(kind)
        row = np.repeat(np.arange(len(begin)), count)
        if len(row):
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            tail = (begin + 6 + 16 * width)[row]
            value = area[(tail + count[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
            diff[row, area[tail + nth]] = value
        done.append((diff + least[:, None]).reshape(-1))
    return np.concatenate(done) if done else np.zeros(0, np.uint32)


def file_bytes(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    area, starts = encode_blocks(ids)
    null = np.array([x is None for x in doc_ids], np.uint8)
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8")
    head = np.array([len(doc_ids), len(ids), len(starts) - 1], "<u8").tobytes()
    return b"".join([MAGIC, head, keys.tobytes(), null.tobytes(), sizes.astype("<u4").tobytes(), starts.tobytes(), area])


class TokenFile:
    """A file's documents and ids; a range of ids decodes only the blocks that hold it."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        raw = np.frombuffer(content, np.uint8)
        docs, self.n_ids, blocks = (int(x) for x in np.frombuffer(content, "<u8", 3, 8))
        at = 32
        self.null = raw[at + 8 * docs : at + 9 * docs].astype(bool)
        self.doc_ids = np.frombuffer(content, "<i8", docs, at)
        self.sizes = raw[at + 9 * docs : at + 13 * docs].copy().view("<u4").astype(np.int64)
        self.starts = raw[at + 13 * docs : at + 13 * docs + 8 * (blocks + 1)].copy().view("<u8").astype(np.int64)
        self.area = raw[at + 13 * docs + 8 * (blocks + 1) :]
        self.ends = np.cumsum(self.sizes)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        got = decode_blocks(self.area, self.starts[first:last])
        return got[start - first * BLOCK : stop - first * BLOCK]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Writes the ids of all texts (null: empty), each with `end_id` after it; (file, documents, ids) in order.

    Documents are dealt by ranges of doc_id and a hash of the text, so one id with many rows is not one task's.
    A task writes its range as files of some ROLL ids. An empty table writes no file.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("_hash").asc()]
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_hash"))

    def run(batches):
        import pyarrow.fs as fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        enc, number, rolled = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys, sizes, ids, held = [], [], [], 0

        def close():
            name, attempt = f"part-{number:06d}-{rolled:06d}.pfor", f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(attempt) as out:
                out.write(file_bytes(keys, np.concatenate(sizes), np.concatenate(ids)))
            store.move(attempt, f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "documents": [len(keys)], "ids": [held]})

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                got, starts = enc.encode(part.column(1))
                keys += part.column(0).to_pylist()
                sizes.append(np.diff(starts) + 1)
                ids.append(np.insert(got, starts[1:], end_id).astype(np.uint32))
                held += len(ids[-1])
                if held >= ROLL:
                    yield close()
                    keys, sizes, ids, held, rolled = [], [], [], 0, rolled + 1
        if keys:
            yield close()
        give_back()

    made = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "file string, documents long, ids long")
    # Names sort as the files follow each other; one row a file.
    return sorted((r["file"], r["documents"], r["ids"]) for r in made.collect())


def read_token_files(spark: SparkSession, path: str, manifest: list[tuple[str, int, int]], with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if not manifest:
        return spark.createDataFrame([], schema)
    bases, total = {}, 0
    for name, _, ids in manifest:
        bases[name], total = total, total + ids
    shared = spark.sparkContext.broadcast(bases)  # a number for each file

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                held = TokenFile(content.as_buffer())
                ends, base = held.ends, shared.value[name]
                for a in range(0, len(ends), 4096):
                    mine = slice(a, min(a + 4096, len(ends)))
                    first = int(ends[a] - held.sizes[a])
                    ids = held.ids(first, int(ends[mine.stop - 1])).astype("<u4")
                    raw, starts = ids.tobytes(), ends[mine] - held.sizes[mine] - first
                    crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), held.sizes[mine].tolist())]
                    columns = [pa.array(held.doc_ids[mine], pa.int64(), mask=held.null[mine]), pa.array(starts + first + base), pa.array(held.sizes[mine]), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.view("<i4"))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files and reads them back; `path` defaults to a new folder in the shared one."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return read_token_files(spark, path, write_token_files(docs, tokenizer, path, end_id, doc_id, text), with_ids)
