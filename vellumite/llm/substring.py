"""Substring dedup by content-defined chunks.

A gear rolling hash (h = 4 h + gear[byte] mod 2^32, so it remembers 16 bytes) runs over the UTF-8 bytes of a
text. A place is a cut where its hash is less than the REACH hashes before it and not more than the REACH
after it, moved on to the end of the word there. A cut depends on some 40 bytes to either side only, so an
insertion moves the cuts near it and no others, and equal passages get equal chunks wherever they stand.
Chunks are more than REACH bytes long, some 50 on average; where no place qualifies (runs of one character)
there is a cut every MOST bytes.

Chunks are compared by a 128-bit digest over all documents. A chunk that several documents hold stays in
the one with the smallest doc_id; in the others it is a repeat. Adjacent repeats are one span, and spans
shorter than `least_bytes` are left alone, as a few common words may meet by chance. Repeats inside one
document are left alone too, unless they are asked for (`within`): then a chunk's first place in the document
that keeps it stays, and its later places there are repeats as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from vellumite.llm._common import SPACES, give_back, written

REACH, MOST, LEAST_BYTES = 24, 1024, 64
_LAST = (1 << 63) - 1


def _gear() -> np.ndarray:
    """256 numbers by the splitmix64 rule."""
    z = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolling(raw: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: doubling the remembered bytes 1, 2, 4, 8, 16 gives the recurrence's values."""
    h = GEAR[raw]
    for n in (1, 2, 4, 8):
        if len(h) <= n:
            break
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint32(2 * n)
        h = longer
    return h


def cuts(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text's bytes, the last being its length."""
    n = len(raw)
    if n <= 2 * REACH:
        return np.array([n] if n else [], np.int64)
    h = rolling(raw)
    least = h  # least[i]: of h[i - k + 1 .. i], for k = 1, 2, 4, 8, 16
    for k in (1, 2, 4, 8):
        least = np.minimum(least[k:], least[:-k])
    wide = np.minimum(least[REACH - 16 :], least[: len(least) - (REACH - 16)])  # wide[j]: of h[j .. j + REACH - 1]
    inner = h[REACH : n - REACH]
    at = np.flatnonzero((inner < wide[: len(inner)]) & (inner <= wide[REACH + 1 : REACH + 1 + len(inner)])) + REACH + 1
    spaces = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13))) + 1
    if len(spaces):
        k = np.searchsorted(spaces, at)
        ahead = spaces[np.minimum(k, len(spaces) - 1)]
        near = (k < len(spaces)) & (ahead - at <= 2 * REACH)
        at = np.where(near, ahead, at)
    out = np.unique(np.append(at[at < n], n))
    gaps = np.diff(out, prepend=0)
    if (gaps > MOST).any():
        out = np.concatenate([np.append(np.arange(e - g + MOST, e, MOST), e) for e, g in zip(out.tolist(), gaps.tolist())])
    # Never inside a character.
    for _ in range(3):
        mid = (out < n) & ((raw[np.minimum(out, n - 1)] & 0xC0) == 0x80)
        out = np.where(mid, out + 1, out)
    return np.unique(out)


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: doc_id, text_hash, at (byte offset), bytes, d1, d2 (digest). Null and empty texts have none."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where("text <> ''")

    def run(batches):
        for b in batches:
            rows, starts, sizes, digests, held = [], [], [], [], 0

            def out():
                pick = pa.array(np.concatenate(rows))
                d = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(np.concatenate(starts)), pa.array(np.concatenate(sizes)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=["doc_id", "text_hash", "at", "bytes", "d1", "d2"])

            for i, value in enumerate(b.column(2)):
                raw = value.as_buffer().to_pybytes()
                end = cuts(np.frombuffer(raw, np.uint8))
                begin = np.concatenate([[0], end[:-1]])
                digests += [xxh3_128_digest(raw[x:y]) for x, y in zip(begin.tolist(), end.tolist())]
                rows.append(np.full(len(end), i))
                starts.append(begin.astype(np.int32))
                sizes.append((end - begin).astype(np.int32))
                held += len(end)
                if held > 200_000:
                    yield out()
                    rows, starts, sizes, digests, held = [], [], [], [], 0
            if held:
                yield out()
        give_back()

    return slim.mapInArrow(run, "doc_id long, text_hash long, at int, bytes int, d1 long, d2 long")


def repeated_spans(docs: DataFrame, least_bytes: int = LEAST_BYTES, doc_id: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """One row per span of a document that an earlier document holds: doc_id, text_hash, start, bytes, chunks, kept_in.

    `kept_in` is the document that keeps the span's first chunk. Rows equal in doc_id and text are one
    document. A null doc_id comes after all others; among rows of one doc_id the smallest hash of the text
    keeps a chunk. Digests are counted with partial sums and met by an equi-join that Spark may split where
    one passage is in very many documents. No row where nothing repeats.
    """
    found = written(chunks(docs, doc_id, text), "chunks")
    key = F.coalesce("doc_id", F.lit(_LAST))
    place = [F.min(F.struct(key.alias("id"), "text_hash", "at")).alias("place"), F.count(F.lit(1)).alias("n")] if within else []
    seen = found.groupBy("d1", "d2").agg(F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.min("text_hash").alias("first_hash"), F.max("text_hash").alias("last_hash"), *place)
    shared = written(seen.where("first_id <> last_id or first_hash <> last_hash" + (" or n > 1" if within else "")), "shared")
    repeat = F.when(F.col("first_id") != F.col("last_id"), key != F.col("first_id")).otherwise(F.col("text_hash") != F.col("first_hash"))
    if within:
        own = (key == F.col("place")["id"]) & (F.col("text_hash") == F.col("place")["text_hash"])
        repeat |= own & (F.col("at") > F.col("place")["at"])
    s = shared.select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), "first_id", "last_id", "first_hash", *(["place"] if within else []))
    met = found.join(s, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2"))).where(repeat)
    by_doc = met.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("at", "bytes", "first_id"))).alias("c"))
    def run(batches):
        for b in batches:
            lists = b.column(2)
            at, size, first = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            begin = lists.offsets.to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(begin))
            at, size, first = (x[begin[0] : begin[-1]] for x in (at, size, first))
            # A chunk that does not begin where the one before ended opens a span.
            opens = np.ones(len(at), bool)
            opens[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + size[:-1])
            lead = np.flatnonzero(opens)
            total = np.add.reduceat(size, lead) if len(lead) else size[:0]
            count = np.diff(np.append(lead, len(at)))
            keep = total >= least_bytes
            lead, pick = lead[keep], pa.array(row[lead[keep]])
            kept_in = pa.array(first[lead], pa.int64(), mask=first[lead] == _LAST)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(at[lead], pa.int32()), pa.array(total[keep], pa.int32()), pa.array(count[keep], pa.int32()), kept_in], names=["doc_id", "text_hash", "start", "bytes", "chunks", "kept_in"])

    return by_doc.mapInArrow(run, "doc_id long, text_hash long, start int, bytes int, chunks int, kept_in long")


def without_repeats(docs: DataFrame, least_bytes: int = LEAST_BYTES, doc_id: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """docs with the repeated spans cut out of `text` (and `n_chars`, where docs has it, counted anew).

    A document that loses all its words goes; one without repeats stays as it is, an empty one too.
    """
    columns = docs.columns
    spans = repeated_spans(docs, least_bytes, doc_id, text, within)
    lists = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "bytes"))).alias("_spans"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans")
    rows = docs.select(F.struct(*columns).alias("_row"), F.col(doc_id).cast("long").alias("_doc"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text"))
    joined = rows.join(lists, (F.col("_text_hash") == F.col("_hash")) & F.col("_doc").eqNullSafe(F.col("_id")), "left").select("_row", "_text", "_spans")

    def cut(batches):
        for b in batches:
            out, keep = [], []
            for text_, spans_ in zip(b.column(1), b.column(2)):
                left = text_.as_py()
                if spans_.is_valid:
                    raw, at, parts = left.encode(), 0, []
                    for s in spans_.as_py():
                        parts.append(raw[at : s["start"]])
                        at = s["start"] + s["bytes"]
                    left = b"".join([*parts, raw[at:]]).decode()
                    keep.append(bool(left.strip(SPACES)))
                else:
                    keep.append(True)
                out.append(left)
            whole = pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["_row", "_text"])
            yield whole.filter(pa.array(keep, pa.bool_()))
        give_back()

    row_type = joined.schema["_row"].dataType.simpleString()
    done = joined.mapInArrow(cut, f"_row {row_type}, _text string")
    new = {text: F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return done.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in columns])
