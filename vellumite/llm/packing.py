"""Packing token sequences by linear grouping.

Only the number of pieces of each length matters for a plan, and a length is at most the capacity, so the
plan is made on the driver from a table of at most `capacity` rows, whatever the number of documents:

1. Lengths above a third (or a quarter) of the capacity are large. Sorted from longest to shortest, they are cut into
   groups of equal cardinality, and each length is rounded up to the longest of its group.
2. Configurations of these few sizes (multisets that fit the capacity, two or three pieces) are optimised: the
   linear program of covering all groups is solved by multiplicative weights over all of them, and its
   fractional solution is rounded down; what remains is configured greedily, fullest first.
3. Actual pieces are put into the slots of their group, longest first; a slot has the room they leave.
4. Small pieces go, longest first, where the least room is left that takes them; new sequences open last.

Sequences with equal contents are kept as one entry with a count, so each step works on runs of equal
lengths. The plan is a list of runs: "pieces of length L number a to b go to sequences s, s+1, ... at
offset o". Pieces are numbered per length by a distributed rank and meet their run in a broadcast table whose
size depends on the capacity alone.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm._common import distributed_rank, give_back, written
from vellumite.llm.tokens import encoder

CAPACITY, ROUNDS = 2048, 12
#: (k, groups): lengths over 1 / k of the capacity are large and are rounded up to so many sizes.
GRIDS = ((4, 24), (3, 60), (3, 120), (3, 240))


def configurations(sizes: list[int], capacity: int) -> list[tuple[int, ...]]:
    """All maximal configurations of sizes above a quarter of the capacity: at most three items each."""
    found = []

    def add(i: int, room: int, chosen: list[int]) -> None:
        grew = False
        for j in range(i, len(sizes)):
            if sizes[j] <= room:
                grew = True
                add(j, room - sizes[j], [*chosen, j])
        if not grew and chosen:
            found.append(tuple(chosen))

    add(0, capacity, [])
    return found


def cover(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, times): covers `counts` pieces of each size in few sequences.

    A fractional cover by multiplicative weights: prices of the groups rise where they lag behind, the
    configuration of highest price is taken again and again. Rounded down, the rest is filled greedily.
    """
    shapes = configurations(sizes, capacity)
    if not shapes:
        return []
    wide = max(map(len, shapes))
    items = np.array([[*s, *[len(sizes)] * (wide - len(s))] for s in shapes])  # padded by a group of price 0
    need = np.array(counts, float)
    share = np.append(1 / np.maximum(need, 1), 0.0)
    share /= share.max()
    prices, taken = np.append(np.ones(len(sizes)), 0.0), np.zeros(len(shapes))
    for _ in range(ROUNDS * len(sizes) // wide):
        k = int(np.argmax((share * prices)[items].sum(1)))
        taken[k] += 1
        np.multiply.at(prices, items[k], np.exp(-0.5 * share[items[k]]))
        if prices.max() < 1e-200:
            prices /= prices.max()
    got = np.bincount(items.ravel(), np.repeat(taken, wide), len(sizes) + 1)[:-1]
    scale = (need / np.maximum(got, 1e-12))[got > 0].min() if (got > 0).any() else 0
    plan: Counter = Counter()
    left = np.array(counts, np.int64)
    for k in np.argsort(-taken):
        times = int(taken[k] * scale)
        for i, n in Counter(shapes[k]).items():
            times = min(times, int(left[i]) // n)
        if times > 0:
            plan[shapes[k]] += times
            for i, n in Counter(shapes[k]).items():
                left[i] -= times * n
    while left.any():
        chosen: list[int] = []
        room = capacity
        for i in np.argsort([-s for s in sizes], kind="stable").tolist():
            while left[i] > chosen.count(i) and sizes[i] <= room:
                chosen.append(i)
                room -= sizes[i]
        best, filled = tuple(sorted(chosen)), capacity - room
        first = max((i for i in range(len(sizes)) if left[i]), key=lambda i: sizes[i])
        for s in shapes:
            if first in s and all(left[i] >= n for i, n in Counter(s).items()) and sum(sizes[i] for i in s) > filled:
                best, filled = s, sum(sizes[i] for i in s)
        times = min(int(left[i]) // n for i, n in Counter(best).items())
        plan[best] += times
        for i, n in Counter(best).items():
            left[i] -= times * n
    return list(plan.items())


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, grids: tuple[tuple[int, int], ...] = GRIDS) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, count, first sequence, offset): every piece of every length in exactly one run.

    Of several grids (large means over 1 / k of the capacity; number of groups) the plan with the fewest sequences.
    """
    plans = [_plan(histogram, capacity, k, groups) for k, groups in grids]
    return min(plans, key=lambda p: max((r[3] + r[2] for r in p), default=0))


def _plan(histogram: dict[int, int], capacity: int, small: int, groups: int) -> list[tuple[int, int, int, int, int]]:
    large = sorted((n for n in histogram if n * small > capacity), reverse=True)
    total = sum(histogram[n] for n in large)
    # 1. Groups of equal cardinality; a length may be shared by neighbouring groups.
    queue: list[list[tuple[int, int]]] = []
    if total:
        each, at = -(-total // groups), 0
        for n in large:
            rest = histogram[n]
            while rest:
                g = at // each
                while len(queue) <= g:
                    queue.append([])
                take = min(rest, (g + 1) * each - at)
                queue[g].append((n, take))
                at += take
                rest -= take
    sizes = [g[0][0] for g in queue]
    merged: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for s, g in zip(sizes, queue):
        merged[s] += g
    sizes = list(merged)
    stock = [list(merged[s]) for s in sizes]
    # 2. Configurations of the rounded sizes.
    chosen = cover(sizes, [sum(c for _, c in g) for g in stock], capacity)
    chosen.sort(key=lambda x: (-sum(sizes[i] for i in x[0]), x[0]))
    # 3. Actual pieces, longest first: entries (count, contents), split where a group's run of one length ends.
    entries: list[tuple[int, tuple[int, ...]]] = []
    for shape, times in chosen:
        while times:
            now, contents = times, []
            need = Counter(shape)
            for i, n in need.items():
                length, have = stock[i][0]
                # All n slots of a sequence get this length if there are enough, else one piece at a time is dealt.
                now = min(now, have // n) if have >= n else 1
            for i, n in need.items():
                for _ in range(n):
                    length, have = stock[i][0]
                    contents.append(length)
                    used = now if have >= now else have
                    stock[i][0] = (length, have - used)
                    if have == used:
                        stock[i].pop(0)
            entries.append((now, tuple(contents)))
            times -= now
    # 4. Best fit of the small: entries by room left, least sufficient room first.
    room_of: dict[int, Counter] = defaultdict(Counter)
    for count, contents in entries:
        room_of[capacity - sum(contents)][contents] += count
    for n in sorted((n for n in histogram if n * small <= capacity), reverse=True):
        rest = histogram[n]
        if n == 0:
            room_of[capacity][()] += 0
        while rest:
            room = min((r for r, c in room_of.items() if r >= n and c), default=None)
            if room is None:
                # As many new sequences as this length fills, the last one with what remains.
                fit = capacity // n
                full, over = divmod(rest, fit)
                if full:
                    room_of[capacity - fit * n][(n,) * fit] += full
                if over:
                    room_of[capacity - over * n][(n,) * over] += 1
                break
            contents, count = next(iter(room_of[room].items()))
            fit = min(room // n, rest)
            take = min(count, rest // fit)
            room_of[room][contents] -= take
            if not room_of[room][contents]:
                del room_of[room][contents]
                if not room_of[room]:
                    del room_of[room]
            room_of[room - fit * n][contents + (n,) * fit] += take
            rest -= take * fit
    # Runs: the slots of an entry take consecutive numbers of their length.
    used, runs, sequence = Counter(), [], 0
    for room in sorted(room_of):
        for contents, count in room_of[room].items():
            at = 0
            for n in contents:
                runs.append((n, used[n], count, sequence, at))
                used[n] += count
                at += n
            sequence += count
    return runs


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document's ids with the end id: doc_id, piece, start, length, ids_crc32.

    Longer documents are cut into pieces of `capacity`, the first piece being the shorter one. A null or
    empty text is the end id alone.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids, starts = enc.encode(part.column(1))
                sizes = np.diff(starts) + 1
                rows, raw = [[], [], [], [], []], ids.tobytes()
                end = np.array([end_id], "<u4").tobytes()
                for i, size in enumerate(sizes.tolist()):
                    mine = raw[4 * starts[i] : 4 * starts[i + 1]] + end
                    cuts = [0, *range(size % capacity or capacity, size, capacity), size]
                    for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        for column, value in zip(rows, (i, p, x, y - x, zlib.crc32(mine[4 * x : 4 * y]))):
                            column.append(value)
                taken = part.column(0).take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place(items: DataFrame, capacity: int = CAPACITY, grids: tuple[tuple[int, int], ...] = GRIDS, bucket_rows: int = 1024) -> DataFrame:
    """items (with `length` from 1 to capacity) and their sequence_id and offset.

    Pieces of one length are interchangeable; they are numbered per length, dealt by a hash of the row over
    buckets of some `bucket_rows` (2^20 buckets at most), so no length is one task's. Rows equal in all columns are different pieces.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = plan_runs(counts, capacity, grids)
    bits = min(20, max(1, (max(counts.values(), default=1) // bucket_rows).bit_length()))
    ranked = distributed_rank(items, ["length"], F.shiftrightunsigned(F.xxhash64(*items.columns), 64 - bits), [F.col(c) for c in items.columns], "_number")
    ranked = written(ranked, "ranked")
    by_length: dict[int, list] = defaultdict(list)
    for n, first, count, sequence, at in runs:
        by_length[n].append((first, sequence, at))
    table = {n: tuple(np.array(x, np.int64) for x in zip(*sorted(rows))) for n, rows in by_length.items()}
    columns = items.columns
    shared = spark.sparkContext.broadcast(table)  # its size follows from the capacity, not from the rows

    def run(batches):
        plan = shared.value
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("_number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = length == n
                first, base, at = plan[int(n)]
                k = np.searchsorted(first, number[mine], "right") - 1
                sequence[mine], offset[mine] = base[k] + number[mine] - first[k], at[k]
            kept = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    return ranked.select(*items.columns, "_number").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, grids: tuple[tuple[int, int], ...] = GRIDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents in sequences of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is packed: null ids, repeated rows and empty texts (the end id alone) too. Sequence
    numbers are 0, 1, ...; offsets are gapless from 0. An empty table gives no row.
    """
    return place(written(pieces(docs, tokenizer, end_id, capacity, doc_id, text), "pieces"), capacity, grids)
