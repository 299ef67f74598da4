"""Cross-entropy difference (Moore and Lewis) of two matched bigram models.

One vocabulary, all words of the corpus and <unk>, serves both models; order, discount and smoothing are the
same. The target model counts the labelled good documents, the background model all documents. A document's
score is its loss per token under the target less that under the background: the lower, the more it reads
like the target. No document is scored by its own words: its counts are taken off both models first (off the
target's where it is one of them), so a good document has no advantage over an equal unlabelled one. Words that
only this document has so count as unseen, like <unk>; no other word does. A `size` keeps the size - 1 most
frequent words only; every other word is <unk> then (of the test corpus half of all words with 1,536 places).

The background is the whole corpus, not a sample of the target's size: what the two models know differs in
amount, which shifts all scores alike, not their order.

Words are known by 64-bit hashes, bigrams by a 64-bit hash of two of those. Documents are put in blocks of
some megabytes. A block sends its distinct keys and their counts to shards by hash; a shard adds them up and
sends each block the totals of the block's own keys. Bigrams go first, then words with their totals as
contexts, then every block scores its documents. So no model is ever gathered or broadcast, what is kept
grows with the corpus, and a key has one entry per block at most, however common it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vellumite.llm._common import SPACE_RUN, SPACES, bucketed, give_back, written

DISCOUNT = 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = str.maketrans(UPPER, LOWER)
#: Bytes of text after which a block ends.
BLOCK = 6 << 20
#: The hashes of <unk> and of what stands before a text's first word.
UNKNOWN, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_REQUEST = "shard int, block long, n int, keys binary, numbers binary"
_REPLY = "block long, shard int, n int, sums binary, first binary, own array<long>, kinds array<long>"


def vocabulary(docs: DataFrame, size: int, text: str = "text") -> list[str]:
    """The size - 1 most frequent words, A-Z lower-cased (ties: the lesser word first)."""
    low = F.btrim(F.translate(F.col(text), UPPER, LOWER), F.lit(SPACES))
    words = docs.select(F.explode(F.split(low, SPACE_RUN, -1)).alias("w")).where("w <> ''").groupBy("w").count()
    return [r["w"] for r in words.orderBy(F.desc("count"), "w").limit(size - 1).collect()]


def _split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pieces between white space, place of every piece in them, offsets by text); empty pieces are no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for c in SPACES[1:]:
        texts = pc.replace_substring(texts, c, " ")
    split = pc.split_pattern(texts, " ")
    begin = split.offsets.to_numpy()
    coded = split.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), begin - begin[0]


def _drop_empty(found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    real = found >= 0
    total = np.concatenate([[0], np.cumsum(real)])
    return found[real], total[at[1:]] - total[at[:-1]]


class Words:
    """Texts to places in the vocabulary."""

    def __init__(self, words: list[str]):
        self.places = {w: i + 1 for i, w in enumerate(words)}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places of all words in a row, number of words by text)."""
        words, indices, at = _split(texts)
        own = np.fromiter((-1 if w == "" else self.places.get(w.translate(_LOW), 0) for w in words), np.int32, len(words))
        return _drop_empty(own[indices] if len(words) else np.zeros(0, np.int32), at)


def hashed_words(texts: pa.Array, known: frozenset[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, the commonest first; place of every word in them; number of words by text)."""
    words, indices, at = _split(texts)
    low = [w.translate(_LOW) for w in words]
    own = np.fromiter((UNKNOWN if known is not None and w not in known else xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in low), np.uint64, len(low))
    hashes, place = np.unique(own, return_inverse=True)
    place = np.where(np.array([w != "" for w in low], bool), place, -1).astype(np.int32)
    tokens, sizes = _drop_empty(place[indices] if len(words) else np.zeros(0, np.int32), at)
    times = np.bincount(tokens, minlength=len(hashes))
    order = np.argsort(-times, kind="stable")
    order = order[times[order] > 0]
    rank = np.zeros(len(hashes), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return hashes[order], rank[tokens], sizes


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next: the high ones are zeros and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(x.size, x.itemsize).T.tobytes()


def _numbers(raw, size: int) -> np.ndarray:
    raw = np.frombuffer(raw, np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, size).T).reshape(-1).view(f"<u{len(raw) // size}") if size else np.zeros(0, np.uint32)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class Block:
    """A block's documents, their words, and its distinct bigrams in the order of their keys."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        self.words = np.append(np.frombuffer(row["words"], "<u8"), START)
        tokens = _numbers(row["tokens"], int(self.sizes.sum())).astype(np.int32)
        self.chosen = np.zeros(len(self.sizes), bool)
        self.chosen[np.array(row["good"] or [], np.int64)] = True
        self.good = np.repeat(self.chosen, self.sizes)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = len(self.words) - 1
        cells, cell = np.unique(before.astype(np.int64) * len(self.words) + tokens, return_inverse=True)
        self.cell = cell.astype(np.int32)
        self.before, self.after = (x.astype(np.int32) for x in np.divmod(cells, len(self.words)))
        self.keys = _mixed(self.words[self.before], self.words[self.after])
        self.order = np.argsort(self.keys, kind="stable")

    def bigrams(self) -> list[np.ndarray]:
        """Counts of the distinct bigrams in all documents and in the good ones."""
        return [np.bincount(x, minlength=len(self.keys)) for x in (self.cell, self.cell[self.good])]

    def contexts(self, first: np.ndarray) -> list[np.ndarray]:
        """By word: its bigrams as a context, those bigrams that this block counts as kinds, its own count; each of all and of good documents."""
        n, counts = len(self.words), self.bigrams()
        return [np.bincount(by, weights=x, minlength=n).astype(np.int64) for by, what in ((self.before, counts), (self.before, first), (self.after, counts)) for x in what]

    def request(self, keys: np.ndarray, order: np.ndarray, numbers: list[np.ndarray], shards: int):
        """One row per shard that some key belongs to."""
        keys, numbers = keys[order], np.stack([x[order] for x in numbers]).astype(np.uint32)
        ends = np.searchsorted(keys >> np.uint64(64 - shards), np.arange((1 << shards) + 1, dtype=np.uint64))
        at = np.flatnonzero(np.diff(ends))
        parts = [slice(ends[i], ends[i + 1]) for i in at]
        # Steps from key to key: their high bytes are zeros.
        steps = [np.diff(keys[p], prepend=np.uint64(i) << np.uint64(64 - shards)) for i, p in zip(at.tolist(), parts)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([self.block] * len(at), pa.int64()), pa.array([p.stop - p.start for p in parts], pa.int32()), pa.array([_planes(x) for x in steps], pa.binary()), pa.array([_planes(numbers[:, p]) for p in parts], pa.binary())], names=["shard", "block", "n", "keys", "numbers"])


def _add_up(width: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        """Sums of a shard's keys over the blocks; `first` marks, per number, the one block that counts the key as a kind."""
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        base = np.uint64(rows[0]["shard"]) << np.uint64(64 - shards)
        distinct, place = np.unique(np.concatenate([base + np.cumsum(_numbers(r["keys"], r["n"])) for r in rows]), return_inverse=True)
        numbers = np.concatenate([_numbers(r["numbers"], r["n"] * width).reshape(width, -1) for r in rows], axis=1)
        sums, first = np.empty(numbers.shape, np.uint64), np.zeros(numbers.shape, np.uint8)
        for k in range(width):
            sums[k] = np.bincount(place, weights=numbers[k])[place].astype(np.uint64)
            held = np.flatnonzero(numbers[k])[::-1]
            least = np.full(len(distinct), -1, np.int64)
            least[place[held]] = held  # the last assignment stays: that of the least block
            first[k, least[least >= 0]] = 1
        sums = sums.astype(np.uint32) if sums.max() < 1 << 32 else sums
        out, at = [], 0
        for r in rows:
            own = slice(at, at := at + r["n"])
            out.append((r["block"], r["shard"], r["n"], _planes(sums[:, own]), np.packbits(first[:, own], axis=1).tobytes(), numbers[:, own].sum(1, dtype=np.int64).tolist(), first[:, own].sum(1, dtype=np.int64).tolist()))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["block", "shard", "n", "sums", "first", "own", "kinds"])

    return run


def _replies(rows: list[dict], width: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, first) in the order of the block's own keys; rows without `sums` give zeros there."""
    rows = sorted(rows, key=lambda r: r["shard"])
    sums, first = np.zeros((width, len(order)), np.uint64), np.zeros((width, len(order)), np.uint8)
    if rows:
        if "sums" in rows[0]:
            sums[:, order] = np.concatenate([_numbers(r["sums"], r["n"] * width).reshape(width, -1) for r in rows], axis=1)
        first[:, order] = np.concatenate([np.unpackbits(np.frombuffer(r["first"], np.uint8).reshape(width, -1), axis=1, count=r["n"]) for r in rows], axis=1)
    return sums, first


def blocks(docs: DataFrame, target_ids: DataFrame, known: frozenset[str] | None, doc_id: str, text: str) -> DataFrame:
    """(block, doc_ids, sizes, tokens, words, good): documents by blocks; `good` has the places of the target's."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def encode(batches):
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def block():
            ids = pa.concat_arrays([b.column(0) for b in held])
            words, tokens, sizes = hashed_words(pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in held]), shared.value)
            columns = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in (sizes.astype("<i4").tobytes(), _planes(tokens), words.tobytes()))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "sizes", "tokens", "words"])

        for b in batches:
            for at in range(0, b.num_rows, 64):
                held.append(part := b.slice(at, 64))
                size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if size >= BLOCK:
                    yield block()
                    held, size, number = [], 0, number + 1
                    give_back()
        if held:
            yield block()

    # A task makes a few blocks, so a few files; whatever meets the blocks later is moved to them, not they to it.
    coded = bucketed(slim.mapInArrow(encode, f"block long, doc_ids array<{kind}>, sizes binary, tokens binary, words binary"), "block", "encoded")
    # Ids meet the target's, not texts. The same join at every size.
    chosen = target_ids.toDF("_target").where("_target is not null").distinct()
    placed = coded.select("block", F.posexplode("doc_ids").alias("at", "doc_id")).join(chosen.hint("merge"), F.col("doc_id") == F.col("_target"))
    good = placed.groupBy(F.col("block").alias("_block")).agg(F.collect_list("at").alias("good"))
    good = written(good, "good")
    return coded.join(good.hint("merge"), F.col("block") == F.col("_block"), "left").drop("_block")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places of the runs of equal neighbours, number of its run for every place)."""
    opens = np.ones(len(x), bool)
    opens[1:] = x[1:] != x[:-1]
    return np.flatnonzero(opens), np.cumsum(opens) - 1


class Own:
    """What each document of a block has of its own: a row per document and distinct bigram."""

    def __init__(self, block: Block):
        n = len(block.words)
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        key, self.times = np.unique(doc * max(1, len(block.keys)) + block.cell, return_counts=True)
        self.doc, self.cell = np.divmod(key, max(1, len(block.keys)))
        self.before, self.after = block.before[self.cell], block.after[self.cell]
        # Bigrams are in the order of their first words, so those of one document and first word are neighbours.
        self.first, self.run = _runs(self.doc * n + self.before)
        word, place = np.unique(self.doc * n + self.after, return_inverse=True)
        self.single = np.bincount(place, weights=self.times, minlength=len(word))[place]
        self.total = np.add.reduceat(self.times, self.first)[self.run] if len(key) else self.times
        self.sizes = block.sizes[self.doc]

    def loss(self, counts: np.ndarray, total: np.ndarray, kinds: np.ndarray, single: np.ndarray, every: int, size: int, mine: np.ndarray) -> np.ndarray:
        """By row: the loss of its bigram under a model without the document's own counts, where `mine` says that it has them.

        Absolute discounting interpolated with an add-one unigram.
        """
        if not len(self.times):
            return np.zeros(0)
        mine = mine[self.doc]
        left = counts[self.cell].astype(np.float64) - np.where(mine, self.times, 0)
        lost = np.add.reduceat((mine & (left == 0)).astype(np.int64), self.first)[self.run]
        many = total[self.before].astype(np.float64) - np.where(mine, self.total, 0)
        sorts = kinds[self.before].astype(np.float64) - lost
        one = (single[self.after].astype(np.float64) - np.where(mine, self.single, 0) + 1) / (every - np.where(mine, self.sizes, 0) + size)
        held = np.maximum(many, 1)
        return -np.log(np.maximum(left - DISCOUNT, 0) / held + np.where(many > 0, DISCOUNT * sorts / held, 1.0) * one)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, size: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, target_loss, background_loss (nats per token), score (their difference).

    The target is the rows whose doc_id is in the column of `target_ids` (nulls are in none). A null or
    wordless text has no tokens and null losses.
    """
    known = None if size is None else frozenset(vocabulary(docs, size, text))
    kind = docs.select(doc_id).dtypes[0][1]
    marked = blocks(docs, target_ids, known, doc_id, text)
    # Blocks times shards are rows, so the shards' number stays the same until one would be too large for a task.
    tokens = marked.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    shards = 4 if tokens < 4 << 20 else 10
    while tokens >> shards > 32 << 20:
        shards += 1

    def ask_bigrams(batches):
        for b in batches:
            for row in b.to_pylist():
                own = Block(row)
                yield from own.request(own.keys, own.order, own.bigrams(), shards)
                del own
                give_back()

    bigrams = written(marked.drop("doc_ids").mapInArrow(ask_bigrams, _REQUEST).groupBy("shard").applyInArrow(_add_up(2, shards), _REPLY), "bigrams")

    def ask_words(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        own = Block(left.to_pylist()[0])
        _, first = _replies(right.to_pylist(), 2, own.order)
        return pa.Table.from_batches(own.request(own.words, np.argsort(own.words), own.contexts(first), shards))

    asked = marked.drop("doc_ids").groupBy("block").cogroup(bigrams.select("block", "shard", "n", "first").groupBy("block")).applyInArrow(ask_words, _REQUEST)
    words = written(asked.groupBy("shard").applyInArrow(_add_up(6, shards), _REPLY), "words")
    kinds, every, good = words.agg(*[F.coalesce(F.sum(F.col(c)[k]), F.lit(0)) for c, k in (("kinds", 4), ("own", 4), ("own", 5))]).first()
    places = len(known) + 1 if known is not None else kinds + 1

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        own, rows = Block(left.drop_columns(["doc_ids"]).to_pylist()[0]), right.to_pylist()
        counts, _ = _replies([r for r in rows if r["level"] == 2], 2, own.order)
        by_word, _ = _replies([r for r in rows if r["level"] == 6], 6, np.argsort(own.words))
        each, losses = Own(own), []
        for k, n, mine in ((1, good, own.chosen), (0, every, np.ones(len(own.sizes), bool))):
            loss = each.loss(counts[k], *by_word[k::2], n, places, mine)
            losses.append(np.bincount(each.doc, weights=loss * each.times, minlength=len(own.sizes)) / np.maximum(own.sizes, 1))
        none = own.sizes == 0
        columns = [pa.array(x, pa.float64(), mask=none) for x in (*losses, losses[0] - losses[1])]
        ids = left.column("doc_ids").combine_chunks().flatten()
        return pa.Table.from_arrays([ids, pa.array(own.sizes, pa.int64()), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    sent = [df.select("block", "shard", "n", "sums", "first", F.lit(level).alias("level")) for df, level in ((bigrams, 2), (words, 6))]
    return marked.groupBy("block").cogroup(sent[0].unionAll(sent[1]).groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
