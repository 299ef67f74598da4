"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, every run of characters that are not letters becomes one space, and each language has
an interpolated Kneser-Ney model of 4 characters: counts at the top, numbers of distinct left neighbours
below, absolute discounts, a uniform floor over the shared alphabet. N-grams are kept as sorted arrays of
64-bit hashes (a bijection of the packed characters, so there are no collisions). The language of the
lowest cross-entropy per character is predicted.

The models are fitted on a bounded sample: for every language the `sample_docs` documents of least
xxhash64(doc_id), whole texts. A quarter of it is held back to calibrate: the temperature that turns
cross-entropies into a probability, and for each language the cross-entropy above which a text is unlike the
language (`rejected`). Prediction covers every document.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumite.llm._common import give_back

ORDER, SAMPLE_DOCS, MOST_LANGUAGES, BUCKETS = 4, 400, 500, 16
_MIX, _SLICE, _SEGMENT = np.uint64(0x9E3779B97F4A7C15), 1 << 20, 1 << 20
_SPACE, _UNKNOWN = 0, 1


def normalised(text: str) -> str:
    """Lower case, runs of other characters than letters as one space, none at the start."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + (" " if text and not text[-1].isalpha() and any(c.isalpha() for c in text) else "")


def hashed(packed: np.ndarray) -> np.ndarray:
    return packed * _MIX


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


class KneserNey:
    """One language's model over packed grams of 16-bit characters, the last character lowest."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        self.levels = []
        for order in range(ORDER, 0, -1):
            # Discount by the usual estimate from how many grams occur once and twice.
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
            context, where = np.unique(grams >> np.uint64(16), return_inverse=True)
            total = np.bincount(where, counts)
            kinds = np.bincount(where)
            share = np.log(np.maximum(counts - discount, 1e-12) / total[where])
            h, c = hashed(grams), hashed(context)
            i, j = np.argsort(h), np.argsort(c)
            self.levels.append((h[i], share[i], c[j], np.log(discount * kinds / total)[j]))
            if order > 1:
                # Below the top a gram counts its distinct left neighbours.
                grams, counts = np.unique(grams & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)
        self.floor = -np.log(alphabet)

    def logp(self, grams: np.ndarray, level: int = 0) -> np.ndarray:
        """Natural log of P(last character | those before) for packed grams of ORDER - level characters."""
        if level == ORDER:
            return np.full(len(grams), self.floor)
        keys, share, contexts, weight = self.levels[level]
        at = _find(contexts, hashed(grams >> np.uint64(16)))
        back = np.where(at >= 0, weight[at], 0.0)
        lower = self.logp(grams & np.uint64((1 << 16 * (ORDER - level - 1)) - 1), level + 1) + back
        own = _find(keys, hashed(grams))
        return np.where(own >= 0, np.logaddexp(share[own], lower), lower)


class LanguageModels:
    """All languages' models over one alphabet, and one table of every gram that some language has."""

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        letters = sorted({c for grams in counts.values() for g in grams for c in g if c != " "})[: (1 << 16) - 2]
        self.letters = "".join(letters)
        code = {" ": _SPACE} | {c: i + 2 for i, c in enumerate(letters)}
        self.models, seen = [], []
        for name in self.languages:
            packed: Counter = Counter()
            for g, n in counts[name].items():
                k = 0
                for c in g:
                    k = k << 16 | code.get(c, _UNKNOWN)
                packed[k] += n
            keys = np.fromiter(packed, np.uint64, len(packed))
            order = np.argsort(keys)
            self.models.append(KneserNey(keys[order], np.fromiter(packed.values(), np.int64, len(packed))[order], len(letters) + 2))
            seen.append(keys)
        every = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        table = np.stack([m.logp(every) for m in self.models], 1).astype(np.float32) if self.models else np.zeros((0, 0), np.float32)
        h = hashed(every)
        order = np.argsort(h)
        self.keys, self.table = h[order], table[order]
        self.temperature, self.trust, self.limits = 1.0, 1.0, np.full(len(self.languages), np.inf)

    def codes(self) -> np.ndarray:
        """The character code of every code point: space for what is no letter."""
        if getattr(self, "_codes", None) is None:
            out = np.fromiter((_UNKNOWN if chr(c).isalpha() else _SPACE for c in range(0x110000)), np.uint16, 0x110000)
            if self.letters:
                out[[ord(c) for c in self.letters]] = np.arange(2, len(self.letters) + 2)
            self._codes = out
        return self._codes

    def losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of -log p by text and language, characters, whether there is a letter)."""
        sums, sizes, has = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        group, held = [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), _SEGMENT):
                group.append((i, t[at : at + _SEGMENT].lower()))
                held += len(group[-1][1])
                if held >= _SLICE:
                    self._add(group, sums, sizes, has)
                    group, held = [], 0
        if group:
            self._add(group, sums, sizes, has)
        return sums, sizes, has

    def _add(self, group: list[tuple[int, str]], sums: np.ndarray, sizes: np.ndarray, has: np.ndarray) -> None:
        pad = ORDER - 1
        rows = np.array([i for i, _ in group])
        lengths = np.array([len(t) + pad for _, t in group])
        start = np.cumsum(lengths) - lengths
        raw = np.frombuffer("".join(" " * pad + t for _, t in group).encode("utf-32-le", "surrogatepass"), "<u4")
        c = self.codes()[raw]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != _SPACE) | (c[:-1] != _SPACE)
        padding = np.zeros(len(c), bool)
        for k in range(pad):
            padding[start + k] = True
        keep |= padding
        place = np.cumsum(keep) - keep
        c, padding, start = c[keep].astype(np.uint64), padding[keep], place[start]
        grams = c.copy()
        for k in range(1, ORDER):
            grams[k:] |= c[:-k] << np.uint64(16 * k)
        at = _find(self.keys, hashed(grams))
        values = self.table[at]
        absent = np.flatnonzero((at < 0) & ~padding)
        if len(absent):
            values[absent] = np.stack([m.logp(grams[absent]) for m in self.models], 1)
        values[padding] = 0
        np.add.at(sums, rows, -np.add.reduceat(values, start, axis=0, dtype=np.float64))
        np.add.at(sizes, rows, np.add.reduceat(~padding, start, dtype=np.int64))
        np.logical_or.at(has, rows, np.logical_or.reduceat(c != _SPACE, start))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[bool], np.ndarray]:
        """(language or und, score, rejected, cross-entropy per character) of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), [True] * len(texts), np.zeros(len(texts))
        sums, sizes, has = self.losses(texts)
        mean = sums / np.maximum(sizes, 1)[:, None]
        best = mean.argmin(1)
        own = mean[np.arange(len(texts)), best]
        weight = np.exp(-(mean - own[:, None]) * np.sqrt(np.maximum(sizes, 1))[:, None] / self.temperature)
        score = np.where(has, self.trust / weight.sum(1), 0.0)
        names = [self.languages[b] if h else "und" for b, h in zip(best, has)]
        return names, score, (~has | (own > self.limits[best])).tolist(), own

    def calibrate(self, rows: list[tuple[str, list[float], float]], tail: float = 0.995) -> None:
        """rows: (language, mean loss by language, characters) of documents held back; fits temperature and limits."""
        rows = [r for r in rows if r[0] in self.languages and r[2] > 0]
        if not rows:
            return
        truth = np.array([self.languages.index(r[0]) for r in rows])
        mean, sizes = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        gap = (mean - mean.min(1, keepdims=True)) * np.sqrt(sizes)[:, None]

        def loss(t: float) -> float:
            z = -gap / t
            return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(truth)), truth]).mean())

        self.temperature = min((2.0**k for k in range(-6, 9)), key=loss)
        right = mean.argmin(1) == truth
        self.trust = (right.sum() + 1) / (len(right) + 2)  # no score above the rate of right answers held back
        for i in range(len(self.languages)):
            mine = mean[right & (truth == i), i]
            if len(mine):
                self.limits[i] = np.quantile(mine, tail) + mine.std()


def held_out_fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModels:
    """Models of the languages in docs, from at most `sample_docs` ids a language; rows without id, text or language teach nothing.

    More than MOST_LANGUAGES languages are refused (the models go to every executor).
    """
    ids = docs.where(F.col(doc_id).isNotNull() & F.col(lang).isNotNull()).select(F.col(doc_id).alias("i"), F.col(lang).alias("l")).distinct()
    # First of every language's hash buckets, then of the language, so a language of most rows is not one task's.
    order = [F.xxhash64("i"), F.col("i")]
    inside = Window.partitionBy("l", F.pmod(F.xxhash64("i"), F.lit(BUCKETS))).orderBy(*order)
    ids = ids.withColumn("n", F.row_number().over(inside)).where(F.col("n") <= sample_docs).drop("n")
    picked = ids.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(*order))).where(F.col("n") <= sample_docs).select(F.col("i").alias("_i"), F.col("l").alias("_l"), "n").limit(sample_docs * MOST_LANGUAGES + 1)
    sample = docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(picked), (F.col("i") == F.col("_i")) & (F.col("l") == F.col("_l")))
    # Every fourth document of the sample calibrates.
    learn, check = sample.where("n % 4 <> 0").select("l", "t"), sample.where("n % 4 = 0").select("l", "t")

    def count(batches):
        found: dict[str, Counter] = {}
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1)):
                s = " " * (ORDER - 1) + normalised(value.as_py())
                found.setdefault(name, Counter()).update(s[k : k + ORDER] for k in range(len(s) - ORDER + 1))
        for name, grams in found.items():
            yield pa.RecordBatch.from_pydict({"l": [name] * len(grams), "g": list(grams), "n": list(grams.values())})

    counts: dict[str, Counter] = {}
    for row in learn.mapInArrow(count, "l string, g string, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(row["l"], Counter())[row["g"]] = row["n"]
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    models = LanguageModels(counts)
    if counts:
        shared = docs.sparkSession.sparkContext.broadcast(models)

        def measure(batches):
            for b in batches:
                sums, sizes, _ = shared.value.losses(b.column(1).to_pylist())
                mean = sums / np.maximum(sizes, 1)[:, None]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean.tolist(), pa.list_(pa.float64())), pa.array(sizes)], names=["l", "m", "n"])

        models.calibrate(sorted((r["l"], r["m"], r["n"]) for r in check.mapInArrow(measure, "l string, m array<double>, n double").collect()))
    return models


def identify(docs: DataFrame, models: LanguageModels, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, rejected, cross_entropy.

    `und` (score 0, rejected) where the text is null or has no letter, or nothing was learned; ties go to the
    language that sorts first. `rejected` texts are unlike the language they are nearest to.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for b in batches:
            names, score, rejected, loss = shared.value.predict([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected, pa.bool_()), pa.array(loss)], names=["doc_id", "lang_pred", "score", "rejected", "cross_entropy"])
        give_back()

    return slim.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean, cross_entropy double")
