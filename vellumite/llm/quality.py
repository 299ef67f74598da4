"""Quality rules whose cutoffs are certified on labelled documents.

Every rule rejects a document whose measure lies beyond a cutoff. The rules share one path of levels from mild
to strict: at a level each rule has its cutoff, and a document is refused there if any rule refuses it. For
each stratum the levels are tried in that order on the labelled good documents (the holdout), and a level is
certified while the exact binomial test rejects "this level refuses more than alpha of the stratum's good
documents" (that is, while the one-sided Clopper-Pearson bound on its false rejections stays below alpha).
Testing in a fixed order needs no correction along the path (learn-then-test); as a level is tested as the
union of its rules, none is needed over the rules; over the strata the error delta is divided by their shares
of the holdout (weighted Bonferroni, the weights following from sizes only). So with probability 1 - delta no
stratum loses more than alpha of its good documents to the rules. Everything is DataFrame code; no Python runs
on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumite.llm._common import SPACE_RUN, SPACES, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects where the measure is above (sign 1) or below (sign -1) a cutoff; one cutoff a level, from mild to strict."""

    name: str
    measure: str
    sign: int
    cutoffs: tuple[float, ...]


#: Measures are SQL over the columns of MEASURES; n_words is at least 1 where they are used.
RULES = (
    Rule("symbols", "n_symbols / n_words", 1, (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    Rule("dup_lines", "100 * n_dup_lines / n_words", 1, (10.0, 8.5, 7.5, 6.0, 5.0, 4.5, 4.0, 3.0, 2.0, 1.5, 1.0)),
    Rule("repeats", "n_repeat_words / n_words", 1, (0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04)),
    Rule("long_words", "word_chars / n_words", 1, (30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    Rule("short_words", "word_chars / n_words", -1, (1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.25, 3.5, 3.75, 4.0)),
)
ALPHA, DELTA, WINDOW = 0.02, 0.05, 5


def levels(rules: tuple[Rule, ...]) -> int:
    """The number of levels, the same for all rules; cutoffs that do not grow stricter are refused."""
    sizes = {len(r.cutoffs) for r in rules}
    if len(sizes) > 1 or any(a * r.sign < b * r.sign for r in rules for a, b in zip(r.cutoffs, r.cutoffs[1:])):
        raise ValueError("rules need equally many cutoffs, each at least as strict as the one before")
    return sizes.pop() if sizes else 0


def refused(rules: tuple[Rule, ...], level: int) -> Column:
    """Whether any rule refuses a document at a level."""
    out = F.lit(False)
    for r in rules:
        out |= F.coalesce(F.expr(r.measure) * r.sign > r.cutoffs[level] * r.sign, F.lit(False))
    return out


def _let(value: Column, body) -> Column:
    """Evaluates `value` once and hands it to `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort (hash, place), keep equal neighbours, add up overlaps."""

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        equal = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        hit = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & equal(k, k - 1)) | ((k < last) & equal(k, k + 1)))
        return F.array_sort(F.transform(hit, lambda k: F.get(s, k)["i"]))

    def total(p: Column) -> Column:
        steps = F.when(F.size(p) > 1, F.sequence(F.lit(0), F.size(p) - 2)).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda acc, k: acc + F.least(F.lit(WINDOW), F.get(p, k + 1) - F.get(p, k))))

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(ordered, places), total)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the five counts of MEASURES and `base_failed`; columns of df with these names are replaced.

    A null or empty text has no words: all counts 0, base_failed true. Windows are compared by a 64-bit
    hash (xxhash64) inside one document. The work on a document is linear but for one sort, and that only
    where some window repeats. Nothing is shuffled.
    """
    mark = "_m"  # before the names of what is needed on the way; no column of df begins with it
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    words, hashes, shown = (f"{mark}{n}" for n in ("words", "hashes", "lines"))
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACES))
    out = df.drop(*MEASURES, "base_failed").withColumn(words, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1)))
    w = F.col(words)
    out = out.withColumn("n_words", F.size(w).cast("long")).withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(hashes, windows).withColumn(shown, lines).drop(words)
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size(shown) - F.size(F.array_distinct(shown))).cast("long")).drop(shown)
    out = out.withColumn("n_repeat_words", F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_covered(F.col(hashes)))).drop(hashes)
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    # A generator of one row: no filter on a measure is moved below it, where the measure would be taken again and again.
    found = (*MEASURES, "base_failed")
    return out.select(*[c for c in out.columns if c not in found], F.inline(F.array(F.struct(*found))))


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.lit(3.141592653589793) * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), for k < n p; 1 elsewhere (no cutoff is certified there).

    Terms fall from k downwards faster than a geometric series; those beyond 60 standard deviations add
    nothing to a double and are left out, so the array stays small for any n.
    """
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.ceil(60 * F.sqrt(n * F.lit(p))) + 100)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc: Column, j: Column) -> Column:
        i = k - j + 1
        t = acc["t"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    sums = F.when(steps >= 1, F.aggregate(F.sequence(F.lit(1).cast("long"), steps.cast("long")), start, add, lambda acc: acc["s"])).otherwise(F.lit(1.0))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(top * sums)


def certify(measured: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a certified level: `stratum`, `level` (from 0), `n` (good documents) and `k` (of them refused there).

    `measured` has `doc_id`, `stratum`, MEASURES and base_failed; `labels` has doc_id and quality.
    Good documents are those with a label of quality 1 (any of several) that pass the base rules. A null
    stratum is a stratum. Empty inputs give no row. Counts are summed before the shuffle; one row per
    stratum and level remains after it.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    held = measured.where(~F.col("base_failed")).join(good, F.col(doc_id) == F.col("_id"), "left_semi")
    several = range(levels(rules))
    counts = held.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(refused(rules, i).cast("long")) for i in several]).alias("k"))
    counts = written(counts, "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tests = counts.select("stratum", "n", F.posexplode("k").alias("level", "k"))
    error = F.lit(delta) * F.col("n") / F.lit(max(total, 1))
    passed = tests.withColumn("ok", (binomial_cdf(F.col("k"), F.col("n"), alpha) <= error).cast("int"))
    so_far = passed.withColumn("ok", F.min("ok").over(Window.partitionBy("stratum").orderBy("level"))).where("ok = 1")
    best = so_far.groupBy("stratum").agg(F.max(F.struct("level", "n", "k")).alias("b"))
    return best.select("stratum", "b.*")


def judge(measured: DataFrame, certified: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured with `kept`: base rules passed and not refused at the stratum's level; a stratum without one has the base rules only."""
    cuts = certified.select(F.col("stratum").alias("_stratum"), F.col("level").alias("_level"))
    if cuts.count() <= 10_000:
        cuts = F.broadcast(cuts)
    out = measured.join(cuts, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    crossed = F.lit(False)
    for r in rules:
        cutoff = F.get(F.array(*[F.lit(float(c)) for c in r.cutoffs]), F.col("_level"))
        crossed |= F.coalesce(F.expr(r.measure) * r.sign > cutoff * r.sign, F.lit(False))
    kept = F.when(F.col("base_failed"), False).otherwise(~crossed)
    return out.withColumn("kept", kept).drop("_stratum", "_level")


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, stratum column, MEASURES, base_failed, kept. Texts are read once."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    measured = written(measures(slim).drop("text"), "measures")
    cutoffs = written(certify(measured, labels, "stratum", "doc_id", rules, alpha, delta), "cutoffs")
    return judge(measured, cutoffs, "stratum", rules)


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept, with docs' columns only.

    The measures are taken twice, once for the cutoffs and once beside the text, rather than shuffling texts
    to join verdicts; so rows with null or repeated doc_id are judged each by itself.
    """
    columns = docs.columns
    slim = docs.select("doc_id", F.col(stratum).alias("stratum"), "text")
    cutoffs = written(certify(measures(slim).drop("text"), labels, "stratum", "doc_id", rules, alpha, delta), "cutoffs")
    whole = measures(docs.select(F.struct(*columns).alias("_row"), F.col("text"), F.col(stratum).alias("stratum")))
    return judge(whole, cutoffs, "stratum", rules).where("kept").select("_row.*")
