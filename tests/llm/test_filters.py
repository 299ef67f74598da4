"""URL rules, quality rules, language ID, language-model scores."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumite.llm import langid, lm_score, quality
from vellumite.llm._common import components
from vellumite.llm.queries import URL_RULES
from vellumite.llm.url_filter import url_verdicts, without_dots


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, k) for k in range(400, 460)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [
    (1, "http://a.net/x", '<link rel="canonical" href="https://B.com/y?z=1&amp;q=2#f">'),
    (2, "https://b.com/y?z=1&q=2", ""),
    (3, "http://c.org/de/k", "<META http-equiv=refresh content='0; url=/de/m'>"),
    (4, "http://c.org/de/m", '<link href="//a.net/x" rel=canonical>'),
    (5, None, None),
    (6, "nonsense", ""),
    (7, "https://s.example.net/en/", "<link rel=canonical href=http://a.net/x>"),
    (8, "HTTP://c.ORG", None),
    (8, "HTTP://c.ORG", None),
]


def test_url_verdicts_follow_links(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["via"]) for r in url_verdicts(pages, [("net/", "block")]).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block", "rule")
    assert got[2] == ("b.com", "/y", None, "block", "link") and got[3][3:] == got[4][3:] == ("block", "link")
    assert got[5] == got[6] == ("", "", None, "allow", "default") and got[8] == ("c.org", "", None, "allow", "default")
    # An explicit allow among the aliases goes before the block.
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_verdicts(pages, URL_RULES).collect()}
    assert got[1] == ("net/", "block") and got[7] == ("example.net/en/", "allow") and got[2] == got[3] == (None, "allow")
    links = spark.createDataFrame([("http://a.net/x#1", "http://new.com/"), (None, "x")], "a string, b string")
    more = spark.createDataFrame([(9, "http://NEW.com/", None)], "page_id long, url string, html string")
    assert url_verdicts(more, [("net/", "block")], links).first()["verdict"] == "block"
    assert url_verdicts(pages.limit(0), URL_RULES).count() == 0


def linked_pages():
    """Chains, a hub, a cycle, dot steps and several tags on one page; each group has a rule's decision at one far end."""
    page = lambda i, url, *to: (i, url, "".join(f'<link rel="canonical" href="{t}">' for t in to))
    chain = [page(i, f"http://chain{i}.com/a/b/p", f"http://chain{i + 1}.com/x/../a/./b/p") for i in range(30)] + [page(30, "http://chain30.com/a/b/p", "http://end.net/")]
    hub = [page(100 + i, f"http://spoke{i}.com/", "http://hub.com/") for i in range(200)] + [page(300, "http://hub.com/", "http://www.example.com/de/x", "http://sub.org/fr/y")]
    cycle = [page(400 + i, f"http://c{i}.com/d/", f"http://c{(i + 1) % 5}.com/d/q/..") for i in range(5)] + [page(405, "http://c0.com/d/", "../../e/..//z?n=1"), page(406, "http://c0.com/z?n=1", "")]
    last = [(500, "http://q.com/a?x", "<meta http-equiv=refresh content='0;url=?y'><META HTTP-EQUIV='refresh' content='1; URL=./z'>"), page(501, "http://q.com/a?y", "http://q.net/")]
    return chain + hub + cycle + last


def test_links_of_chains_hubs_and_cycles(spark):
    rows = linked_pages()
    got = {r["page_id"]: (r["verdict"], r["via"]) for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), URL_RULES).collect()}
    assert all(got[i] == ("block", "link") for i in range(31))  # end.net is not a page, and is blocked
    assert all(got[i] == ("allow", "link") for i in range(100, 301))  # org/fr/ allowed goes before example.com/de/ blocked
    assert all(got[i][1] == "default" for i in range(400, 407))
    assert got[500] == got[501] == ("block", "link")


def test_dot_steps(spark):
    cases = {"/a/./b": "/a/b", "/a/../b": "/b", "/..": "/", "/../../x": "/x", "/a/b/..": "/a/", "/a/.": "/a/", "/a..b/c.": "/a..b/c.", "": "", "/": "/", "/a//../b": "/a/b"}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", without_dots(F.col("p")).alias("q"))
    assert {r["p"]: r["q"] for r in df.collect()} == cases


def test_longest_rule_wins(spark):
    rules = [("b.com/", "block"), ("a.b.com/x/", "allow"), ("b.com/x/y", "block")]
    pages = spark.createDataFrame([(1, "http://z.a.b.com/x/y"), (2, "http://ab.com/"), (3, "http://b.com?q"), (4, "http://A.b.com/x/")], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    got = {r["page_id"]: r["rule"] for r in url_verdicts(pages, rules).collect()}
    assert got == {1: "a.b.com/x/", 2: None, 3: None, 4: "a.b.com/x/"}


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_measures_against_plain_python(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "one", "a b c d e a b c d e", "é漢 😀 x\x0by\x0cz", "l\nl\n \nl\nm"]
    texts += [rng.choice(["", "\n "]).join([]) + "".join(rng.choice(["a ", "b ", "c\n", "# ", "dd\t", " ", "|"]) for _ in range(rng.randrange(200))) for _ in range(120)]
    texts.append("w " * 40_000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("_mwords", F.col("doc_id"))
    assert quality.measures(df).columns[:3] == ["doc_id", "text", "_mwords"]
    got = {r["doc_id"]: tuple(r[c] for c in (*quality.MEASURES, "base_failed")) for r in quality.measures(df).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", [1, 19, 21, 400, 30_000])
def test_binomial_cdf(spark, n):
    p = 0.01
    ks = sorted({0, 1, int(n * p) // 2, max(0, int(n * p) - 1), int(n * p) + 1})
    rows = spark.createDataFrame([(min(k, n), n) for k in ks], "k long, n long")
    for r in rows.select("k", quality.binomial_cdf(F.col("k"), F.col("n"), p).alias("c")).collect():
        if r["k"] >= n * p:
            assert r["c"] == 1.0
        else:
            exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(r["k"] + 1))
            assert r["c"] == pytest.approx(exact, rel=1e-9)


def test_levels_keep_their_promise(spark):
    """A level that would refuse too many good documents of a stratum is not reached there; small strata reach none."""
    rows, labels = [], []
    for i in range(8000):
        lang, noisy = ("a", 0) if i % 2 else (None, 1 if i % 20 == 0 else 0)
        rows.append((i, lang, 100, 500, 30 if noisy else 0, 0, 0, False))
        labels.append((i, 1))
    rows += [(20_000 + i, "few", 100, 500, 0, 0, 0, False) for i in range(100)]
    labels += [(20_000 + i, 1) for i in range(100)]
    rows += [(10_000 + k, s, 100, 500, 30, 0, 0, False) for k, s in enumerate(["a", None, "unseen", "few"])]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    cuts = quality.certify(measured, spark.createDataFrame([*labels, *labels[:50], (None, 1)], "doc_id long, quality int"))
    found = {r["stratum"]: (r["level"], r["n"], r["k"]) for r in cuts.collect()}
    # A tenth of the good null ones have a share of symbols of 0.3: not above 0.3, the cutoff of level 6.
    assert found == {"a": (10, 4000, 0), None: (6, 4000, 0)} and quality.RULES[0].cutoffs[6] == 0.3
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(measured, cuts).collect()}
    assert not kept[10_000] and kept[10_001] and kept[10_002] and kept[10_003] and len(kept) == len(rows)
    empty = quality.certify(measured, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.judge(measured, empty).where("kept").count() == len(rows)


def test_certified_levels_against_a_plain_version(spark):
    """Random measures and strata: the last level of the path whose exact tail is small enough."""
    rng = random.Random(6)
    rows = []
    for i in range(6000):
        s = rng.choices(["x", "y", None], (12, 5, 2))[0]
        n = rng.randint(20, 400)
        rows.append((i, s, n, int(n * rng.gauss(6, 1.2)), int(n * rng.expovariate(30)), rng.choices([0, 1, 9], (90, 8, 2))[0], int(n * 0.2 * rng.random() ** 20), rng.random() < 0.1))
    good = {i for i in range(6000) if rng.random() < 0.6}
    measured = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(6000)], "doc_id long, quality int")
    held = [r for r in rows if r[0] in good and not r[7]]
    want = {}
    for s in {r[1] for r in held}:
        own = [r for r in held if r[1] == s]
        for level in range(quality.levels(quality.RULES)):
            k = 0
            for _, _, n, chars, symbols, lines, repeats, _ in own:
                values = (symbols / n, 100 * lines / n, repeats / n, chars / n, chars / n)
                k += any(v * r.sign > r.cutoffs[level] * r.sign for v, r in zip(values, quality.RULES))
            tail = sum(math.comb(len(own), j) * 0.02**j * 0.98 ** (len(own) - j) for j in range(k + 1))
            if tail > 0.05 * len(own) / len(held):
                break
            want[s] = (level, len(own), k)
    got = {r["stratum"]: (r["level"], r["n"], r["k"]) for r in quality.certify(measured, labels).collect()}
    assert got == want and len({w[0] for w in want.values()}) > 1
    with pytest.raises(ValueError):
        quality.levels((quality.Rule("a", "n_words", 1, (1.0, 2.0)),))


def test_levels_are_certified_on_the_correctness_table(spark):
    """At sf0.01 the method refuses documents that the base rules pass."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_verdicts(docs, labels)
    assert out.where("not base_failed and not kept").count() > 0 and out.where("kept").count() > 0.8 * out.where("not base_failed").count()


def test_quality_filter_keeps_rows_and_columns(spark):
    good = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, good, "en", "x"), (1, good, "en", "x"), (None, good, None, "y"), (2, "short", "en", None), (3, None, "en", None)], "doc_id long, text string, lang string, kept string")
    out = quality.quality_filter(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert out.columns == docs.columns and sorted((str(r["doc_id"]), r["kept"]) for r in out.collect()) == [("1", "x"), ("1", "x"), ("None", "y")]
    assert quality.quality_filter(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_kneser_ney_sums_to_one():
    rng = random.Random(1)
    grams = {}
    for name, alphabet in (("a", "xyz "), ("b", "xyw ")):
        t = "   " + "".join(rng.choice(alphabet) for _ in range(400))
        grams[name] = Counter(t[i : i + 4] for i in range(len(t) - 3))
    models = langid.LanguageModels(grams)
    n = len(models.letters) + 2
    for m in models.models:
        for context in itertools.product(range(n), repeat=3):
            k = 0
            for c in context:
                k = k << 16 | c
            assert np.exp(m.logp(np.array([k << 16 | c for c in range(n)], np.uint64))).sum() == pytest.approx(1)


def plain_kneser_ney(counts, alphabet):
    """P(last | others) of 4 characters by the definition, level by level, in plain dictionaries."""
    levels, now = [], dict(counts)
    for order in range(4, 0, -1):
        once, twice = (sum(n == k for n in now.values()) for k in (1, 2))
        d = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        total, kinds = Counter(), Counter()
        for g, n in now.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        levels.append((now, d, total, kinds))
        if order > 1:
            now = Counter(g[1:] for g in now)  # distinct left neighbours

    def p(gram, level=0):
        if level == 4:
            return 1 / alphabet
        now, d, total, kinds = levels[level]
        context = gram[:-1]
        lower = p(gram[1:], level + 1)
        if not total[context]:
            return lower
        return max(now.get(gram, 0) - d, 0) / total[context] + d * kinds[context] / total[context] * lower

    return p


def test_kneser_ney_against_a_plain_version():
    rng = random.Random(7)
    texts = {"a": "".join(rng.choices("abc ", (5, 3, 2, 2), k=900)), "b": "".join(rng.choices("abd ", (2, 3, 5, 2), k=700))}
    counts = {k: Counter(("   " + t)[i : i + 4] for i in range(len(t))) for k, t in texts.items()}
    models = langid.LanguageModels(counts)
    code = {" ": 0, **{c: i + 2 for i, c in enumerate(models.letters)}}
    n = len(models.letters) + 2
    for model, name in zip(models.models, models.languages):
        p = plain_kneser_ney(counts[name], n)
        grams = ["".join(g) for g in itertools.product("abcd ", repeat=4)]
        packed = np.array([sum(code[c] << 16 * (3 - i) for i, c in enumerate(g)) for g in grams], np.uint64)
        assert np.exp(model.logp(packed)) == pytest.approx([p(g) for g in grams], rel=1e-9)
    # The loss of a text is the mean of the characters' losses, each after the three before it.
    text = "abad cab dab"
    sums, sizes, _ = models.losses([text])
    for k, name in enumerate(models.languages):
        p = plain_kneser_ney(counts[name], n)
        want = -sum(math.log(p(("   " + text)[i : i + 4])) for i in range(len(text)))
        assert sums[0][k] == pytest.approx(want, rel=1e-5) and sizes[0] == len(text)


def test_language_of_odd_rows(spark):
    rows = [(1, "der die das und nicht " * 9, "de"), (1, "der die das und nicht " * 9, "de"), (2, "the and of to which " * 9, "en"), (None, "the of and", "en"), (3, "ab " * (1 << 20), None), (4, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("l", F.lit("clash")).withColumn("n", F.lit(1))
    models = langid.fit(docs, 5)
    assert models.languages == ["de", "en"]
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in langid.identify(docs, models).collect())
    assert [g for g in got if g[0] in (0, 1, 2, 4)] == [(0, "en"), (1, "de"), (1, "de"), (2, "en"), (4, "und")] and len(got) == 6
    assert langid.identify(docs.limit(0), models).count() == 0


def test_scores_of_odd_rows(spark):
    """Repeated rows each have a score, columns may clash, a very long text is whole, an empty table gives none."""
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "x " * 600_000), (None, "a b"), (3, " \n"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("good", F.lit("clash"))
    good = spark.createDataFrame([(1,), (None,)], "doc_id long")
    got = lm_score.cross_entropy_difference(docs, good).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (1, 5), (1, 5), (2, 600_000), (3, 0), (4, 0)]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and all(r["score"] is None for r in got if r["n_tokens"] == 0)
    assert lm_score.cross_entropy_difference(docs.limit(0), good).count() == 0


def test_losses_do_not_depend_on_batches():
    grams = {"a": Counter({"   a": 3, "  ab": 2, " aba": 2, "abab": 9}), "b": Counter({"   z": 2, "  zz": 5})}
    m = langid.LanguageModels(grams)
    texts = ["abab 12 zz", "", "...", "a", "漢字 Zz", "ab " * 50]
    whole = m.losses(texts)
    for i, t in enumerate(texts):
        one = m.losses([t])
        assert np.allclose(one[0][0], whole[0][i]) and one[1][0] == whole[1][i] and one[2][0] == whole[2][i]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    models = langid.fit(docs.where(langid.held_out_fold() != 2), 120)
    held = docs.where(langid.held_out_fold() == 2)
    got = langid.identify(held, models).join(held.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.99 and 0 <= got[1] <= got[2] <= 1
    odd = spark.createDataFrame([(1, None), (None, "the of and"), (3, ""), (4, "12 ..")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(odd, models).collect()] == ["und", "en", "und", "und"]
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def test_lm_score_against_plain_counts(spark):
    texts = ["the cat sat", "The cat", "dog ate the\tcat", None, "", "zebra zebra"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    good = spark.createDataFrame([(0,), (1,), (1,), (None,)], "doc_id long")
    size = 4
    words = Counter(w for t in texts for w in (t or "").lower().split())
    vocabulary = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[: size - 1]]
    place = {w: i + 1 for i, w in enumerate(vocabulary)}
    ids = [[place.get(w, 0) for w in (t or "").lower().split()] for t in texts]

    def model(rows):
        c, single = Counter(), Counter()
        for r in rows:
            for a, b in zip([size, *r], r):
                c[a, b] += 1
                single[b] += 1
        total, kinds = Counter(), Counter()
        for (a, _), n in c.items():
            total[a] += n
            kinds[a] += 1
        one = {w: (single[w] + 1) / (sum(single.values()) + size) for w in range(size)}
        return lambda a, b: math.log(max(c[a, b] - 0.75, 0) / total[a] + 0.75 * kinds[a] / total[a] * one[b] if total[a] else one[b])

    for r in lm_score.cross_entropy_difference(docs, good, size).collect():
        i = r["doc_id"]
        row = ids[i]
        assert r["n_tokens"] == len(row)
        if not row:
            assert r["score"] is None
            continue
        # The models of all other documents.
        target, background = model([x for k, x in enumerate(ids[:2]) if k != i]), model(ids[:i] + ids[i + 1 :])
        want = [-sum(m(a, b) for a, b in zip([size, *row], row)) / len(row) for m in (target, background)]
        assert r["target_loss"] == pytest.approx(want[0], rel=1e-9) and r["background_loss"] == pytest.approx(want[1], rel=1e-9)
        assert r["score"] == pytest.approx(want[0] - want[1], abs=1e-9)
    assert lm_score.cross_entropy_difference(docs.limit(0), good, size).count() == 0


def test_word_places_of_slices():
    texts = pa.array(["a B\tc", None, "", " x  é\n"] * 300)
    got, sizes = lm_score.Words(["b", "é"]).encode(texts.slice(5, 700))
    flat, want = [], []
    for t in texts.slice(5, 700).to_pylist():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        flat += [{"b": 1, "é": 2}.get(x.lower(), 0) for x in w]
        want.append(len(w))
    assert got.tolist() == flat and sizes.tolist() == want


def test_lm_score_keeps_every_word(spark, monkeypatch):
    """More words than any fixed vocabulary of 16 bits; documents that differ in rare words only differ in score."""
    monkeypatch.setattr(lm_score, "BLOCK", 40_000)
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(i, 90_000)}" for i in range(0, 2000)) for _ in range(60)] + ["a W7 b", "a w8 b", "a w7 b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    chosen = {0, 5, 60}
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in chosen], "doc_id long")).collect()}
    rows = [t.lower().split() for t in texts]

    def losses(kept, i):
        """Of document i under the model of the others in `kept`."""
        c, one = Counter(), Counter()
        for k in kept:
            if k != i:
                c.update(zip(["", *rows[k]], rows[k]))
                one.update(rows[k])
        total, kinds = Counter(), Counter()
        for (a, _), n in c.items():
            total[a] += n
            kinds[a] += 1
        every = sum(one.values())

        def p(a, b):
            single = (one[b] + 1) / (every + size)
            return max(c[a, b] - 0.75, 0) / total[a] + 0.75 * kinds[a] / total[a] * single if total[a] else single

        return -sum(math.log(p(a, b)) for a, b in zip(["", *rows[i]], rows[i])) / len(rows[i])

    size = len({w for r in rows for w in r}) + 1
    assert len(got) == len(texts) and size > 40_000
    for i in (0, 1, 5, 17, 59, 60, 61, 62):
        r = got[i]
        assert (r["target_loss"], r["background_loss"]) == (pytest.approx(losses(chosen, i), rel=1e-9), pytest.approx(losses(range(len(texts)), i), rel=1e-9))
    assert got[62]["target_loss"] < got[61]["target_loss"]  # reads like the good 60


def test_a_good_document_is_not_scored_by_itself(spark):
    """A labelled good document gets the target loss of an unlabelled one with the same words, had it been the same corpus but for it."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(200)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    with_own = {r["doc_id"]: r["target_loss"] for r in lm_score.cross_entropy_difference(docs, ids(range(10))).collect()}
    without = {r["doc_id"]: r["target_loss"] for r in lm_score.cross_entropy_difference(docs, ids(range(1, 10))).collect()}
    assert with_own[0] == pytest.approx(without[0], rel=1e-12) and with_own[20] != without[20]
