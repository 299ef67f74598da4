"""SimHash components, content-defined chunks, nearest neighbours."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest, xxh64_intdigest

from vellumite.llm import ann, simhash, substring


def plain_fingerprint(text, shingle=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = sorted(parent)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in every}


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def test_fingerprints():
    for t in (None, "", " \n", "A", "a b c", "a b c d", "É x É x y", "the " * 50, " ".join(map(str, range(300))), " ".join(map(str, range(70_000)))):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("crowd", [1, 8, 4096])
def test_links_give_all_components(spark, crowd):
    """Balls around centres, some dense, whether keys count as crowded or not."""
    rng = random.Random(crowd)
    fps = {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1}
    for size, flips in ((40, 4), (25, 7), (15, 2), (1, 0), (12, 9)):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            fps.add(x)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.near_links(df, crowd).collect()]
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {f: find(f) for f in fps} == plain_components(fps)


def shingle_set(text, shingle=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def least_of_components(items, linked, ids):
    """The smallest id (None last) of each component, by all pairs."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(items):
        for j in range(i):
            if linked(a, items[j]):
                parent[find(i)] = find(j)
    out = {}
    for i, name in enumerate(ids):
        g = find(i)
        out[g] = name if g not in out or out[g] is None else out[g] if name is None else min(out[g], name)
    return list(out.values())


def test_wide_fingerprints_and_their_keys(spark):
    """Votes bit by bit, and the keys of a segment, against a plain version."""
    rng = random.Random(14)
    for t in ("", "one", " ".join(f"w{rng.randrange(50)}" for _ in range(3)), " ".join(f"w{rng.randrange(90)}" for _ in range(700))):
        node, raw, parts, weak, info = simhash.shingle_sketch(t)
        hashes = sorted({int.from_bytes(xxh3_64_digest(b" ".join(g)), "little") for g in shingle_set(t)})
        mixed = []
        salt = [[xxh64_intdigest(k.to_bytes(2, "little") + bytes([side])) for side in (0, 1)] for k in range(9)]
        for h in hashes:
            word = []
            for k in range(9):
                x = (h ^ salt[k][0]) * (salt[k][1] | 1) % 2**64
                x = (x ^ (x >> 32)) * 0x94D049BB133111EB % 2**64
                word.append(x ^ (x >> 29))
            mixed.append(word)
        margin = [sum(1 if w[b // 64] >> (b % 64) & 1 else -1 for w in mixed) for b in range(576)]
        assert simhash.votes(np.array(hashes, np.uint64), 536).tolist() == margin
        assert np.frombuffer(raw, "<u4").tolist() == sorted({h % 2**32 for h in hashes})
        keys = set()
        for s in range(24):
            own = margin[20 * s : 20 * s + 20]
            value = sum(1 << i for i in range(20) if own[i] > 0)
            worst = sorted(range(20), key=lambda i: (abs(own[i]), i))[:8]
            assert (parts[s], weak[s]) == (value, sum(1 << i for i in worst))
            keys |= {(s * 20 + i) << 20 | value & ~(1 << i) for i in worst}
        assert sum(1 << b for b in range(56) if margin[480 + b] > 0) == (info % 2**64) >> 8 and (info % 256) == int(math.log(max(1, len(hashes))) / math.log(1.06))
        df = spark.createDataFrame([(node, list(map(int, parts)), list(map(int, weak)), info)], "node long, parts array<int>, weak array<int>, info long")
        assert {r["key"] for r in simhash._keys(df, 20).collect()} == keys and len(keys) == 192
    assert simhash.segments(50_000) == (24, 20) and simhash.segments(250_000)[1] == 22 and simhash.segments(0)[1] == 16


def test_recall_of_pairs_at_the_similarity(spark):
    """Pairs whose similarity lies from 0.8 to 0.83, where keys are shared least: 0.95 of them and more are found."""
    rng = random.Random(31)
    rows = []
    while len(rows) < 800:
        base = [f"w{rng.randrange(10**7)}" for _ in range(rng.choice([40, 150, 400]))]
        other = list(base)
        while jaccard(shingle_set(" ".join(base)), shingle_set(" ".join(other))) > 0.83:
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**7)}"
        if jaccard(shingle_set(" ".join(base)), shingle_set(" ".join(other))) >= 0.8:
            rows += [" ".join(base), " ".join(other)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert {i for i in range(0, 800, 2)} <= kept and len(kept) - 400 <= 0.05 * 400


@pytest.mark.parametrize("few", [1, 2, 5000])
def test_crowded_keys(spark, few, monkeypatch):
    """A thousand near copies of one text, and texts near one of them only; nothing is emitted pair by pair."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**7)}" for _ in range(300)]
    rows = []
    for _ in range(300 if few > 1000 else 1000):
        w = list(base)
        w[rng.randrange(300)] = f"x{rng.randrange(10**7)}"
        rows.append(" ".join(w))
    for i in range(3):
        w = rows[i].split()
        for at in (20, 60, 100, 140, 180)[: 3 + i]:
            w[at] = f"y{rng.randrange(10**7)}"
        rows.append(" ".join(w))
    rows += [" ".join(f"z{rng.randrange(10**7)}" for _ in range(200)) for _ in range(20)]
    n = len(rows) - 23
    links = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda classes, shape, similarity: links(classes, shape, similarity, few))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert kept == {0, *range(n + 3, n + 23)}  # texts n to n + 2 are within 0.8 of one copy each


def test_pairs_meet_under_their_first_key_only(spark):
    """Against a plain search for the first key that two classes share."""
    rng = random.Random(2)
    shape = (6, 12)
    rows = []
    base = [f"w{i}" for i in range(60)]
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(60), rng.randint(0, 6)):
            w[at] = f"x{rng.randrange(10**6)}"
        node, _, parts, weak, info = simhash.shingle_sketch(" ".join(w), 5, shape)
        rows.append((node, list(map(int, parts)), list(map(int, weak)), info))
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "node long, parts array<int>, weak array<int>, info long")
    keyed = simhash._keys(df, 12).join(df.select(F.col("node").alias("n"), "parts", "weak"), F.col("node") == F.col("n"))
    other = keyed.select(*[F.col(c).alias(f"_{c}") for c in ("key", "node", "parts", "weak")])
    got = sorted((r["key"], r["node"], r["_node"]) for r in keyed.join(other, (F.col("key") == F.col("_key")) & (F.col("node") > F.col("_node")) & simhash._near(12, 6)).collect())
    keys = {}
    for r in simhash._keys(df, 12).collect():
        keys.setdefault(r["node"], set()).add(r["key"])
    want, most = [], int(72 * 0.16 + 2.5 * math.sqrt(72 * 0.16 * 0.84))
    for a in rows:
        for b in rows:
            far = sum((x ^ y).bit_count() for x, y in zip(a[1], b[1]))
            if a[0] > b[0] and far <= most and keys[a[0]] & keys[b[0]]:
                want.append((min(keys[a[0]] & keys[b[0]], key=lambda k: k >> 12), a[0], b[0]))
    assert got == sorted(want) and len(want) > 50


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(9001, None), (9002, ""), (9002, ""), (None, docs[0]["text"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    fp = [plain_fingerprint(t) for _, t in rows]
    group = plain_components(set(fp))
    least = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    want = sorted((str(i), f, least[group[f]]) for (i, _), f in zip(rows, fp))
    got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(df).collect())
    assert got == want
    sets = [shingle_set(t) for _, t in rows]
    least = least_of_components([(len(a), a) for a in sets], lambda a, b: jaccard(a[1], b[1]) >= 0.8, [i for i, _ in rows])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least)
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.simhash_components(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert simhash.keep_one(nulls).count() == 1


def test_near_copies_go_and_clean_documents_stay(spark):
    """Copies with a few words changed, in a dense group and in pairs; similarity 0.85 and more over five-word shingles."""
    rng = random.Random(11)
    texts = {i: words(rng, 220).split() for i in range(60)}
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    near = 1000
    for i in range(30):
        for _ in range(40 if i == 0 else 2):
            w = list(texts[i])
            for at in rng.sample(range(len(w)), 2):
                w[at] = "changed" + str(rng.randrange(10**6))
            rows.append((near, " ".join(w)))
            near += 1
    out = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(texts) <= out and len(out - set(texts)) <= 3


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_cuts_follow_the_recurrence():
    rng = random.Random(1)
    raw = words(rng, 700).encode()
    h, x = [], 0
    for b in raw:
        x = (4 * x + int(substring.GEAR[b])) % (1 << 32)
        h.append(x)
    r = substring.REACH
    assert substring.rolling(np.frombuffer(raw, np.uint8)).tolist() == h
    at = [i + 1 for i in range(r, len(raw) - r) if h[i] < min(h[i - r : i]) and h[i] <= min(h[i + 1 : i + r + 1])]
    spaces = [i + 1 for i, b in enumerate(raw) if b == 32]
    want = sorted({next((s for s in spaces if a <= s <= a + 2 * r), a) for a in at} | {len(raw)})
    assert substring.cuts(np.frombuffer(raw, np.uint8)).tolist() == want
    for t in ("", "a", "é" * 5000, "x" * 3000, "漢字 " * 400):
        b = t.encode()
        ends = substring.cuts(np.frombuffer(b, np.uint8)).tolist()
        assert ends == sorted(set(ends)) and (ends[-1:] == [len(b)] if b else ends == [])
        assert "".join(b[x:y].decode() for x, y in zip([0, *ends], ends)) == t


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(3)
    passages = [words(rng, 52) for _ in range(30)]
    rows = [(i, words(rng, rng.randint(20, 200))) for i in range(100)]
    for k, p in enumerate(passages):
        rows.append((1000 + 2 * k, f"{words(rng, 40)} {p}\n{words(rng, 11)}"))
        rows.append((1001 + 2 * k, f"{words(rng, 7)}\n{p} {words(rng, 60)}"))
    rows += [(5000, None), (5001, ""), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(1))
    found = substring.repeated_spans(df).collect()
    pairs = {(r["doc_id"], r["kept_in"]) for r in found}
    assert pairs == {(1001 + 2 * k, 1000 + 2 * k) for k in range(30)} | {(None, 0)}
    texts = dict(rows[:-2])
    for r in found:
        if r["doc_id"] is not None:
            cut = texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["bytes"]].decode()
            assert cut in texts[r["kept_in"]]
    left = substring.without_repeats(df)
    assert left.columns == df.columns
    out = {r["doc_id"]: r["text"] for r in left.collect()}
    assert None not in out and out[5000] is None and out[5001] == "" and all(out[i] == t for i, t in rows[:100]) and left.where("doc_id = 0").count() == 2
    assert substring.without_repeats(df.limit(0)).count() == 0


def test_repeats_inside_a_document(spark):
    rng = random.Random(8)
    passage, other = words(rng, 60), words(rng, 60)
    rows = [(1, f"{words(rng, 20)} {passage}\n{words(rng, 30)}\n{passage} {words(rng, 20)}"), (2, f"{words(rng, 9)}\n{other}\n{other}"), (3, f"{words(rng, 30)}\n{passage}\n{words(rng, 5)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    across = {(r["doc_id"], r["kept_in"]) for r in substring.repeated_spans(df).collect()}
    every = {(r["doc_id"], r["kept_in"]) for r in substring.repeated_spans(df, within=True).collect()}
    assert across == {(3, 1)} and every == {(1, 1), (2, 2), (3, 1)}
    left = {r["doc_id"]: r["text"] for r in substring.without_repeats(df, within=True).collect()}
    middle = " ".join(passage.split()[15:45])
    assert left[1].count(middle) == 1 and left[2].count(" ".join(other.split()[15:45])) == 1 and middle not in left[3]


def brute(ids, x, k, queries):
    out = {}
    for i in np.flatnonzero(queries):
        score = np.cumsum(x * x[i], axis=1)[:, -1]
        rest = ids != ids[i]
        order = np.lexsort((ids[rest], -score[rest]))[:k]
        out[int(ids[i])] = list(zip(ids[rest][order].tolist(), score[rest][order].tolist()))
    return out


def test_nearest_recall_and_exact_scores(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = t.orderBy("vec_id").toPandas()
    want = brute(p.vec_id.to_numpy(), np.stack(p.embedding).astype(float), 20, p.vec_id.to_numpy() % 20 == 0)
    got = {}
    for r in ann.nearest(t, F.col("id") % 20 == 0, candidate_block=300, query_block=32, rerank=60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = {q: dict(brute(p.vec_id.to_numpy(), np.stack(p.embedding).astype(float), 10**6, p.vec_id.to_numpy() == q)[q]) for q in list(want)[:5]}
    assert all(exact[q][a] == s for q in exact for a, s in got[q])


def test_nearest_with_copies_ties_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0]), (101, [2.0, 0.0]), (102, None), (103, []), (104, [0.0, 0.0]), (105, [float("nan"), 1.0]), (106, [1.0]), (107, [float("inf"), 0.0]), (108, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(0))
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("id") == 5, k=4).orderBy("rank").collect()]
    assert got == [(1, 101, 2.0), (2, 0, 1.0), (3, 1, 1.0), (4, 2, 1.0)]
    assert ann.nearest(df, F.col("id") == 100, k=60).count() == 41
    assert ann.nearest(df.limit(0), F.col("id") == 1).count() == 0 and ann.nearest(df, F.col("id") == 9999).count() == 0


def test_ties_of_different_vectors(spark):
    """300 different vectors at the same inner product, whatever is measured exactly: the smallest ids win."""
    rows = [(7 * i % 300, [1.0, float(i), float(i * i % 11)]) for i in range(300)] + [(1000, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for rerank, block in ((400, 8192), (400, 50), (60, 8192)):
        got = [r["vec_id"] for r in ann.nearest(df, F.col("id") == 1000, rerank=rerank, candidate_block=block).orderBy("rank").collect()]
        assert len(got) == 20 and (rerank < 300 or got == list(range(20)))
    assert ann._best(np.array([1.0, 3.0, 1.0, 1.0, 2.0]), np.array([9, 8, 2, 5, 1]), 3).tolist() == [1, 4, 2]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_nearest_recall_of_the_codes(spark, size):
    """So few measured exactly that the codes decide: a twentieth of a block."""
    t = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    p = t.orderBy("vec_id").toPandas()
    want = brute(p.vec_id.to_numpy(), np.stack(p.embedding).astype(float), 20, p.vec_id.to_numpy() % 20 == 0)
    got = {}
    for r in ann.nearest(t, F.col("id") % 20 == 0, rerank=max(60, len(p) // 20)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & {a for a, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_keep_one_has_all_pairs_of_the_similarity_and_no_others(spark):
    """At the production settings, against all pairs: similarities around 0.8, a dense group, chains."""
    rng = random.Random(21)
    rows = []
    for i in range(90):
        base = words(rng, rng.choice([30, 120, 300])).split()
        rows.append(" ".join(base))
        for _ in range(25 if i == 0 else 2):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randint(1, 1 + len(w) // 25)):
                w[at] = f"changed{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rng.shuffle(rows)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    between = []
    for i, a in enumerate(sets):
        for j in range(i):
            s = len(a & sets[j]) / len(a | sets[j])
            between.append(s)
            if s >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert sum(0.8 <= s < 0.85 for s in between) > 15 and sum(0.7 <= s < 0.8 for s in between) > 15
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [i for i in range(len(rows)) if find(i) == i]


def test_simhash_and_components_broadcast_nothing(spark, monkeypatch):
    """A file of fewer than 10 MB may be many rows: a broadcast of classes or nodes fills the driver."""
    from vellumite.llm import _common

    plans, write = [], _common.written_at

    def watched(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, path)

    monkeypatch.setattr(_common, "written_at", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    docs = spark.createDataFrame([(i, f"a b c d e {i % 7} g h i") for i in range(60)], "doc_id long, text string")
    for crowd in (4096, 2):
        out = simhash.simhash_components(docs, crowd=crowd)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        assert out.count() == 60
    assert len(plans) > 20 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_sample_of_codebooks_is_cut_before_it_is_sorted(spark, monkeypatch):
    """Each task sent its whole share of the sample to the driver: 503 MB from 56 tasks."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(self):
        raise AssertionError("rows of every task go to the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    rng = np.random.default_rng(3)
    for ids in (range(3000), [i % 40 for i in range(3000)]):  # the second: few ids, and fewer below any hash than rows
        df = spark.createDataFrame([(i, v) for i, v in zip(ids, rng.normal(size=(3000, 4)).tolist())], "id long, v array<double>").repartition(5)
        hashed = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).distinct().collect()}
        owner = {tuple(r["v"]): r["id"] for r in df.collect()}
        got = [owner[tuple(v)] for v in ann._sample(df, 3000, 100).tolist()]
        assert got == sorted(ids, key=lambda i: hashed[i])[:100]
    assert len(ann._sample(df.limit(30), 30, 100)) == 30
    assert ann.nearest(df.withColumnsRenamed({"id": "vec_id", "v": "embedding"}), F.col("id") == 7, k=3).count() == 3


def test_copies_of_a_text_that_are_not_near_each_other_leave_no_pairs(spark, monkeypatch):
    """60 copies at similarity 0.84 to their text, 60 at 0.77: those two kinds are at 0.65, which their bits alone do not tell from 0.8."""
    rng = random.Random(5)
    text = [f"w{i}" for i in range(120)]

    def copy(edits):
        out = list(text)
        for k, at in enumerate(rng.sample(range(6, 114, 6), edits)):
            out[at] = f"x{rng.random()}-{k}"
        return " ".join(out)

    rows = [" ".join(text), *(copy(2) for _ in range(60)), *(copy(3) for _ in range(60))]
    met, alike = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *more: met.append(pairs.count()) or alike(pairs, *more))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    sets = [shingle_set(t) for t in rows]
    assert kept == set(least_of_components(sets, lambda a, b: jaccard(a, b) >= 0.8, list(range(len(rows)))))
    assert met[-1] < 60


def test_parity_maps_differ_in_no_more_bits_than_the_sets(spark):
    rng = np.random.default_rng(2)
    for size in (0, 1, 100, 250, 260, 3000, 9000):
        whole = rng.integers(0, 1 << 32, size, dtype=np.uint32)
        for lost in (0, size // 20, size // 8):
            a, b = np.unique(whole[lost:]), np.unique(np.append(whole[: size - lost // 2], rng.integers(0, 1 << 32, lost, dtype=np.uint32)))
            rows = [(1, [], a.tobytes()), (2, [], b.tobytes())]
            one, two = simhash._mapped(spark.createDataFrame(rows, "node long, parts array<int>, shingles binary").coalesce(1)).orderBy("node").collect()
            df = spark.createDataFrame([(one["size"], one["map"], two["size"], two["map"])], "size int, map array<long>, _size int, _map array<long>")
            both = len(np.intersect1d(a, b))
            near = both >= 0.8 * (len(a) + len(b) - both)
            assert (one["size"], two["size"]) == (len(a), len(b))
            assert df.select(simhash._may_reach(0.8)).first()[0] or not near


def test_blocks_of_queries_are_not_copied_to_the_driver(spark):
    """The queries, once for each block of candidates, were broadcast where little was read of them: 1.2 GB at 615,384 vectors."""
    rng = np.random.default_rng(4)
    p = rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p.tolist())], "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("id") % 20 == 0, k=5, candidate_block=100, query_block=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    got: dict = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [int(i) for i in np.argsort(-(p @ p[q]), kind="stable") if i != q][:5] for q in range(0, 900, 20)}


def test_best_of_several_blocks():
    part = lambda *rows: tuple(np.array(c) for c in zip(*rows))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    got = ann.k_best([part((2, 9, 1.0), (1, 4, 0.5), (2, 7, 0.0)), none, part((2, 3, 1.0), (1, 8, 2.0), (1, 2, 0.5))], 2)
    assert [x.tolist() for x in got] == [[1, 1, 2, 2], [8, 2, 3, 9], [2.0, 0.5, 1.0, 1.0]]
    assert [x.tolist() for x in ann.k_best([none], 2)] == [[], [], []]
