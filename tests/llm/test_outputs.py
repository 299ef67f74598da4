"""Tokens, token files, packing, mixing, and the whole pipeline against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumite.llm import mixing, packing, token_files
from vellumite.llm.tokens import Encoder

ODD = [None, "", " ", "\n", "a", "\n\n", "a\n", " a", "a  b", "don't I'll", "x\ty", "<|endoftext|>", "é漢😀", "word, word.", "Straße!!", "ª²|", "x" * 400, "a b", "ń", "Ġ", "ﬀ"]


class Library:
    """The library as it comes: nothing is set on it."""

    def __init__(self, path):
        self.tokenizer = Tokenizer.from_file(path)

    def whole(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_library(tokenizer):
    e, plain, rng = Encoder(tokenizer, most=400), Library(tokenizer), random.Random(4)
    bits = [x for x in ODD if x]
    texts = ODD + [rng.choice(["", " ", "\n"]).join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(1500)]
    ids, starts = e.encode(pa.array(texts).slice(3))
    for t, a, b in zip(texts[3:], starts, starts[1:]):
        assert ids[a:b].tolist() == plain.whole(t or ""), repr(t)
    assert e.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_strings_of_special_tokens(tokenizer):
    """At the start, the middle and the end, with and without white space around, in words and in long texts."""
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"{end} a", f"a {end}", f"a{end}b", f"a  {end}\n{end}\n\nb", f"a\n{end}", f"{end}{end}", "<|endof text|>", f"x\t{end} y", f"word {end} " * 3000]
    e, plain = Encoder(tokenizer), Library(tokenizer)
    ids, starts = e.encode(pa.array(texts))
    for t, a, b in zip(texts, starts, starts[1:]):
        assert ids[a:b].tolist() == plain.whole(t), t[:40]
    assert 50256 in ids.tolist() and e.encode(pa.array([f"a {end} b"]))[0].tolist() == [64, 220, 50256, 275]
    assert 50256 not in Encoder(tokenizer, special_as_text=True).encode(pa.array(texts))[0].tolist()


def test_other_tokenizer_files_are_encoded_whole(tokenizer):
    path = tokenizer.replace("byte_bpe_50k", "word_bpe_49k")
    e, plain = Encoder(path), Library(path)
    assert not e.plain
    ids, starts = e.encode(pa.array(ODD))
    for t, a, b in zip(ODD, starts, starts[1:]):
        assert ids[a:b].tolist() == plain.whole(t or "")


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("high", [1, 2, 50_257, 70_000, 1 << 32])
def test_blocks_round_trip(n, high):
    rng = np.random.default_rng(n)
    x = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    if n > 10:
        x[rng.integers(0, n, n // 12)] = high - 1
    file = token_files.TokenFile(token_files.file_bytes([5, None], np.array([n // 3, n - n // 3]), x))
    assert file.ids(0, n).tolist() == x.tolist() and file.null.tolist() == [False, True]
    for a, b in ((0, 0), (n // 3, n), (n // 2, min(n, n // 2 + 3))):
        assert file.ids(a, b).tolist() == x[a:b].tolist()


def test_outliers_do_not_widen_a_block():
    x = np.arange(128, dtype=np.uint32) % 8
    plain = len(token_files.encode_blocks(x)[0])
    x[[3, 77]] = 50_000
    assert len(token_files.encode_blocks(x)[0]) == plain + 2 * 5


def test_token_files(spark, tokenizer, tmp_path):
    rows = list(enumerate(ODD, 10)) + [(3, "again"), (3, "again"), (None, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    e = Library(tokenizer)
    path = f"file://{tmp_path}/tokens"
    got = token_files.token_files(df.repartition(3), tokenizer, path, with_ids=True).orderBy("start").collect()
    want = {i: e.whole(t or "") + [2] for i, t in rows}
    at = 0
    assert [r["doc_id"] for r in got] == [3, 3, *range(10, 10 + len(ODD)), None]
    for r in got:
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_files(df.limit(0), tokenizer).count() == 0


def test_token_files_roll(spark, tokenizer, monkeypatch):
    """Files end after so many ids; starts go on over files and tasks; a very long text is in one file."""
    texts = [f"{w} " * n for w, n in (("one", 300), ("two", 5), ("three", 20_000), ("four", 700), ("five", 0))] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    made = []
    write = token_files.write_token_files
    monkeypatch.setattr(token_files, "write_token_files", lambda *a: made.extend(write(*a)) or made)
    got = token_files.token_files(df, tokenizer).orderBy("doc_id").collect()
    assert len(made) > len({m[0].split("-")[1] for m in made}) and sum(m[1] for m in made) == len(texts)
    plain, at = Library(tokenizer), 0
    size = {t: len(plain.whole(t)) + 1 for t in set(texts)}
    for r, t in zip(got, texts):
        assert (r["start"], r["n_tokens"]) == (at, size[t])
        at += size[t]


def check_plan(histogram, capacity=2048):
    runs = packing.plan_runs(dict(histogram), capacity)
    got, numbers, sequences = Counter(), defaultdict(list), defaultdict(list)
    for n, first, count, sequence, at in runs:
        got[n] += count
        numbers[n].append((first, count))
        for k in range(count):
            sequences[sequence + k].append((at, n))
    assert got == Counter({n: c for n, c in histogram.items() if c})
    for runs_ in numbers.values():
        at = 0
        for first, count in sorted(runs_):
            assert first == at
            at += count
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences), -(-sum(n * c for n, c in histogram.items()) // capacity)


def test_plans():
    rng = random.Random(9)
    for size, tolerance in ((1, 1.0), (50, 1.1), (1000, 1.02), (30_000, 1.005)):
        h = Counter(min(2048, max(1, int(rng.lognormvariate(6.4, 1)))) for _ in range(size))
        used, bound = check_plan(h)
        assert used <= max(bound * tolerance, bound + 1)
    assert check_plan(Counter({2048: 7})) == (7, 7) and check_plan(Counter()) == (0, 0)
    assert check_plan(Counter({1024: 9}))[0] == 5 and check_plan(Counter({1: 5000}))[0] == 3
    assert check_plan(Counter({1200: 40, 800: 40}))[0] == 40  # pairs found by the configurations
    assert check_plan(Counter({683: 300, 682: 300, 10: 5}))[0] <= 240


def test_packing(spark, tokenizer):
    long = "word " * 5000
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, long), (50, long), (None, "x y"), (51, "same"), (51, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    e = Library(tokenizer)
    got = packing.pack(df, tokenizer, 0, 64).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for held in by_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 64
    for i, text in rows:
        ids = e.whole(text or "") + [0]
        times = sum(j == i for j, _ in rows)
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]})
        assert len(by_doc[i]) == times * len(own) and sum(x[2] for x in own) == len(ids)
        assert [x[0] for x in own] == list(range(-(-len(ids) // 64))) and all(x[2] == 64 for x in own[1:])
        for _, start, n, crc in own:
            assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
    assert packing.pack(df.limit(0), tokenizer).count() == 0


def plain_targets(sizes, weights, share):
    left, free, out = share * sum(sizes.values()), dict(weights), {}
    while free:
        offer = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in offer if offer[s] > 2 * sizes[s]]
        if not over:
            return out | offer
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            del free[s]
    return out


def test_points():
    assert mixing._PHI % 2 == 1


def test_points_are_exact(spark):
    big = [0, 1, 2, 12_345_678_901, (1 << 40) - 1]
    got = spark.createDataFrame([(i,) for i in big], "i long").select("i", mixing.point(F.col("i")).alias("p")).collect()
    assert all(r["p"] == r["i"] * mixing._PHI % (1 << 40) for r in got)


def test_schedule_is_even(spark):
    quotas = {"a": 600, None: 300, "c": 100, "d": 0}
    slots = mixing.schedule(spark, quotas, {"a": 6.0, None: 3.0, "c": 1.0, "d": 0.0}).orderBy("slot", "source").collect()
    assert Counter(r["source"] for r in slots) == Counter({"a": 600, None: 300, "c": 100})
    seen = Counter()
    for r in slots:
        assert r["rank"] == seen[r["source"]]
        seen[r["source"]] += 1
        if r["slot"] % 100 == 99 and r["slot"] < 1000:
            assert abs(seen["a"] - 0.6 * (r["slot"] + 1)) < 4  # close to its share in every prefix


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).collect()
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    own, by_source, taken = {}, Counter(), Counter()
    for r in got:
        own[r["doc_id"]] = r["size"]
        by_source[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert own == sizes
    names = sorted(by_source)
    want = plain_targets(by_source, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == by_source[r["source"]]
    assert all(abs(taken[s] - want[s]) <= mixing.BLOCK_WORDS for s in names)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    drawn = mixing.mixed_documents(docs)
    assert drawn.columns == docs.columns
    back = Counter()
    for r in drawn.collect():
        back[r["doc_id"]] += len(r["text"].split())
    assert back == Counter({r["doc_id"]: r["taken"] for r in got if r["taken"]})


def test_mix_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c", None), (1, "a b c", None), (None, None, "x"), (3, "", ""), (4, "a " * 1000, "b")], "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["source"] or "", r["size"], r["taken"]) for r in mixing.mix(df).collect())
    assert [g[:3] for g in got] == [("1", "", 3), ("1", "", 3), ("3", "", 0), ("4", "b", 1000), ("None", "x", 0)]
    assert got[0][3] == got[1][3] == 6 and abs(got[3][3] - 1497) < 130
    assert mixing.mixed_documents(df).count() >= 5
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_small_sources_come_near_their_targets(spark):
    """Five sources of 120 words in documents of 1 to 7 words, and one of three words; the numbers of a plain version."""
    rng, rows = random.Random(3), []
    for s in "abcde":
        left = 120
        while left:
            n = min(left, rng.randint(1, 7))
            rows.append((len(rows), "w " * n, s))
            left -= n
    rows.append((len(rows), "x y z", "f"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, by_source = mixing.mix(df).collect(), Counter()
    for r in got:
        by_source[r["source"]] += r["taken"]
    want = plain_targets({**dict.fromkeys("abcde", 120), "f": 3}, dict(zip("abcdef", (5, 2, 1, 5, 2, 1))), 1.5)
    assert all(abs(by_source[s] - want[s]) <= 2 for s in want) and all(r["target"] == pytest.approx(want[r["source"]]) for r in got)


def test_many_sources(spark):
    """More sources than the places of points are compared with one by one."""
    rows = [(i, "w " * (40 + i % 9), f"s{i % 150:03d}") for i in range(900)]
    got, taken, size = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect(), Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
    want = plain_targets(size, {f"s{i:03d}": (5, 2, 1)[i % 3] for i in range(150)}, 1.5)
    assert all(abs(taken[s] - want[s]) <= 0.02 * size[s] for s in want)


def test_pipeline_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, an extra column whose name clashes, a very long text."""
    import corpus_pipeline

    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one = text(40)
    rows = [(1, one, "en", "a", 1, "x"), (1, one, "en", "a", 1, "x"), (None, text(50), None, None, None, None), (2, None, None, None, None, None), (3, "", "en", "a", 0, None), (4, text(30_000), "de", "b", 5, "y"), (5, text(60), None, "b", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {1, None, 4, 5} and {4, 5} <= {r["doc_id"] for r in got}


def test_pipeline_against_plain_python(spark, tokenizer, tmp_path):
    """Every stage's decisions on a small corpus: what goes, what stays, what is cut, what is packed."""
    import corpus_pipeline

    from tests.llm.test_dedup import words
    from tests.llm.test_filters import counts

    rng = random.Random(8)
    clean = [(i, words(rng, rng.randint(30, 200)), "en", f"s{i % 4}") for i in range(60)]
    passage = words(rng, 60)
    shared = [(100 + i, f"{words(rng, 50)} {passage} {words(rng, 40)}", "en", "s1") for i in range(3)]
    copies = [(200, clean[0][1], "en", "s2"), (201, clean[0][1].upper(), "en", "s2"), (202, clean[5][1], None, None)]
    junk = [(300, "too short", "en", "s0"), (301, "a b c d e " * 40, "en", "s0"), (302, None, "en", "s0"), (303, "", None, "s3")]
    rows = [(*r, len(r[1] or "")) for r in clean + shared + copies + junk]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(sorted(tuple(r) for r in docs.collect()) if k != 1 and k != 0 else docs.collect())
    passed = {r[0]: r[1] for r in rows if not counts(r[1])[5]}  # sixty labels certify no cutoff
    assert {r["doc_id"] for r in kept[0]} == set(passed)
    least = {}
    for i, t in sorted(passed.items()):
        least.setdefault(t.lower(), i)  # copies differ by case at most; no others are near each other
    assert {r["doc_id"] for r in kept[1]} == set(least.values()) and not {200, 201, 202} & set(least.values())
    after = {r[0]: r[1] for r in kept[2]}
    assert set(after) == set(least.values())
    assert all(after[i] == passed[i] for i in after if i not in (101, 102)) and after[100] == passed[100]
    assert all(len(after[i]) < len(passed[i]) - 100 for i in (101, 102))
    drawn = Counter()
    for r in kept[3]:
        drawn[r[0]] += len(r[1].split())
    assert all(drawn[i] <= 2 * len(t.split()) for i, t in after.items()) and sum(drawn.values()) == pytest.approx(1.5 * sum(len(t.split()) for t in after.values()), rel=0.1)
    e = Library(tokenizer)
    tokens = sum(len(e.whole(r[1])) + 1 for r in kept[3])
    for got in (corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect(), corpus_pipeline.run(spark, folder).collect()):
        assert sum(r["length"] for r in got) == tokens
        full = Counter()
        for r in got:
            full[r["sequence_id"]] += r["length"]
        assert max(full.values()) <= 2048


def test_words_of_letters_are_learned_together(monkeypatch):
    """Latin words with their marks go past the way of single words; the ids are the library's."""
    import public_tokenizers
    import pyarrow as pa
    from vellumite.llm.tokens import Encoder

    enc, single = Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    one = enc._ids
    monkeypatch.setattr(enc, "_ids", lambda word: single.append(word) or one(word))
    texts = ["Größe, naïve café; ǅ ƻ ª words words. words?! x2 can't 日本 ɐ\nnext line", "words. Größe!? ...", "", "a  b", "ÿ. Ā ɏ, 1 <|endoftext|> end."]
    for _ in range(2):
        ids, starts = enc.encode(pa.array([*texts, None]))
        got = [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
        assert got == [*map(enc.whole, texts), []]
    assert single and not [w for w in single if w[0] != "\n" and w.rstrip(".,!?;:").isalpha() and max(w) < "ɐ"]
