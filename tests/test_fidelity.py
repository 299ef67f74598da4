"""What survives: words in order, quantiles, page means, markup."""

import random

import pytest
from pyspark.sql import functions as F

from vellumite.operators import fidelity
from vellumite.sources import html


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_words():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        assert fidelity.common_words(a, b) == longest(a, b)
    assert fidelity.common_words(list("xaby"), list("xbay"), most_cells=1) == 2  # equal ends only
    assert fidelity.words(" oﬃce  ﬁt\n") == ["office", "fit"]


def test_common_words_of_long_texts(monkeypatch):
    """Beyond 25 million cells only equal ends counted: 2 of these 8,997 words."""
    a = [str(i) for i in range(9000)]
    b = [*a[:1], "new", *a[2:5000], *a[5001:8998], a[8999], "end", a[8999]]
    assert fidelity.common_words(a, b) == 8997 and fidelity.common_words(b, a) == 8997
    assert fidelity.common_words(a, a[::-1]) == 1 and fidelity.common_words(a, [f"x{i}" for i in range(9000)]) == 0
    monkeypatch.setattr(fidelity, "STRETCH", 5)  # several stretches
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefg"[: rng.randrange(1, 8)]) for _ in range(rng.randrange(40))] for _ in range(2))
        assert fidelity.common_words(a, b) == longest(a, b)


def test_text_fidelity(spark):
    rows = [(1, "a b c d", "a x c d"), (2, "", None), (3, "a", ""), (4, None, "b")]
    got = {r["doc_id"]: (r["kept"], r["share"]) for r in fidelity.text_fidelity(spark.createDataFrame(rows, "id long, a string, b string"), "id", "a", "b").collect()}
    assert got == {1: (3, 0.75), 2: (0, 1.0), 3: (0, 0.0), 4: (0, 0.0)}


def test_text_fidelity_query(spark, tmp_path):
    """Each row of documents has a row of its own, whatever its id and characters, as in SQL; one file is dealt over tasks."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    odd = ["a\fb c", "a\x1cb\x1fc", "\x01 a\x0bb \uffff", "a\rb\r\nc\td\x85e\u2028f", "<p>&amp; &#0; \ufeff\u200b \u00ad", " \n\n", None, "\x0b"]
    rows = [(i, "one two\nthree") for i in range(40)] + [(None, "null id"), (None, "again"), (3, "of a used id"), *((100 + i, x) for i, x in enumerate(odd))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries()["text_fidelity"](spark, str(tmp_path))
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(db.sql(oracle_sql()["text_fidelity"]).fetchall(), key=key)


def test_text_fidelity_query_has_no_limits(spark, tmp_path, monkeypatch):
    """Packages of the query's own making are read whatever their size: beyond an entry's 128 MiB no word was kept."""
    from vellumite.engine import Engine, Options
    from vellumite.plans import model_queries

    monkeypatch.setattr(Engine, "plain", classmethod(lambda cls: cls(Options(most_entry_bytes=50, most_total_bytes=50))))
    spark.createDataFrame([(1, "one two\nthree")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in model_queries.text_fidelity(spark, str(tmp_path)).collect()] == [(1, 3, 3, 1.0)]
    failed = Engine.plain().docx_texts(spark.createDataFrame([(1, "<p>one")], "doc_id long, html string"))
    with pytest.raises(Exception, match="document 1: too_large"):
        model_queries._sound(failed, "document").collect()


def test_quantiles_and_page_means(spark):
    values = [5.0, 1.0, 4.0, 2.0, 3.0]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    got = df.agg(*[fidelity.quantile(F.col("v"), q).alias(f"q{i}") for i, q in enumerate((0.0, 0.5, 0.9, 1.0))]).first()
    assert tuple(got) == tuple(sorted(values)[min(4, int(5 * q))] for q in (0.0, 0.5, 0.9, 1.0))
    pages = spark.createDataFrame([(1, 1, 0.8), (1, 3, 0.9), (2, 1, 1.0)], "doc long, page int, v double")
    expected = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc long, page int")
    means = {r["doc"]: r["mean"] for r in fidelity.page_mean(pages, expected, ["doc", "page"], "v").collect()}
    assert means == {1: pytest.approx(0.8 / 3), 2: 1.0}


def test_markup_survival(spark):
    nodes = lambda source: html.html_nodes(spark.createDataFrame([(1, source)], "page_id long, html string"))
    got = {(r["kind"], r["name"]): (r["before"], r["after"]) for r in fidelity.markup_survival(nodes("<p style='color: red; margin:0'>a<b>c</b>"), nodes("<p class=x>a<i>c</i><i>d</i>")).collect()}
    assert got == {("tag", "p"): (1, 1), ("tag", "b"): (1, 0), ("tag", "i"): (0, 2), ("attribute", "style"): (1, 0), ("attribute", "class"): (0, 1), ("property", "color"): (1, 0), ("property", "margin"): (1, 0)}
