import pytest
from pyspark.sql import functions as F

from vellumite import model
from vellumite.engine import Engine, Options, PageLayout, editor_profile
from vellumite.sources import docx, html


def test_layouts():
    a4 = PageLayout.paper("A4")
    assert (a4.width, a4.height, a4.content_width, a4.landscape) == (11906, 16838, 9026, False)
    assert PageLayout.paper("letter", True).width == 15840 and PageLayout.paper("a4", left=10, right=10).left == 567
    for bad in (lambda: PageLayout.paper("A4", left=200), lambda: PageLayout.paper("B9"), lambda: PageLayout(0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_options():
    e = Engine().with_(editor="CK", links=False)
    assert e.options.editor == "ckeditor" and e.options.switched_off() == {"links"} and Engine().options.switched_off() == set()
    assert Engine.for_editor("tiny").options.editor == "tinymce" and Engine.plain() == Engine()
    with pytest.raises(ValueError):
        editor_profile("word")
    for bad in ({"base_size_pt": 0}, {"base_color": "nonsense"}, {"most_entry_bytes": 0}):
        with pytest.raises(ValueError):
            Options(**bad)


PAGE = "<title>T</title><h1 id=t>Hi <b>there</b></h1><p>a <b>b</b> <a href='http://x/'>c</a><a href='#t'>d</a></p><ul><li>i<ol><li>j</ol></ul><table><tr><td rowspan=2>q<td>r<tr><td>s</table>"


def pages(spark, *sources):
    return spark.createDataFrame(list(enumerate(sources, 1)), "doc_id long, html string")


def test_round_trips(spark):
    e = Engine.plain()
    models = e.read_html(pages(spark, PAGE, None, "")).cache()
    once = e.write_html(models)
    assert {r["doc_id"]: r["error"] for r in once.collect()} == {1: None, 2: None, 3: None}
    again = e.write_html(e.read_html(once))
    assert sorted(map(tuple, once.select("doc_id", "html").collect())) == sorted(map(tuple, again.select("doc_id", "html").collect()))
    packages = e.write_docx(models)
    assert packages.first()["docx"] == e.write_docx(models).first()["docx"]
    back = e.read_docx(packages)
    texts = lambda m: sorted((r["doc_id"], r["place"], r["place_id"], r["ord"], r["text"]) for r in model.texts(m).collect())
    assert texts(back) == texts(models) and any(t[1] == "cell" for t in texts(back))
    assert back.where("doc_id = 1").first()["meta"]["title"] == "T"
    numbered = model.texts(back).where("num_id is not null").orderBy("ord").collect()
    assert [(r["text"], r["level"]) for r in numbered] == [("i", 0), ("j", 1)]
    links = model.table(back, "inlines").where("url is not null or anchor is not null").select("text", "url", "anchor").collect()
    assert [tuple(r) for r in links] == [("c", "http://x/", None), ("d", None, "_t")]


def test_docx_texts(spark):
    """One kernel gives what the three verbs give; failures are rows, and columns go along."""
    e = Engine.plain()
    given = pages(spark, PAGE, None, "", "<pre>a\n b\tc</pre><img src=x alt=y><ol start=3><li value=9>i", "<p>" + "<b>" * 5000 + "deep").withColumn("own", F.col("doc_id") * 2)
    m = e.read_docx(e.write_docx(e.read_html(given)))
    joined = F.array_join(F.transform("blocks", lambda b: model.inline_text(F.coalesce(b["inlines"], F.array().cast(f"array<{model.INLINE}>")))), "\n")
    verbs = {r["doc_id"]: (r["after"], r["error"] is None) for r in m.select("doc_id", joined.alias("after"), "error").collect()}
    got = e.docx_texts(given, keep=("own",))
    assert got.columns == ["doc_id", "own", "after", "error"]
    rows = got.collect()
    assert {r["doc_id"]: (r["after"], r["error"] is None) for r in rows} == verbs and all(r["own"] == 2 * r["doc_id"] for r in rows)
    assert [r["error"]["kind"] for r in rows if r["error"]] == ["too_deep"] and "Hi there" in verbs[1][0]
    with pytest.raises(ValueError):
        e.with_(links=False).docx_texts(given)


def test_feature_switches(spark):
    def kept(**off):
        m = Engine.plain().with_(**off).read_html(pages(spark, PAGE))
        return [r["text"] for r in model.texts(m).where("place = 'body'").orderBy("ord").collect()]

    assert kept() == ["Hi there", "a b cd", "i", "j", ""]
    assert kept(links=False) == ["Hi there", "a b ", "i", "j", ""]
    assert kept(lists=False) == ["Hi there", "a b cd", ""]
    off = Engine.plain().with_(tables=False).read_html(pages(spark, PAGE)).first()
    assert off["tables"] == [] and not [b for b in off["blocks"] if b["place"] == "cell" or b["kind"] == "table"]


def test_options_reach_the_output(spark):
    e = Engine.plain().with_(title="Own", author="A", language="de", created="2020-02-02T02:02:02Z", base_font="Arial", base_size_pt=10.0, page=PageLayout.paper("letter", True), full_page=True, id_prefix="x-")
    m = e.read_html(pages(spark, PAGE))
    row = m.first()
    assert row["meta"].asDict() == {"title": "Own", "author": "A", "language": "de", "created": "2020-02-02T02:02:02Z"} and row["layout"]["width"] == 15840
    assert row["default_run"]["family"] == "Arial" and row["default_run"]["size"] == 20
    made = e.write_html(m).first()["html"]
    assert made.startswith('<!DOCTYPE html>\n<html lang="de">') and "<title>Own</title>" in made and 'id="x-t"' in made and 'href="#x-t"' in made
    back = Engine.plain().read_docx(e.write_docx(m)).first()
    assert back["meta"]["created"] == "2020-02-02T02:02:02Z" and back["meta"]["author"] == "A" and back["layout"]["width"] == 15840
    tight = Engine.plain().with_(most_entry_bytes=50).read_docx(e.write_docx(m)).first()
    assert tight["error"]["kind"] == "too_large"


def test_failures_are_rows(spark):
    packages = spark.createDataFrame([(1, b"no zip"), (2, None)], "doc_id long, docx binary")
    models = Engine.plain().read_docx(packages)
    assert {r["doc_id"]: r["error"]["kind"] for r in models.collect()} == {1: "malformed", 2: "malformed"}
    assert all(r["error"] and r["html"] is None for r in Engine.plain().write_html(models).collect())
    deep = Engine.plain().read_html(pages(spark, "<div>" * 5000 + "x", "<p>ok"))
    assert {r["doc_id"]: r["error"] and r["error"]["kind"] for r in deep.collect()} == {1: "too_deep", 2: None}


def test_a_failure_stays_one(spark):
    """What failed on the way to HTML was read again as an empty document."""
    e = Engine.plain()
    html = e.write_html(e.read_html(pages(spark, "<div>" * 5000 + "x", "<p>ok", None)))
    rows = {r["doc_id"]: r for r in e.read_html(html).collect()}
    assert rows[1]["error"]["kind"] == "too_deep" and rows[1]["blocks"] is None
    assert not rows[2]["error"] and len(rows[2]["blocks"]) == 1 and not rows[3]["error"] and len(rows[3]["blocks"]) == 1
    other = pages(spark, "<p>ok").withColumn("error", F.lit("of its own"))
    assert e.read_html(other).first()["error"] is None
    deep = Engine.plain().with_(any_depth=True)
    again = deep.read_html(deep.write_html(deep.read_html(pages(spark, "<p>a" + "<div>" * 5000 + "x", "<b>" * 2000 + "y", "<table><tr><td>" * 250 + "z"))))
    assert {(r["doc_id"], r["text"]) for r in model.texts(again).where("text <> ''").collect()} == {(1, "a"), (1, "x"), (2, "y"), (3, "z")}


def test_model_html_again_query(spark, tmp_path):
    """A deep page has the paragraphs that it has in SQL; one that fails still is told."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from vellumite.plans.model_queries import _sound

    rows = [(1, "<html><body><article><p>one</p>" + "<div>" * 600 + "<p>deep</p>" + "</div>" * 600 + "<p>two</p></article></body></html>"), (2, "<html><body><article><p>other</p></article></body></html>")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries()["model_html_again"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.sql(oracle_sql()["model_html_again"]).fetchall()) and [r[2] for r in got] == ["one", "deep", "two", "other"]
    with pytest.raises(Exception, match="page 1: too_deep"):
        _sound(Engine.plain().read_html(pages(spark, "<div>" * 5000 + "x"))).collect()


def test_files(spark, tmp_path):
    e = Engine.plain()
    m = e.read_html(pages(spark, PAGE, "<p>two"))
    saved = e.save(e.write_docx(m), f"file://{tmp_path}/out").collect()
    assert sorted(r["file"] for r in saved) == ["1.docx", "2.docx"] and all(r["error"] is None for r in saved)
    back = e.read_docx(docx.read_docx_files(spark, f"{tmp_path}/out"))
    assert back.count() == 2 and back.where("error is not null").count() == 0
    e.save(e.write_html(m), f"file://{tmp_path}/html").collect()
    assert e.read_html(html.read_html_files(spark, f"{tmp_path}/html")).count() == 2


def test_pictures_by_folder_and_handler(spark, tmp_path):
    gif = b"GIF89a\x04\x00\x02\x00" + b"\0" * 20
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gif").write_bytes(gif)
    (tmp_path / "secret.gif").write_bytes(gif)
    e = Engine.plain().with_images(folder=str(tmp_path / "in"), handler=lambda image, words: f"cid:{image['kind']}-{words}")
    m = e.read_html(pages(spark, "<p><img src='a.gif' alt=x width=8><img src='../secret.gif' alt=no><img src='http://h/a.gif' alt=far></p>"))
    assert [tuple(r) for r in model.table(m, "media").select("kind", "width", "height").collect()] == [("gif", 4, 2)]
    out = e.write_html(m).first()["html"]
    assert 'src="cid:gif-x"' in out and "width: 8px; height: 4px;" in out and "nofar" in out
    back = e.read_docx(e.write_docx(m))
    assert bytes(model.table(back, "media").first()["bytes"]) == gif
