"""Documents and events that arrive: the batch plan on every micro-batch, kernels on the stream itself, windows with late rows."""

from pyspark.sql import functions as F

from vellumite import model
from vellumite.engine import Engine
from vellumite.streaming.documents import event_windows, run_on_arrival


def test_batches_of_documents(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    e = Engine.plain()

    def plan(pages):
        return model.texts(e.read_docx(e.write_docx(e.read_html(pages))))

    for k in (1, 2):
        spark.createDataFrame([(10 * k + i, f"<p>{k} {i}</p><ul><li>x</ul>") for i in range(3)], "doc_id long, html string").write.mode("append").parquet(source)
        run_on_arrival(spark, source, "doc_id long, html string", plan, out, f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 12 and {r["batch"] for r in got.select("batch").distinct().collect()} == {0, 1}
    assert sorted(r["text"] for r in got.where("num_id is null").collect()) == ["1 0", "1 1", "1 2", "2 0", "2 1", "2 2"]


def test_kernels_run_on_a_stream(spark, tmp_path):
    """Reading and writing keep no state, so they are stream operators as they are."""
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, "<p>a<b>b</b></p>"), (2, None)], "doc_id long, html string").write.parquet(source)
    e = Engine.plain()
    stream = spark.readStream.schema("doc_id long, html string").parquet(source)
    made = e.write_html(e.read_docx(e.write_docx(e.read_html(stream))))
    made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {r["doc_id"]: r["html"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert "a<strong>b</strong>" in got[1] and len(got) == 2


def test_windows_drop_what_is_too_late(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "ts timestamp, event_type string, value double"
    rows = lambda *x: spark.createDataFrame([(t, "a", 1.0) for t in x], "ts string, event_type string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    stream = lambda: event_windows(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    for batch in (rows("2024-01-01 00:10:00", "2024-01-01 00:50:00", "2024-01-01 02:00:00"), rows("2024-01-01 00:30:00", "2024-01-01 05:00:00")):
        batch.write.mode("append").parquet(source)
        stream()
    got = {str(r["window_start"]): (r["n"], r["total"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["2024-01-01 00:00:00"] == (2, 2.0)  # the row of 00:30 came after the window was closed
    assert event_windows(rows("2024-01-01 00:10:00", "2024-01-01 00:20:00")).first()["n"] == 2
