import datetime as dt
import zipfile

from tidemark.operators.embed import diagnostics, embedded
from tidemark.operators.model import rolling_scores
from tidemark.sources.events_xml import is_preliminary, headline_ticker, transcripts, xml_files, zipped_xml_files
from tidemark.sources.stores import read_csv, read_database, text_lookup, unfinished, write_by, write_csv
from tidemark.streaming.versions import event_stream, first_arrivals
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

BODY = "=====\nPresentation\n-----\nOperator\nHello there [1]\n=====\nQuestions and Answers\n-----\nWhy?"


def event(i, kind="1", body=BODY, start="9-Dec-17 1:00am GMT", update="2018", company="c1", extra=""):
    return (
        f'<Event Id="e{i}" eventTypeId="{kind}" lastUpdate="{update}"><EventStory version="Final"><Headline>Edited Transcript of ABC earnings call 8-Dec-17 20:00</Headline>'
        f"<Body><![CDATA[{body}]]></Body></EventStory><companyName> A </companyName><companyId>{company}</companyId><startDate>{start}</startDate>{extra}</Event>"
    )


FILES = {
    "e1_T.xml": event(1), "e2_T.xml": event(2, update="2017"), "e3_T.xml": event(3, kind="2"), "e4_T.xml": event(4, body=" "), "e5_T.xml": "<broken",
    "e6_T.xml": event(6, company="c2", start=""), "e7_T.xml": event(7, company="c3", start="9-Dec-17 1:00pm EST"), "note.xml": event(8),
    "e9_T.xml": event(9, company="c4", start="9-Dec-17 1:00am ET"),
}


def test_xml_files_and_archives_give_the_same_transcripts(spark, tmp_path):
    (tmp_path / "plain/2017").mkdir(parents=True)
    (tmp_path / "packed").mkdir()
    with zipfile.ZipFile(tmp_path / "packed/2017.zip", "w") as archive:
        for name, xml in FILES.items():
            (tmp_path / "plain/2017" / name).write_text(xml)
            archive.writestr(f"2017/{name}", xml)
    plain = {r.event_id: r for r in transcripts(xml_files(spark, str(tmp_path / "plain"))).collect()}
    packed = {r.event_id: r for r in transcripts(zipped_xml_files(spark, str(tmp_path / "packed"))).collect()}
    assert set(plain) == set(packed) == {"e2", "e6", "e7", "e9"}
    e = plain["e2"]
    assert (e.presentation_text, e.qa_text, e.n_words_pres, e.n_words_qa, e.company_name, e.year) == ("Hello there", "Why?", 2, 1, "A", "2017")
    assert (e.call_date, e.is_before_close) == (dt.date(2017, 12, 8), False)
    assert (plain["e6"].call_date, plain["e6"].is_before_close) == (dt.date(2017, 12, 8), None)
    assert (plain["e7"].call_date, plain["e7"].is_before_close) == (dt.date(2017, 12, 9), False)
    # a stamp labelled ET is read as UTC
    assert plain["e9"].call_date == dt.date(2017, 12, 8)


def test_headline_helpers(spark):
    row = spark.range(1).select(headline_ticker(F.lit(""), F.lit("Transcript of XY.N earnings")).alias("t"), is_preliminary(F.lit("Preliminary text"), F.lit("Final")).alias("p")).first()
    assert (row.t, row.p) == ("XY.N", True)


def test_sinks_resume_and_prune(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 2001, "x"), ("b", 2002, None)], "event_id string, year int, text string")
    assert unfinished(df, spark, path, "year").count() == 2
    write_by(df.where("year = 2001"), path, "year")
    assert [r.event_id for r in unfinished(df, spark, path, "year").collect()] == ["b"]
    write_by(df, path, "year")
    write_by(df.where("year = 2002"), path, "year")
    assert spark.read.parquet(path).count() == 2
    found = text_lookup(df.select("event_id", "year"), spark.read.parquet(path)).collect()
    assert {r.event_id: r.text for r in found} == {"a": "x", "b": ""}
    write_csv(df, str(tmp_path / "csv"))
    assert read_csv(spark, str(tmp_path / "csv"), "event_id string, year int, text string").count() == 2


def test_stream_keeps_first_arrivals(spark, tmp_path):
    rows = [(1, dt.datetime(2020, 1, 1, 0, i)) for i in range(3)] + [(2, dt.datetime(2020, 1, 1))]
    spark.createDataFrame(rows, "k int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    query = first_arrivals(stream, ["k"], "ts", "1 hour").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("firsts").count() == 2


def test_embeddings(spark):
    df = spark.createDataFrame([([1.0, -20.0],), ([3.0, 4.0],)], "v array<float>")
    row = diagnostics(df, "v").first()
    assert (row.n, row.dims_over_10, row.max_abs, row.max_dim, row["mean"]) == (2, 1, 20.0, 1, -3.0)
    texts = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    assert [r.embedding for r in embedded(texts, "t", lambda ts: [[float(len(t))] for t in ts]).collect()] == [[2.0], [0.0], [0.0]]


def test_rolling_scores_never_train_on_the_test_quarter(spark):
    # the classes are told apart by x in training and the other way round in the test quarter
    rows = [(q, float(2 * (i % 2)), Vectors.dense([float(i % 2) if q < 9 else 1.0 - i % 2])) for q in range(1, 10) for i in range(40)]
    df = spark.createDataFrame(rows, ["q", "label", "features"])
    members = spark.createDataFrame([(9, t) for t in range(1, 9)], "test_quarter int, train_quarter int")
    scored = rolling_scores(df, members, "q", [0.001]).collect()
    assert len(scored) == 40 and all(r.prediction != r.label for r in scored)
    assert rolling_scores(df, members, "q", [0.001], least_train=1000).count() == 0


def test_database_is_read_in_parts_and_filtered_there(spark):
    """Spark's own embedded database, in memory."""
    link = {"url": "jdbc:derby:memory:tidemark;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).selectExpr("cast(id as int) PERMNO", "cast(id * 0.5 as double) RET", "date_add(date'2010-01-01', cast(id as int)) DT").write.format("jdbc").options(dbtable="daily", **link).mode("overwrite").save()
    whole = read_database(spark, link["url"], "select * from daily where permno >= 10", driver=link["driver"])
    parts = read_database(spark, link["url"], "select * from daily", "PERMNO", ("0", "100"), 4, driver=link["driver"])
    assert whole.count() == 90 and parts.count() == 100 and parts.rdd.getNumPartitions() == 4
    few = parts.where("PERMNO in (3, 50) and DT >= date'2010-01-10'")
    assert [(r.PERMNO, r.RET) for r in few.collect()] == [(50, 25.0)]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "*In(PERMNO" in plan and "*GreaterThanOrEqual(DT" in plan
