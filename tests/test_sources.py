"""Readers and writers on files."""

import pytest
from pyspark.sql import functions as F

from textloom.sources import readers, writers
from textloom.streaming import frequency_stream


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "1930").mkdir()
    (tmp_path / ".venv").mkdir()
    (tmp_path / "1930" / "12. Ausgabe.txt").write_text("# note\nÜber\n", encoding="utf-8")
    (tmp_path / "1930" / "alt.txt").write_bytes("Müßig".encode("latin-1"))
    (tmp_path / ".venv" / "x.txt").write_text("no")
    (tmp_path / "top 1931.txt").write_text("oben")
    return str(tmp_path)


def texts(df):
    return {r["name"]: r["text"] for r in df.collect()}


def test_trees(spark, tree):
    assert texts(readers.text_files(spark, tree)) == {"top 1931": "oben"}
    found = texts(readers.text_files(spark, tree, recursive=True, exclude=[".venv"], errors="latin1", comments="#"))
    assert found["12. Ausgabe"].strip() == "Über" and found["alt"] == "Müßig" and "x" not in found
    assert "alt" not in texts(readers.text_files(spark, tree, recursive=True, errors="skip"))
    assert "�" in texts(readers.text_files(spark, tree, recursive=True))["alt"]
    assert [r["path"].endswith("alt.txt") for r in readers.rejected_files(spark, tree, True).collect()] == [True]


def test_missing_input(spark, tree):
    with pytest.raises(readers.MissingInput):
        readers.text_files(spark, tree + "/nothing")


def test_year_of_path(spark):
    df = spark.createDataFrame([("/in/1930/a 1931.txt",), ("/in/x/a 1931.txt",), ("/in/x/a.txt",)], "p string")
    assert [r[0] for r in df.select(readers.year_of_path(F.col("p"))).collect()] == [1930, 1931, None]


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.txt").write_text("Gut|ADJ\t0.5\tguter,gutes\nBös|ADJ\t-0.7\t\n", encoding="utf-8")
    assert {tuple(r) for r in readers.weighted_lexicon(spark, str(tmp_path / "l.txt")).collect()} == {("gut", 0.5), ("guter", 0.5), ("gutes", 0.5), ("bös", -0.7)}
    (tmp_path / "s.txt").write_text("# x\nund\nUnd\n\noder\n")
    assert {r[0] for r in readers.word_list(spark, str(tmp_path / "s.txt")).collect()} == {"und", "oder"}


def test_topic_files(spark, tmp_path):
    (tmp_path / "k").write_text("0\t0,5\ta b c\nbad\n1\t0.25\td e\n")
    assert [tuple(r) for r in readers.topic_keys(spark, str(tmp_path / "k")).orderBy("topic").collect()] == [(0, 0.5, ["a", "b", "c"]), (1, 0.25, ["d", "e"])]
    (tmp_path / "d").write_text("#doc\n0\tfile:/in/a_b.txt\t0.5\tx\n")
    row = readers.document_topics(spark, str(tmp_path / "d"), 3).first()
    assert row["doc_id"] == "a_b" and (row["topic_0"], row["topic_1"], row["topic_2"]) == (0.5, 0.0, 0.0)


def test_pages_are_joined_in_order(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "doc_id string, page int, text string")
    assert tuple(readers.joined_pages(df).first()) == ("a", 2, "x\n\ny")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("ä, b", 1)], "t string, n long")
    writers.write_csv(df, str(tmp_path / "o"), single=True)
    assert readers.csv(spark, str(tmp_path / "o"), "t string, n long").collect() == df.collect()
    (tmp_path / "bad.csv").write_text("t,n\nx,1\ny,z\n")
    assert readers.csv(spark, str(tmp_path / "bad.csv"), "t string, n long", "DROPMALFORMED").collect() == [("x", 1)]


def test_total_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, n double")
    assert {tuple(r) for r in writers.with_total_row(df, "k", "GESAMT", ["n"]).collect()} == {("a", 1.0), ("b", 2.0), ("GESAMT", 3.0)}


def test_stream_counts_equal_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a", 1929), (2, "b", 1930)], "doc_id long, text string, slice int")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = frequency_stream.term_counts(frequency_stream.document_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
    running = frequency_stream.to_table(stream, "streamed_terms", str(tmp_path / "cp"))
    running.awaitTermination(60)
    batch = frequency_stream.term_counts(docs)
    assert sorted(map(tuple, spark.table("streamed_terms").collect())) == sorted(map(tuple, batch.collect()))
