"""Files read and written, and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from plumage import schemas
from plumage.operators.users import tag_country
from plumage.sources import readers, writers
from plumage.streaming.pipelines import first_deliveries, mention_weights, users_by_window


def test_tweets_round_trip(spark, tmp_path):
    d = tmp_path / "in" / "hour"
    d.mkdir(parents=True)
    with gzip.open(d / "a.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": 1, "full_text": "x", "place": None, "geo": {"type": "Point", "coordinates": [1.0, 2.0]}, "unknown": 3}) + "\nbroken\n")
    t = readers.tweets(spark, str(d), spread=2)
    rows = t.orderBy(F.col("id").desc_nulls_last()).collect()
    assert rows[0].id == 1 and rows[0].geo.coordinates == [1.0, 2.0] and rows[0].source_file == "a.jsonl.gz" and rows[0].source_dir == "hour" and rows[1].id is None
    out = str(tmp_path / "out")
    writers.json_lines(t.where("id = 1"), out, by=["source_dir"], compression="gzip")
    assert spark.read.schema(schemas.TWEET).json(out).count() == 1
    with pytest.raises(Exception):
        writers.json_lines(t, out)
    writers.ids_only(t.where("id = 1"), str(tmp_path / "ids"), by=["source_dir"])
    writers.append_ids(t.where("id = 1"), str(tmp_path / "more"))
    writers.append_ids(t.where("id = 1"), str(tmp_path / "more"))
    assert spark.read.text(str(tmp_path / "more")).count() == 2 and readers.id_set(spark, str(tmp_path / "more")).count() == 1


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'two\nlines, "quoted"', "Neutral", "English")], schemas.LABELLED)
    writers.csv(df, str(tmp_path / "csv"))
    assert readers.labelled(spark, str(tmp_path / "csv")).collect() == df.collect()
    loc = spark.createDataFrame([("u", 1.5, -2.0)], schemas.LOCATION)
    writers.tsv(loc, str(tmp_path / "tsv"))
    assert readers.locations(spark, str(tmp_path / "tsv")).collect() == loc.collect()
    top = spark.createDataFrame([("tag", ["a b", "ab"])], "tag string, c array<string>")
    writers.ranked(top, str(tmp_path / "top"), "tag", "c")
    r = readers.ragged(spark, str(tmp_path / "top"), 1).first()
    assert r.cols == ["tag"] and r.rest == ["a b", "ab"]


def test_small_files(spark, tmp_path):
    (tmp_path / "lex.txt").write_text(" Mask \n\nmask\nB\n")
    assert {r.term for r in readers.lexicon(spark, str(tmp_path / "lex.txt")).collect()} == {"mask", "b"}
    (tmp_path / "titles.txt").write_text("Mask (film)\nNew Town [1]\n")
    assert {r.title for r in readers.titles(spark, str(tmp_path / "titles.txt")).collect()} == {"mask", "new town"}
    for r, names in (("a", ["x.csv", "y.csv"]), ("b", ["x.csv"])):
        (tmp_path / "sheets" / r).mkdir(parents=True)
        for n in names:
            (tmp_path / "sheets" / r / n).write_text("Tweet ID,Full Text,Mask Sentiment,Language,Tags,Notes\n1,t,Neutral,English,,\n")
    p = readers.paired_files(spark, str(tmp_path / "sheets" / "*" / "*")).collect()
    assert [(r.file_name, len(r.paths)) for r in p] == [("x.csv", 2)]
    s = readers.rater_sheets(spark, str(tmp_path / "sheets" / "*" / "*"))
    assert {(r.rater, r.file_name, r.tweet_id) for r in s.collect()} == {("a", "x.csv", "1"), ("a", "y.csv", "1"), ("b", "x.csv", "1")}


def test_stored_graphs_are_checked(spark, tmp_path):
    good = [("a", "b", 2), ("b", "a", 2), ("b", "c", None), ("c", "b", None)]
    graphs = {"good": good, "empty": [], "loop": [*good, ("c", "c", 1)], "one_way": [*good, ("a", "c", 1)], "weight": [*good, ("a", "c", 1), ("c", "a", 3)], "end": [*good, (None, "a", 1)]}
    for name, rows in graphs.items():
        spark.createDataFrame(rows, schemas.EDGE).write.parquet(str(tmp_path / name))
    assert sorted(map(tuple, readers.edges(spark, str(tmp_path / "good")).collect()), key=str) == sorted(good, key=str)
    assert readers.edges(spark, str(tmp_path / "empty")).count() == 0
    for name in ("loop", "one_way", "weight", "end"):
        with pytest.raises(ValueError, match="inconsistent"):
            readers.edges(spark, str(tmp_path / name))


def test_stream_keeps_first_deliveries(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/tweets.parquet")
    for i in range(3):
        src.where(F.col("delivery_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = first_deliveries(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("firsts")
    n = src.select(F.coalesce("tweet_json.id", F.col("tweet_json.id_str").try_cast("bigint"))).distinct().count()
    assert got.count() == n and got.select("number").distinct().count() == n


def test_stream_windows_and_weights(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/tweets.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    tagged = tag_country(stream, spark.read.parquet(f"{sf}/places.parquet")).withColumn("user_id", F.col("tweet_json.user.id"))
    q = users_by_window(tagged, window="30 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n_tweets")).first()[0] == src.count()
    q = mention_weights(stream).writeStream.format("memory").queryName("weights").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("weights").count() > 0


def test_written_location_model(spark, tmp_path):
    df = spark.createDataFrame([("1", 45.5, -73.6), ("2", -1.0, 2.0), ("2", -1.0, 3.0)], "user_id string, lat double, lon double")
    df.coalesce(1).write.csv(f"{tmp_path}/m", sep="\t", compression="gzip")
    assert {(r.user_id, r.lat, r.lon) for r in readers.location_model(spark, f"{tmp_path}/m").collect()} == {("1", 45.5, -73.6), ("2", -1.0, 3.0)}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.tsv").write_text("1\tnorth\t2\n")
    with pytest.raises(Exception):
        readers.location_model(spark, f"{tmp_path}/bad").collect()
