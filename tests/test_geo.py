import datetime as dt

from pyspark.sql import functions as F

from kinloom.operators import enrolment, geo


def test_places_around(spark):
    points = [(1, "A", "hospital", 52.501, 13.4), (2, "A", "hospital", 52.50101, 13.40001), (3, "B", "shelter", 52.52, 13.4), (4, "C", "cafe", 52.5, 13.4), (5, None, "police", 52.5, 13.41), (6, "D", "shelter", 55.0, 13.4)]
    rows = geo.nearby(spark.createDataFrame(points, "ord int, name string, kind string, lat double, lon double"), 52.5, 13.4).collect()
    assert [(r.ord, r.direction, r["rank"]) for r in rows] == [(3, "N", 0), (1, "N", 1), (5, "E", 3)]
    text = spark.createDataFrame([(4.0,), (994.0,), (1234.0,), (12345.0,)], "m double").select(geo.readable(F.col("m")).alias("t")).collect()
    assert [r.t for r in text] == ["0 m", "990 m", "1.2 km", "12 km"]
    tags = spark.createDataFrame([({"amenity": "clinic", "shelter_type": "x"},), ({"man_made": "water_tap"},), ({"amenity": "bench"},), (None,)], "tags map<string,string>").select(geo.kind(F.col("tags")).alias("k")).collect()
    assert [r.k for r in tags] == ["clinic", "drinking_water", None, None]


def test_enrolment(spark):
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    log = spark.createDataFrame([(at(0), "enrol", "old", [1.0, 0.0]), (at(1), "clear", None, None), (at(2), "enrol", "ana", [1.0, 0.0]), (at(3), "enrol", "ben", [0.0, 1.0]), (at(4), "forget", "ben", None), (at(5), "enrol", "eva", [1.0]), (None, "enrol", "x", [1.0, 0.0])], "at timestamp, action string, name string, v array<double>")
    known = enrolment.enrolled(log)
    assert {r.name for r in known.collect()} == {"ana", "eva"}
    looks = enrolment.looks(spark.createDataFrame([(1, [0.9, 0.1]), (2, None)], "look_id int, v array<double>"), known)
    assert [(r.look_id, r.name) for r in enrolment.best_look(looks).collect()] == [(1, "ana")]
    held = spark.createDataFrame([("A-1", [1.0]), ("B-1", [2.0])], "record_id string, v array<double>")
    asked = spark.createDataFrame([(1, ["faces/B-1.png", "A-1.png"]), (2, ["A-1.png"]), (3, ["A-1.png", "A-9.png"]), (4, None)], "request_id int, images array<string>")
    replies = enrolment.embed_pair(asked, held)
    got = {r.request_id: (r.problem, r.embeddings) for r in replies.collect()}
    assert got[1] == (None, [[2.0], [1.0]]) and got[2][0].startswith("exactly") and got[3][0].startswith("an image") and got[4][0].startswith("exactly")
    assert {r.request_id for r in enrolment.with_replies(asked, replies.where("problem is null")).where("embeddings is not null").collect()} == {1}
