import datetime as dt

from kinloom.operators import review
from kinloom.streaming import reviews
from kinloom.operators.evaluation import best_threshold

ROWS = [("A1", "B1", "REFER", "r", dt.datetime(2024, 1, 1)), ("A1", "B2", "ruled_out", "r", dt.datetime(2024, 1, 2)), ("A2", "B1", "refer", "q", dt.datetime(2024, 1, 1)), ("A2", "B1", "clear", "q", dt.datetime(2024, 1, 3)), ("A3", "B1", "maybe", "q", dt.datetime(2024, 1, 1)), (None, "B1", "refer", "q", dt.datetime(2024, 1, 1))]
SCHEMA = "a_record_id string, b_record_id string, decision string, reviewer string, decided_at timestamp"


def test_latest_and_stream_agree(spark, tmp_path):
    log = spark.createDataFrame(ROWS + ROWS[:2], SCHEMA)
    want = {(r.a_record_id, r.b_record_id, r.decision) for r in review.latest(log).collect()}
    assert want == {("A1", "B2", "rule_out")}
    for i in range(2):
        log.repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = reviews.write_latest(stream, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "state" / str(n))), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    changes = spark.read.parquet(*(str(p) for p in (tmp_path / "state").iterdir()))
    assert {(r.a_record_id, r.b_record_id, r.decision) for r in reviews.current(changes).collect()} == want
    assert review.latest(log.limit(0)).count() == 0


def test_ties_and_nulls_fold_alike(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("A1", "B1", "delete", "r", at), ("A1", "B1", "refer", "r", at), ("A2", None, "refer", None, None), ("A2", "B9", "rule out", "q", None), ("A3", "B1", "refer", None, at)]
    log = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in review.latest(log).collect())
    log.repartition(1).write.parquet(str(tmp_path / "in"))
    q = reviews.write_latest(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / str(n))), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    changes = spark.read.parquet(*(str(p) for p in (tmp_path / "out").iterdir()))
    assert sorted(tuple(r) for r in reviews.current(changes).collect()) == want
    assert [r[:3] for r in want] == [("A2", "B9", "rule_out"), ("A3", "B1", "refer")]


def test_cases_wait_for_usable_decisions(spark):
    scored = spark.createDataFrame([("A1", "B1", 80.0, "strong"), ("A2", "B2", 61.0, "possible"), ("A3", "B3", 10.0, "unlikely")], "a_record_id string, b_record_id string, score double, band string")
    log = spark.createDataFrame([("A1", "B1", "Referred", "r", dt.datetime(2024, 1, 1)), ("A2", "B2", "maybe", "r", dt.datetime(2024, 1, 1))], SCHEMA)
    got = {r.a_record_id: (r.status, r.outcome, r.human_decision_required) for r in review.audit(review.resolve_cases(review.cases(scored, None), log)).collect()}
    assert got == {"A1": ("reviewed", "referred for human verification", True), "A2": ("open", "open", True)}


def test_notices_never_stop(spark):
    sent = []

    def send(row):
        if row == 2:
            raise OSError("no line")
        sent.append(row)

    assert review.notify([1, 2, 3], send) == ["2: no line"] and sent == [1, 3]


def test_queue(spark):
    ranked = spark.createDataFrame([("A1", "B1", 90.0, "strong", 1, None), ("A1", "B2", 50.0, "weak", 2, None), ("A2", "B1", 70.0, "possible", 1, 61.0)], "a_record_id string, b_record_id string, score double, band string, rank int, face_similarity double")
    a = spark.createDataFrame([("A1", "Ana", None), ("A2", None, "Bel"), ("A3", "x", "y")], "record_id string, given_name string, family_name string")
    queue = review.queue_of(ranked, a)
    assert {(r.a_record_id, r.b_record_id, r.candidate_count, r.display_name) for r in queue.collect()} == {("A1", "B1", 2, "Ana"), ("A2", "B1", 1, "Bel")}
    state = review.latest(spark.createDataFrame(ROWS, SCHEMA))
    assert tuple(review.queue_counts(queue, state).first()) == (1, 1)
    assert {r.record_id: r.reviewed for r in review.annotate(a, state).collect()} == {"A1": "rule_out", "A2": None, "A3": None}
    good, bad = review.known_only(spark.createDataFrame(ROWS[:1], SCHEMA), a, a)
    assert good.count() == 0 and bad.count() == 1


def test_best_threshold(spark):
    r = best_threshold(spark.createDataFrame([(0.1, False), (0.2, False), (0.3, True), (0.9, True)], "score double, same boolean")).first()
    assert (r.threshold, r.accuracy) == (0.3, 1.0)
