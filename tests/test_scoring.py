import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.functions import names
from kinloom.operators import evaluation, images, ranking, scoring, synth, vectors
from kinloom.sources import registry
from kinloom.streaming import pairs

SCHEMA = registry.SCHEMA
A = [("A-1", "A", "Ana", "Trostith", "F", "1990-02-03", "Port Velmar", "Grunwick", "Ostrish", [("Ben Trostith", "father")], "Desk", dt.date(2024, 1, 1), "a.png"), ("A-2", "A", None, None, None, None, None, None, None, None, None, None, None), ("A-3", "A", "", "", "", "", "", "", "", [], "", None, "")]
B = [("B-1", "B", "Trostith", "Ana", "F", "03/02/1990", "Velmar Harbour", "Port Velmar", "Pelmian", [("Ben Trostith", "dad")], "Desk", None, "b.png"), ("B-2", "B", "Ana", "Trostith", "M", "1990", "Velmar Harbour", "", "stateless", None, None, None, None)]


@pytest.fixture(scope="module")
def tables(spark):
    places = spark.createDataFrame([("port velmar", "p1"), ("velmar harbour", "p1"), ("grunwick", "p2")], "alias string, cluster string")
    return spark.createDataFrame(A + A[:1], SCHEMA), spark.createDataFrame(B, SCHEMA), places


def test_pairs_are_explained(tables):
    a, b, places = tables
    every = scoring.candidate_pairs(a, b, "exhaustive").distinct()
    rows = {(r.a_record_id, r.b_record_id): r for r in scoring.score_pairs(every, a.withColumn("score", F.lit("x")), b, places=places).collect()}
    assert len(rows) == 6
    r = rows["A-1", "B-1"]
    signals = {s.field: s for s in r.signals}
    assert r.name_method == "name-order-swap" and signals["name"].score == 96
    assert (signals["origin_place"].score, signals["origin_place"].method) == (97, "gazetteer-alias")
    assert r.cross_notes == []  # the origins agree already
    assert signals["family"].score == 85 and r.flags == [] and r.review_required and r.notice == scoring.NOTICE
    assert [x.field for x in r.surfaced_because][0] == "name" and r.score <= sum(x.contribution for x in r.surfaced_because) <= 100
    assert "Carried by: Name 96 %" in r.explanation
    r = rows["A-1", "B-2"]
    assert r.sex_conflict and r.flags == ["sex recorded differently"] and {s.field: s.status for s in r.signals}["nationality"] == "unavailable"
    moved = b.where("record_id = 'B-1'").withColumn("origin_place", F.lit("Amsolio"))
    assert scoring.score_pairs(every.where("a_record_id = 'A-1' and b_record_id = 'B-1'"), a, moved, places=places).first().cross_notes == [scoring.SWAP_NOTES["origin_place", "last_seen_place"]]
    assert rows["A-2", "B-1"].score == 0 and rows["A-3", "B-1"].score == 0 and rows["A-2", "B-1"].band == "unlikely"


def test_faces_alone_are_capped(tables, spark):
    a, b, _ = tables
    face = spark.createDataFrame([("A-2", "B-1", 99.0)], "a_record_id string, b_record_id string, face_score double")
    r = scoring.score_pairs(face.select("a_record_id", "b_record_id"), a, b, faces=face).first()
    assert r.face_only and r.score <= scoring.FACE_CEILING and r.face_similarity == 99.0
    assert scoring.score_pairs(face.limit(0), a, b).count() == 0


def test_lists_are_kept_when_empty(tables):
    a, b, _ = tables
    scored = scoring.score_pairs(scoring.candidate_pairs(a, b), a, b)
    every = {r.a_record_id: r.candidates for r in scoring.match_all(a, scoring.top_candidates(scored)).collect()}
    assert set(every) == {"A-1", "A-2", "A-3"} and every["A-2"] == [] and {c.b_record_id for c in every["A-1"]} == {"B-1", "B-2"}
    portable = scoring.score_pairs(scoring.candidate_pairs(a, b), a, b, profile="portable")
    stats = evaluation.parity_problems(evaluation.parity(scored, portable)).first()
    assert stats.pairs == 2 and stats.bands_differ == 0


def test_hot_blocks_lose_no_pair(spark):
    a = spark.createDataFrame([(f"A-{i}", "A", "Ana", "Trost", "F", "1990", "", "", "", [], "", None, "") for i in range(12)], SCHEMA)
    b = spark.createDataFrame([(f"B-{i}", "B", "Ana", "Trost", "F", "1990", "", "", "", [], "", None, "") for i in range(15)], SCHEMA)
    assert scoring.candidate_pairs(a, b, hot=4).count() == 12 * 15


def test_calibration_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((30, 8)) + 1, rng.standard_normal((20, 8)) + 1
    df = lambda v: spark.createDataFrame([([float(t) for t in r],) for r in v] + [(None,), ([],)], "v array<double>")
    c = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    r = vectors.calibrate(df(x), df(y)).first()
    assert (r.sample_pairs, round(r.background_mean, 9), round(r.background_sd, 9)) == (600, round(c.mean(), 9), round(c.std(), 9))
    assert vectors.calibrate(df(x).limit(0), df(y)).count() == 0
    nearest = vectors.rank_one(*(spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "id long, v array<double>"),) * 2, block=7, size=5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert {r.id: r.other for r in nearest.collect()} == dict(enumerate(s.argmax(1)))
    two = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0])], "a array<double>, b array<double>").select(vectors.compare(F.col("a"), F.col("b")).alias("c")).collect()
    assert two[0].c.cosine == 1.0 and two[1].c is None


def test_synthetic_truth(spark):
    a, b, truth = synth.registries(spark, 120)
    rows = truth.collect()
    assert a.count() == b.count() == 120 and len(rows) == round(120 * 0.32) and {r.difficulty for r in rows} >= {"easy", "moderate"}
    assert all(r.difficulty == "easy" for r in rows if not r.divergences)
    ids = {r.record_id for r in b.collect()}
    assert all(r.b_record_id in ids for r in rows) and evaluation.difficulty_histogram(truth).count() >= 2
    t = truth.withColumnRenamed("b_record_id", "b_true")
    ranked = t.select("a_record_id", F.col("b_true").alias("b_record_id"), F.lit(1).alias("rank"), F.lit(90.0).alias("score"))
    assert all(r.recall == 1 for r in evaluation.recall_by_difficulty(ranked, t).collect()) and all(r.recall == 1 for r in evaluation.topk_recall(ranked, t).collect())
    revealed = evaluation.reveal(ranked.unionByName(ranked.limit(1).withColumn("a_record_id", F.lit("A-x"))), t).collect()
    assert sum(r.has_true_partner for r in revealed) == len(rows) and len(revealed) == len(rows) + 1
    assert evaluation.error_kinds(evaluation.outcomes(ranked, t)).count() == 0


def test_descriptors_against_plain_loops():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 255, (2, 64, 64))
    padded = np.pad(x, ((0, 0), (4, 4), (4, 4)), mode="edge")
    want = np.array([[[padded[n, i : i + 9, j : j + 9].mean() for j in range(64)] for i in range(64)] for n in range(2)])
    assert np.allclose(images.box_mean(x, 9), want)
    assert images.local_max(x, 2)[0, 10, 10] == x[0, 8:13, 8:13].max()
    rgb = rng.uniform(0, 255, (3, 64, 64, 3))
    d = images.describe(rgb)
    assert d.shape == (3, images.DIMENSIONS) == (3, 1812) and np.allclose(np.linalg.norm(d, axis=1), 1)
    assert np.allclose(images.describe(rgb * 0.5)[:, -48:], d[:, -48:], atol=1e-6)  # darker, same colours
    face = np.full((140, 140, 3), 100.0)
    face[59:62, 49:52] = face[59:62, 89:92] = 255
    turned = images.align(face, (50.5, 60.5, 90.5, 60.5))
    bright = np.argwhere(turned[:, :, 0] > 150)
    assert {tuple(p) for p in bright} <= {(y, x) for y in range(24, 30) for x in (*range(18, 24), *range(40, 46))} and len(bright)


def test_images_embed(spark):
    rgb = bytes(range(256)) * 48
    df = spark.createDataFrame([((64, 64, rgb), None), ((64, 64, rgb), [20.0, 27.0, 44.0, 27.0]), ((64, 64, b"x"), None), (None, None)], "image struct<height: int, width: int, rgb: binary>, eyes array<double>")
    got = df.select(images.embedding("image", "eyes").alias("e")).collect()
    assert [r.e and len(r.e) for r in got] == [1812, 1812, None, None]


def test_requests_are_checked_and_scored(spark, tmp_path):
    record = lambda i, **kw: {"record_id": i, "given_name": "Ana", "family_name": "Trost", "sex": "F", "birth_date_raw": "1990", "family_members": [{"name": "Ben", "relation": "father"}]} | kw
    rows = [{"record_a": record("A-1", face_embedding=[1.0, 0.0]), "record_b": record("B-1", face_embedding=[1.0, 0.1])}, {"record_a": record("A-2", birth_date_raw=""), "record_b": record("B-2")}, {"record_a": record("A-3"), "record_b": record("B-3", given_name="Zorb", family_name="Quix"), "options": {"review_threshold": 10.0}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
    requests = pairs.read_requests(spark, str(tmp_path / "in"))
    sent = []
    q = pairs.serve(requests, lambda df, n: df.select("a_record_id", "score", "face_similarity", "needs_review").write.mode("overwrite").parquet(str(tmp_path / "out" / str(n))), str(tmp_path / "cp"), sent.append).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    got = {r.a_record_id: r for r in spark.read.parquet(str(tmp_path / "out" / "0")).collect()}
    assert set(got) == {"A-1", "A-3"} and got["A-1"].face_similarity is not None and got["A-1"].needs_review and {x["a_record_id"] for x in sent} == {"A-1", "A-3"}
    bad = pairs.checked(spark.read.schema(pairs.REQUEST).json(str(tmp_path / "in"))).where("size(problems) > 0").collect()
    assert [r.problems for r in bad] == [["record_a: no birth date"]]


def test_files(spark, tmp_path):
    a = spark.createDataFrame(A, SCHEMA)
    with pytest.raises(FileNotFoundError, match="synth"):
        registry.read_json(spark, str(tmp_path / "none.json"))
    registry.write_json(a, str(tmp_path / "a"))
    registry.write_csv(a, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("family_members = 'father: Ben Trostith'").count() == 1
    (tmp_path / "r.json").write_text(json.dumps([{"record_id": "A-1", "given_name": "x"}, {"record_id": "A-2"}]))
    assert [r.record_id for r in registry.read_json(spark, str(tmp_path / "r.json")).orderBy("ord").collect()] == ["A-1", "A-2"]
    (tmp_path / "t.json").write_text(json.dumps({"_meta": {}, "pairs": [{"a_record_id": "A-1", "b_record_id": "B-1", "difficulty": "hard", "divergences": ["x"]}]}))
    assert registry.read_truth(spark, str(tmp_path / "t.json")).first().b_true == "B-1"
    assert registry.read_calibration(spark, str(tmp_path / "cal"), "gradient", 0.78, 0.093) == (0.78, 0.093)
    registry.write_calibration(spark.createDataFrame([(10, 0.81, 0.07)], "sample_pairs long, background_mean double, background_sd double"), str(tmp_path / "cal"), "gradient")
    assert registry.read_calibration(spark, str(tmp_path / "cal"), "gradient", 0.78, 0.093) == (0.81, 0.07) and registry.read_calibration(spark, str(tmp_path / "cal"), "other", 0.78, 0.093) == (0.78, 0.093)
    v = spark.createDataFrame([("A-1", [0.123456789], "gradient"), ("A-2", [1.0], "legacy")], "record_id string, embeddings array<float>, backend string")
    with pytest.raises(ValueError, match="legacy"):
        registry.read_vectors(v, "gradient")
    registry.write_vectors(registry.read_vectors(v, "gradient", "skip"), str(tmp_path / "v"))
    assert abs(spark.read.parquet(str(tmp_path / "v")).first().embeddings[0] - 0.12346) < 1e-7
    answers = spark.createDataFrame([(f"A-{i}", i) for i in range(40)], "a_record_id string, n long")
    registry.materialise(answers, "a_record_id", str(tmp_path / "m"), 8)
    assert registry.answer(spark, str(tmp_path / "m"), "a_record_id string, n long", "a_record_id", "A-7", 8).first().n == 7
    registry.write_report(str(tmp_path / "rep"), counts=answers)
    assert spark.read.json(str(tmp_path / "rep" / "counts")).count() == 40
    assert registry.point(a, "A-1").first().given_name == "Ana"
    with pytest.raises(KeyError):
        registry.point(a, "A-9")
    assert registry.first_by(answers.withColumn("k", F.lit(1)), ["k"], "n").first().n == 0


def test_thresholds_in_buckets(spark):
    rng = np.random.default_rng(3)
    rows = [(float(round(x, 2)), bool(rng.random() < x)) for x in rng.random(400)]
    best = max(((sum((s >= t) == y for s, y in rows) / len(rows), -t) for t in {s for s, _ in rows}))
    for n in (1, 7, 1000):
        r = evaluation.best_threshold(spark.createDataFrame(rows, "score double, same boolean"), n).first()
        assert (r.threshold, r.accuracy) == (-best[1], pytest.approx(best[0]))


@pytest.mark.parametrize("n, floor, slice_rows", [(3, 25.0, 10**6), (1, 60.0, 400)])
def test_best_candidates_form_no_list_of_pairs(spark, monkeypatch, n, floor, slice_rows):
    a, b, _ = (x.cache() for x in synth.registries(spark, 40))
    places = scoring.aliases(synth.place_entries(spark), "entry", [F.col("forms")])
    ids = [r[0] for r in a.unionByName(b, True).select("record_id").collect()]
    rng = np.random.default_rng(5)
    faces = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4) + 1]) for i in ids[::2]], "record_id string, v array<double>")
    pairs = scoring.candidate_pairs(a, b)
    scored = scoring.score_pairs(pairs, a, b, scoring.face_similarities(pairs, faces), places)
    columns = ("a_record_id", "b_record_id", "score", "band", "face_similarity", "rank")
    want = {tuple(r) for r in scoring.top_candidates(scored, n, floor).select(*columns).collect()}
    monkeypatch.setattr(scoring, "candidate_pairs", None)
    monkeypatch.setattr(scoring, "score_pairs", None)
    got = [tuple(r) for r in ranking.best_candidates(a, b, faces, places, n=n, floor=floor, slice_rows=slice_rows).select(*columns).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    assert ranking.best_candidates(a.limit(0), b, faces, places, n=n, floor=floor).count() == 0


def test_review_queries_form_no_list_of_pairs(spark, monkeypatch):
    from kinloom.plans import reference_queries

    def pairs_listed(*_):
        raise AssertionError("all pairs are listed")

    monkeypatch.setattr(scoring, "candidate_pairs", pairs_listed)
    for name in ("review_cases", "review_queue"):
        reference_queries.QUERIES[name](spark, "/root/testdata/sf0.001")


def test_the_bound_of_names_is_never_below_their_score():
    rng = np.random.default_rng(8)
    words = ["", None, "Ana", "anna", "Anaaaa", "aaaana", "Trostith", "Trosthit", "Kathy", "Cathie", "José", "w" * 30, "Phaen", "Faen"] + ["".join(rng.choice(list("abenrstk"), rng.integers(1, 9))) for _ in range(60)]
    memo = ranking._Names()
    for x in words:
        most = ranking.most_name(np.array([memo[x]] * len(words)), np.array([memo[y] for y in words]))
        assert all(m >= names.name_score(x, y)[0] - 1e-9 for m, y in zip(most, words) if x is not None and y is not None)
