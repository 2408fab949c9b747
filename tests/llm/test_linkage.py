from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("kinloom.llm")
from kinloom.llm import canonical, linkage, people, tokens  # noqa: E402

SCHEMA = "record_id string, side int, given_name string, family_name string, sex string, birth_date_raw string, origin_place string, last_seen_place string, nationality string, family_members array<struct<name: string, relation: string>>, source_org string, intake_date date"
KIN = [("Ana Trostith", "mother"), ("Ben Trostith", "father")]
BASE = ("Kemox", "Trostith", "M", "1990-02-03", "Port Velmar", "Grunwick", "Ostrish", KIN, None, None)


def features(spark, rows):
    places = canonical.Reference([(n, [n], [], []) for n in ("Port Velmar", "Grunwick", "Amsolio", "Bretuga")])
    nations = canonical.Reference([(n, [n], [], []) for n in ("Ostrish", "Pelmian")])
    desks = spark.createDataFrame([("d", "UTC", "dmy")], "source_org string, iana_zone string, date_order string")
    df = spark.createDataFrame(rows, SCHEMA)
    return people.features(df, desks, people.Forms([("Kex", "Kemox")]), people.PlaceKeys(places), people.PlaceKeys(nations))


def rec(number, side=0, **changes):
    names = ("given_name", "family_name", "sex", "birth_date_raw", "origin_place", "last_seen_place", "nationality", "family_members", "source_org", "intake_date")
    row = dict(zip(names, BASE)) | changes
    return (f"{'AB'[side]}-{number:09d}", side, *row.values())


VARIANTS = [
    rec(1), rec(2, given_name="Kemx"), rec(3, given_name="Kemush", birth_date_raw="1990"), rec(4, given_name="Trostith", family_name="Kemox"), rec(5, given_name="K."), rec(6, given_name="Kex", family_name="TROSTITH"),
    rec(7, given_name="Zorbel"),  # a twin
    rec(8, given_name=None, family_name=None), rec(9, given_name="", family_name="", family_members=None, birth_date_raw=None, sex=None, origin_place=None, last_seen_place=None, nationality=None),
    rec(10, birth_date_raw="1961-07-01"), rec(11, given_name="w " * 4000, family_name="x" * 9000),
]


def pairs(df):
    return {(int(r.record_id_1[2:]), int(r.record_id_2[2:])) for r in df.collect()}


def test_variants_link_and_twins_do_not(spark):
    got = pairs(linkage.link_variants(features(spark, VARIANTS + VARIANTS[:2])))
    assert got >= {(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 6)}
    assert not {x for p in got for x in p} & {7, 8, 9, 10, 11}
    assert linkage.link_variants(features(spark, VARIANTS).limit(0)).count() == 0


def test_sources_match_with_confidence(spark):
    rows = VARIANTS + [rec(51, 1), rec(52, 1, given_name="Kemax", birth_date_raw="3 February 1990"), rec(57, 1, given_name="Zorbel"), rec(58, 1, given_name=None)]
    facts = features(spark, rows)
    found = linkage.match_sources(facts)
    got = pairs(found)
    assert {(1, 51), (2, 51), (4, 51), (1, 52), (7, 57)} <= got and not {(1, 57), (7, 51)} & got
    assert all(0.5 <= r.confidence <= 1 for r in found.collect())
    labels = facts.where("id % 2 = 0").select(F.col("id").alias("id1")).crossJoin(facts.where("id % 2 = 1").select(F.col("id").alias("id2"))).withColumn("same", (F.col("id1") < 14).cast("int"))
    assert pairs(linkage.match_sources(facts, labels)) == got


def test_names_without_a_shared_beginning_still_meet(spark):
    thin = {"birth_date_raw": "1990", "family_members": None}
    rows = [
        rec(1, given_name="Ana", family_name="Anana", **thin), rec(51, 1, given_name="Ana", family_name="Anana", **thin),  # one vector of grams
        rec(2, given_name="Zorbel", family_name="Zorbel", **thin), rec(52, 1, given_name="Zorbel", family_name="Zorbel", **thin),
        rec(3, given_name="Quemdir", family_name="Hestrov", **thin), rec(53, 1, given_name="Q.", family_name="Hestrov", **thin), rec(54, 1, given_name=None, family_name="Hestrov", **thin),
        rec(4, given_name="Luulbemkrava", family_name="Dadjwibra", **thin), rec(55, 1, given_name="Lulbka", family_name="Dadjeibra", **thin),
    ]
    facts = features(spark, rows)
    assert tokens.gram_bits("ana") == tokens.gram_bits("anana")
    assert pairs(linkage.match_sources(facts)) >= {(1, 51), (2, 52), (3, 53), (3, 54), (4, 55)}


def test_crowded_keys_and_joined_words_change_nothing(spark, monkeypatch):
    rows = VARIANTS + [rec(100 + i, birth_date_raw=(f"19{40 + i}-03-04", None, "1990", "c. 1990")[i % 4], family_members=None, origin_place=None) for i in range(24)]
    facts = features(spark, rows)
    want = pairs(linkage.link_variants(facts))
    assert len(want) > 40
    monkeypatch.setattr(linkage, "HOT", 3)
    assert pairs(linkage.link_variants(facts)) == want
    monkeypatch.setattr(tokens, "MAX_BROADCAST", 0)
    assert pairs(linkage.link_variants(facts)) == want


def test_the_bound_is_never_below_the_points(spark):
    rng = np.random.default_rng(3)
    n = 4000
    windows = [None if rng.random() < 0.1 else (int(d), int(d) + int(rng.choice([0, 2, 30, 364, 1500])), 0) for d in rng.integers(-9000, -8000, 2 * n)]
    sig = people.signatures(windows, list(rng.choice(["M", "F", ""], 2 * n)), list(rng.random(2 * n) < 0.5), rng.integers(-1, 3, (2 * n, 3)))
    a, b = sig[:n], sig[n:]
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long").select("a", "b", people.most_points("a", "b").alias("most")).collect()
    kin = (a >> people.KIN) & (b >> people.KIN) & 1
    for r, plain, k in zip(df, people.plain_points(a, b), kin):
        assert r.most == pytest.approx(plain + people.NAMES + (people.KINS[2] if k else 0.0))


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    words = ["kemox", "kemax", "trost", "trist", "ana", "anna", "k", "velmarin", "velmarin", "zorbel"]
    for _ in range(60):
        a, b = (list(rng.choice(words, rng.integers(1, 5))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        best = max(sum(people.word_similarity(x, long[j]) for x, j in zip(short, p)) for p in permutations(range(len(long)), len(short)))
        assert people.assignment(a, b) == pytest.approx(best / len(short))
        assert people._hungarian([[people.word_similarity(x, y) for y in long] for x in short]) == pytest.approx(best)
    assert people.assignment(["ana", "maria"], ["ana", "petra"]) == pytest.approx(0.5) and people.assignment([], ["a"]) == -1


def test_heads_of_rare_words(spark):
    counts = {"trostith": 50, "trosith": 1, "trostiht": 2, "velmar": 40, "velmra": 1, "quem": 1, "bretuga": 30, "bretuka": 20}
    rows = [(w, "", "") for w, n in counts.items() for _ in range(n)]
    words = tokens.vocabulary(spark.createDataFrame(rows, "given string, family string, kin string"))
    by = {r.token: r.skeleton for r in words.collect()}
    heads = {by[r.token]: by[r["head"]] for r in tokens.by_deletes(words).collect()}
    s = people.sound
    # both frequent words keep their own heads, as does a word without neighbours
    assert heads == {s(w): s(h) for w, h in (("trosith", "trostith"), ("trostiht", "trostith"), ("velmra", "velmar")) if s(w) != s(h)}


def test_birth_windows():
    w = lambda raw, order=None: people.birth_window(raw, None, order, 2025)
    assert w("1970-01-02") == (1, 1, people.EXACT) and w("02.01.1970", "dmy") == (1, 1, people.EXACT) and w("01/02/1970", "mdy") == (1, 1, people.EXACT)
    assert w("01/02/1970")[2] == people.YEAR and w("13/01/1970") == (12, 12, people.EXACT) and w("1970")[:2] == (0, 364)
    assert w(None) is None and w("") is None and w("x" * 5000) is None and w("c. 1970")[2] == people.WIDE and w("May 1970")[2] == people.MONTH


def test_calibration_sees_through_errors():
    rng = np.random.default_rng(6)
    x = rng.uniform(-5, 20, 8000)
    true = rng.random(8000) < 1 / (1 + np.exp(-1.2 * (x - 8)))
    for wrong, missed in ((0.0, 0.0), (0.22, 0.2)):
        same = np.where(rng.random(8000) < np.where(true, missed, wrong), ~true, true).astype(float)
        middle, slope = linkage.calibrate(x, same)
        assert abs(middle - 8) < 0.6 and abs(slope - 1.2) < 0.35
    assert linkage.calibrate(np.zeros(0), np.zeros(0)) == pytest.approx((linkage.MIDDLE, linkage.SLOPE))
    middle, slope = linkage.calibrate(np.array([-99.0] * 600 + [15.0] * 200), np.array(([0.0] * 4 + [1.0]) * 120 + [1.0, 1.0, 1.0, 1.0, 0.0] * 40))
    assert -2 < middle < 12 and slope > 0.3


def test_bound_of_names_holds_and_leaves_out_strangers():
    rng = np.random.default_rng(5)
    words = ["", "k", "q", "kemox", "trostith", "kemush", "lisith loshev", "hhhhush", "jeebeeree", "xxxxa", "rnorna", "phoouey", "abush", "anna maria lou", "lorostae", "drouruma"]

    def typed(w):
        i = rng.integers(len(w) + 1)
        return (w, w[:i] + "akn"[rng.integers(3)] + w[i:], w[:i] + w[i + 1 :], w[:i] + w[i:][1:2] + w[i : i + 1] + w[i + 2 :], w[:i] + "ush")[rng.integers(5)].strip()

    rows = [[typed(words[i]) for i in rng.integers(len(words), size=4)] for _ in range(1500)]
    rows += [[g, f, *names] for g, f, _, _ in rows for names in ((typed(g), typed(f)), (typed(f), typed(g)), ("", f"{g} {f}".strip()))]
    points = np.array([people.names_points(*people.align(*(x.split() for x in r))) for r in rows])
    columns = [pa.array(c, pa.string()) for c in zip(*rows)]
    for need in (-15.0, -2.0, 0.3, 3.0, 5.0, 7.0):
        may = people.names_may_reach(*columns, np.full(len(rows), need))
        assert may[points >= need].all() and (need < 0 or not may.all())
    strangers = people.names_may_reach(*(pa.array([x] * 3) for x in ("lorostae", "trostith")), pa.array(["drouruma", "kemox", "lorostae"]), pa.array(["trostith"] * 3), np.full(3, 1.0))
    assert strangers.tolist() == [False, False, True]


def test_keys_stand_by_side(spark):
    facts = features(spark, [rec(i, i % 2) for i in range(6)])
    words = tokens.vocabulary(facts)
    sides = linkage.keyed(facts, tokens.resolved(words, tokens.by_deletes(words), vectors=True), True)
    assert [{r.id & 1 for r in s.select("id").distinct().collect()} for s in sides] == [{0}, {1}]
