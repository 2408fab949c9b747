import random
from itertools import combinations

import numpy as np
import pytest

llm = pytest.importorskip("kinloom.llm")
from kinloom.llm import canonical, leakage, neighbours, packing, spam_pages, text  # noqa: E402

ITEM = "a rigid hopper guides the sealed valve while one outer drum cools seven hollow plates near an axial lever so that no planar crate bends before every winding stops at dusk"


def test_edits_and_index():
    assert text.edits("abcd", "abdc") == 1 and text.edits("abcdef", "xyz") == 4
    index = text.DeleteIndex(["harbour", "pushoumlo", "neebrude"])
    assert index.search("harbor")[0][0] == "harbour" and index.search("pushuomlo")[0][0] == "pushoumlo" and not index.search("qqqqqqq")
    words = ["abcde", "abxde", "fghij", "abcd"]
    for w in ("abcdf", "abce", "ghij"):
        assert {v for v, _ in text.DeleteIndex(words).search(w)} >= {v for v in words if text.edits(w, v, 1) == 1}


def test_deletes():
    for word in ("abcde", "aab", "a", ""):
        want = {"".join(c for i, c in enumerate(word) if i not in cut) for k in range(min(2, max(len(word) - 1, 0)) + 1) for cut in map(set, combinations(range(len(word)), k))}
        assert text.deletes(word, 2) == want


def test_mapping(spark):
    ref = canonical.Reference([("1", ["Port Velmar"], [], ["Ostry"]), ("2", ["Lake Velmar"], [], ["Ostry"]), ("3", ["Grunwick"], [], ["Pelm"]), ("4", ["Grunwick"], [], ["Dorst"])] + [(f"{k}{n}", [f"{k} {n}"], [], []) for k in ("Port", "Lake") for n in ("Amsolio", "Bretuga", "Corvendi", "Dastimer")])  # a generic word stands in four names or more
    values = [("k", v) for v in ("PORT VELMAR", "Velmar, Lk.", "port  velmra old quarter", "Grunwick (Dorst)", "Grunwick", "nowhere", "", None, "x" * 5000)]
    got = {r.value: r.ref_id for r in canonical.map_to_list(spark.createDataFrame(values * 2, "kind string, value string"), {"k": ref}).collect()}
    assert got == {"PORT VELMAR": "1", "Velmar, Lk.": "2", "port  velmra old quarter": "1", "Grunwick (Dorst)": "4", "Grunwick": "UNLISTED", "nowhere": "UNLISTED", "x" * 5000: "UNLISTED"}


def test_leaks(spark):
    words = ITEM.split()
    changed = words[:]
    changed[5], changed[14] = "other", "thing"
    docs = [(1, "before " + " ".join(words[:27]) + " after"), (2, "<p>" + "<br/>".join(" ".join(changed[i : i + 5]) for i in range(0, len(changed), 5)).upper() + "</p>"), (3, " ".join(words[:20])), (4, " ".join(sorted(words))), (5, None), (6, ""), (7, "z" * 30000)]
    items = spark.createDataFrame([(9, ITEM), (10, None), (11, "short")], "item_id long, item_text string")
    df = spark.createDataFrame(docs + docs[:1], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, items).collect()} == {(1, 9), (2, 9)}
    assert leakage.find_leaks(df.limit(0), items).count() == 0 and leakage.find_leaks(df, items.limit(0)).count() == 0


def test_grams_match_brute_force():
    a = np.frombuffer(b"abcabcabdabcabc", np.uint8)
    h = leakage.gram_hashes(a, 3)
    grams = [bytes(a[i : i + 3]) for i in range(len(a) - 2)]
    assert [[x == y for x in h] for y in h] == [[x == y for x in grams] for y in grams]


def test_packing():
    random.seed(3)
    for capacity in (7, 100, 2048):
        hist: dict = {}
        for _ in range(400):
            n = min(capacity, max(1, int(random.lognormvariate(0, 1) * capacity / 5)))
            hist[n] = hist.get(n, 0) + 1
        got: dict = {}
        for lengths, m in packing.plan(hist, capacity):
            assert sum(lengths) <= capacity
            for n in lengths:
                got[n] = got.get(n, 0) + m
        assert got == hist
    assert packing.plan({}, 10) == []


def test_pack_round_trip(spark):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate((0, 3, 50, 70, 250, 30))] + [(9, None)], "doc_id long, text string")
    rows = packing.pack(docs, capacity=100).collect()
    used: dict = {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= 100 and {r.doc_id for r in rows} == {1, 2, 3, 4, 5}
    assert sorted((r.piece, r.first_token) for r in rows if r.doc_id == 4)[:2] == [(0, 0), (1, 100)]


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 64))
    v = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 64)), base[:2]])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(0, [float(x) for x in v[0]]), (900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64)]
    vectors = neighbours.usable(spark.createDataFrame(rows, "k long, e array<float>"), "k", "e", 64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(len(u)) for j in range(len(u)) if i != j and u[i] @ u[j] >= 0.98}
    assert {(r.id, r.other) for r in neighbours.nearest(vectors).collect()} == want
    monkeypatch.setattr(neighbours, "HOT", 2)
    monkeypatch.setattr(neighbours, "_BLOCK", 2)
    assert {(r.id, r.other) for r in neighbours.nearest(vectors).collect()} == want
    assert neighbours.nearest(vectors.limit(0)).count() == 0


def test_leak_with_three_spread_changes(spark):
    words = "so if it is at an up or by we to on of as he do go in me my no us be am ox add old own far".split()
    for places in ((6, 12, 18), (5, 11, 17), (7, 13, 19)):
        quote = [("zzqj" if i in places else w) for i, w in enumerate(words[:25])]
        got = leakage.find_leaks(spark.createDataFrame([(1, "lead " + " ".join(quote) + " tail")], "doc_id long, text string"), spark.createDataFrame([(9, " ".join(words))], "item_id long, item_text string"))
        assert got.count() == 1
    words = ITEM.split()
    quote = [("quux" if i in (6, 12, 18) else w) for i, w in enumerate(words[:25])]
    items = spark.createDataFrame([(9, ITEM)], "item_id long, item_text string")
    assert leakage.find_leaks(spark.createDataFrame([(1, " ".join(quote))], "doc_id long, text string"), items).count() == 1


def test_spans_are_cut_and_other_scripts_leak(spark):
    cyrillic = " ".join(f"слово{i} вентиль" for i in range(15))
    items = spark.createDataFrame([(9, ITEM), (8, cyrillic)], "item_id long, item_text string")
    docs = spark.createDataFrame([(1, "Kept before. " + ITEM.upper() + " Kept after."), (2, "<b>Kept</b> " + ITEM), (3, "до " + cyrillic.replace("слово3 ", "СЛОВО3 ") + " после"), (4, None), (5, "nothing here")], "doc_id long, text string")
    leaks = leakage.find_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in leaks.collect()} == {(1, 9), (2, 9), (3, 8)}
    assert {r.doc_id for r in leakage.without_leaks(docs, leaks).collect()} == {4, 5}
    got = {r.doc_id: r.text for r in leakage.cleaned(docs, leaks).collect()}
    assert got[1].split() == ["Kept", "before.", "Kept", "after."] and got[2].split() == ["kept"] and got[3].split() == ["до", "после"] and got[4] is None and got[5] == "nothing here"
    assert leakage.find_leaks(leakage.cleaned(docs, leaks), items).count() == 0


def test_leak_beside_a_shorter_excerpt(spark):
    words = ITEM.split()
    changed = words[:]
    changed[6], changed[13], changed[20] = "quux", "quux", "quux"
    filler = " ".join(f"gap{i}" for i in range(100))
    items = spark.createDataFrame([(9, ITEM)], "item_id long, item_text string")
    docs = [(1, " ".join(words[:24]) + f" {filler} " + " ".join(changed[:25])), (2, " ".join(changed[:25]) + f" {filler} " + " ".join(words[:24])), (3, " ".join(words[:24]) + f" {filler} " + " ".join(words[:24]))]
    assert {r.doc_id for r in leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()} == {1, 2}


def test_spam(spark):
    spam = "\n".join(f"SKU {i} blue valve {i}.99 add to cart" for i in range(12))
    patent = "The valve is fitted to the drum by means of a lever. In one embodiment the crate is hinged to the plate, so that the rail remains fixed."
    claims = "\n".join(f"{i}. valve according to claim {i - 1}, wherein the drum {i} holds a lever" for i in range(2, 12))
    docs = spark.createDataFrame([(1, spam, "a"), (2, spam.replace("blue", "red"), "b"), (3, patent, "c"), (4, None, None), (5, "", "a"), (6, "Stub", None), (7, claims, "d"), (8, "x" * 30000, "e"), (1, spam, "a")], "doc_id long, text string, assignee string")
    rows = spam_pages.score_pages(docs.withColumn("is_spam", docs.doc_id)).collect()
    assert {r.doc_id for r in rows if r.is_spam} == {1, 2} and len(rows) == 8
    assert spam_pages.score_pages(docs.limit(0)).count() == 0


def test_stuffing_phrases_by_hosts(spark):
    """A template is stuffing if mostly dense pages use it, however many hosts there are."""
    dense, dressed = "\n".join(["our {0} shop ships every {0} tonight"] * 6), "our {0} shop ships every {0} tonight. our {0} shop ships every {0} tonight. The lever {1} holds the drum in its seat."
    rows = [(i, dense.format("pump"), f"h{i}") for i in range(90)] + [(1000 + i, dressed.format("pump", i), f"g{i}") for i in range(30)]
    plain = [(2000 + i, "\n".join(["any sound {0} of steel turns slowly inside the old {0} crate"] * 5).format("rod"), f"h{i}") for i in range(70)]
    plain += [(3000 + i, f"any sound rod of steel turns slowly inside the old rod crate. Any sound rod of steel turns slowly inside the old rod crate. The lever {i} holds the drum.", f"k{i}") for i in range(300)]
    got = {r.doc_id: r.phrase_share for r in spam_pages.score_pages(spark.createDataFrame(rows + plain, "doc_id long, text string, assignee string")).collect()}
    assert got[1000] > 0 and got[3000] == 0


def test_own_words():
    assert not canonical._own(4, 0.15 * 10) and canonical._own(900, 0.15 * 1000) and not canonical._own(160, 0.15 * 1000)


def test_recall_and_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((80, 64))
    v = np.concatenate([base, base + 0.03 * rng.standard_normal((80, 64))])
    vectors = neighbours.usable(spark.createDataFrame([(f"A-{i:05d}", [float(x) for x in r]) for i, r in enumerate(v)], "k string, e array<float>"), "k", "e", 64)
    r = neighbours.recall_against_blocks(vectors, neighbours.nearest(vectors), vectors.where("id like '%0'")).first()
    assert r.pairs == 16 and r.recall >= 0.9
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {(r.id, r["rank"]): r.other for r in neighbours.exact(vectors.where("id like '%0'"), vectors, 5, part=50).collect()}
    assert all(got[f"A-{i:05d}", k + 1] == f"A-{j:05d}" for i in range(0, 160, 10) for k, j in enumerate(np.argsort(-s[i])[:5]))
