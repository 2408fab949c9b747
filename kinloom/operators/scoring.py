"""Explainable pair scores: signals per field, fusion by renormalised weights, candidates and top-k.

A score orders pairs for human review; it never claims identity. A missing field abstains (weight 0).

Text similarities are computed once for each distinct pair of values and joined back, so their Python runs
over values and not over pairs; everything else is a Column expression. ``profile="portable"`` is the
second scorer: Metaphone alone, names keyed with digits after stripping marks, token-sort ratios, signals
rounded before they are fused.

Defined results: null and blank fields abstain; a null record id gives no pair; repeated records count
once; without pairs there is no row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions import dates, names
from kinloom.operators import vectors
from kinloom.session import cut

# Weight of a signal, damping of a sex conflict, ceiling of a pair that only faces support.
WEIGHTS = {"face": 0.30, "name": 0.25, "family": 0.15, "birth_date": 0.10, "origin_place": 0.09, "last_seen_place": 0.06, "nationality": 0.05}
SEX_DAMPING, FACE_CEILING = 0.55, 39.0
LABELS = {"face": "Facial similarity", "name": "Name", "family": "Family members", "birth_date": "Birth date", "origin_place": "Place of origin", "last_seen_place": "Last seen", "nationality": "Nationality"}
# Relations of one group count as nearly the same.
RELATIONS = {
    "parent": "mother father parent guardian", "child": "son daughter child", "sibling": "brother sister sibling",
    "spouse": "spouse wife husband", "extended": "aunt uncle cousin grandparent",
}
_GROUP = {r: g for g, rs in RELATIONS.items() for r in rs.split()}
BANDS = ((80, "strong"), (60, "possible"), (40, "weak"))
OPEN_NATIONALITIES = ("stateless", "undetermined", "not established")
NOTICE = "A potential match score says how soon people should look at these records; it does not confirm an identity."
SWAP_NOTES = {("origin_place", "last_seen_place"): "origin of A is where B was last seen", ("last_seen_place", "origin_place"): "A was last seen at the origin of B"}
HOT = 2_000  # rows of a block beside which the other side is split


def status(score: Column) -> Column:
    return F.when(score >= 85, "strong").when(score >= 65, "partial").otherwise("weak")


def band(score: Column) -> Column:
    out = F.lit("unlikely")
    for least, label in reversed(BANDS):
        out = F.when(score >= least, label).otherwise(out)
    return out


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _by_values(pairs: DataFrame, base: DataFrame, a: str, b: str, score, out: str) -> DataFrame:
    """``out = score(a, b)`` on ``pairs``, computed once for each distinct pair of values of ``base``."""
    values = base.select(F.col(a).alias("_x"), F.col(b).alias("_y")).where("_x is not null and _y is not null").distinct().withColumn(out, score(F.col("_x"), F.col("_y")))
    return pairs.join(values, (F.col(a) == F.col("_x")) & (F.col(b) == F.col("_y")), "left").drop("_x", "_y")


def relation_group(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in _GROUP.items() for x in kv)), F.lower(F.trim(c)))


def relation_agreement(a: Column, b: Column) -> Column:
    x, y = relation_group(a), relation_group(b)
    return F.when(x.isNull() | y.isNull(), 0.85).when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0).when(x == y, 0.94).otherwise(0.55)


def aliases(entries: DataFrame, key: str, forms: list[Column]) -> DataFrame:
    """``alias, cluster``: normalised spellings of entries that name one entry only."""
    spelled = entries.select(F.col(key).alias("cluster"), F.explode(F.array_compact(F.flatten(F.array(*forms)))).alias("alias")).withColumn("alias", names.normalise_place(F.col("alias")))
    one = spelled.where("alias <> ''").groupBy("alias").agg(F.min("cluster").alias("cluster"), F.countDistinct("cluster").alias("n"))
    return one.where("n = 1").drop("n")


def block_keys(records: DataFrame) -> DataFrame:
    """``record_id, block``: one row a key of ``block_lists``."""
    return block_lists(records).select("record_id", F.explode("blocks").alias("block"))


def block_lists(records: DataFrame) -> DataFrame:
    """``record_id, blocks``: sounds of the names (either order), and either name's sound beside a year of birth, a place or a relative."""
    records = records.select("record_id", "family_members", "origin_place", "last_seen_place", dates.date_window("birth_date_raw").alias("_w"), *(F.soundex(names.clean_name(F.col(f"{n}_name"))).alias(f"_{n}") for n in ("given", "family")))
    g, f = F.col("_given"), F.col("_family")
    years = F.when(F.col("_w").isNotNull(), F.sequence(F.year("_w.lo"), F.year("_w.hi")))
    places = F.array_compact(F.array(*(F.when(p != "", p) for p in (names.normalise_place(F.col("origin_place")), names.normalise_place(F.col("last_seen_place"))))))
    kin = F.transform(F.filter("family_members", lambda m: names.clean_name(m["name"]) != ""), lambda m: F.soundex(names.clean_name(m["name"])))
    both = F.when((g != "") & (f != ""), F.array(F.concat(F.lit("n"), F.least(g, f), F.greatest(g, f))))

    def beside_each(part: Column, tag: str, others: Column) -> Column:
        return F.when(part != "", F.transform(others.cast("array<string>"), lambda x: F.concat(F.lit(tag), part, x)))

    beside = [beside_each(part, tag, others) for part in (g, f) for tag, others in (("y", years), ("p", places), ("k", kin))]
    return records.select("record_id", F.array_distinct(F.flatten(F.array_compact(F.array(both, *beside)))).alias("blocks"))


def candidate_pairs(a: DataFrame, b: DataFrame, mode: str = "blocked", hot: int = HOT) -> DataFrame:
    """``a_record_id, b_record_id``: all of A by all of B (``exhaustive``, for bounded registries), or those that share a block key.

    A block with more than ``hot`` rows of B is split into parts, each of which meets every A row of the block.
    """
    a, b = a.where("record_id is not null"), b.where("record_id is not null")
    if mode == "exhaustive":
        return a.select(F.col("record_id").alias("a_record_id")).crossJoin(b.select(F.col("record_id").alias("b_record_id")))
    x, y = block_keys(a).toDF("a_record_id", "block"), block_keys(b).toDF("b_record_id", "block")
    parts = y.groupBy("block").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts"))
    x = x.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    y = y.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("b_record_id"), "parts").cast("int"))
    return x.join(y, ["block", "part"]).select("a_record_id", "b_record_id").distinct()


def family_score(rows: list | None, other: list | None, score=names.name_score) -> tuple[float, float]:
    """Greedy one-to-one assignment of relatives by name and relation; ``(score, weight)``."""
    mine = [(r["name"].replace(" ", ""), (r["relation"] or "").strip().lower()) for r in (rows if rows is not None else []) if r["name"] and r["name"].strip()]
    theirs = [(r["name"].replace(" ", ""), (r["relation"] or "").strip().lower()) for r in (other if other is not None else []) if r["name"] and r["name"].strip()]
    if not mine or not theirs:
        return 0.0, 0.0

    def agree(x: str, y: str) -> float:
        p, q = _GROUP.get(x), _GROUP.get(y)
        return 0.85 if p is None or q is None else 1.0 if x == y else 0.94 if p == q else 0.55

    scored = sorted(((score(n, m)[0] * agree(r, s), i, j) for i, (n, r) in enumerate(mine) for j, (m, s) in enumerate(theirs)), key=lambda x: -x[0])
    used_a, used_b, chosen = set(), set(), []
    for s, i, j in scored:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            chosen.append(s)
    return 0.75 * chosen[0] + 0.25 * sum(chosen) / len(chosen), 1.0 if len(mine) == len(theirs) else 0.8


_FAMILY = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("weight", T.DoubleType())])


def _family_udf(score=names.name_score):
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([family_score(x, y, score) for x, y in zip(a, b)], columns=["score", "weight"])

    return F.pandas_udf(run, _FAMILY)


def face_similarities(pairs: DataFrame, faces: DataFrame, mean: Column | float = vectors.MEAN, sd: Column | float = vectors.SD) -> DataFrame:
    """``a_record_id, b_record_id, face_score``, one place, of the pairs whose records both have a vector (``record_id, v``)."""
    one, two = (faces.select(F.col("record_id").alias(f"{s}_record_id"), F.col("v").alias(f"{s}_v")) for s in "ab")
    met = pairs.select("a_record_id", "b_record_id").join(one, "a_record_id").join(two, "b_record_id")
    return met.select("a_record_id", "b_record_id", F.bround(vectors.calibrated(vectors.cosine(F.col("a_v"), F.col("b_v")), mean, sd), 1).alias("face_score"))


FIELDS = ["given_name", "family_name", "sex", "birth_date_raw", "origin_place", "last_seen_place", "nationality", "family_members"]


def prepared(records: DataFrame, side: str, places: DataFrame | None, nations: DataFrame | None) -> DataFrame:
    """A registry with everything that is read once a record: windows, normalised texts, clusters of aliases."""
    r = records.where("record_id is not null").dropDuplicates(["record_id"]).select(
        "record_id", *FIELDS, dates.date_window("birth_date_raw").alias("window"),
        *(names.normalise_place(F.col(c)).alias(f"{c}_n") for c in ("origin_place", "last_seen_place")),
        F.lower(F.trim(F.coalesce("nationality", F.lit("")))).alias("nationality_n"),
    )
    for c, known in (("origin_place", places), ("last_seen_place", places), ("nationality", nations)):
        if known is None:
            r = r.withColumn(f"{c}_c", F.lit(None).cast("string"))
        else:
            text = names.normalise_place(F.col("nationality")) if c == "nationality" else F.col(f"{c}_n")
            r = r.withColumn("_t", text).join(known.select(F.col("alias").alias("_t"), F.col("cluster").cast("string").alias(f"{c}_c")), "_t", "left").drop("_t")
    return r.select(*(F.col(c).alias(f"{side}_{c}") for c in r.columns))


def place_signal(x: Column, y: Column, cx: Column, cy: Column, fuzzy: Column) -> tuple[Column, Column, Column]:
    """Score, weight and method of two normalised places with their clusters and fuzzy score."""
    none, same, alias = (x == "") | (y == ""), x == y, F.coalesce(cx == cy, F.lit(False))
    score = F.when(none, 0.0).when(same, 100.0).when(alias, 97.0).otherwise(fuzzy)
    weight = F.when(none, 0.0).when(same | alias | (fuzzy >= 80), 1.0).otherwise(0.7)
    return score, weight, F.when(none, "unavailable").when(same, "exact").when(alias, "gazetteer-alias").otherwise("fuzzy")


def nationality_signal(x: Column, y: Column, cx: Column, cy: Column, fuzzy: Column) -> tuple[Column, Column, Column]:
    """Like ``place_signal``; entries that differ are no evidence either way."""
    none = x.isin("", *OPEN_NATIONALITIES) | y.isin("", *OPEN_NATIONALITIES)
    same, alias = x == y, F.coalesce(cx == cy, F.lit(False))
    score = F.when(none, 0.0).when(same, 100.0).when(alias, 97.0).when(fuzzy < 70, 50.0).otherwise(fuzzy)
    weight = F.when(none, 0.0).when(same | alias, 1.0).when(fuzzy < 70, 0.35).otherwise(0.8)
    return score, weight, F.when(none, "unavailable").when(same, "exact").when(alias, "known-equivalent").otherwise("fuzzy")


def name_signal(p: DataFrame) -> DataFrame:
    """``s_name, w_name, name_method`` from the four part scores ``gg, ff, gf, fg`` (score, coded)."""
    part = lambda c: F.coalesce(F.col(f"{c}.score"), F.lit(0.0))
    straight, swapped = (part("gg") + part("ff")) / 2, (part("gf") + part("fg")) / 2
    swap = (swapped > straight + 12) & (swapped >= 65)
    letters = {f"{s}{n}": names.clean_name(F.col(f"{s}_{n}_name")) != "" for s in "ab" for n in ("given", "family")}
    no_name = ~(letters["agiven"] | letters["afamily"]) | ~(letters["bgiven"] | letters["bfamily"])
    whole = letters["agiven"] & letters["afamily"] & letters["bgiven"] & letters["bfamily"]
    coded = F.coalesce(F.col("gg.coded"), F.lit(False)) | F.coalesce(F.col("ff.coded"), F.lit(False))
    return p.withColumns(
        {
            "s_name": F.when(no_name, 0.0).when(swap, swapped * 0.96).otherwise(straight),
            "w_name": F.when(no_name, 0.0).when(whole, 1.0).otherwise(0.6),
            "name_method": F.when(no_name, "unavailable").when(swap, "name-order-swap").when(coded, "phonetic").otherwise("edit-distance"),
        }
    )


def score_pairs(
    pairs: DataFrame, a: DataFrame, b: DataFrame, faces: DataFrame | None = None, places: DataFrame | None = None,
    nations: DataFrame | None = None, profile: str = "reference",
) -> DataFrame:
    """Signals, fused score, band, coverage, notes and flags of ``a_record_id, b_record_id``.

    ``faces``: ``a_record_id, b_record_id, face_score`` where both have a vector. ``places`` and ``nations``:
    ``alias, cluster`` (see ``aliases``). Columns of other names in ``a`` and ``b`` play no part.
    """
    portable = profile == "portable"
    p = pairs.select("a_record_id", "b_record_id")
    for side, t in (("a", a), ("b", b)):
        p = p.join(prepared(t, side, places, nations), f"{side}_record_id")
    p = base = cut(p)  # the value tables below all read it
    part_score = names.portable_name_udf if portable else names.name_score_udf
    for x, y, out in (("given", "given", "gg"), ("family", "family", "ff"), ("given", "family", "gf"), ("family", "given", "fg")):
        p = _by_values(p, base, f"a_{x}_name", f"b_{y}_name", part_score, out)
    p = name_signal(p)
    s, w = dates.birth_signal(F.col("a_window"), F.col("b_window"))
    exact = (F.col("a_window")["precision"] == "day") & (F.col("b_window")["precision"] == "day")
    p = p.withColumn("s_birth_date", s).withColumn("w_birth_date", w).withColumn("birth_date_method", F.when(w == 0, "unavailable").when(exact, "exact-date").otherwise("tolerance-window"))
    for f in ("origin_place", "last_seen_place"):
        p = _by_values(p, base, f"a_{f}_n", f"b_{f}_n", names.portable_place_udf if portable else names.place_udf, "_s")
        s, w, m = place_signal(*(F.col(f"{x}_{f}_{k}") for k in "nc" for x in "ab"), F.coalesce("_s", F.lit(0.0)))
        p = p.withColumns({f"s_{f}": s, f"w_{f}": w, f"{f}_method": m}).drop("_s")
    fuzzy = (lambda u, v: names.indel_udf(u, v)) if portable else (lambda u, v: F.greatest(names.token_set_udf(u, v), 100 * names.jaro_winkler_udf(u, v)))
    p = _by_values(p, base, "a_nationality_n", "b_nationality_n", fuzzy, "_s")
    s, w, m = nationality_signal(*(F.col(f"{x}_nationality_{k}") for k in "nc" for x in "ab"), F.coalesce("_s", F.lit(0.0)))
    p = p.withColumns({"s_nationality": s, "w_nationality": w, "nationality_method": m}).drop("_s")
    p = _by_values(p, base, "a_family_members", "b_family_members", _family_udf(names.portable_name if portable else names.name_score), "_f")
    p = p.withColumns({"s_family": F.coalesce("_f.score", F.lit(0.0)), "w_family": F.coalesce("_f.weight", F.lit(0.0))}).drop("_f")
    p = p.join(faces.select("a_record_id", "b_record_id", "face_score"), ["a_record_id", "b_record_id"], "left") if faces is not None else p.withColumn("face_score", F.lit(None).cast("double"))
    face_weight = F.when(F.col("face_score").isNull(), 0.0).when(F.col("face_score") >= 55, 1.0).otherwise(0.25 + 0.75 * F.col("face_score") / 55)
    p = p.withColumns({"s_face": F.coalesce("face_score", F.lit(0.0)), "w_face": F.round(face_weight, 2) if portable else face_weight})
    a_sex, b_sex = (F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in ("a_sex", "b_sex"))
    if portable:
        a_sex, b_sex = F.substring(a_sex, 1, 1), F.substring(b_sex, 1, 1)
        p = p.withColumns({f"s_{f}": F.round(f"s_{f}", 1) for f in WEIGHTS})
    p = p.withColumn("sex_conflict", (a_sex != "") & (b_sex != "") & (a_sex != b_sex))
    return explained(fuse(p))


def fuse(p: DataFrame) -> DataFrame:
    """``score, band, evidence_coverage, ...`` from ``s_*``, ``w_*`` and ``sex_conflict``."""
    mass = sum((F.col(f"w_{f}") * v for f, v in WEIGHTS.items()), F.lit(0.0))
    gain = sum((F.col(f"s_{f}") * F.col(f"w_{f}") * v for f, v in WEIGHTS.items()), F.lit(0.0))
    others = sum((F.col(f"w_{f}") * v for f, v in WEIGHTS.items() if f != "face"), F.lit(0.0))
    p = p.withColumn("_mass", mass).withColumn("_gain", gain).withColumn("_others", others)
    raw = F.coalesce(F.try_divide("_gain", "_mass"), F.lit(0.0)) * F.least(F.lit(1.0), 0.55 + 0.5 * F.col("_mass") / sum(WEIGHTS.values()))
    raw = raw * F.when(F.col("sex_conflict"), SEX_DAMPING).otherwise(1.0)
    face_only = (F.col("_others") <= 1e-9) & (F.col("w_face") > 0)
    p = p.withColumn("_full", raw).withColumn("face_only", face_only).withColumn("_raw", F.when(face_only, F.least("_full", F.lit(FACE_CEILING))).otherwise(F.col("_full")))
    return p.withColumns(
        {
            "score": F.bround("_raw", 1), "band": band(F.col("_raw")), "evidence_coverage": F.bround(F.col("_mass") / sum(WEIGHTS.values()), 2),
            "surfaced_because": surfaced(F.col("_mass")),
            "flags": F.array_compact(F.array(F.when(F.col("sex_conflict"), "sex recorded differently"), F.when(face_only & (F.col("_full") > FACE_CEILING), "faces alone support the pair: score capped"))),
            "face_similarity": F.when(F.col("w_face") > 0, F.bround("s_face", 1)), "review_required": F.lit(True), "notice": F.lit(NOTICE),
        }
    ).drop("_mass", "_gain", "_others", "_raw", "_full")


def surfaced(mass: Column) -> Column:
    """The signals that carried a pair, strongest first: ``array<struct<field, label, score, contribution>>``."""
    rows = []
    for i, (f, v) in enumerate(WEIGHTS.items()):
        gain = F.col(f"s_{f}") * F.col(f"w_{f}") * v
        row = F.struct((-gain).alias("k"), F.lit(i).alias("i"), F.lit(f).alias("field"), F.lit(LABELS[f]).alias("label"), F.bround(f"s_{f}", 0).alias("score"), F.bround(gain / F.greatest(mass, F.lit(1e-9)), 3).alias("contribution"))
        rows.append(F.when((F.col(f"w_{f}") > 0) & (F.col(f"s_{f}") >= 65), row))
    return F.transform(F.array_sort(F.array_compact(F.array(*rows))), lambda x: F.struct(x["field"].alias("field"), x["label"].alias("label"), x["score"].alias("score"), x["contribution"].alias("contribution")))


def explained(p: DataFrame) -> DataFrame:
    """``signals`` (one struct a field, rounded for reading), ``cross_notes`` and a sentence made of them."""
    shown = {"name": lambda s: F.trim(F.concat_ws(" ", F.coalesce(f"{s}_given_name", F.lit("")), F.coalesce(f"{s}_family_name", F.lit(""))))}
    shown["family"] = lambda s: F.array_join(F.transform(F.filter(f"{s}_family_members", lambda m: F.trim(F.coalesce(m["name"], F.lit(""))) != ""), lambda m: F.concat(m["name"], F.lit(" ("), F.coalesce(m["relation"], F.lit("?")), F.lit(")"))), "; ")
    shown["birth_date"] = lambda s: F.col(f"{s}_birth_date_raw")
    shown["face"] = lambda s: F.when(F.col("w_face") > 0, F.concat(F.lit("photograph of "), F.col(f"{s}_record_id")))
    rows = []
    for f in WEIGHTS:
        s, w = F.col(f"s_{f}"), F.col(f"w_{f}")
        value = shown.get(f, lambda side, f=f: F.col(f"{side}_{f}"))
        method = F.col(f"{f}_method") if f"{f}_method" in p.columns else F.when(w == 0, "unavailable").otherwise("greedy-assignment" if f == "family" else "calibrated-cosine")
        conflict = (s < 40) & (F.lit(f) == "birth_date")
        rows.append(F.struct(
            F.lit(f).alias("field"), F.lit(LABELS[f]).alias("label"), F.bround(s, 0).alias("score"), F.bround(w, 2).alias("weight"),
            *(F.when(_blank(value(x)), "—").otherwise(value(x)).alias(f"{x}_value") for x in "ab"),
            F.when(w == 0, "unavailable").when(conflict, "conflict").otherwise(status(s)).alias("status"), method.alias("method"),
        ))
    notes = []
    for (x, y), text in SWAP_NOTES.items():
        u, v = F.col(f"a_{x}_n"), F.col(f"b_{y}_n")
        strong = (F.col(f"w_{x}") > 0) & (F.col(f"s_{x}") >= 85)
        notes.append(F.when(~strong & (u != "") & (v != "") & ((u == v) | F.coalesce(F.col(f"a_{x}_c") == F.col(f"b_{y}_c"), F.lit(False))), text))
    p = p.withColumns({"signals": F.array(*rows), "cross_notes": F.array_compact(F.array(*notes))})
    reasons = F.array_join(F.transform("surfaced_because", lambda r: F.concat(r["label"], F.lit(" "), r["score"].cast("int").cast("string"), F.lit(" %"))), ", ")
    text = F.concat(F.lit("Priority "), F.format_string("%.1f", F.col("score")), F.lit(" ("), F.col("band"), F.lit("). "), F.when(reasons == "", "Nothing stands out.").otherwise(F.concat(F.lit("Carried by: "), reasons, F.lit("."))), F.lit(" "), F.col("notice"))
    return p.withColumn("explanation", text)


def top_candidates(scored: DataFrame, n: int = 3, floor: float = 25.0) -> DataFrame:
    """The ``n`` best of every A record at ``floor`` or more; ties go to the smaller B id."""
    order = Window.partitionBy("a_record_id").orderBy(F.desc("score"), "b_record_id")
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= n) & (F.col("score") >= floor))


SHOWN = ("b_record_id", "rank", "score", "band", "evidence_coverage", "signals", "flags", "cross_notes", "surfaced_because", "face_similarity", "review_required", "notice")


def match_all(a: DataFrame, ranked: DataFrame) -> DataFrame:
    """``a_record_id, candidates``: one row a record of A, its list empty where nothing was found."""
    lists = ranked.groupBy("a_record_id").agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in SHOWN if c != "rank")))).alias("candidates"))
    ids = a.where("record_id is not null").select(F.col("record_id").alias("a_record_id")).distinct()
    both = ids.join(lists, "a_record_id", "left")
    return both.withColumn("candidates", F.coalesce("candidates", F.filter("candidates", lambda x: F.lit(False)), F.array().cast(lists.schema["candidates"].dataType)))
