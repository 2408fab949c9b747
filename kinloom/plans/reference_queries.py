"""Queries of the record-linkage surface, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import dates, names
from kinloom.operators import evaluation, geo, ranking, review, scoring, vectors
from kinloom.operators.synth import place_entries, registries
from kinloom.sources import registry
from kinloom.session import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _records(spark, d, name="registry_a"):
    return table(spark, d, name).drop("received_at").dropDuplicates(["record_id"])


_A = "(SELECT DISTINCT ON (record_id) * FROM registry_a)"
_B = "(SELECT DISTINCT ON (record_id) * FROM registry_b)"
_NUM = "CAST(substr(record_id, 3) AS BIGINT)"


def _number():
    return F.substring("record_id", 3, 20).cast("long")


@query("SELECT (SELECT count(DISTINCT record_id) FROM registry_a) AS a_records, (SELECT count(DISTINCT record_id) FROM registry_b) AS b_records, (SELECT count(DISTINCT record_id) FROM registry_a) * (SELECT count(DISTINCT record_id) FROM registry_b) AS comparisons")
def corpus_meta(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).agg(F.countDistinct("record_id").alias(c)) for t, c in (("registry_a", "a_records"), ("registry_b", "b_records")))
    return a.crossJoin(b).withColumn("comparisons", F.col("a_records") * F.col("b_records"))


_JOINED = "lower(concat_ws(' ', coalesce(record_id,''), coalesce(given_name,''), coalesce(family_name,''), coalesce(nationality,''), coalesce(origin_place,''), coalesce(last_seen_place,''), coalesce(source_org,'')))"


@query(f"SELECT record_id, source_org FROM {_A} WHERE contains({_JOINED}, 'relief desk')")
def registry_search(spark, d):
    return registry.search(_records(spark, d), " Relief Desk ").select("record_id", "source_org")


@query(f"SELECT record_id, (SELECT count(*) FROM {_A} WHERE contains({_JOINED}, 'harbour')) AS total, (SELECT count(*) FROM {_A} WHERE contains({_JOINED}, 'harbour')) > 60 AS truncated FROM {_A} WHERE contains({_JOINED}, 'harbour') ORDER BY record_id LIMIT 60")
def search_page(spark, d):
    return registry.page(registry.search(_records(spark, d), "harbour"), 60, "record_id").select("record_id", "total", "truncated")


@query(f"SELECT record_id, array_to_string(list_transform(coalesce(family_members, []), lambda m: concat(coalesce(m.relation,''), ': ', coalesce(m.name,''))), '; ') AS family FROM {_A}")
def csv_flatten(spark, d):
    return _records(spark, d).select("record_id", registry.flatten_family(F.col("family_members")).alias("family"))


@query(f"SELECT record_id, m.name AS name, m.relation AS relation FROM (SELECT record_id, unnest(family_members) AS m FROM {_A})")
def relatives_exploded(spark, d):
    return _records(spark, d).select("record_id", F.explode("family_members").alias("m")).select("record_id", "m.name", "m.relation")


@query(f"SELECT record_id, regexp_replace(lower(coalesce(given_name,'')), '[^a-z]', '', 'g') AS given, trim(regexp_replace(lower(coalesce(origin_place,'')), '[^a-z0-9]+', ' ', 'g')) AS origin FROM {_A}")
def cleaned_fields(spark, d):
    return _records(spark, d).select("record_id", names.clean_name(F.col("given_name")).alias("given"), names.normalise_place(F.col("origin_place")).alias("origin"))


@query("WITH v AS (SELECT DISTINCT regexp_replace(lower(given_name), '[^a-z]', '', 'g') AS x, regexp_replace(lower(family_name), '[^a-z]', '', 'g') AS y FROM registry_a) SELECT x, y, round(100 * jaro_winkler_similarity(x, y), 4) AS similarity FROM v WHERE x <> '' AND y <> ''")
def jaro_winkler(spark, d):
    v = table(spark, d, "registry_a").select(names.clean_name(F.col("given_name")).alias("x"), names.clean_name(F.col("family_name")).alias("y")).distinct().where("x <> '' and y <> ''")
    return v.withColumn("similarity", F.round(100 * names.jaro_winkler_udf("x", "y"), 4))


def _lcs(x: str, y: str) -> str:
    """Length of the longest common subsequence of two SQL expressions, a row of the table at a time."""
    cell = f"greatest(list_extract(acc, -1), list_extract(prev, j + 1), list_extract(prev, j) + CASE WHEN substr({y}, j, 1) = c THEN 1 ELSE 0 END)"
    row = f"list_reduce(range(1, length({y}) + 1), lambda acc, j: list_append(acc, {cell}), [CAST(0 AS BIGINT)])"
    return f"list_extract(list_reduce(string_split({x}, ''), lambda prev, c: {row}, list_transform(range(0, length({y}) + 1), lambda z: CAST(0 AS BIGINT))), -1)"


def _indel(x: str, y: str) -> str:
    return f"CASE WHEN length({x}) = 0 AND length({y}) = 0 THEN 100.0 WHEN length({x}) = 0 OR length({y}) = 0 THEN 0.0 ELSE 200.0 * {_lcs(x, y)} / (length({x}) + length({y})) END"


def _token_parts(source: str) -> str:
    """``x, y`` of ``source`` with their shared words ``b`` and these with either rest, ``p`` and ``q``."""
    rest = lambda u, v: f"list_sort(list_filter(list_distinct(string_split({u}, ' ')), lambda w: NOT list_contains(string_split({v}, ' '), w)))"
    parts = f"SELECT *, array_to_string(list_sort(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(y, ' ')))), ' ') AS b, array_to_string({rest('x', 'y')}, ' ') AS ra, array_to_string({rest('y', 'x')}, ' ') AS rb FROM {source}"
    return f"SELECT *, trim(concat(b, ' ', ra)) AS p, trim(concat(b, ' ', rb)) AS q FROM ({parts})"


_TOKEN_SET = f"CASE WHEN x = '' OR y = '' THEN 0.0 WHEN b <> '' AND (ra = '' OR rb = '') THEN 100.0 ELSE greatest({_indel('p', 'q')}, CASE WHEN b <> '' THEN greatest({_indel('b', 'p')}, {_indel('b', 'q')}) ELSE 0.0 END) END"
_SORTED = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"
_PLACE = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH v AS (SELECT DISTINCT {_PLACE('origin_place')} AS x, {_PLACE('last_seen_place')} AS y FROM registry_a), t AS ({_token_parts('v')}), s AS (SELECT *, {_SORTED('x')} AS xs, {_SORTED('y')} AS ys FROM t) SELECT x, y, round({_indel('x', 'y')}, 4) AS indel, round({_TOKEN_SET}, 4) AS token_set, round({_indel('xs', 'ys')}, 4) AS token_sort FROM s")
def indel_and_token_ratios(spark, d):
    v = table(spark, d, "registry_a").select(names.normalise_place(F.col("origin_place")).alias("x"), names.normalise_place(F.col("last_seen_place")).alias("y")).distinct()
    return v.select("x", "y", F.round(names.indel_udf("x", "y"), 4).alias("indel"), F.round(names.token_set_udf("x", "y"), 4).alias("token_set"), F.round(names.token_sort_udf("x", "y"), 4).alias("token_sort"))


@query()
def phonetic_codes(spark, d):
    v = table(spark, d, "registry_a").select(names.clean_name(F.col("family_name")).alias("name")).distinct()
    return v.select("name", names.metaphone_udf("name").alias("metaphone"), names.nysiis_udf("name").alias("nysiis"), F.soundex("name").alias("soundex"))


def _window_sql(col: str) -> str:
    """The ladder of date windows as SQL over a column."""
    m = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
    t = f"lower(trim(coalesce({col}, ''), ' '))"
    g = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    approx, age = r"^(?:approx[.]?|c[.]?|circa|ca[.]?)\s*([0-9]{4})$", r"^age\s*(?:approx[.]?)?\s*([0-9]{1,3})$"
    iso, num, y4 = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$", r"^([0-9]{4})$"
    long, my = rf"^({m})\s+([0-9]{{1,2}}),\s*([0-9]{{4}})$", rf"^({m})\s+([0-9]{{4}})$"
    is_ = lambda p: f"regexp_matches({t}, '{p}')"
    day = lambda y, mo, dd: f"try_cast(concat(lpad({y},4,'0'),'-',lpad(CAST({mo} AS VARCHAR),2,'0'),'-',lpad({dd},2,'0')) AS DATE)"
    mon = lambda p: f"CAST((position(substr({g(p, 1)},1,3) IN 'janfebmaraprmayjunjulaugsepoctnovdec')+2)//3 AS VARCHAR)"
    year = lambda y, k: (f"make_date(CAST({y} AS INT)-{k},1,1)", f"make_date(CAST({y} AS INT)+{k},12,31)")
    whole, dm, md = day(g(iso, 1), g(iso, 2), g(iso, 3)), day(g(num, 3), g(num, 2), g(num, 1)), day(g(num, 3), g(num, 1), g(num, 2))
    named, first = day(g(long, 3), mon(long), g(long, 2)), day(g(my, 2), mon(my), "'1'")
    w = lambda lo, hi, p: f"CASE WHEN {lo} IS NOT NULL THEN struct_pack(lo := {lo}, hi := {hi}, precision := '{p}') END"
    return (
        f"CASE WHEN {is_(approx)} THEN {w(*year(g(approx, 1), 1), 'approx-year')} WHEN {is_(age)} THEN {w(*year(f'(2026-CAST({g(age, 1)} AS INT))', 1), 'approx-year')} "
        f"WHEN {is_(iso)} THEN CASE WHEN {whole} IS NOT NULL THEN {w(whole, whole, 'day')} ELSE {w(*year(g(iso, 1), 0), 'year')} END "
        f"WHEN {is_(num)} THEN CASE WHEN {dm} IS NOT NULL AND {md} IS NOT NULL THEN {w(f'least({dm},{md})', f'greatest({dm},{md})', 'month')} "
        f"WHEN {dm} IS NOT NULL OR {md} IS NOT NULL THEN {w(f'coalesce({dm},{md})', f'coalesce({dm},{md})', 'day')} ELSE {w(*year(g(num, 3), 0), 'year')} END "
        f"WHEN {is_(long)} THEN {w(named, named, 'day')} WHEN {is_(my)} THEN {w(first, f'last_day({first})', 'month')} WHEN {is_(y4)} THEN {w(*year(g(y4, 1), 0), 'year')} END"
    )


@query(f"SELECT record_id, w.lo AS lo, w.hi AS hi, w.precision AS precision FROM (SELECT record_id, {_window_sql('birth_date_raw')} AS w FROM {_A})")
def date_windows(spark, d):
    return _records(spark, d).select("record_id", dates.date_window("birth_date_raw").alias("w")).select("record_id", "w.lo", "w.hi", "w.precision")


_PAIRS = "(SELECT DISTINCT a_record_id, b_record_id FROM review_decisions WHERE a_record_id IS NOT NULL AND b_record_id IS NOT NULL)"
_WEIGHT = lambda w: f"CASE {w}.precision WHEN 'day' THEN 1.0 WHEN 'month' THEN 0.85 WHEN 'year' THEN 0.7 WHEN 'approx-year' THEN 0.58 END"
_MID = lambda w: f"({w}.lo + CAST(floor(({w}.hi - {w}.lo) / 2) AS INT))"


def _reviewed(spark, d, *cols):
    pairs = table(spark, d, "review_decisions").select("a_record_id", "b_record_id").where("a_record_id is not null and b_record_id is not null").distinct()
    for side in "ab":
        r = _records(spark, d, f"registry_{side}").select(F.col("record_id").alias(f"{side}_record_id"), *(F.col(c).alias(f"{side}_{c}") for c in cols))
        pairs = pairs.join(r, f"{side}_record_id")
    return pairs


@query(
    f"WITH a AS (SELECT record_id, {_window_sql('birth_date_raw')} AS w FROM {_A}), b AS (SELECT record_id, {_window_sql('birth_date_raw')} AS w FROM {_B}), "
    f"p AS (SELECT a_record_id, b_record_id, a.w AS x, b.w AS y FROM {_PAIRS} JOIN a ON a.record_id = a_record_id JOIN b ON b.record_id = b_record_id) "
    f"SELECT a_record_id, b_record_id, CASE WHEN x IS NULL OR y IS NULL THEN 0.0 WHEN x.lo <= y.hi AND y.lo <= x.hi THEN 100.0 ELSE round(100 * pow(0.5, abs({_MID('x')} - {_MID('y')}) / CASE WHEN x.precision='day' AND y.precision='day' THEN 120.0 ELSE 400.0 END), 6) END AS score, "
    f"CASE WHEN x IS NULL OR y IS NULL THEN 0.0 ELSE CAST(least({_WEIGHT('x')}, {_WEIGHT('y')}) AS DOUBLE) END AS weight FROM p"
)
def birth_date_signal(spark, d):
    p = _reviewed(spark, d, "birth_date_raw").withColumn("x", dates.date_window("a_birth_date_raw")).withColumn("y", dates.date_window("b_birth_date_raw"))
    s, w = dates.birth_signal(F.col("x"), F.col("y"))
    return p.select("a_record_id", "b_record_id", F.round(s, 6).alias("score"), w.alias("weight"))


@query(f"WITH w AS (SELECT record_id, {_window_sql('birth_date_raw')} AS w FROM {_A}) SELECT record_id, source_org FROM w JOIN source_desks ON opened_on BETWEEN w.lo AND w.hi")
def date_overlap_join(spark, d):
    """Windows and days meet by year, so the join has an equality to hash on."""
    w = _records(spark, d).select("record_id", dates.date_window("birth_date_raw").alias("w")).where("w is not null")
    w = w.withColumn("y", F.explode(F.sequence(F.year("w.lo"), F.year("w.hi"))))
    desks = table(spark, d, "source_desks").select("source_org", "opened_on", F.year("opened_on").alias("y"))
    return w.join(desks, "y").where("opened_on between w.lo and w.hi").select("record_id", "source_org")


@query(f"SELECT a_record_id, b_record_id, upper(trim(coalesce(a.sex,''))) <> '' AND upper(trim(coalesce(b.sex,''))) <> '' AND upper(trim(coalesce(a.sex,''))) <> upper(trim(coalesce(b.sex,''))) AS conflict FROM {_PAIRS} JOIN {_A} a ON a.record_id = a_record_id JOIN {_B} b ON b.record_id = b_record_id")
def sex_flag(spark, d):
    x, y = (F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in ("a_sex", "b_sex"))
    return _reviewed(spark, d, "sex").select("a_record_id", "b_record_id", ((x != "") & (y != "") & (x != y)).alias("conflict"))


_GROUPS = "CASE " + " ".join(f"WHEN r IN ({', '.join(repr(x) for x in v.split())}) THEN '{g}'" for g, v in scoring.RELATIONS.items()) + " END"


@query(f"WITH v AS (SELECT DISTINCT lower(trim(m.relation)) AS r FROM (SELECT unnest(family_members) AS m FROM registry_b) WHERE m.relation IS NOT NULL), g AS (SELECT r, {_GROUPS} AS g FROM v) SELECT x.r AS one, y.r AS two, CAST(CASE WHEN x.g IS NULL OR y.g IS NULL THEN 0.85 WHEN x.r = y.r THEN 1.0 WHEN x.g = y.g THEN 0.94 ELSE 0.55 END AS DOUBLE) AS agreement FROM g x, g y")
def relation_agreement(spark, d):
    v = table(spark, d, "registry_b").select(F.explode("family_members").alias("m")).select(F.lower(F.trim("m.relation")).alias("r")).where("r is not null").distinct()
    return v.toDF("one").crossJoin(v.toDF("two")).withColumn("agreement", scoring.relation_agreement(F.col("one"), F.col("two")))


@query(f"SELECT record_id, place_id FROM {_A} JOIN (SELECT place_id, unnest(alt_names) AS alias FROM gazetteer) ON alias = origin_place")
def alias_lookup(spark, d):
    alias = table(spark, d, "gazetteer").select("place_id", F.explode("alt_names").alias("origin_place"))
    return _records(spark, d).join(alias, "origin_place").select("record_id", "place_id")


_SIGNALS = {f: (37 + 11 * i, 17 + 6 * i) for i, f in enumerate(scoring.WEIGHTS)}
_S = {f: f"CAST(({_NUM} * {a}) % 101 AS DOUBLE)" for f, (a, _) in _SIGNALS.items()}
_W = {f: f"(CASE WHEN ({_NUM} * {b}) % 4 = 0 THEN 0.0 ELSE (({_NUM} * {b}) % 8 + 1) / 8.0 END)" for f, (_, b) in _SIGNALS.items()}
_MASS = " + ".join(f"{_W[f]} * CAST({w} AS DOUBLE)" for f, w in scoring.WEIGHTS.items())
_GAIN = " + ".join(f"{_S[f]} * {_W[f]} * CAST({w} AS DOUBLE)" for f, w in scoring.WEIGHTS.items())
_REST = " + ".join(f"{_W[f]} * CAST({w} AS DOUBLE)" for f, w in scoring.WEIGHTS.items() if f != "face")


_RANKS = ", ".join(f"CASE WHEN {_W[f]} > 0 AND {_S[f]} >= 65 THEN struct_pack(k := -({_S[f]} * {_W[f]} * CAST({w} AS DOUBLE)), i := {i}, f := '{f}') END" for i, (f, w) in enumerate(scoring.WEIGHTS.items()))
_TOTAL = f"CAST({sum(scoring.WEIGHTS.values())!r} AS DOUBLE)"


@query(
    f"WITH s AS (SELECT record_id, {_MASS} AS mass, {_GAIN} AS gain, {_REST} AS rest, {_W['face']} AS wf, {_NUM} % 9 = 0 AS conflict, [{_RANKS}] AS reasons FROM {_A}), "
    f"r AS (SELECT *, CASE WHEN mass > 0 THEN gain / mass ELSE 0 END * least(1.0, 0.55 + 0.5 * mass / {_TOTAL}) * CASE WHEN conflict THEN 0.55 ELSE 1.0 END AS raw FROM s), "
    "c AS (SELECT *, rest <= 1e-9 AND wf > 0 AS lone, CASE WHEN rest <= 1e-9 AND wf > 0 THEN least(raw, 39.0) ELSE raw END AS v FROM r) "
    f"SELECT record_id, round_even(v, 1) AS score, CASE WHEN v >= 80 THEN 'strong' WHEN v >= 60 THEN 'possible' WHEN v >= 40 THEN 'weak' ELSE 'unlikely' END AS band, round_even(mass / {_TOTAL}, 2) AS evidence_coverage, lone AS face_only, "
    "array_to_string(list_transform(list_sort(list_filter(reasons, lambda x: x IS NOT NULL)), lambda x: x.f), ', ') AS surfaced, CAST(conflict AS INT) + CAST(lone AND raw > 39.0 AS INT) AS n_flags FROM c"
)
def fused_scores(spark, d):
    """Fusion over signals made from record numbers: score, band, coverage, ceiling, reasons and flags as ``fuse`` gives them."""
    n = _number()
    p = _records(spark, d).withColumn("sex_conflict", n % 9 == 0)
    for f, (a, b) in _SIGNALS.items():
        p = p.withColumn(f"s_{f}", (n * a % 101).cast("double")).withColumn(f"w_{f}", F.when(n * b % 4 == 0, 0.0).otherwise((n * b % 8 + 1) / 8.0))
    return scoring.fuse(p).select("record_id", "score", "band", "evidence_coverage", "face_only", F.array_join(F.transform("surfaced_because", lambda r: r["field"]), ", ").alias("surfaced"), F.size("flags").alias("n_flags"))


def _aliases(spark, d):
    """Spellings of places and nationalities that name one entry."""
    nations = table(spark, d, "nationalities")
    return scoring.aliases(table(spark, d, "gazetteer"), "place_id", [F.array("place_name"), F.coalesce("alt_names", F.array().cast("array<string>"))]), scoring.aliases(nations, "nat_id", [F.array("nat_name", "country")])


_ALIAS = lambda source: f"(SELECT alias, min(c) AS c FROM (SELECT {_PLACE('alias')} AS alias, c FROM ({source})) WHERE alias <> '' GROUP BY alias HAVING count(DISTINCT c) = 1)"
_PLACE_ALIAS = _ALIAS("SELECT place_id AS c, place_name AS alias FROM gazetteer UNION ALL SELECT place_id AS c, unnest(alt_names) AS alias FROM gazetteer")
_NATION_ALIAS = _ALIAS("SELECT nat_id AS c, nat_name AS alias FROM nationalities UNION ALL SELECT nat_id AS c, country AS alias FROM nationalities")


def _signal_base(spark, d):
    """Reviewed pairs with both records prepared."""
    places, nations = _aliases(spark, d)
    pairs = table(spark, d, "review_decisions").select("a_record_id", "b_record_id").where("a_record_id is not null and b_record_id is not null").distinct()
    for side in "ab":
        pairs = pairs.join(scoring.prepared(table(spark, d, f"registry_{side}"), side, places, nations), f"{side}_record_id")
    return pairs


@query(
    f"WITH p AS (SELECT a_record_id, b_record_id, {_PLACE('a.origin_place')} AS x, {_PLACE('b.origin_place')} AS y FROM {_PAIRS} JOIN {_A} a ON a.record_id = a_record_id JOIN {_B} b ON b.record_id = b_record_id), "
    f"c AS (SELECT p.*, k.c AS cx, l.c AS cy FROM p LEFT JOIN {_PLACE_ALIAS} k ON k.alias = x LEFT JOIN {_PLACE_ALIAS} l ON l.alias = y) "
    "SELECT a_record_id, b_record_id, CASE WHEN x = '' OR y = '' THEN 'unavailable' WHEN x = y THEN 'exact' WHEN coalesce(cx = cy, false) THEN 'gazetteer-alias' ELSE 'fuzzy' END AS method, CAST(CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 100.0 WHEN coalesce(cx = cy, false) THEN 97.0 END AS DOUBLE) AS settled FROM c"
)
def place_signal(spark, d):
    """How the places of origin of reviewed pairs agree; ``settled`` is the score where no spelling has to be compared."""
    s, _, m = scoring.place_signal(*(F.col(f"{x}_origin_place_{k}") for k in "nc" for x in "ab"), F.lit(0.0))
    return _signal_base(spark, d).select("a_record_id", "b_record_id", m.alias("method"), F.when(m != "fuzzy", s).alias("settled"))


_LOW = lambda c: f"lower(trim(coalesce({c}, ''), ' '))"


@query(
    f"WITH p AS (SELECT a_record_id, b_record_id, {_LOW('a.nationality')} AS x, {_LOW('b.nationality')} AS y, k.c AS cx, l.c AS cy FROM {_PAIRS} JOIN {_A} a ON a.record_id = a_record_id JOIN {_B} b ON b.record_id = b_record_id LEFT JOIN {_NATION_ALIAS} k ON k.alias = {_PLACE('a.nationality')} LEFT JOIN {_NATION_ALIAS} l ON l.alias = {_PLACE('b.nationality')}), "
    f"w AS (SELECT DISTINCT x, y, trim(regexp_replace(x, '[ \t]+', ' ', 'g')) AS xs, trim(regexp_replace(y, '[ \t]+', ' ', 'g')) AS ys FROM p), t AS ({_token_parts('(SELECT x AS x0, y AS y0, xs AS x, ys AS y FROM w)')}), f AS (SELECT x0, y0, greatest({_TOKEN_SET}, 100 * jaro_winkler_similarity(x0, y0)) AS fuzzy FROM t), "
    f"o AS (SELECT p.*, fuzzy, x IN ('', 'stateless', 'undetermined', 'not established') OR y IN ('', 'stateless', 'undetermined', 'not established') AS none, coalesce(cx = cy, false) AS alias FROM p JOIN f ON x0 = x AND y0 = y) "
    "SELECT a_record_id, b_record_id, CASE WHEN NOT regexp_matches(concat(x, y), '[^ -~]') THEN round(CASE WHEN none THEN 0.0 WHEN x = y THEN 100.0 WHEN alias THEN 97.0 WHEN fuzzy < 70 THEN 50.0 ELSE fuzzy END, 6) END AS score, CASE WHEN NOT regexp_matches(concat(x, y), '[^ -~]') THEN CAST(CASE WHEN none THEN 0.0 WHEN x = y OR alias THEN 1.0 WHEN fuzzy < 70 THEN 0.35 ELSE 0.8 END AS DOUBLE) END AS weight FROM o"
)
def nationality_signal(spark, d):
    base = _signal_base(spark, d)
    p = scoring._by_values(base, base, "a_nationality_n", "b_nationality_n", lambda u, v: F.greatest(names.token_set_udf(u, v), 100 * names.jaro_winkler_udf(u, v)), "_s")
    s, w, _ = scoring.nationality_signal(*(F.col(f"{x}_nationality_{k}") for k in "nc" for x in "ab"), F.coalesce("_s", F.lit(0.0)))
    plain = ~F.concat("a_nationality_n", "b_nationality_n").rlike("[^ -~]")  # other letters: DuckDB compares their bytes
    return p.select("a_record_id", "b_record_id", F.when(plain, F.round(s, 6)).alias("score"), F.when(plain, w).alias("weight"))


_CLEAN = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^a-z]', '', 'g')"


@query(
    f"WITH v AS (SELECT DISTINCT {_CLEAN('a.given_name')} AS x, {_CLEAN('b.given_name')} AS y FROM {_PAIRS} JOIN {_A} a ON a.record_id = a_record_id JOIN {_B} b ON b.record_id = b_record_id) "
    f"SELECT x, y, round(60 * jaro_winkler_similarity(x, y) + 0.4 * ({_indel('x', 'y')}), 4) AS edit FROM v WHERE x <> '' AND y <> ''"
)
def name_edit_score(spark, d):
    """The spelling part of a name score over the given names of reviewed pairs."""
    v = _reviewed(spark, d, "given_name").select(names.clean_name(F.col("a_given_name")).alias("x"), names.clean_name(F.col("b_given_name")).alias("y")).where("x <> '' and y <> ''").distinct()
    return v.select("x", "y", F.round(60 * names.jaro_winkler_udf("x", "y") + 0.4 * names.indel_udf("x", "y"), 4).alias("edit"))


_TOP = f"(SELECT record_id AS a_record_id, CAST({_NUM} % 5 AS VARCHAR) AS b_record_id, (({_NUM} * 37) % 1000) / 10.0 AS score, CASE WHEN {_NUM} % 3 = 0 THEN CAST({_NUM} % 7 % 5 AS VARCHAR) END AS b_true FROM {_A})"


def _tops(spark, d):
    n = _number()
    return _records(spark, d).select(F.col("record_id").alias("a_record_id"), (n % 5).cast("string").alias("b_record_id"), (n * 37 % 1000 / 10.0).alias("score"), F.when(n % 3 == 0, (n % 7 % 5).cast("string")).alias("b_true"))


@query(
    f"WITH t AS (SELECT unnest([40.0,50.0,55.0,60.0,65.0,70.0,75.0,80.0]) AS threshold), x AS (SELECT CAST(threshold AS DOUBLE) AS threshold, score >= threshold AS claimed, coalesce(b_record_id = b_true, false) AS ok, b_true IS NOT NULL AS truth FROM {_TOP}, t), "
    "c AS (SELECT threshold, count(*) FILTER (claimed AND ok) AS tp, count(*) FILTER (claimed AND NOT ok) AS fp, count(*) FILTER (truth AND NOT (claimed AND ok)) AS fn, count(*) FILTER (NOT claimed AND NOT truth) AS tn FROM x GROUP BY threshold), "
    "m AS (SELECT *, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0.0 END AS p, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0.0 END AS r FROM c) SELECT threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0.0 END, 6) AS f1 FROM m"
)
def threshold_sweep(spark, d):
    return evaluation.confusion(_tops(spark, d))


@query(f"SELECT a_record_id, CASE WHEN score >= 75 AND b_true IS NOT NULL THEN 'wrong-person' WHEN score >= 75 THEN 'false-claim' ELSE 'missed' END AS kind FROM {_TOP} WHERE (score >= 75 AND NOT coalesce(b_record_id = b_true, false)) OR (score < 75 AND b_true IS NOT NULL)")
def error_kinds(spark, d):
    return evaluation.error_kinds(_tops(spark, d)).select("a_record_id", "kind")


_FACE = "SELECT x.vec_id, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS score, x.label = y.label AS same FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1"


def _face_pairs(spark, d):
    e = table(spark, d, "embeddings")
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"), F.col("label").alias("l2"))
    return e.join(y, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("e2")), 6).alias("score"), (F.col("label") == F.col("l2")).alias("same"))


@query(_FACE)
def face_pairs(spark, d):
    return _face_pairs(spark, d)


@query(f"WITH p AS ({_FACE}), t AS (SELECT DISTINCT score AS threshold FROM p), a AS (SELECT threshold, avg(CASE WHEN (score >= threshold) = same THEN 1.0 ELSE 0.0 END) AS accuracy FROM p, t GROUP BY threshold) SELECT threshold, round(accuracy, 9) AS accuracy FROM a ORDER BY a.accuracy DESC, threshold LIMIT 1")
def verification_accuracy(spark, d):
    return evaluation.best_threshold(_face_pairs(spark, d)).select("threshold", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH p AS ({_FACE}) SELECT round(avg(score) FILTER (same), 6) AS mean_same, round(avg(score) FILTER (NOT same), 6) AS mean_different FROM p")
def class_separation(spark, d):
    return evaluation.separation(_face_pairs(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("mean_same", "mean_different")))


@query(f"WITH p AS ({_FACE}), r AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY vec_id) AS r FROM p) SELECT vec_id, score, same FROM r WHERE r <= 10")
def balanced_sample(spark, d):
    return evaluation.balanced(_face_pairs(spark, d), "same", 20, "vec_id")


@query(
    "WITH v AS (SELECT vec_id % 2 AS side, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT list_cosine_similarity(x.e, y.e) AS c FROM v x, v y WHERE x.side = 0 AND y.side = 1) "
    "SELECT count(*) AS sample_pairs, round(avg(c), 6) AS background_mean, round(stddev_pop(c), 6) AS background_sd FROM d"
)
def face_calibration(spark, d):
    e = table(spark, d, "embeddings")
    a, b = (e.where(F.col("vec_id") % 2 == i).select(F.col("embedding").alias("v")) for i in (0, 1))
    return vectors.calibrate(a, b).select("sample_pairs", F.round("background_mean", 6).alias("background_mean"), F.round("background_sd", 6).alias("background_sd"))


_GOOD = "len(embeddings) = 64 AND list_aggregate(list_transform(embeddings, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END), 'sum') = 0 AND list_aggregate(list_transform(embeddings, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), 'sum') > 0"
_USABLE = f"(SELECT record_id, CAST(min(embeddings) AS DOUBLE[]) AS v FROM face_embeddings WHERE backend = 'gradient' AND record_id IS NOT NULL AND {_GOOD} GROUP BY record_id)"


def _usable(spark, d):
    """One usable vector of the present backend a record; older backends are skipped knowingly."""
    return vectors.usable(registry.read_vectors(table(spark, d, "face_embeddings"), "gradient", others="skip"), "record_id", "embeddings", 64)


@query(
    f"WITH p AS (SELECT a_record_id, b_record_id, list_cosine_similarity(x.v, y.v) AS c FROM {_PAIRS} JOIN {_USABLE} x ON x.record_id = a_record_id JOIN {_USABLE} y ON y.record_id = b_record_id) "
    f"SELECT a_record_id, b_record_id, round(100 / (1 + exp(-((c - {vectors.MEAN}) / {vectors.SD} - {vectors.MIDPOINT}) / {vectors.SPREAD})), 6) AS similarity, round((c - {vectors.MEAN}) / {vectors.SD}, 6) AS z FROM p"
)
def face_similarity(spark, d):
    """Calibrated similarity of the faces of reviewed pairs, under the default background."""
    pairs = table(spark, d, "review_decisions").select("a_record_id", "b_record_id").where("a_record_id is not null and b_record_id is not null").distinct()
    one, two = (_usable(spark, d).select(F.col("record_id").alias(f"{s}_record_id"), F.col("v").alias(f"{s}_v")) for s in "ab")
    met = pairs.join(one, "a_record_id").join(two, "b_record_id").withColumn("c", vectors.cosine(F.col("a_v"), F.col("b_v")))
    return met.select("a_record_id", "b_record_id", F.round(vectors.calibrated(F.col("c")), 6).alias("similarity"), F.round(vectors.z_score(F.col("c")), 6).alias("z"))


_SIDE = lambda x: f"(SELECT v FROM {_USABLE} WHERE record_id LIKE '{x}-%')"
_UNIT = "list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))"


@query(
    f"WITH a AS (SELECT {_UNIT} AS u FROM {_SIDE('A')}), b AS (SELECT {_UNIT} AS u FROM {_SIDE('B')}), d AS (SELECT list_inner_product(a.u, b.u) AS c FROM a, b) "
    "SELECT count(*) AS sample_pairs, round(avg(c), 6) AS background_mean, round(stddev_pop(c), 6) AS background_sd FROM d"
)
def registry_calibration(spark, d):
    """Background of all faces of A against all of B."""
    return _background(spark, d).select("sample_pairs", F.round("background_mean", 6).alias("background_mean"), F.round("background_sd", 6).alias("background_sd"))


def _background(spark, d):
    faces = _usable(spark, d)
    return vectors.calibrate(*(faces.where(F.col("record_id").startswith(f"{x}-")) for x in "AB"))


@query(
    "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS id, r.vec_id AS other, list_cosine_similarity(q.v, r.v) AS c FROM e q JOIN e r ON r.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 9) DESC, other) AS n FROM s) SELECT id, other, round(c, 6) AS similarity FROM k WHERE n = 1"
)
def rank1_retrieval(spark, d):
    """The nearest other vector of every vector whose id is divisible by 100, against all."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.rank_one(rows.where("id % 100 = 0"), rows).select("id", "other", F.round("similarity", 6).alias("similarity"))


_T = "regexp_replace(lower(trim(decision)), '[\\s-]+', '_', 'g')"
_DEC = f"CASE WHEN {_T} IN ('refer','referred') THEN 'refer' WHEN {_T} IN ('rule_out','ruled_out','ruleout') THEN 'rule_out' WHEN {_T} IN ('withdraw','withdrawn','delete','deleted','clear') THEN 'withdraw' END"
_LATEST = (
    f"WITH r AS (SELECT a_record_id, coalesce(b_record_id,'') AS b_record_id, coalesce(reviewer,'') AS reviewer, decided_at, {_DEC} AS d FROM review_decisions), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY a_record_id ORDER BY decided_at DESC NULLS LAST, b_record_id DESC, d DESC, reviewer DESC) AS n FROM r WHERE d IS NOT NULL AND a_record_id IS NOT NULL), "
    "l AS (SELECT a_record_id, b_record_id, d AS decision, reviewer, decided_at FROM k WHERE n = 1 AND d <> 'withdraw') "
)


@query(_LATEST + "SELECT * FROM l")
def review_latest(spark, d):
    return review.latest(table(spark, d, "review_decisions"))


@query(f"SELECT coalesce({_DEC}, 'unusable') AS decision, count(*) AS n FROM review_decisions GROUP BY 1")
def review_status_counts(spark, d):
    return table(spark, d, "review_decisions").groupBy(F.coalesce(review.decision(F.col("decision")), F.lit("unusable")).alias("decision")).agg(F.count("*").alias("n"))


@query(_LATEST + "SELECT DISTINCT record_id AS a_record_id FROM registry_a WHERE record_id NOT IN (SELECT a_record_id FROM l)")
def queue_pending(spark, d):
    queue = table(spark, d, "registry_a").select(F.col("record_id").alias("a_record_id")).distinct()
    return review.pending(queue, review.latest(table(spark, d, "review_decisions")))


@query(_LATEST + f"SELECT record_id, given_name, l.decision AS reviewed FROM {_A} a LEFT JOIN l ON l.a_record_id = a.record_id")
def annotated_records(spark, d):
    """Every record of A with the decision that stands on it."""
    return review.annotate(_records(spark, d), review.latest(table(spark, d, "review_decisions"))).select("record_id", "given_name", "reviewed")


@query(_LATEST + "SELECT count(*) FILTER (l.a_record_id IS NULL) AS waiting, count(l.a_record_id) AS reviewed FROM (SELECT DISTINCT record_id FROM registry_a WHERE record_id IS NOT NULL) q LEFT JOIN l ON l.a_record_id = q.record_id")
def queue_counts(spark, d):
    queue = table(spark, d, "registry_a").select(F.col("record_id").alias("a_record_id")).where("a_record_id is not null").distinct()
    return review.queue_counts(queue, review.latest(table(spark, d, "review_decisions")))


@query(
    f"SELECT CASE WHEN {_DEC} IS NULL THEN 'decision is none of refer, rule_out, withdraw' WHEN a.record_id IS NULL THEN 'no such record in A' ELSE 'no such record in B' END AS problem, count(*) AS n FROM review_decisions r "
    f"LEFT JOIN (SELECT DISTINCT record_id FROM registry_a) a ON a.record_id = r.a_record_id LEFT JOIN (SELECT DISTINCT record_id FROM registry_b) b ON b.record_id = r.b_record_id WHERE {_DEC} IS NULL OR a.record_id IS NULL OR b.record_id IS NULL GROUP BY 1"
)
def review_problems(spark, d):
    """What is wrong with rows of the log."""
    _, bad = review.known_only(table(spark, d, "review_decisions"), table(spark, d, "registry_a"), table(spark, d, "registry_b"))
    return bad.groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', decided_at) AS start, reviewer, count(*) AS n FROM review_decisions WHERE decided_at IS NOT NULL GROUP BY 1, 2")
def reviewer_throughput(spark, d):
    return review.throughput(table(spark, d, "review_decisions"))


@query(
    f"SELECT record_id, array_to_string(list_filter([CASE WHEN trim(coalesce(record_id,''), ' ') = '' THEN 'record_id is missing' END, CASE WHEN trim(coalesce(given_name,''), ' ') = '' AND trim(coalesce(family_name,''), ' ') = '' THEN 'no name' END, CASE WHEN trim(coalesce(birth_date_raw,''), ' ') = '' THEN 'no birth date' END, CASE WHEN coalesce(len(family_members), 0) < 1 THEN 'no relatives' END], lambda x: x IS NOT NULL), '; ') AS problems FROM {_A}"
)
def validate_requests(spark, d):
    return registry.problems(_records(spark, d)).select("record_id", F.array_join("problems", "; ").alias("problems"))


_KIND = "CASE s_suppkey % 5 WHEN 0 THEN 'hospital' WHEN 1 THEN 'shelter' WHEN 2 THEN 'pharmacy' WHEN 3 THEN 'doctors' ELSE 'cafe' END"
_DIST = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 52.5) / 2), 2) + cos(radians(52.5)) * cos(radians(lat)) * pow(sin(radians(lon - 13.4) / 2), 2))))"


@query(
    f"WITH s AS (SELECT s_suppkey AS ord, s_name AS name, {_KIND} AS kind, 52.5 + (s_suppkey * 7 % 101 - 50) / 1000.0 AS lat, 13.4 + (s_suppkey * 13 % 103 - 51) / 1000.0 AS lon FROM supplier), "
    f"x AS (SELECT *, {_DIST} AS m, CASE kind WHEN 'shelter' THEN 0 WHEN 'hospital' THEN 1 WHEN 'doctors' THEN 2 WHEN 'pharmacy' THEN 3 END AS rank FROM s) SELECT ord, name, kind, rank, round(m, 3) AS distance, list_extract(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], CAST(round(((degrees(atan2(sin(radians(lon - 13.4)) * cos(radians(lat)), cos(radians(52.5)) * sin(radians(lat)) - sin(radians(52.5)) * cos(radians(lat)) * cos(radians(lon - 13.4)))) + 360) % 360) / 45) AS INT) % 8 + 1) AS direction FROM x WHERE m <= 3000 AND rank IS NOT NULL"
)
def nearby_ranked(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("ord"), F.col("s_name").alias("name"), F.element_at(F.array(*map(F.lit, "hospital shelter pharmacy doctors cafe".split())), (k % 5 + 1).cast("int")).alias("kind"), (52.5 + (k * 7 % 101 - 50) / 1000.0).alias("lat"), (13.4 + (k * 13 % 103 - 51) / 1000.0).alias("lon"))
    return geo.nearby(s, 52.5, 13.4, 3000, None).select("ord", "name", "kind", "rank", F.round("distance", 3).alias("distance"), "direction")


def _scored(spark, d, pairs=None, profile="reference"):
    """Candidates of both registries (or given pairs), scored with faces, places and nationalities."""
    a, b = _records(spark, d), _records(spark, d, "registry_b")
    pairs = cut(scoring.candidate_pairs(a, b)) if pairs is None else pairs
    places, nations = _aliases(spark, d)
    background = _background(spark, d).head()
    mean, sd = (background.background_mean, background.background_sd) if background else (vectors.MEAN, vectors.SD)
    return scoring.score_pairs(pairs, a, b, scoring.face_similarities(pairs, _usable(spark, d), mean, sd), places, nations, profile)


def _best(spark, d, n=3, floor=25.0):
    """The best candidates of the registries as ``_scored`` and ``top_candidates`` give them, without a list of all pairs."""
    background = _background(spark, d).head()
    mean, sd = (background.background_mean, background.background_sd) if background else (vectors.MEAN, vectors.SD)
    return ranking.best_candidates(_records(spark, d), _records(spark, d, "registry_b"), _usable(spark, d), *_aliases(spark, d), n, floor, mean, sd)


@query()
def topk_candidates(spark, d):
    """The three best candidates of every record of registry_a; records without one keep a row."""
    ranked = scoring.top_candidates(_scored(spark, d))
    every = scoring.match_all(_records(spark, d), ranked)
    return every.select("a_record_id", F.size("candidates").alias("candidate_count"), F.explode_outer("candidates").alias("c")).select("a_record_id", "candidate_count", "c.*")


@query()
def review_queue(spark, d):
    """Records that wait for a person, the strongest candidate first."""
    queue = review.queue_of(_best(spark, d), _records(spark, d))
    return review.pending(queue, review.latest(table(spark, d, "review_decisions"))).orderBy(F.desc("score"), "a_record_id")


@query()
def review_cases(spark, d):
    return review.resolve_cases(review.cases(_best(spark, d, 1, 60.0)), table(spark, d, "review_decisions"))


def _pairs_reviewed(spark, d):
    return table(spark, d, "review_decisions").select("a_record_id", "b_record_id").where("a_record_id is not null and b_record_id is not null").distinct()


@query()
def pair_explanations(spark, d):
    """Signals, notes and the sentence a reviewer reads, of the reviewed pairs."""
    return _scored(spark, d, _pairs_reviewed(spark, d)).select("a_record_id", "b_record_id", "score", "band", "signals", "flags", "cross_notes", "surfaced_because", "explanation")


@query()
def name_signal(spark, d):
    """Score, weight and method of the names of reviewed pairs, sounds and swapped fields included."""
    return _scored(spark, d, _pairs_reviewed(spark, d)).select("a_record_id", "b_record_id", F.round("s_name", 4).alias("score"), F.col("w_name").alias("weight"), F.col("name_method").alias("method"))


@query()
def family_signal(spark, d):
    return _scored(spark, d, _pairs_reviewed(spark, d)).select("a_record_id", "b_record_id", F.round("s_family", 4).alias("score"), F.col("w_family").alias("weight"))


@query(
    f"WITH p AS (SELECT a_record_id, b_record_id, {_PLACE('a.origin_place')} AS ao, {_PLACE('a.last_seen_place')} AS al, {_PLACE('b.origin_place')} AS bo, {_PLACE('b.last_seen_place')} AS bl FROM {_PAIRS} JOIN {_A} a ON a.record_id = a_record_id JOIN {_B} b ON b.record_id = b_record_id), "
    f"c AS (SELECT p.*, k.c AS kao, l.c AS kal, m.c AS kbo, n.c AS kbl FROM p LEFT JOIN {_PLACE_ALIAS} k ON k.alias = ao LEFT JOIN {_PLACE_ALIAS} l ON l.alias = al LEFT JOIN {_PLACE_ALIAS} m ON m.alias = bo LEFT JOIN {_PLACE_ALIAS} n ON n.alias = bl) "
    "SELECT a_record_id, b_record_id, ao <> '' AND bl <> '' AND (ao = bl OR coalesce(kao = kbl, false)) AS origin_then_seen, al <> '' AND bo <> '' AND (al = bo OR coalesce(kal = kbo, false)) AS seen_then_origin FROM c"
)
def crossed_places(spark, d):
    """Whether either registry's place of origin is where the other last saw the person: what cross notes are made of."""
    met = lambda x, y: (F.col(f"a_{x}_n") != "") & (F.col(f"b_{y}_n") != "") & ((F.col(f"a_{x}_n") == F.col(f"b_{y}_n")) | F.coalesce(F.col(f"a_{x}_c") == F.col(f"b_{y}_c"), F.lit(False)))
    return _signal_base(spark, d).select("a_record_id", "b_record_id", met("origin_place", "last_seen_place").alias("origin_then_seen"), met("last_seen_place", "origin_place").alias("seen_then_origin"))


@query()
def parity_profiles(spark, d):
    """How far the two scorers agree over the reviewed pairs."""
    pairs = _pairs_reviewed(spark, d)
    return evaluation.parity_problems(evaluation.parity(_scored(spark, d, pairs), _scored(spark, d, pairs, "portable")))


@query(
    f"SELECT a_record_id, b_record_id, a.given_name AS a_given, b.family_name AS b_family, coalesce(len(a.family_members), -1) AS a_kin, x.v IS NOT NULL AS a_has_vector, false AS has_image, CAST(60.0 AS DOUBLE) AS threshold FROM {_PAIRS} JOIN {_A} a ON a.record_id = a_record_id JOIN {_B} b ON b.record_id = b_record_id LEFT JOIN {_USABLE} x ON x.record_id = a_record_id"
)
def pair_payloads(spark, d):
    """Requests for the pair service, read back field by field."""
    a, b = _records(spark, d), _records(spark, d, "registry_b")
    made = registry.pair_payload(_pairs_reviewed(spark, d), a, b, _usable(spark, d).withColumnRenamed("v", "embeddings"), (vectors.MEAN, vectors.SD))
    got = lambda path: F.get_json_object("payload", path)
    kin = F.from_json(got("$.record_a.family_members"), "array<struct<name: string, relation: string>>")
    return made.select(
        "a_record_id", "b_record_id", got("$.record_a.given_name").alias("a_given"), got("$.record_b.family_name").alias("b_family"), F.coalesce(F.size(kin), F.lit(-1)).cast("long").alias("a_kin"),
        got("$.record_a.face_embedding").isNotNull().alias("a_has_vector"), got("$.record_a.face_image").isNotNull().alias("has_image"), got("$.options.review_threshold").cast("double").alias("threshold"),
    )


def _synthetic(spark, size=600, mode="blocked"):
    """Synthetic registries with planted truth, ranked."""
    a, b, truth = (cut(x) for x in registries(spark, size))
    places = scoring.aliases(place_entries(spark), "entry", [F.col("forms")])
    pairs = cut(scoring.candidate_pairs(a, b, mode))
    scored = cut(scoring.score_pairs(pairs, a, b, places=places).drop("a_window", "b_window"))
    return a, b, truth.withColumnRenamed("b_record_id", "b_true"), pairs, scored


@query()
def synthetic_recall(spark, d):
    """Recall of the first three candidates on synthetic registries with planted truth."""
    _, _, truth, _, scored = _synthetic(spark)
    return evaluation.topk_recall(scoring.top_candidates(scored, 3, 0), truth)


@query()
def synthetic_threshold_sweep(spark, d):
    """Precision, recall and F1 of real scores against planted truth."""
    a, _, truth, _, scored = _synthetic(spark)
    top = a.select(F.col("record_id").alias("a_record_id")).join(scoring.top_candidates(scored, 1, 0), "a_record_id", "left")
    return evaluation.confusion(evaluation.outcomes(top, truth))


@query()
def synthetic_errors(spark, d):
    a, _, truth, _, scored = _synthetic(spark)
    top = a.select(F.col("record_id").alias("a_record_id")).join(scoring.top_candidates(scored, 1, 0), "a_record_id", "left")
    return evaluation.error_kinds(evaluation.outcomes(top, truth)).select("a_record_id", "b_record_id", "b_true", "score", "difficulty", "kind")


@query()
def recall_by_difficulty(spark, d):
    _, _, truth, _, scored = _synthetic(spark)
    return evaluation.recall_by_difficulty(scoring.top_candidates(scored, 3, 0), truth)


@query()
def difficulty_histogram(spark, d):
    return evaluation.difficulty_histogram(registries(spark, 600)[2])


@query()
def showcase(spark, d):
    a, _, truth = registries(spark, 600)
    names_ = a.select(F.col("record_id").alias("a_record_id"), F.concat_ws(" ", "given_name", "family_name").alias("display_name"))
    return evaluation.showcase(truth, names_)


@query()
def demo_pick(spark, d):
    """The hard planted pair that resolves best: divergences, score and the steps shown for it."""
    _, _, truth, _, scored = _synthetic(spark)
    return evaluation.demo_pair(truth, scored).select("a_record_id", "b_record_id", "score", "band", "divergences", "signals", "explanation")


@query()
def revealed_candidates(spark, d):
    """Ranked candidates with the planted partner shown beside them afterwards."""
    _, _, truth, _, scored = _synthetic(spark)
    return evaluation.reveal(scoring.top_candidates(scored), truth).select("a_record_id", "b_record_id", "rank", "score", "has_true_partner", "b_true", "difficulty", "divergences")


@query()
def blocked_vs_exhaustive(spark, d):
    """Blocking against all pairs at two sizes: planted pairs that share a block, and first candidates that stay the same."""
    out = None
    for size in (100, 250):
        _, _, truth, pairs, scored = _synthetic(spark, size)
        _, _, _, all_pairs, all_scored = _synthetic(spark, size, "exhaustive")
        first, all_first = (scoring.top_candidates(x, 1, 60).select("a_record_id", F.col("b_record_id").alias(c)) for x, c in ((scored, "b1"), (all_scored, "b2")))
        same = all_first.join(first, "a_record_id", "left").agg(F.avg((F.coalesce(F.col("b1"), F.lit("")) == F.col("b2")).cast("double")).alias("first_kept"))
        met = truth.join(pairs.withColumnRenamed("b_record_id", "b_true"), ["a_record_id", "b_true"], "left_semi").agg(F.count("*").alias("met")).crossJoin(truth.agg(F.count("*").alias("planted")))
        counts = pairs.agg(F.count("*").alias("blocked_pairs")).crossJoin(all_pairs.agg(F.count("*").alias("all_pairs")))
        row = met.crossJoin(counts).crossJoin(same).select(F.lit(size).alias("records"), "planted", "met", (F.col("met") / F.col("planted")).alias("completeness"), "blocked_pairs", "all_pairs", "first_kept")
        out = row if out is None else out.unionByName(row)
    return out
