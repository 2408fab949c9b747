"""A synthetic pair of registries with planted truth, from hashes of ids alone.

People live in pools of made-up names; a shared person is rendered in both registries, each with its own slips,
spellings and gaps, and every divergence between the two renderings is noted in the truth. Part of the others
are near twins: the household and place of a person of A, another given name, a birth a year or two away.
"""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.evaluation import difficulty
from kinloom.session import cut

_ONSET, _VOWEL, _CODA = "b d dr f g gr h k kl l m n p r s sh st t tr v z".split(), "a e i o u ae ia ou".split(), "l m n nd r s sh t v x".split()
# Divergences that make a pair hard.
HARD = ("given name has a slip", "names in swapped fields", "no birth date in one registry", "no relative in common")
_RELATIONS = "mother father brother sister son daughter aunt uncle spouse".split()


def pool(n: int, slot: str) -> list[str]:
    """``n`` made-up names that depend on ``slot``."""
    out = []
    for i in range(n):
        h = blake2b(f"{slot}{i}".encode(), digest_size=8).digest()
        out.append("".join(w[x % len(w)] for w, x in zip((_ONSET, _VOWEL, [*_CODA, ""], _ONSET, _VOWEL, _CODA), h)).capitalize())
    return out


def uniform(key: Column, seed: int, slot: str) -> Column:
    """A number in [0, 1) that depends on key, seed and slot."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(slot)), F.lit(1_000_003)) / 1_000_003.0


def pick(words: list[str], u: Column) -> Column:
    return F.element_at(F.lit(words), (F.floor(u * len(words)) + 1).cast("int"))


def slip(text: Column, key: Column, seed: int, slot: str) -> Column:
    """One letter dropped, doubled, swapped with the next or replaced; never the first."""
    n = F.length(text)
    at = (F.floor(uniform(key, seed, slot + "at") * (n - 2)) + 2).cast("int")
    head, x, tail = F.substr(text, F.lit(1), at - 1), F.substr(text, at, F.lit(1)), F.substr(text, at + 1, n)
    how = uniform(key, seed, slot + "how")
    out = F.when(how < 0.3, F.concat(head, tail)).when(how < 0.55, F.concat(head, x, x, tail)).when(how < 0.8, F.concat(head, F.substr(tail, F.lit(1), F.lit(1)), x, F.substr(tail, F.lit(2), n))).otherwise(F.concat(head, F.lit("e"), tail))
    return F.when(n >= 4, out).otherwise(text)


def render_date(day: Column, style: Column) -> Column:
    """Nine ways to write a day, the last of them nothing."""
    f = lambda p: F.date_format(day, p)
    ways = [f("yyyy-MM-dd"), f("dd/MM/yyyy"), f("MM/dd/yyyy"), f("MMMM d, yyyy"), f("MMMM yyyy"), f("yyyy"), F.concat(F.lit("approx. "), f("yyyy")), F.concat(F.lit("c. "), f("yyyy")), F.lit("")]
    return F.element_at(F.array(*ways), (F.pmod(style, F.lit(9)) + 1).cast("int"))


def _latent(spark: SparkSession, size: int, shared: int, seed: int) -> DataFrame:
    """One row a person: ``p`` under ``shared`` is in both registries, under ``size`` in A, the rest in B."""
    n = 2 * size - shared
    rows = spark.range(n).select(F.col("id").alias("p"))
    # a third of the people of B alone are near twins of people of A
    twin = (F.col("p") >= size) & (uniform(F.col("p"), seed, "twin") < 0.33)
    like = F.when(twin, F.pmod(F.xxhash64("p", F.lit(seed)), F.lit(size))).otherwise(F.col("p"))
    rows = rows.select("p", twin.alias("twin"), like.alias("like"))
    p, l = F.col("p"), F.col("like")
    born = F.date_add(F.lit("1958-01-01").cast("date"), F.floor(uniform(l, seed, "b") * 21_000).cast("int"))
    born = F.when(F.col("twin"), F.add_months(born, F.when(uniform(p, seed, "ty") < 0.5, 12).otherwise(-24))).otherwise(born)
    kin = F.array(*(F.struct(F.concat_ws(" ", pick(pool(400, "given"), uniform(l, seed, f"r{i}")), F.when(uniform(l, seed, f"rs{i}") < 0.82, pick(pool(300, "family"), uniform(l, seed, "f"))).otherwise(pick(pool(300, "family"), uniform(l, seed, f"rf{i}")))).alias("name"), pick(_RELATIONS, uniform(l, seed, f"rr{i}")).alias("relation")) for i in range(2)))
    many = F.when(uniform(l, seed, "k1") < 0.72, 1).otherwise(0) + F.when((uniform(l, seed, "k1") < 0.72) & (uniform(l, seed, "k2") < 0.4), 1).otherwise(0)
    return rows.select(
        "p", pick(pool(400, "given"), uniform(p, seed, "g")).alias("g"), pick(pool(300, "family"), uniform(l, seed, "f")).alias("f"), born.alias("born"),
        *(F.floor(uniform(l, seed, s) * 60).cast("int").alias(s) for s in ("o", "s")), F.floor(uniform(l, seed, "n") * 12).cast("int").alias("n"),
        F.when(uniform(p, seed, "x") < 0.5, "M").otherwise("F").alias("x"), F.slice(kin, F.lit(1), many).alias("kin"),
    )


def _render(latent: DataFrame, side: str, size: int, shared: int, messy: float, seed: int) -> DataFrame:
    """A registry: ``p``, the record and ``noted``, what its rendering changed."""
    k = F.xxhash64("p", F.lit(side))
    u = lambda s: uniform(k, seed, side + s)
    rows = latent.where((F.col("p") < shared) | ((F.col("p") < size) if side == "A" else (F.col("p") >= size)))
    places, alternatives = pool(60, "place"), [x + " Old Town" for x in pool(60, "place")]
    nations, variants = [x + "an" for x in pool(12, "nation")], [x + "ish" for x in pool(12, "nation")]
    at = lambda words, c: F.element_at(F.lit(words), F.col(c) + 1)
    place = lambda c: F.when(u(c + "alt") < 0.3, at(alternatives, c)).otherwise(at(places, c))
    changes = {"slip": u("slip") < 0.3, "swap": u("swap") < 0.1, "no_dob": u("dob") < 0.12, "no_origin": u("origin") < 0.14, "no_seen": u("seen") < 0.10, "no_nation": u("nation") < 0.10, "no_kin": u("kin") < 0.18}
    rows = rows.withColumn("messy", u("messy") < messy).withColumns({c: F.col("messy") & test for c, test in changes.items()})
    g = F.when(F.col("slip"), slip(F.col("g"), k, seed, side)).otherwise(F.col("g"))
    number = F.lpad(F.pmod(F.xxhash64("p", F.lit(side + "id")), F.lit(10**9)).cast("string"), 9, "0")
    noted = F.array_compact(F.array(*(F.when(F.col(c), t) for c, t in (("slip", HARD[0]), ("swap", HARD[1]), ("no_dob", HARD[2]), ("no_kin", HARD[3]), ("no_origin", "no place of origin in one registry"), ("no_seen", "no last seen place in one registry"), ("no_nation", "no nationality in one registry"))), F.when(F.col("style") > 0, "birth date written another way")))
    return rows.withColumn("style", F.when(F.col("messy"), F.floor(u("style") * 8)).otherwise(0)).select(
        "p", F.concat(F.lit(side + "-"), number).alias("record_id"), F.lit(side).alias("registry"), F.when(F.col("swap"), F.col("f")).otherwise(g).alias("given_name"), F.when(F.col("swap"), g).otherwise(F.col("f")).alias("family_name"),
        F.when(u("sex") < 0.05, "").otherwise(F.col("x")).alias("sex"), F.when(F.col("no_dob"), "").otherwise(render_date(F.col("born"), F.col("style"))).alias("birth_date_raw"),
        F.when(F.col("no_origin"), "").otherwise(place("o")).alias("origin_place"), F.when(F.col("no_seen"), "").otherwise(place("s")).alias("last_seen_place"),
        F.when(F.col("no_nation"), "").when(u("nvar") < 0.45, at(variants, "n")).otherwise(at(nations, "n")).alias("nationality"),
        F.when(F.col("no_kin"), F.slice("kin", 1, 0)).otherwise(F.col("kin")).alias("family_members"), F.concat(F.lit("Desk "), F.pmod(k, F.lit(9)).cast("string")).alias("source_org"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.floor(u("intake") * 700).cast("int")).alias("intake_date"), F.concat(F.lit(f"faces/{side}-"), number, F.lit(".png")).alias("face_image"), noted.alias("noted"),
    )


def registries(spark: SparkSession, size: int, overlap: float = 0.32, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registry A, registry B and truth (``a_record_id, b_record_id, difficulty, divergences``)."""
    shared = round(size * overlap)
    latent = cut(_latent(spark, size, shared, seed))  # both renderings and the truth start from it
    a, b = _render(latent, "A", size, shared, 0.25, seed), _render(latent, "B", size, shared, 0.85, seed)
    both = a.select("p", F.col("record_id").alias("a_record_id"), F.col("noted").alias("na")).join(b.select("p", F.col("record_id").alias("b_record_id"), F.col("noted").alias("nb")), "p")
    notes = F.array_union("na", "nb")
    truth = both.select("a_record_id", "b_record_id", difficulty(notes, HARD).alias("difficulty"), F.array_sort(notes).alias("divergences"))
    return a.drop("p", "noted"), b.drop("p", "noted"), truth


def place_entries(spark: SparkSession) -> DataFrame:
    """``entry, forms`` of half the places: a gazetteer that does not know them all."""
    rows = [(str(i), [x, x + " Old Town"]) for i, x in enumerate(pool(60, "place")) if i % 2 == 0]
    return spark.createDataFrame(rows, "entry string, forms array<string>")
