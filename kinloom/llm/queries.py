"""Queries of the training-data problems, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import canonical, leakage, linkage, neighbours, packing, people, spam_pages
from kinloom.operators import review
from kinloom.session import store, table


def _once(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The records of a registry, each once."""
    return table(spark, sf_dir, name).select("record_id", *columns).where("record_id is not null").dropDuplicates(["record_id"])


def _listed(spark: SparkSession, sf_dir: str, name: str) -> list:
    """A canonical list; one with more than ``MAX_ENTRIES`` rows raises before it is read whole."""
    rows = table(spark, sf_dir, name).limit(canonical.MAX_ENTRIES + 1).collect()
    if len(rows) > canonical.MAX_ENTRIES:
        raise ValueError(f"{name} has more than {canonical.MAX_ENTRIES} rows")
    return rows


def p1_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's three typed fields with the entry each denotes; null where nothing was typed."""
    lists = {"place": canonical.places(_listed(spark, sf_dir, "gazetteer")), "nationality": canonical.nationalities(_listed(spark, sf_dir, "nationalities"))}
    records = _once(spark, sf_dir, "registry_a", "origin_place", "last_seen_place", "nationality")
    kind = F.when(F.col("field_name") == "nationality", "nationality").otherwise("place")
    typed = records.unpivot("record_id", ["origin_place", "last_seen_place", "nationality"], "field_name", "value").withColumn("kind", kind)
    return typed.join(canonical.map_to_list(typed.select("kind", "value"), lists), ["kind", "value"], "left").select("record_id", "field_name", "kind", "value", "ref_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (
        table(spark, sf_dir, "gazetteer").select(F.lit("place").alias("kind"), F.col("place_name").alias("value"))
        .unionByName(table(spark, sf_dir, "nationalities").select(F.lit("nationality").alias("kind"), F.col("nat_name").alias("value")))
    )
    return p1_mapped(spark, sf_dir).where("value <> ''").join(F.broadcast(names), ["kind", "value"], "left_anti").select("record_id", "field_name", F.coalesce("ref_id", F.lit(canonical.UNLISTED)).alias("ref_id"))


_PERSON = ("given_name", "family_name", "sex", "birth_date_raw", "origin_place", "last_seen_place", "nationality", "family_members", "source_org", "intake_date")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both registries as comparable facts, written once: candidates and scores read them again."""
    a, b = (table(spark, sf_dir, f"registry_{x}").select("record_id", *_PERSON).where("record_id is not null").withColumn("side", F.lit(i)) for i, x in enumerate("ab"))
    forms = people.Forms([(r.short_form, r.given_name) for r in _listed(spark, sf_dir, "given_forms")])
    places = people.PlaceKeys(canonical.places(_listed(spark, sf_dir, "gazetteer")))
    nations = people.PlaceKeys(canonical.nationalities(_listed(spark, sf_dir, "nationalities")))
    return store(people.features(a.unionByName(b), table(spark, sf_dir, "source_desks"), forms, places, nations))


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of registry_a and registry_b with the confidence that they are one person.

    The confidence is fitted to what reviewers last said of a pair, of at most ``linkage.LABELS`` pairs.
    """
    said = review.events(table(spark, sf_dir, "review_decisions")).where("decision <> 'withdraw'").groupBy("a_record_id", "b_record_id").agg(F.max(F.struct("decided_at", "decision")).alias("e"))
    labels = said.select(people.record_number("a_record_id", 0).alias("id1"), people.record_number("b_record_id", 1).alias("id2"), (F.col("e.decision") == "refer").cast("int").alias("same"))
    found = linkage.match_sources(_facts(spark, sf_dir), labels)
    return found.select(F.col("record_id_1").alias("a_record_id"), F.col("record_id_2").alias("b_record_id"), "confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs without a confidence, so nothing is fitted."""
    found = linkage.match_sources(_facts(spark, sf_dir))
    return found.select(F.col("record_id_1").alias("a_record_id"), F.col("record_id_2").alias("b_record_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked records whose given or family name is not identical."""
    return linkage.link_variants(_facts(spark, sf_dir)).where("respelled").select("record_id_1", "record_id_2")


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every record, cosine 0.98 or more."""
    return neighbours.nearest(neighbours.usable(table(spark, sf_dir, "face_embeddings"), "record_id", "embeddings", 64))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p4_neighbours(spark, sf_dir)
    return near.select(F.least("id", "other").alias("record_id_1"), F.greatest("id", "other").alias("record_id_2")).distinct()


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the true nearest (cosine 0.98 or more) of the records whose number ends in 00 the index finds."""
    vectors = neighbours.usable(table(spark, sf_dir, "face_embeddings"), "record_id", "embeddings", 64)
    return neighbours.recall_against_blocks(vectors, neighbours.nearest(vectors), vectors.where("id like '%00'"))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors, however far, of the records whose number ends in 00, against all rows."""
    vectors = neighbours.usable(table(spark, sf_dir, "face_embeddings"), "record_id", "embeddings", 64)
    return neighbours.exact(vectors.where("id like '%00'"), vectors)


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item with the words of the longest quote."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters every document loses when its leaked spans are cut out."""
    documents = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text")
    after = leakage.cleaned(documents, p7_leaks(spark, sf_dir))
    return after.select("doc_id", F.length("text").alias("n_chars"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the shares of its text that look stuffed."""
    return spam_pages.score_pages(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("is_spam").select("doc_id")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_matches": p2_matches, "p5_found": p5_found, "p4_found": p4_found, "p4_recall": p4_recall, "p4_nearest": p4_nearest, "p6_packed": p6_packed, "p7_found": p7_found, "p7_cleaned": p7_cleaned, "p8_found": p8_found}
ORACLES: dict[str, str] = {}
