"""Free-typed values mapped to the entries of a canonical list (token repair, then soft TF-IDF).

The distinct words of all values meet the words of the list by edit distance once each; a value is
then scored from its repaired words: every name an entry goes by gets the share of its TF-IDF weight
that the value's words cover, and the best name wins if it covers enough and no other entry ties with
it. Words beside the name serve only to tell entries of one name apart.

Defined results: null and blank values give no row; values that denote no entry, or several alike,
give ``UNLISTED``; values equal to a name are answered like any other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from kinloom.llm.text import DeleteIndex, edits, sound, words
from kinloom.session import parallelism, store

UNLISTED = "UNLISTED"
MAX_ENTRIES = 100_000


class Reference:
    """A canonical list: ``entries`` are ``(ref_id, names, codes, context)``, at most ``MAX_ENTRIES``."""

    def __init__(self, entries: list[tuple[str, list[str], list[str], list[str]]]):
        if len(entries) > MAX_ENTRIES:
            raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
        self.forms: list[tuple[str, tuple[str, ...]]] = []
        self.codes: dict[str, set[str]] = {}
        self.context: dict[str, set[str]] = {}
        spread: dict[str, set[str]] = {}
        for ref, names, codes, context in entries:
            for name in names:
                form = tuple(words(name))
                if form:
                    self.forms.append((ref, form))
                    for w in form:
                        spread.setdefault(w, set()).add("".join(form))
                    if len(form) > 1:
                        self.forms.append((ref, ("".join(form),)))
            for c in codes:
                self.codes.setdefault("".join(words(c)), set()).add(ref)
            self.context[ref] = {w for c in context for w in words(c)}
        n = max(1, len(entries))
        self.idf = {w: math.log(1 + n / len(s)) for w, s in spread.items()}
        self.generic = {w for w, s in spread.items() if len(s) >= 4}
        vocabulary = sorted({w for _, f in self.forms for w in f} | {w for c in self.context.values() for w in c})
        self.index = DeleteIndex(vocabulary)
        self.by_word: dict[str, list[int]] = {}
        for i, (_, f) in enumerate(self.forms):
            for w in set(f):
                self.by_word.setdefault(w, []).append(i)

    def repair(self, word: str, dotted: bool) -> list[tuple[str, float]]:
        """Words of the list that a written word may stand for."""
        found = dict(self.index.search(word))
        if len(word) <= 5:
            for g in self.generic:
                if g[0] == word[0] and len(word) < len(g):
                    letters = iter(g)
                    if all(c in letters for c in word):
                        sim = 0.95 if len(word) > 1 and (word[-1] == g[-1] or g.startswith(word)) else 0.8
                        found[g] = max(found.get(g, 0), sim)
        if dotted and len(word) >= 4 and max(found.values(), default=0) < 0.8:
            skeleton = sound(word)
            for v, s in zip(self.index.vocabulary, self.index.sounds):
                if len(v) > len(word) + 1:
                    cost = 0 if v.startswith(word) else 0.5 if s.startswith(skeleton) else min(edits(word, v[: len(word) + j], 1) for j in (-1, 0, 1))
                    if cost <= 1:
                        found[v] = max(found.get(v, 0), 0.9 - 0.1 * cost)
        if len(word) >= 8 and word not in found:  # a listed word with an ending that the list has not
            for n in range(max(7, len(word) - 4), len(word)):
                if word[:n] in self.index.place:
                    found[word[:n]] = max(found.get(word[:n], 0), 0.9)
        return sorted(found.items(), key=lambda x: (-x[1], x[0]))

    def rank(self, tokens: list[tuple[int, int, list[tuple[str, float]]]], whole: str) -> tuple[str, float]:
        """The entry of a value from its repaired words ``(first, last position, repairs)``."""
        if whole in self.codes:
            refs = self.codes[whole]
            return (next(iter(refs)), 1.0) if len(refs) == 1 else (UNLISTED, 0.0)
        best: dict[str, list[tuple[float, int, int]]] = {}
        for first, last, repairs in tokens:
            for v, sim in repairs:
                best.setdefault(v, []).append((sim, first, last))
        scored: dict[str, tuple] = {}
        for i in {i for v in best for i in self.by_word.get(v, ())}:
            ref, form = self.forms[i]
            got = total = 0.0
            used: set[int] = set()
            strong, missing, surest = False, [], 0.0
            for w in sorted(form, key=lambda w: -self.idf.get(w, 6.0)):
                weight = self.idf.get(w, math.log(1 + len(self.context)))
                free = [x for x in best.get(w, ()) if not used.intersection(range(x[1], x[2] + 1))]
                if free:
                    sim, first, last = max(free, key=lambda x: (x[0] - 0.1 * (x[2] > x[1]), -x[1]))
                    if last > first and sim < 0.8:
                        sim *= 0.8
                    used.update(range(first, last + 1))
                    total += weight
                    got += weight * sim
                    if w not in self.generic:
                        strong, surest = strong or sim >= 0.7, max(surest, sim)
                else:
                    missing.append(w)
                    total += weight * (0.3 if w in self.generic else 1)
            score = got / total
            others = {v for v, xs in best.items() if v in self.generic and v not in form and max(x[0] for x in xs) >= 0.9 and any(not used.intersection(range(x[1], x[2] + 1)) for x in xs)}
            if not strong or score < 0.6 or (missing and surest < 0.75) or (others and any(w in self.generic for w in missing)):
                continue
            around = sum(max((x[0] for x in best.get(w, ())), default=0) for w in self.context[ref])
            key = (round(score, 3), round(around, 3), len(form))
            if key > scored.get(ref, ((),))[0] if ref in scored else True:
                scored[ref] = (key, score)
        if not scored:
            return UNLISTED, 0.0
        order = sorted(scored.items(), key=lambda x: x[1][0], reverse=True)
        if len(order) > 1 and order[0][1][0][:2] == order[1][1][0][:2]:
            return UNLISTED, order[0][1][1]
        # same-name entries: the surroundings must decide, whatever the last digit of the score
        return order[0][0], order[0][1][1]


_RUN_ON = re.compile(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})")  # words written without a space


def _split(raw: str, known: dict) -> list[tuple[int, int, str, bool]]:
    """Words of a value and joins of neighbours that the list does not know, with positions and whether a full stop follows."""
    parts = []
    for chunk in _RUN_ON.sub(" ", raw.replace("_", " ")).split():
        for w in words(chunk):
            parts.append((w, False))
        if parts and chunk.rstrip(",;:)?*").endswith("."):
            parts[-1] = (parts[-1][0], True)
    if len(parts) > 1 and all(len(w) == 1 for w, _ in parts):
        parts = [("".join(w for w, _ in parts), False)]
    out = [(i, i, w, dot) for i, (w, dot) in enumerate(parts)]
    out += [(i, i + 1, a + b, False) for i, ((a, _), (b, _)) in enumerate(zip(parts, parts[1:])) if not (a in known or b in known)]
    return out


def _own(n: int, slips: float) -> bool:
    """Whether a word stands more often than its slips could, if ``slips`` are expected; two deviations are allowed for."""
    return n > slips + 2 * math.sqrt(slips + 1)


def map_to_list(values: DataFrame, references: dict[str, Reference], own_share: float = 0.1) -> DataFrame:
    """``(kind, value, ref_id, score)`` for the distinct ``(kind, value)`` of ``values``; kind names the list."""
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast(references)  # bounded by MAX_ENTRIES each

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, v, c, *x) for k, v, c in zip(b["kind"], b["value"], b["n"]) for x in (_split(v, shared.value[k].index.place) or [(0, 0, "", False)])]
            yield pd.DataFrame(rows, columns=["kind", "value", "n", "first", "last", "word", "dotted"])

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, word, dotted, n in zip(b["kind"], b["word"], b["dotted"], b["n"]):
                got = shared.value[kind].repair(word, bool(dotted)) if word else []
                # a slip is rare beside the word it was meant for; a word written as often is a word of its own
                out.append([{"w": w, "s": s} for w, s in got if s >= 0.9 or not (right.value.get((kind, w)) and _own(n, own_share * right.value[kind, w]))])
            yield b[["kind", "word", "dotted"]].assign(repairs=out)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            refs = []
            for kind, value, tokens in zip(b["kind"], b["value"], b["tokens"]):
                got = [(t["first"], t["last"], [(r["w"], r["s"]) for r in t["repairs"]]) for t in tokens]
                refs.append(shared.value[kind].rank(got, "".join(words(value))))
            yield pd.DataFrame({"kind": b["kind"], "value": b["value"], "ref_id": [r for r, _ in refs], "score": [s for _, s in refs]})

    n = parallelism(spark)
    # dealt out evenly: these stages cost CPU and few bytes, so partitions gathered by size would be one task
    distinct = values.where(F.trim("value") != "").groupBy("kind", "value").agg(F.count("*").alias("n")).repartition(n)
    split_ = store(distinct.mapInPandas(split, "kind string, value string, n long, first int, last int, word string, dotted boolean"))
    lists = [(k, w) for k, r in references.items() for w in r.index.vocabulary]
    listed = spark.createDataFrame(lists, "kind string, word string")
    # how often each word of the lists is written right: as many rows as the lists have words
    right = spark.sparkContext.broadcast({(r.kind, r.word): r.n for r in split_.join(F.broadcast(listed), ["kind", "word"]).groupBy("kind", "word").agg(F.sum("n").alias("n")).collect()})
    words_ = split_.groupBy("kind", "word", "dotted").agg(F.sum("n").alias("n")).repartition(n)
    repaired = words_.mapInPandas(repair, "kind string, word string, dotted boolean, repairs array<struct<w: string, s: double>>")
    met = split_.join(repaired, ["kind", "word", "dotted"])
    grouped = met.groupBy("kind", "value").agg(F.collect_list(F.struct("first", "last", "repairs")).alias("tokens"))
    return grouped.mapInPandas(rank, "kind string, value string, ref_id string, score double")


def places(rows: list[Row]) -> Reference:
    return Reference([(r.place_id, [r.place_name, *(r.alt_names or [])], [], [r.district or "", r.country or ""]) for r in rows])


def nationalities(rows: list[Row]) -> Reference:
    endings = ("ish", "ese", "an", "i")  # fixed values: endings of the listed names
    entries = []
    for r in rows:
        stem = next((r.nat_name[: -len(e)] for e in endings if r.nat_name.endswith(e)), r.nat_name)
        entries.append((r.nat_id, [r.nat_name, r.country, *(stem + e for e in (*endings, "ian", "er"))], [r.code], []))
    return Reference(entries)
