"""Records of one person: across registries by bit vectors, inside a registry by delete neighbourhoods.

Both first find, for the distinct name words, the common words that rare ones are respellings of
(``tokens``, a symmetric-delete index), so records meet under equal words although they were typed
differently. Then records are indexed by pairs of what they say (``keyed``): a name word beside the
beginning of another, beside the day of birth, beside a relative. Pairs under one key whose births, sexes
and list entries leave enough points (``people.most_points``, a bound, so nothing acceptable is lost) are
scored field by field, if the letters of their names leave enough too (``people.names_may_reach``).

``match_sources``: every name word is a bit vector of its two-letter grams and a record's code the row of
its attributes' vectors. The key is a pair of these substrings, as in multi-index hashing: all codes that
agree in two of the indexed substrings are found, whatever the others hold. A name's vector stands beside the
first letter of another word, beside every letter where the other field has no word, and the beginnings of two
words stand together, so a name that is an initial, missing or respelled beyond repair still meets. Dice coefficients of the
vectors, weighted by field, and the points of the fields give a confidence, whose slope and middle are
fitted to a bounded sample of reviewers' decisions (``calibrate``).

``link_variants``: the words of both names are assigned to each other, initials, abbreviations and short
forms permitted.

Crowds: a key is as large as its word at most. Keys of words held by more than ``HOT`` records also hold
the years of birth, in stretches of ``STRETCH`` days; a record of unknown birth stands in every stretch, so
every pair of compatible births still meets. The join itself is split by adaptive execution.

Defined results: records without a usable name or attribute give no key and no row; repeated rows count
once; nulls never agree with anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import people, tokens
from kinloom.session import release, store

HOT = 20_000
STRETCH = 5 * 365
LETTERS = 26
KEYED = "key long, id long, sig long"
MIDDLE, SLOPE = 5.5, 0.9
LABELS = 20_000
_KEY = [c.split()[0] for c in KEYED.split(", ")]


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """One number of several."""
    out = np.zeros(1, np.uint64)
    for p in parts:
        p = p.view(np.uint64) if isinstance(p, np.ndarray) else np.uint64(p)
        out = (out ^ p) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out.view(np.int64)


def _inside(times: np.ndarray) -> np.ndarray:
    """0, 1, ... for every repetition."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _cross(at1: np.ndarray, x: np.ndarray, at2: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and all pairs of ``x`` and ``y`` that stand at the same row; both sorted by row."""
    starts, counts = np.searchsorted(at2, np.arange(n)), np.bincount(at2, minlength=n)
    times = counts[at1]
    return np.repeat(at1, times), np.repeat(x, times), y[np.repeat(starts[at1], times) + _inside(times)]


def _merge(at1: np.ndarray, x: np.ndarray, at2: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, both = np.concatenate([at1, at2]), np.concatenate([x, y])
    order = np.argsort(at, kind="stable")
    return at[order], both[order]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a column of lists."""
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy(zero_copy_only=False)


def batch_keys(ids: np.ndarray, sig: np.ndarray, given, family, kin, words: tokens.Lookup, across: bool) -> list[np.ndarray]:
    """Keys, ids and signatures of a batch; names are ``(rows, tokens)`` sorted by row."""
    n = len(ids)
    (ga, g), (fa, f), (ka, k) = (words.expand(*x) for x in (given, family, kin))
    na, names = _merge(ga, g, fa, f)
    alone = np.bincount(fa, minlength=n)[ga] == 0
    la, last = _merge(fa, f, ga[alone], g[alone])  # family names, or all names where there is one field
    rows, keys, common = [], [], []

    def add(at, kind, word, other):
        rows.append(at)
        keys.append(_mix(kind, words.head[word], other))
        common.append(words.n[word])

    if across:
        each = np.arange(len(names))
        at, i, j = _cross(na, each, na, each, n)
        at, x, y = at[i != j], names[i[i != j]], names[j[i != j]]
        add(at, 1, x, words.first[y])
        # a field without a word (empty, or an initial) may stand for any: the other field's words beside every letter
        for mine, word, rest in ((ga, g, fa), (fa, f, ga)):
            lone = np.bincount(rest, minlength=n)[mine] == 0
            add(np.repeat(mine[lone], LETTERS), 1, np.repeat(word[lone], LETTERS), np.tile(np.arange(LETTERS), lone.sum()))
        p, q = np.minimum(words.prefix[x], words.prefix[y]), np.maximum(words.prefix[x], words.prefix[y])
        rows.append(at)
        keys.append(_mix(4, p, q))
        common.append(np.zeros(len(at), np.int64))  # as rare as both beginnings together
        at, x, y = _cross(na, names, ka, k, n)
        add(at, 2, x, words.head[y])
    else:
        at, x, y = _cross(na, names, na, names, n)
        other = words.head[x] != words.head[y]
        add(at[other], 1, x[other], words.prefix[y[other]])
        at, x, y = _cross(na, names, ka, k, n)
        other = words.head[x] != words.head[y]
        add(at[other], 2, x[other], words.head[y[other]])
    day, span, born = sig & ((1 << 17) - 1), (sig >> people.SPAN) & ((1 << 13) - 1), (sig >> people.BORN) & 1 == 1
    days = np.where(born & (span <= 2), span + 1, 0)
    at, x, d = _cross(la, last, np.repeat(np.arange(n), days), np.repeat(day, days) + _inside(days), n)
    add(at, 3, x, d)
    at, key, common = np.concatenate(rows), np.concatenate(keys), np.concatenate(common)
    if not across:
        key = _mix(key, (ids & 1)[at])
    hot = common > HOT
    if hot.any():
        first = np.where(born, day, 0) // STRETCH
        end = np.where(born, np.minimum(day + span, (1 << 17) - 1), (1 << 17) - 1) // STRETCH
        times = np.where(hot, (end - first)[at] + 1, 1)
        stretch = np.repeat(first[at], times) + _inside(times)
        at, key, hot = np.repeat(at, times), np.repeat(key, times), np.repeat(hot, times)
        key = np.where(hot, _mix(key, stretch), key)
    order = np.lexsort((key, at))
    at, key = at[order], key[order]
    once = np.ones(len(at), bool)
    once[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
    return [key[once], ids[at[once]], sig[at[once]]]


def keyed(facts: DataFrame, resolved: DataFrame, across: bool) -> list[DataFrame]:
    """``key, id, sig``: the keys of every record, from its words and their heads; ``across``: of either side by itself."""
    spark = facts.sparkSession
    resolved = store(resolved)
    sides = [facts.where(F.col("id").bitwiseAND(F.lit(1).cast("long")) == i) for i in (0, 1)] if across else [facts]
    if resolved.count() <= tokens.MAX_BROADCAST:
        rows = resolved.toPandas()
        held = spark.sparkContext.broadcast(tokens.Lookup(*(rows[c].to_numpy(np.int64) for c in tokens.RESOLVED)))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = [_flat(b.column(c)) for c in ("gt", "ft", "kt")]
                got = batch_keys(b.column("id").to_numpy(), b.column("sig").to_numpy(), *names, held.value, across)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], _KEY)

        return [x.select("id", "sig", "gt", "ft", "kt").mapInArrow(emit, KEYED) for x in sides]
    return [joined_keys(x, resolved, across) for x in sides]


def joined_keys(facts: DataFrame, resolved: DataFrame, across: bool) -> DataFrame:
    """``keyed`` for a vocabulary too large to send to every task: heads are joined to the words."""
    parts = [facts.select("id", "sig", F.lit(i).alias("role"), F.explode(c).alias("token")) for i, c in enumerate(("gt", "ft", "kt"))]
    met = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(resolved, "token")
    whole = met.groupBy("id").agg(F.first("sig").alias("sig"), F.collect_set(F.struct("role", *tokens.RESOLVED)).alias("words"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, w = np.repeat(np.arange(b.num_rows), np.diff(b.column("words").offsets.to_numpy())), b.column("words").flatten()
            role = w.field("role").to_numpy()
            columns = [w.field(c).to_numpy() for c in tokens.RESOLVED]
            names = []
            for i in range(3):
                own = np.unique(np.stack([at[role == i], columns[0][role == i]]), axis=1)
                names.append((own[0], own[1]))
            got = batch_keys(b.column("id").to_numpy(), b.column("sig").to_numpy(), *names, tokens.Lookup(*columns), across)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], _KEY)

    return whole.mapInArrow(emit, KEYED)


def candidates(facts: DataFrame, across: bool, need: float) -> DataFrame:
    """Distinct ``id1, id2`` that share a key and may reach ``need`` points; ``across``: of both sides, else of one."""
    words = tokens.vocabulary(facts)
    sides = keyed(facts, tokens.resolved(words, tokens.by_deletes(words), vectors=across), across)
    a, b = sides[0].alias("a"), sides[-1].alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & people.births_meet("a.sig", "b.sig") & (people.most_points("a.sig", "b.sig") >= need - 1e-6))
    if not across:
        met = met.where("a.id < b.id")
    return met.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")).distinct()


def scored(facts: DataFrame, pairs: DataFrame, least: float, dice: bool) -> DataFrame:
    """``record_id_1, record_id_2, points, respelled`` of the pairs that reach ``least`` points.

    ``respelled``: the names as typed differ. Further columns of ``pairs`` are kept, and then all its rows.
    """
    more = [c for c in pairs.columns if c not in ("id1", "id2")]
    cols = ["record_id", "spelled", "given", "family", "kin", "sig", "places"]
    once = facts.select("id", *cols).dropDuplicates(["id"])
    one, two = (once.select(F.col("id").alias(f"id{i}"), *(F.col(c).alias(f"{c}{i}") for c in cols)) for i in (1, 2))
    met = pairs.join(one, "id1").join(two, "id2").drop("id1", "id2")
    most = people.KINS[2] + (MOST_DICE if dice else 0.0)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig1, sig2, at1, at2 = (b.column(c).to_numpy() for c in ("sig1", "sig2", "places1", "places2"))
            plain = people.plain_points(sig1, sig2) + people.exact_entries(at1, at2)
            points = np.full(b.num_rows, -99.0)
            if more:
                open_ = np.arange(b.num_rows)
            else:  # names are compared where the bounds leave enough points
                kin = np.where((sig1 & sig2) >> people.KIN & 1, people.KINS[2], 0.0)
                need = least - 1e-6 - plain - kin - (MOST_DICE if dice else 0.0)
                open_ = np.flatnonzero(people.names_may_reach(*(b.column(c) for c in ("given1", "family1", "given2", "family2")), need))
            rows = zip(open_, *(tokens.listed(b.column(c).take(pa.array(open_))) for c in ("given1", "family1", "kin1", "given2", "family2", "kin2")))
            for i, g1, f1, k1, g2, f2, k2 in rows:
                total = plain[i] + people.names_points(*people.align(g1.split(), f1.split(), g2.split(), f2.split()))
                if total + most < least and not more:
                    continue
                total += people.kin_points(k1, k2, f2) if k1 and k2 else 0.0
                points[i] = total + (weighted_dice((g1, f1, k1), (g2, f2, k2)) if dice else 0.0)
            good = pa.array(np.arange(b.num_rows) if more else np.flatnonzero(points >= least))
            differ = pa.array(b.column("spelled1").to_numpy() != b.column("spelled2").to_numpy())
            columns = [b.column("record_id1"), b.column("record_id2"), pa.array(points), differ, *(b.column(c) for c in more)]
            yield pa.RecordBatch.from_arrays([c.take(good) for c in columns], ["record_id_1", "record_id_2", "points", "respelled", *more])

    kinds = "".join(f", {c} {pairs.schema[c].dataType.simpleString()}" for c in more)
    return met.mapInArrow(rate, "record_id_1 string, record_id_2 string, points double, respelled boolean" + kinds)


MOST_DICE = 0.6


def weighted_dice(x: tuple[str, str, str], y: tuple[str, str, str]) -> float:
    """Points, ``MOST_DICE`` at most, from the Dice coefficients of the bit vectors of given name, family name and kin, around their usual middle."""
    total = weight = 0.0
    for p, q, w in zip(x, y, (1.0, 1.0, 0.5)):
        if p and q:
            if p == q:
                total += w
            else:
                a = b = 0
                for word in p.replace(";", " ").split():
                    a |= people.bits(word)
                for word in q.replace(";", " ").split():
                    b |= people.bits(word)
                total += w * 2 * (a & b).bit_count() / max(1, a.bit_count() + b.bit_count())
            weight += w
    return 1.5 * (total / weight - 0.6) if weight else 0.0


def calibrate(points: np.ndarray, same: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Middle and slope of the logistic curve that gives the share of true pairs at these points.

    Reviewers err, so ``same`` is a noisy sight of the truth: by expectation-maximisation, the truth of every pair is
    weighed under the present curve and the two rates of error, then curve and rates are fitted to it. A weak prior
    holds the built-in curve, which stands where there are no labels.
    """
    x = np.clip(points, -10, 20)
    w = np.array([-SLOPE * MIDDLE, SLOPE])
    prior, hold = w.copy(), np.array([1.0, 10.0])
    wrong, missed = 0.1, 0.1  # said of pairs that are not one person, not said of pairs that are
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        one = p * np.where(same > 0, 1 - missed, missed)
        other = (1 - p) * np.where(same > 0, wrong, 1 - wrong)
        truth = one / (one + other)
        wrong = min(0.45, (((1 - truth) * same).sum() + 1) / ((1 - truth).sum() + 10))
        missed = min(0.45, ((truth * (1 - same)).sum() + 1) / (truth.sum() + 10))
        r = p * (1 - p)
        gradient = np.array([(truth - p).sum(), ((truth - p) * x).sum()]) - hold * (w - prior)
        curve = np.array([[r.sum(), (r * x).sum()], [(r * x).sum(), (r * x * x).sum()]]) + np.diag(hold)
        step = np.linalg.solve(curve, gradient)
        w = w + step * min(1.0, 0.5 / max(np.abs(step).max(), 1e-12))
        w[1] = max(w[1], 0.1)
    return -w[0] / w[1], w[1]


def match_sources(facts: DataFrame, labels: DataFrame | None = None, middle: float = MIDDLE, most: int = LABELS) -> DataFrame:
    """``record_id_1`` (side 0), ``record_id_2`` (side 1), ``points``, ``confidence`` of the pairs of ``middle`` points or more.

    ``labels``: ``id1, id2, same`` (0 or 1), pairs that people decided on. At most ``most`` of them, chosen by a
    hash of their ids, fit the confidence; without labels the built-in curve gives it.
    """
    pairs = store(candidates(facts, across=True, need=middle - MOST_DICE))
    release(facts.sparkSession)  # the keys make room for the names
    found = scored(facts, pairs, middle, dice=True)
    at, slope = middle, SLOPE
    if labels is not None:
        sample = labels.orderBy(F.xxhash64("id1", "id2")).limit(most)
        fit = scored(facts, sample, middle, dice=True).select("points", "same").toPandas()
        at, slope = calibrate(fit["points"].to_numpy(float), fit["same"].to_numpy(float))
    return found.select("record_id_1", "record_id_2", "points", (1 / (1 + F.exp(-slope * (F.col("points") - at)))).alias("confidence"))


def link_variants(facts: DataFrame, middle: float = MIDDLE) -> DataFrame:
    """``record_id_1 < record_id_2`` of one person inside a side."""
    found = scored(facts, candidates(facts, across=False, need=middle), middle, dice=False)
    return found.select(F.least("record_id_1", "record_id_2").alias("record_id_1"), F.greatest("record_id_1", "record_id_2").alias("record_id_2"), "points", "respelled")
