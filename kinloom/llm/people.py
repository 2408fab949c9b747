"""What a person record says, in comparable form, and how far two records say the same.

Names become folded words with their roles (titles dropped, initials kept), birth dates windows of days,
places and nationalities entries of their lists where a word of theirs is written right or sounds right.
Evidence is added in log-odds-like points: a field that one record lacks says nothing, a given name that
differs speaks against one person however much the household agrees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kinloom.llm.canonical import Reference
from kinloom.llm.text import edits, sound, words
from kinloom.llm.tokens import gram_bits, listed, number
from kinloom.operators.timestamps import _MONTH, _plain, candidates

# Words in name fields that name nobody.
_TITLES = frozenset("mr mrs ms miss dr sir the late child of baby born son daughter unknown name nn nil none sheikh hajj haji".split())
_DAY0 = date(1970, 1, 1).toordinal()
_APPROX = re.compile(r"(?:approx|circa|ca|c|about|~)\.?\s*(\d{4})$", re.I)
_AGE = re.compile(r"age\D*(\d{1,3})", re.I)
_YEAR_MONTH = re.compile(r"(\d{4})-(\d{1,2})$|(\d{1,2})/(\d{4})$")
_NAME_YEAR = re.compile(r"([^\W\d_]+)\.?,?\s+(\d{4})$")
_YEAR = re.compile(r"(?:^|\D)(\d{4})$")
EXACT, NEAR, MONTH, YEAR, WIDE = 0, 1, 2, 3, 4


def _ord(y: int, m: int, d: int) -> int:
    return date(y, m, d).toordinal() - _DAY0


def _span(y: int, m: int | None = None, slack: int = 0) -> tuple[int, int]:
    if m:
        return _ord(y, m, 1), (_ord(y, m + 1, 1) if m < 12 else _ord(y + 1, 1, 1)) - 1
    return _ord(y - slack, 1, 1), _ord(y + slack, 12, 31)


_WORDED = re.compile(r"([A-Za-z]{3,12}) (\d{1,2}), (\d{4})|(\d{1,2})[ -]([A-Za-z]{3,12})[ -](\d{4})")
_NUMERIC = re.compile(r"(\d{1,2})([/.-])(\d{1,2})\2(\d{4})")


def _day(y: int, m: int, d: int) -> int | None:
    try:
        return date(y, m, d).toordinal() - _DAY0
    except ValueError:
        return None


def birth_window(raw: str | None, zone: str | None, order: str | None, this_year: int) -> tuple[int, int, int] | None:
    """First and last day (since 1970) and precision; none where nothing is stated.

    Days alone in the common forms are read here, everything else by the readings of ``timestamps``; a moment
    may be a day off in another zone.
    """
    if not raw:
        return None
    if len(raw) == 10 and raw[4] == "-" == raw[7] and raw.isascii():
        try:
            day = date.fromisoformat(raw).toordinal() - _DAY0
            return day, day, EXACT
        except ValueError:
            pass
    elif m := _NUMERIC.fullmatch(raw):
        p, q, y = int(m[1]), int(m[3]), int(m[4])
        dmy, mdy = _day(y, q, p), _day(y, p, q)
        if dmy is not None and mdy is not None and dmy != mdy:
            if order is None or order not in ("dmy", "mdy"):
                return min(dmy, mdy), max(dmy, mdy), YEAR if abs(dmy - mdy) > 3 else EXACT
            dmy, mdy = (dmy, None) if order == "dmy" else (None, mdy)
        day = mdy if dmy is None else dmy
        if day is not None:
            return day, day, EXACT
    elif m := _WORDED.fullmatch(raw):
        month = _MONTH.get((m[1] or m[5]).lower())
        day = _day(int(m[3] or m[6]), month, int(m[2] or m[4])) if month else None
        if day is not None:
            return day, day, EXACT
    return _window(raw, zone, order, this_year)


@lru_cache(maxsize=100_000)
def _window(raw: str, zone: str | None, order: str | None, this_year: int) -> tuple[int, int, int] | None:
    status, found = candidates(raw, zone)
    days = [f for label, f in found if f and (len(found) == 1 or not order or label == order or label not in ("dmy", "mdy"))]
    if status in ("ok", "ambiguous") and days:
        at = sorted(date.fromisoformat(f[:10]).toordinal() - _DAY0 for f in days)
        timed = "T" in days[0]
        if len(at) > 1 and at[-1] - at[0] > 3:
            return at[0], at[-1], YEAR
        return (at[0] - 1, at[-1] + 1, NEAR) if timed else (at[0], at[0], EXACT)
    text = _plain(raw).strip(" .,;").lower()
    try:
        if m := _APPROX.match(text):
            return (*_span(int(m[1]), slack=2), WIDE)
        if m := _AGE.match(text):
            return (*_span(this_year - int(m[1]), slack=3), WIDE)
        if m := _YEAR_MONTH.match(text):
            y, mo = (int(m[1]), int(m[2])) if m[1] else (int(m[4]), int(m[3]))
            return (*_span(y, mo), MONTH)
        if (m := _NAME_YEAR.match(text)) and m[1] in _MONTH:
            return (*_span(int(m[2]), _MONTH[m[1]]), MONTH)
        if m := _YEAR.search(text):
            return (*_span(int(m[1])), YEAR)
    except ValueError:
        return None
    return None


class Forms:
    """Given names behind short forms, from a list of at most ``most`` rows."""

    def __init__(self, rows: list[Row], most: int = 100_000):
        if len(rows) > most:
            raise ValueError(f"more than {most} short forms")
        self.behind: dict[str, frozenset[str]] = {}
        for short, full in ((("".join(words(r[0]))), ("".join(words(r[1])))) for r in rows if r[0] and r[1]):
            self.behind[short] = self.behind.get(short, frozenset()) | {full}

    def full(self, w: str) -> str:
        """The one given name a short form stands for, else the word."""
        got = self.behind.get(w)
        return next(iter(got)) if got and len(got) == 1 else w


class PlaceKeys:
    """Entries by a word written or sounding right; words of several entries tell nothing alone."""

    def __init__(self, reference: Reference):
        by: dict[str, set[str]] = {}
        for ref, form in reference.forms:
            for w in form:
                if w not in reference.generic:
                    by.setdefault(w, set()).add(ref)
                    by.setdefault("~" + sound(w), set()).add(ref)
            if len(form) > 1:
                by.setdefault(" ".join(form), set()).add(ref)
        for code, refs in reference.codes.items():
            by.setdefault(code, set()).update(refs)
        self.by = by
        self.number = {r: i for i, r in enumerate(sorted({r for x in by.values() for r in x}))}

    def find(self, text: str | None) -> int:
        """Number of the entry, -1 where none or several are named."""
        if not text:
            return -1
        ws = words(text)
        for tests in ([" ".join(x) for x in zip(ws, ws[1:])], ws, ["~" + sound(w) for w in ws if len(w) > 4]):
            for t in tests:
                got = self.by.get(t)
                if got and len(got) == 1:
                    return self.number[next(iter(got))]
        return -1


FEATURES = "record_id string, id long, given string, family string, kin string, sig long, places long, spelled long, gt array<long>, ft array<long>, kt array<long>"
_SEP = "\x1f"
# Layout of ``sig``: day 17 bits, span 13, born 1, sex 2, kin 1, then 10 bits each of origin, seen, nation (0: unknown).
DAY, SPAN, BORN, SEX, KIN, ORIGIN, SEEN, NATION = 0, 17, 30, 31, 33, 34, 44, 54
DAY_0 = 1850
_FIRST = _DAY0 - date(DAY_0, 1, 1).toordinal()


def signatures(windows: list, sexes: list[str], kin: list[bool], entries: np.ndarray) -> np.ndarray:
    """What is compared before names, one number a record; entries (rows of three) of long lists are folded to 1,023 values."""
    lo, hi = (np.array([w[k] if w else -(1 << 40) for w in windows], np.int64) for k in (0, 1))
    day = lo + _FIRST
    out = np.where((day >= 0) & (day < 1 << 17), 1 << BORN | day | np.minimum(hi - lo, (1 << 13) - 1) << SPAN, 0)
    out |= np.array([{"M": 1, "F": 2}.get((x or "").strip().upper()[:1], 0) for x in sexes], np.int64) << SEX
    out |= np.array(kin, np.int64) << KIN
    for at, e in zip((ORIGIN, SEEN, NATION), entries.T):
        out |= np.where(e >= 0, e % 1023 + 1, 0) << at
    return out


def record_number(column: str, side: int | Column) -> Column:
    """Number of a record: of its id, or a hash of an id of another form; the last bit is the side."""
    own = F.when(F.col(column).rlike("^[A-Z]-[0-9]{9}$"), F.substring(column, 3, 9).cast("long") * 2).otherwise(F.shiftleft(F.xxhash64(column), 1))
    return own.bitwiseOR((F.lit(side) if isinstance(side, int) else side).cast("long"))


def features(records: DataFrame, desks: DataFrame, forms: Forms, places: PlaceKeys, nations: PlaceKeys, most: int = 100_000) -> DataFrame:
    """One row a row of ``records``: ``FEATURES`` from ``record_id, side, given_name, ...``.

    ``desks`` may have ``most`` rows and raises beyond. Nothing is shuffled: repeated records stay repeated.
    """
    spark = records.sparkSession
    rows = desks.select("source_org", "iana_zone", "date_order").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} source desks")
    lists = spark.sparkContext.broadcast((forms, places, nations, {r[0]: (r[1], r[2]) for r in rows}))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, places, nations, zones = lists.value
        # kept beside the lists, so the next task of this worker finds them filled
        place, nation, name = _kept(places, places.find), _kept(nations, nations.find), _kept(forms, _named(forms))
        for b in batches:
            col = {c: listed(b.column(c)) for c in b.schema.names if c not in ("id", "spelled", "record_id")}
            given, family = [name[g] for g in col["given_name"]], [name[f] for f in col["family_name"]]
            kin = [[x for k in text.split(_SEP) if (x := name[k])[0]] if text else [] for text in col["kin"]]
            windows = [birth_window(born, *zones.get(org, (None, None)), year) for born, org, year in zip(col["birth_date_raw"], col["source_org"], col["year"])]
            entries = np.array([[place[x] for x in col["origin_place"]], [place[x] for x in col["last_seen_place"]], [nation[x] for x in col["nationality"]]], np.int64).T
            sig = signatures(windows, col["sex"], [bool(k) for k in kin], entries)
            where = (entries[:, 0] + 1) << 42 | (entries[:, 1] + 1) << 21 | entries[:, 2] + 1
            flat = [_lists([x[1] for x in given]), _lists([x[1] for x in family]), _lists([[x[1][0] for x in k if x[1]] for k in kin])]
            yield pa.RecordBatch.from_arrays(
                [b.column("record_id"), b.column("id"), *(pa.array(x, pa.string()) for x in ([x[0] for x in given], [x[0] for x in family], [";".join(x[0] for x in k) for k in kin])),
                 pa.array(sig, pa.int64()), pa.array(where, pa.int64()), b.column("spelled"), *flat],
                [c.split()[0] for c in FEATURES.split(", ")],
            )

    chosen = records.select(
        "record_id", record_number("record_id", F.col("side")).alias("id"),
        "given_name", "family_name", "sex", "birth_date_raw", "origin_place", "last_seen_place", "nationality", "source_org",
        F.array_join(F.transform("family_members", lambda m: m["name"]), _SEP).alias("kin"), F.coalesce(F.year("intake_date"), F.lit(2025)).alias("year"),
        F.xxhash64("given_name", F.isnull("given_name"), "family_name", F.isnull("family_name")).alias("spelled"),
    )
    return chosen.mapInArrow(read, FEATURES)


class _Memo(dict):
    """Answers kept by value; emptied when many."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, value):
        if len(self) > 300_000:
            self.clear()
        out = self[value] = self.make(value)
        return out


def _named(forms: Forms):
    words_of = _Memo(lambda w: _word(w, forms))
    return lambda text: _name(text, words_of)


def _kept(lists, make) -> _Memo:
    if not hasattr(lists, "memo"):
        lists.memo = _Memo(make)
    return lists.memo


def _name(text: str | None, words_of: _Memo) -> tuple[str, list[int]]:
    """Folded words of a name and the numbers of their sounds."""
    if not text:
        return "", []
    got = [t for w in words(text) if (t := words_of[w])]
    long = [t for t in got if t[0]]
    if len(long) < len(got) and any(t[1] for t in long):
        got = long
    return " ".join([t[2] for t in got]), [t[3] for t in got if t[3] is not None]


def _word(w: str, forms: Forms) -> tuple | None:
    """Of a word: whether it is long or an initial, whether it is no initial, its full form, the number of that; none for titles."""
    if w in _TITLES:
        return None
    full = forms.full(w)
    return len(w) > 3 or len(w) == 1, len(w) > 1, full, number(sound(full)) if len(full) > 1 else None


def _letters(word: str) -> int:
    """A bit for the first four of every letter in a word."""
    out = 0
    for c in word:
        at = ord(c) % 32 * 4
        out |= ((out >> at & 15) << 1 & 15 | 1) << at
    return out


def _apart(a: int, b: int) -> int:
    """Letters, told by their bits, that one word has beside the other: their edit distance is no less."""
    return max((a & ~b).bit_count(), (b & ~a).bit_count())


_BITS = _Memo(lambda w: gram_bits(sound(w)))
_GRAMS = _Memo(gram_bits)
_LETTERS = _Memo(_letters)


def bits(word: str) -> int:
    """Bit vector of the grams of a word's sound."""
    return _BITS[word]


def _lists(values: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array([x for v in values for x in v], pa.int64()))


@lru_cache(maxsize=400_000)
def word_similarity(a: str, b: str) -> float:
    """1 equal, less for sound, small slips, short forms; 0.5 for an initial; 0 otherwise."""
    if a == b:
        return 1.0 if len(a) > 1 else 0.5
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else 0.0
    s, t = sound(a), sound(b)
    if s == t:
        return 0.95
    short = min(len(a), len(b))
    if short >= 4:
        # edits that count at these lengths; one puts in and takes out a letter at most and touches six grams at most
        far, heard = 3 if short >= 9 else 2 if short >= 6 else 1, 2 if min(len(s), len(t)) >= 7 else 1
        d = edits(a, b, far) if _apart(_LETTERS[a], _LETTERS[b]) <= far and (_GRAMS[a] ^ _GRAMS[b]).bit_count() <= 6 * far else far + 1
        e = edits(s, t, heard) if _apart(_LETTERS[s], _LETTERS[t]) <= heard and (_BITS[a] ^ _BITS[b]).bit_count() <= 6 * heard else heard + 1
        if d == 1 or (e == 1 and short >= 5):
            return 0.88
        if d == 2 and short >= 6 or e == 2 and min(len(s), len(t)) >= 7:
            return 0.78
        if d == 3 and short >= 9:
            return 0.7
    if _short_of(a, b) or _short_of(b, a):
        return 0.75
    if s[:3] == t[:3] and abs(len(s) - len(t)) >= 2:
        n = 0
        for x, y in zip(s, t):
            if x != y:
                break
            n += 1
        if n >= 3 and n >= min(len(s), len(t)) - 1:
            return 0.72  # the beginning of the other, maybe with an ending of its own
    return 0.0


# Endings of short forms that can be guessed.
_ENDINGS = ("ush", "ie", "ka", "y", "i", "o", "a", "e")


def _stems(short: str) -> list[tuple[str, str | None]]:
    """The word without each ending of short forms that it has, and the sound of that where it is long enough."""
    cut = [short[: -len(e)] for e in _ENDINGS if short.endswith(e) and len(short) - len(e) >= 3 - (len(e) == 3)]
    return [(stem, sound(stem) if len(stem) >= 4 else None) for stem in cut]


_STEMS = _Memo(_stems)


def _short_of(short: str, full: str) -> bool:
    """The beginning of a name with an ending of short forms."""
    if len(short) >= len(full) + 2:
        return False
    for stem, heard in _STEMS[short]:
        if len(full) > len(stem) + 1 and (full.startswith(stem) or (heard is not None and sound(full).startswith(heard))):
            return True
    return False


def assignment(ws: list[str], others: list[str]) -> float:
    """Similarity of two lists of words under their best one-to-one assignment; -1 where one is empty.

    The total is taken over the shorter list, so a word of it without a partner costs its share, and
    further words of the longer list (second names left out) cost nothing.
    """
    if not ws or not others:
        return -1.0
    if len(ws) > len(others):
        ws, others = others, ws
    if len(ws) == 1:
        return max([word_similarity(ws[0], b) for b in others])
    if len(ws) > 6:
        return _hungarian([[word_similarity(a, b) for b in others] for a in ws]) / len(ws)
    # best total by subsets of the longer list's words that matter to the shorter one
    rows = [sorted(((word_similarity(a, b), j) for j, b in enumerate(others)), reverse=True)[: len(ws)] for a in ws]
    best = {0: 0.0}
    for row in rows:
        after = dict(best)
        for used, total in best.items():
            for sim, j in row:
                if sim and not used >> j & 1 and after.get(used | 1 << j, -1.0) < total + sim:
                    after[used | 1 << j] = total + sim
        best = after
    return max(best.values()) / len(ws)


def _hungarian(gain: list[list[float]]) -> float:
    """Best total of a one-to-one assignment of rows to columns, rows at most as many as columns."""
    n, m = len(gain), len(gain[0])
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, seen = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[j0]:
            seen[j0] = True
            i0, step, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not seen[j]:
                    cost = 1 - gain[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sum(gain[owner[j] - 1][j - 1] for j in range(1, m + 1) if owner[j])


def align(given1: list[str], family1: list[str], given2: list[str], family2: list[str]) -> tuple[float, float]:
    """Similarity of the given and of the family names under the best assignment of words and roles; -1 where unknown."""
    g, f = assignment(given1, given2), assignment(family1, family2)
    if g >= 0.95 and f >= 0.95:
        return g, f
    if given1 and given2 and (family1 or family2):
        x = assignment(given1, family2)
        if x >= 0.7 and (y := assignment(family1, given2)) >= 0.7 and min(x, y) > min(g, f):
            return x, y
    # a record with one name field may hold both parts in it
    for have, given, family, all_ in ((bool(given1 and family1), given2, family2, given1 + family1), (bool(given2 and family2), given1, family1, given2 + family2)):
        if not have and given and family and len(all_) > 1:
            both = max(((min(x, y), x, y) for i, p in enumerate(all_) for j, q in enumerate(all_) if i != j for x, y in ((assignment([p], given), assignment([q], family)),)), default=(0, 0, 0))
            if both[0] >= 0.7:
                return both[1], both[2]
    return g, f


# Points of the evidence, log-odds-like. A birth that cannot be the same excludes; an entry of the lists
# that differs weighs much more than one that agrees, as entries are found only where they are sure.
BIRTH = ((0, 5.5), (3, 4.5), (31, 3.5), (366, 2.2), (1 << 13, 1.2))  # span of the wider window up to, points
ENTRIES = ((ORIGIN, 2.2, -5.0), (SEEN, 1.0, -4.0), (NATION, 0.7, -4.0))
SEXES = (0.4, -4.0)
KINS = (-1.2, 2.4, 4.0)
NAMES = 7.0


ALIKE = (0.95, 0.85, 0.7, 0.5, 0.0)
GIVENS = (3.5, 2.6, 1.6, 0.3, -14.0)
FAMILIES = (3.5, 2.8, 1.8, 0.5, -5.0)


def names_points(g: float, f: float) -> float:
    points = 0.0
    if g >= 0:
        points += GIVENS[0 if g >= 0.95 else 1 if g >= 0.85 else 2 if g >= 0.7 else 3 if g >= 0.5 else 4]
    if f >= 0:
        points += FAMILIES[0 if f >= 0.95 else 1 if f >= 0.85 else 2 if f >= 0.7 else 3 if f >= 0.5 else 4]
    return points


_FAR = 12  # letters of a beginning that are compared
_WIDE = 400  # pairs of words of two names that are looked at for a bound


def _code(word: str) -> tuple[int, ...]:
    """Of a word: of it and its sound letters, beginnings, lengths and the shortest beginnings that a full form of it must have."""
    s, stems = sound(word), _STEMS[word]
    heard = [len(commonprefix([x, s])) for _, x in stems if x is not None]
    begun = [sum(ord(c) % 32 << 5 * i for i, c in enumerate(x[:_FAR])) for x in (word, s)]
    return _pairs_of(word), _pairs_of(s), *begun, len(word), len(s), min((len(x) for x, _ in stems), default=1 << 20), min(heard, default=1 << 20)


def _pairs_of(word: str) -> int:
    """A bit for the first two of every letter in a word."""
    out = 0
    for c in word:
        at = ord(c) % 32 * 2
        out |= 1 << at + (out >> at & 1)
    return out


_CODES = _Memo(lambda name: [_code(w) for w in name.split()])


class NameCodes:
    """The words of a column of names as numbers; names are known by their place among the distinct ones."""

    def __init__(self, names: pa.Array):
        met = names.dictionary_encode()
        codes = [_CODES[x] for x in listed(met.dictionary)]
        self.at = met.indices.to_numpy()
        self.n = np.array([len(c) for c in codes], np.int64)
        self.start = np.cumsum(self.n) - self.n
        flat = np.array([w for c in codes for w in c], np.uint64).reshape(-1, 8)
        self.bits, self.sizes = np.ascontiguousarray(flat[:, :4].T), np.ascontiguousarray(flat[:, 4:].astype(np.int64).T)


def _words_at_most(x: NameCodes, i: np.ndarray, y: NameCodes, j: np.ndarray) -> np.ndarray:
    """A bound on ``word_similarity`` from the letters and beginnings that two words share."""
    (n, ns, stem1, heard1), (m, ms, stem2, heard2) = x.sizes[:, i], y.sizes[:, j]
    a, b = x.bits[:, i], y.bits[:, j]
    apart = np.maximum(np.bitwise_count(a[:2] & ~b[:2]), np.bitwise_count(b[:2] & ~a[:2])).astype(np.int64)
    other = a[2:] ^ b[2:]
    spelled, sounded = np.where(other == 0, _FAR, np.bitwise_count((other & -other) - np.uint64(1)) // 5)
    short, least = np.minimum(n, m), np.minimum(ns, ms)
    far = (short >= 4) * 1 + (short >= 6) + (short >= 9)
    heard = np.where(least >= 7, 2, 1)
    likely = (short >= 4) & ((np.abs(n - m) <= far) & (apart[0] <= far) | (np.abs(ns - ms) <= heard) & (apart[1] <= heard))
    likely |= (sounded >= np.clip(least - 1, 3, _FAR)) & (np.abs(ns - ms) >= 2)
    likely |= (n < m + 2) & ((spelled >= np.minimum(stem1, _FAR)) & (m > stem1 + 1) | (sounded >= np.minimum(heard1, _FAR)))
    likely |= (m < n + 2) & ((spelled >= np.minimum(stem2, _FAR)) & (n > stem2 + 1) | (sounded >= np.minimum(heard2, _FAR)))
    alike = (ns == ms) & (sounded >= np.minimum(least, _FAR))
    most = np.where(alike, 1.0, np.where(likely, 0.88, 0.0))
    return np.where(short == 1, np.where(spelled > 0, 0.5, 0.0), most)


def at_most(x: NameCodes, y: NameCodes, rows: np.ndarray, single: bool = False) -> np.ndarray:
    """A bound on ``assignment`` of two names, or with ``single`` of a word of each, for some rows; -1 where one is empty."""
    i, j = x.at[rows], y.at[rows]
    n, m = x.n[i], y.n[j]
    out = np.where((n > 0) & (m > 0), 0.0, -1.0)
    one, many = (n == 1) & (m == 1), n * m > _WIDE
    out[many] = 1.0
    out[one] = _words_at_most(x, x.start[i[one]], y, y.start[j[one]])
    # every word of the shorter name beside every word of the other
    for p, q, some in ((x, y, (n <= m) & (n > 0) & ~one & ~many), (y, x, (n > m) & (m > 0) & ~many)):
        some = np.flatnonzero(some)
        if len(some):
            u, v = (i[some], j[some]) if p is x else (j[some], i[some])
            few, others = p.n[u], q.n[v]
            word = np.repeat(p.start[u] - np.cumsum(few) + few, few) + np.arange(few.sum())
            wide = np.repeat(others, few)
            begin = np.cumsum(wide) - wide
            beside = np.repeat(np.repeat(q.start[v], few) - begin, wide) + np.arange(wide.sum())
            best = np.maximum.reduceat(_words_at_most(p, np.repeat(word, wide), q, beside), begin)
            begin = np.cumsum(few) - few
            out[some] = np.maximum.reduceat(best, begin) if single else np.add.reduceat(best, begin) / few
    return out


def names_may_reach(given1: pa.Array, family1: pa.Array, given2: pa.Array, family2: pa.Array, need: np.ndarray) -> np.ndarray:
    """False only where ``names_points`` of the aligned names is less than ``need``."""
    g1, f1, g2, f2 = map(NameCodes, (given1, family1, given2, family2))
    may = need <= names_points(0.0, 0.0)
    rows = np.flatnonzero((need <= NAMES) & ~may)
    points = sum(np.select([x + 1e-9 >= s for s in ALIKE], p, 0.0) for x, p in ((at_most(g1, g2, rows), GIVENS), (at_most(f1, f2, rows), FAMILIES)))
    may[rows] = points >= need[rows] - 1e-9
    # both parts in one field, or roles exchanged
    for g, f, given, family in ((g1, f1, g2, f2), (g2, f2, g1, f1)):
        for all_, none in ((g, f), (f, g)):
            left = rows[~may[rows]]
            left = left[(all_.n[all_.at[left]] > 1) & (none.n[none.at[left]] == 0)]
            for part in (given, family):
                left = left[at_most(all_, part, left, single=True) >= 0.7]
            may[left] = True
    left = rows[~may[rows]]
    left = left[at_most(g1, f2, left) >= 0.7 - 1e-9]
    may[left[at_most(f1, g2, left) >= 0.7 - 1e-9]] = True
    return may


def kin_points(kin1: str, kin2: str, family2: str) -> float:
    k1, k2 = [k.split() for k in kin1.split(";") if k], [k.split() for k in kin2.split(";") if k]
    if not k1 or not k2:
        return 0.0
    family = family2.split()
    hits = sum(any(word_similarity(x, k[0]) >= 0.7 for k in k2) or any(word_similarity(x, y) >= 0.7 for k in k2 for y in k[1:] if y not in family) for x in (k[0] for k in k1))
    return KINS[min(hits, 2)]


def plain_points(a, b, shift=np.right_shift) -> np.ndarray:
    """Points of birth, sex and list entries from two ``sig``; -99 where births exclude each other."""
    part = lambda x, at, width: shift(x, at) & ((1 << width) - 1)
    day1, day2, span1, span2 = part(a, DAY, 17), part(b, DAY, 17), part(a, SPAN, 13), part(b, SPAN, 13)
    born = (part(a, BORN, 1) & part(b, BORN, 1)) == 1
    wide = np.maximum(span1, span2)
    points = np.select([wide <= w for w, _ in BIRTH], [p for _, p in BIRTH])
    points = np.where((day1 <= day2 + span2) & (day2 <= day1 + span1), points, -99.0) * born
    x, y = part(a, SEX, 2), part(b, SEX, 2)
    points += np.where((x == 0) | (y == 0), 0.0, np.where(x == y, *SEXES))
    for at, same, other in ENTRIES:
        x, y = part(a, at, 10), part(b, at, 10)
        points += np.where((x == 0) | (y == 0), 0.0, np.where(x == y, same, other))
    return points


def births_meet(a: str, b: str) -> Column:
    """Whether two ``sig`` leave it open that the births are one: cheap, and false for most strangers."""
    part = lambda x, at, width: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    unknown = F.shiftrightunsigned(F.col(a).bitwiseAND(F.col(b)), BORN).bitwiseAND(F.lit(1).cast("long")) == 0
    day1, day2 = part(a, DAY, 17), part(b, DAY, 17)
    return unknown | ((day1 <= day2 + part(b, SPAN, 13)) & (day2 <= day1 + part(a, SPAN, 13)))


def most_points(a: str, b: str):
    """The points of ``plain_points`` with the best that names and kin could add, as a column over two ``sig``."""
    part = lambda x, at, width: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    day1, day2, span1, span2 = part(a, DAY, 17), part(b, DAY, 17), part(a, SPAN, 13), part(b, SPAN, 13)
    birth = F.lit(BIRTH[-1][1])
    for w, p in reversed(BIRTH[:-1]):
        birth = F.when(F.greatest(span1, span2) <= w, p).otherwise(birth)
    both = F.shiftrightunsigned(F.col(a).bitwiseAND(F.col(b)), BORN).bitwiseAND(F.lit(1).cast("long")) == 1
    points = F.when(~both, 0.0).when((day1 <= day2 + span2) & (day2 <= day1 + span1), birth).otherwise(-99.0) + NAMES
    x, y = part(a, SEX, 2), part(b, SEX, 2)
    points = points + F.when((x == 0) | (y == 0), 0.0).when(x == y, SEXES[0]).otherwise(SEXES[1])
    for at, same, other in ENTRIES:
        x, y = part(a, at, 10), part(b, at, 10)
        points = points + F.when((x == 0) | (y == 0), 0.0).when(x == y, same).otherwise(other)
    kin = F.shiftrightunsigned(F.col(a).bitwiseAND(F.col(b)), KIN).bitwiseAND(F.lit(1).cast("long")) == 1
    return points + F.when(kin, KINS[2]).otherwise(0.0)


def exact_entries(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What ``plain_points`` gives too much to entries that only their folded numbers make equal."""
    out = np.zeros(len(a))
    for at, (_, same, other) in zip((42, 21, 0), ENTRIES):
        x, y = (a >> at) & ((1 << 21) - 1), (b >> at) & ((1 << 21) - 1)
        out += np.where((x > 0) & (y > 0) & (x != y) & ((x - 1) % 1023 == (y - 1) % 1023), other - same, 0.0)
    return out
