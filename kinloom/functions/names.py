"""Name and place similarity: edit measures, phonetic codes and their fusion; scalar rules and Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions.dates import window_sql


def clean_name(c) -> Column:
    """Letters a-z alone, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")


def normalise_place(c) -> Column:
    """Runs of other characters become one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


@lru_cache(200_000)
def jaro_winkler(a: str, b: str) -> float:
    """0 to 1; half transpositions are floored, the prefix counts above 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, t in zip(b, taken) if t]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(200_000)
def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths; two empty texts are alike."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with either rest; 100 where one is part of the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    one, two = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    return max(indel_ratio(one, two), *((indel_ratio(both, one), indel_ratio(both, two)) if both else (0.0,)))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def metaphone(word: str) -> str:
    """The published rules for English consonants."""
    w = re.sub("[^A-Z]", "", word.upper())
    if w[:2] in ("KN", "GN", "PN", "AE", "WR"):
        w = w[1:]
    elif w[:1] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out, i = [], 0
    at = lambda k: w[k] if 0 <= k < len(w) else ""
    vowel = lambda c: c != "" and c in "AEIOU"
    while i < len(w):
        c, n = w[i], at(i + 1)
        if c == at(i - 1) and c != "C":
            i += 1
            continue
        step = 1
        if vowel(c):
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if i == len(w) - 1 and at(i - 1) == "M" else "B"
        elif c == "C":
            if n == "I" and at(i + 2) == "A" or n == "H":
                code, step = "X", 2 if n == "H" else 1
            elif n and n in "IEY":
                code = "" if at(i - 1) == "S" else "S"
            else:
                code = "K"
        elif c == "D":
            code, step = ("J", 2) if n == "G" and at(i + 2) != "" and at(i + 2) in "EIY" else ("T", 1)
        elif c == "G":
            if n == "H":
                code = "K" if i + 2 == len(w) or vowel(at(i + 2)) else ""
            elif n == "N":
                code = ""
            elif n and n in "IEY":
                code = "J"
            else:
                code = "K"
        elif c == "H":
            code = "" if (vowel(at(i - 1)) and not vowel(n)) or (at(i - 1) and at(i - 1) in "CSPT") else "H"
        elif c == "K":
            code = "" if at(i - 1) == "C" else "K"
        elif c == "P":
            code, step = ("F", 2) if n == "H" else ("P", 1)
        elif c == "Q":
            code = "K"
        elif c == "S":
            if n == "H":
                code, step = "X", 2
            else:
                code = "X" if n == "I" and at(i + 2) in ("O", "A") and at(i + 2) else "S"
        elif c == "T":
            if n == "H":
                code, step = "0", 2
            elif n == "I" and at(i + 2) in ("O", "A") and at(i + 2):
                code = "X"
            else:
                code = "" if n == "C" and at(i + 2) == "H" else "T"
        elif c == "V":
            code = "F"
        elif c in "WY":
            code = c if vowel(n) else ""
        elif c == "X":
            code = "KS"
        elif c == "Z":
            code = "S"
        else:
            code = c
        out.append(code)
        i += step
    return "".join(out)


def nysiis(word: str) -> str:
    """The published New York State code, without a length limit."""
    w = re.sub("[^A-Z]", "", word.upper())
    if not w:
        return ""
    for old, new in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(old):
            w = new + w[len(old) :]
            break
    for old, new in (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D")):
        if w.endswith(old):
            w = w[: -len(old)] + new
            break
    out, i = w[0], 1
    while i < len(w):
        c, step = w[i], 1
        if w[i : i + 2] == "EV":
            new, step = "AF", 2
        elif c in "AEIOU":
            new = "A"
        elif c == "Q":
            new = "G"
        elif c == "Z":
            new = "S"
        elif c == "M":
            new = "N"
        elif w[i : i + 2] == "KN":
            new, step = "N", 2
        elif c == "K":
            new = "C"
        elif w[i : i + 3] == "SCH":
            new, step = "SSS", 3
        elif w[i : i + 2] == "PH":
            new, step = "FF", 2
        elif c == "H" and (w[i - 1] not in "AEIOU" or i + 1 < len(w) and w[i + 1] not in "AEIOU"):
            new = w[i - 1]
        elif c == "W" and w[i - 1] in "AEIOU":
            new = w[i - 1]
        else:
            new = c
        for x in new:
            if out[-1] != x:
                out += x
        i += step
    if len(out) > 1 and out.endswith("S"):
        out = out[:-1]
    if out.endswith("AY"):
        out = out[:-2] + "Y"
    if len(out) > 1 and out.endswith("A"):
        out = out[:-1]
    return out


def soundex(word: str) -> str:
    w = re.sub("[^A-Z]", "", word.upper())
    if not w:
        return ""
    groups = {c: str(i) for i, g in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in g}
    out, last = w[0], groups.get(w[0], "")
    for c in w[1:]:
        code = groups.get(c, "")
        if code and code != last:
            out += code
        if c not in "HW":
            last = code
    return (out + "000")[:4]


# Coders by trust, and the floor their agreement justifies.
CODERS = (("metaphone", metaphone, 90.0), ("nysiis", nysiis, 84.0), ("soundex", soundex, 76.0))


def phonetic_agreement(a: str, b: str) -> tuple[str | None, float]:
    if a and b:
        for name, coder, floor in CODERS:
            x = coder(a)
            if x and x == coder(b):
                return name, floor
    return None, 0.0


@lru_cache(200_000)
def name_score(a: str, b: str) -> tuple[float, bool]:
    """0 to 100 for one name part, and whether a code agreed."""
    x, y = re.sub("[^a-z]", "", (a or "").lower()), re.sub("[^a-z]", "", (b or "").lower())
    if not x or not y:
        return 0.0, False
    if x == y:
        return 100.0, False
    edit = 60 * jaro_winkler(x, y) + 0.4 * indel_ratio(x, y)
    coder, floor = phonetic_agreement(a, b)
    return max(edit, floor), coder is not None


@lru_cache(200_000)
def place_score(a: str, b: str) -> float:
    """Fuzzy part of a place comparison on normalised text."""
    best = max(token_set_ratio(a, b), 100 * jaro_winkler(a, b))
    return max(best, phonetic_agreement(a.replace(" ", ""), b.replace(" ", ""))[1])


def portable_key(text: str) -> str:
    """Marks stripped, lower case, letters, digits and single spaces kept."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return " ".join(re.sub("[^a-z0-9 ]", "", " ".join(plain.split())).split())


@lru_cache(200_000)
def portable_jaro_winkler(a: str, b: str) -> float:
    """The variant of the second scorer: half transpositions count, the prefix always does."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == x), None)
        if j is not None:
            taken.add(j)
            mine.append(x)
    if not mine:
        return 0.0
    m, apart = len(mine), sum(x != b[j] for x, j in zip(mine, sorted(taken))) / 2
    jaro = (m / len(a) + m / len(b) + (m - apart) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(200_000)
def portable_name(a: str, b: str) -> tuple[float, bool]:
    """``name_score`` of the second scorer: one phonetic code."""
    x, y = portable_key(a), portable_key(b)
    if not x or not y:
        return 0.0, False
    if x == y:
        return 100.0, False
    edit, code = 60 * portable_jaro_winkler(x, y) + 0.4 * indel_ratio(x, y), metaphone(x)
    coded = bool(code) and code == metaphone(y)
    return (max(edit, 90.0) if coded else edit), coded


def portable_place(a: str, b: str) -> float:
    """Fuzzy part of a place comparison of the second scorer."""
    best = max(token_sort_ratio(a, b), 100 * portable_jaro_winkler(a, b))
    code = metaphone(a.replace(" ", ""))
    return max(best, 90.0) if code and code == metaphone(b.replace(" ", "")) else best


def _pairwise(fn):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x or "", y or "") for x, y in zip(a, b)], dtype=float)

    return F.pandas_udf(run, T.DoubleType())


def _each(fn):
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in a], dtype=object)

    return F.pandas_udf(run, T.StringType())


def _jw(a, b):
    return jaro_winkler(a, b)


jaro_winkler_udf, indel_udf, token_set_udf = _pairwise(_jw), _pairwise(indel_ratio), _pairwise(token_set_ratio)
token_sort_udf, place_udf = _pairwise(token_sort_ratio), _pairwise(place_score)
metaphone_udf, nysiis_udf, soundex_udf = _each(metaphone), _each(nysiis), _each(soundex)


_SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("coded", T.BooleanType())])


def _scored(fn):
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fn(x or "", y or "") for x, y in zip(a, b)], columns=["score", "coded"])

    return F.pandas_udf(run, _SCORED)


name_score_udf, portable_name_udf = _scored(name_score), _scored(portable_name)
portable_place_udf, portable_jaro_winkler_udf, portable_key_udf = _pairwise(portable_place), _pairwise(portable_jaro_winkler), _each(portable_key)


def register(spark) -> None:
    """SQL names of the functions: similarities, codes, ``parse_date_window`` and ``vector_cosine``."""
    named = {"jaro_winkler": jaro_winkler_udf, "indel_ratio": indel_udf, "token_set_ratio": token_set_udf, "token_sort_ratio": token_sort_udf, "metaphone": metaphone_udf, "nysiis": nysiis_udf, "name_score": name_score_udf, "portable_name_score": portable_name_udf}
    for name, udf in named.items():
        spark.udf.register(name, udf)
    spark.sql(f"create or replace temporary function parse_date_window(raw string) returns struct<lo: date, hi: date, precision: string> return {window_sql('raw')}")
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, x) -> s + x)"
    spark.sql(f"create or replace temporary function vector_cosine(a array<float>, b array<float>) returns double return coalesce(try_divide({dot.format('a', 'b')}, sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')})), 0)")
