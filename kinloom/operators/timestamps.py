"""Mixed timestamp formats and zones, settled by EM over format mixtures per source.

``candidates`` lists every valid reading of a value (a *label* and its normal form). Values with
one reading teach the mixture of their source, values with several take the posterior of that
mixture. A declared order is a prior (``trust``) that the values of a source can outweigh: against it
must stand as many values as make the posterior reach ``sure``; between the two a value stays open.
What stays open is marked, never guessed.

Defined results: null or blank values have status ``empty``; values that state nothing as exact as
a day ``no_day``; dates or clock times that do not exist ``invalid``; wall-clock times a zone skipped
or showed twice ``dst``; values whose zone or day-month order nothing settles ``ambiguous``.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.session import store

# Month names by language.
_MONTHS = [
    "january janvier januar enero",
    "february février februar febrero",
    "march mars märz marzo",
    "april avril april abril",
    "may mai mai mayo",
    "june juin juni junio",
    "july juillet juli julio",
    "august août august agosto",
    "september septembre september septiembre",
    "october octobre oktober octubre",
    "november novembre november noviembre",
    "december décembre dezember diciembre",
]


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


_MONTH = {}
for _i, _names in enumerate(_MONTHS, 1):
    for _n in _names.split():
        _MONTH[_plain(_n)] = _i
        _MONTH.setdefault(_plain(_n)[:3], _i)
_MONTH["sept"] = 9

_NAME = r"(?P<mon>[a-z]{3,12})\.?"
_DAY_FORMS = [
    r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})",
    r"(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})",
    r"(?P<y>\d{4})-(?P<doy>\d{3})",
    r"(?P<y>\d{4})-?w(?P<week>\d{2})-?(?P<dow>\d)",
    r"(?P<p>\d{1,2})(?P<sep>[/.-])(?P<q>\d{1,2})(?P=sep)(?P<y>\d{4})",
    rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th|er|\.)?[\s-]+(?:of\s+|de\s+)?{_NAME},?[\s-]+(?:de\s+)?(?P<y>\d{{4}})",
    rf"{_NAME}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})",
    r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})",
]
_TIME = (
    r"(?:(?P<H>\d{1,2})[:h](?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,]\d+)?)?|(?P<hms>\d{6}|\d{4}))"
    r"\s*(?P<ap>[ap]\.?m\.?(?![a-z]))?(?:\s*uhr)?"
    r"\s*(?:(?P<z>z)|(?:(?:utc|gmt)\s*)?(?P<off>[+-]\d{2}:?\d{2})(?:\s*\[[a-z_/+-]+\])?|\[?(?P<zone>[a-z]+/[a-z_/]+)\]?|(?P<abbr>[a-z]{2,5}))?"
)
_JOIN = r"(?:t|\s+|,\s+|\s+at\s+|\s+a\s+|,?\s+um\s+)"
_PARSERS = [re.compile(rf"(?:{f})(?:{_JOIN}{_TIME})?") for f in _DAY_FORMS]
_WORDED = [rx for rx, f in zip(_PARSERS, _DAY_FORMS) if f.startswith(_NAME)]
_LEAD = re.compile(r"^(?:born(?: on)?|b\.|dob:?|d\.o\.b\.:?|geb\.|ne\(?e?\)? le|le|am|on)\s+")
_DOW = re.compile(r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+")
_UNIT = {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_FIRST, _LAST = date(1900, 1, 1), date(2035, 12, 31)
# Abbreviations that zone data spell as offsets.
_ABBR = {"Asia/Kathmandu": {"npt": timedelta(hours=5, minutes=45)}}


@lru_cache(maxsize=512)
def _zone(name: str | None):
    try:
        return ZoneInfo("/".join(p.capitalize() if p.islower() else p for p in name.split("/"))) if name else None
    except Exception:
        try:
            return ZoneInfo(name.title().replace("_Of_", "_of_"))
        except Exception:
            return None


def _utc(moment: datetime) -> str:
    return moment.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if moment.year > 1 else ""


def _wall(wall: datetime, zone) -> tuple[str, str]:
    """A zone's wall-clock time: its moment, or why there is none."""
    found = set()
    for fold in (0, 1):
        moment = wall.replace(tzinfo=zone, fold=fold).astimezone(timezone.utc)
        if moment.astimezone(zone).replace(tzinfo=None) == wall:
            found.add(moment)
    return ("ok", _utc(found.pop())) if len(found) == 1 else ("dst", "")


def _abbreviated(wall: datetime, zone, name: str) -> tuple[str, str]:
    """A wall-clock time with an abbreviation of ``zone``: the abbreviation tells which of two."""
    fixed = _ABBR.get(getattr(zone, "key", ""), {}).get(name)
    found, known = set(), fixed is not None
    for fold in (0, 1):
        local = wall.replace(tzinfo=zone, fold=fold)
        for at in (local, local.replace(month=1, day=15), local.replace(month=7, day=15)):
            if (at.tzname() or "").lower() != name and fixed is None:
                continue
            known = True
            moment = (wall - (fixed or at.utcoffset())).replace(tzinfo=timezone.utc)
            if moment.astimezone(zone).replace(tzinfo=None) == wall:
                found.add(moment)
    if not known:
        return "ambiguous", ""
    return ("ok", _utc(found.pop())) if len(found) == 1 else ("dst", "")


def _days(g: dict) -> list[tuple[str, date]]:
    """The real days of a match, by label."""
    y, out = int(g["y"]), []

    def add(label, make):
        try:
            out.append((label, make()))
        except ValueError:
            pass

    if g.get("p"):
        p, q = int(g["p"]), int(g["q"])
        add("dmy", lambda: date(y, q, p))
        if p != q:
            add("mdy", lambda: date(y, p, q))
    elif g.get("doy"):
        n = int(g["doy"])
        add("ordinal", lambda: d if n and (d := date(y, 1, 1) + timedelta(n - 1)).year == y else date(0, 1, 1))
    elif g.get("week"):
        add("week", lambda: date.fromisocalendar(y, int(g["week"]), int(g["dow"])))
    elif g.get("mon"):
        m = _MONTH.get(g["mon"]) or 0
        add("named", lambda: date(y, m, int(g["d"])))
    else:
        add("iso", lambda: date(y, int(g["m"]), int(g["d"])))
    return out


def candidates(raw: str | None, desk_zone: str | None) -> tuple[str, list[tuple[str, str]]]:
    """Status and all valid readings ``(label, normal form)`` of one value."""
    if raw is None:
        return "empty", []
    if raw.isascii():
        text = raw.lower()
    else:
        text = _plain(unicodedata.normalize("NFKC", raw)).lower()
        text = "".join(str(unicodedata.digit(c)) if c.isdigit() and not c.isascii() else c for c in text if unicodedata.category(c) != "Cf")
    text = " ".join(text.split()).strip(" .;,")
    if not text:
        return "empty", []
    if not text[0].isdigit():
        for _ in range(3):
            text = _DOW.sub("", _LEAD.sub("", text))
    if text.isdigit() and len(text) > 8:
        out = []
        for label, unit in _UNIT.items():
            seconds = int(text) // unit
            if seconds < 4_000_000_000 and _FIRST <= (moment := _EPOCH + timedelta(seconds=seconds)).date() <= _LAST:
                out.append((f"epoch:{label}", seconds, moment))
        # a number this long in a finer unit stays within days of 1970; only readings after 1972 count unless none is
        late = [x for x in out if x[1] > 63_072_000] or out
        return ("ok" if late else "invalid"), [(label, _utc(m)) for label, _, m in late]
    for rx in _PARSERS if text[:1].isdigit() else _WORDED:
        m = rx.fullmatch(text)
        if m:
            break
    else:
        return "no_day", []
    g = m.groupdict()
    days = _days(g)
    if not days:
        return "invalid", []
    if g["H"] is None and g["hms"] is None:
        return "ok", [(label, d.isoformat()) for label, d in days]
    hms = g["hms"]
    h, mi, s = (int(hms[:2]), int(hms[2:4]), int(hms[4:] or 0)) if hms else (int(g["H"]), int(g["M"]), int(g["S"] or 0))
    if g["ap"]:
        if not 1 <= h <= 12:
            return "invalid", []
        h = h % 12 + 12 * (g["ap"][0] == "p")
    if h > 23 or mi > 59 or s > 59:
        return "invalid", []
    status, out = "invalid", []
    for label, d in days:
        wall = datetime(d.year, d.month, d.day, h, mi, s)
        if g["z"] or (g["abbr"] or "") in ("utc", "gmt", "z"):
            how, form = "ok", _utc(wall.replace(tzinfo=timezone.utc))
        elif g["off"]:
            sign = -1 if g["off"][0] == "-" else 1
            ahead = sign * timedelta(hours=int(g["off"][1:3]), minutes=int(g["off"][-2:]))
            how, form = "ok", _utc((wall - ahead).replace(tzinfo=timezone.utc))
        else:
            zone = _zone(g["zone"]) if g["zone"] else _zone(desk_zone)
            if zone is None:
                how, form = "ambiguous", ""
            elif g["abbr"]:
                how, form = _abbreviated(wall, zone, g["abbr"])
            else:
                how, form = _wall(wall, zone)
        status = how if status != "ok" else status
        if how == "ok":
            out.append((label, form))
        elif len(days) > 1:
            out.append((label, ""))
    return (status if any(f for _, f in out) or status != "ok" else "dst"), out


_PARSED = T.StructType([T.StructField("status", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("forms", T.ArrayType(T.StringType()))])


@F.pandas_udf(_PARSED)
def parse_readings(raw: pd.Series, zone: pd.Series) -> pd.DataFrame:
    """``candidates`` over Arrow batches; repeated values are read once a batch."""
    seen: dict = {}
    rows = []
    for key in zip(raw, zone):
        hit = seen.get(key)
        if hit is None:
            status, found = candidates(*key)
            hit = seen[key] = (status, [x for x, _ in found], [x for _, x in found])
        rows.append(hit)
    return pd.DataFrame(rows, columns=["status", "labels", "forms"])


def _em(counts: dict[tuple[str, ...], int], declared: str | None, trust: float, rounds: int) -> dict[str, float]:
    """Mixture weights of one source from counts of label sets."""
    labels = sorted({x for s in counts for x in s})
    theta = {x: 1 / len(labels) for x in labels}
    for _ in range(rounds):
        mass = {x: 0.5 for x in labels}
        for s, n in counts.items():
            like = {x: theta[x] * (1 - trust if declared and x != declared and declared in s else 1) for x in s}
            total = sum(like.values())
            for x in s:
                mass[x] += n * like[x] / total
        total = sum(mass.values())
        theta = {x: v / total for x, v in mass.items()}
    return theta


def fit_mixtures(readings: DataFrame, trust: float = 0.98, rounds: int = 30) -> DataFrame:
    """``(source, label, weight)`` from rows ``(source, declared, labels)``.

    Rows are counted by label set before they meet, so a source costs a few rows however large it is.
    """
    counted = readings.groupBy("source", "declared", "labels").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: dict = {}
        for labels, n in zip(pdf["labels"], pdf["n"]):
            counts[tuple(labels)] = counts.get(tuple(labels), 0) + int(n)
        declared = next((x for x in pdf["declared"] if isinstance(x, str)), None)
        theta = _em(counts, declared, trust, rounds)
        return pd.DataFrame({"source": pdf["source"].iloc[0], "label": list(theta), "weight": list(theta.values())})

    return counted.groupBy("source").applyInPandas(fit, "source string, label string, weight double")


def normalize_timestamps(
    rows: DataFrame,
    sources: DataFrame,
    key: str,
    value: str,
    source: str,
    sure: float = 0.95,
    trust: float = 0.98,
) -> DataFrame:
    """One row a key: ``key, status, normal_form, label, posterior, alternatives``.

    ``sources`` has ``source, zone, order`` (order: dmy, mdy or null); a source outside it settles
    nothing by itself, so its open values stay ``ambiguous`` with the likeliest label and its posterior.
    Repeated keys are read once. Rows with a null key are dropped. Columns of other names play no part.
    """
    desks = sources.select(F.col("source").alias("source"), "zone", F.col("order").alias("declared")).where("source is not null").dropDuplicates(["source"])
    base = (
        rows.select(F.col(key).alias("key"), F.col(value).cast("string").alias("raw"), F.coalesce(F.col(source), F.lit("")).alias("source"))
        .where("key is not null")
        .dropDuplicates(["key"])
        .join(desks, "source", "left")
    )
    # the mixture is learned from values that can be read in more than one way or show which way is meant
    teaches = F.coalesce(F.col("raw").rlike(r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|^\D*\d{9,}\D*$"), F.lit(False))
    read = store(base.withColumn("r", parse_readings("raw", "zone")).select("key", "source", "declared", teaches.alias("teaches"), "r.*"))
    weights = fit_mixtures(read.where("teaches and size(labels) > 0"), trust).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("weights"))
    open_ = read.where(F.size("labels") > 1).join(weights, "source", "left")
    prior = lambda x: F.coalesce(F.try_element_at("weights", x), F.lit(1e-3)) * F.when(
        F.col("declared").isNotNull() & F.array_contains("labels", F.col("declared")) & (x != F.col("declared")), 1 - trust
    ).otherwise(F.lit(1.0))
    open_ = (
        open_.withColumn("p", F.transform("labels", prior))
        .withColumn("total", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
        .withColumn("best", F.array_max(F.transform(F.arrays_zip("p", "labels", "forms"), lambda x: F.struct(x["p"], x["labels"], x["forms"]))))
        .withColumn("posterior", F.col("best.p") / F.col("total"))
    )
    settled = (F.col("posterior") >= sure) & (F.col("declared").isNotNull() | F.col("labels")[0].startswith("epoch"))
    alike = F.size(F.array_distinct("forms")) == 1
    form = F.col("best.forms")
    open_ = open_.select(
        "key",
        F.when(settled | alike, F.when(form != "", "ok").otherwise("dst")).otherwise("ambiguous").alias("status"),
        F.when((settled | alike) & (form != ""), form).alias("normal_form"),
        F.col("best.labels").alias("label"),
        "posterior",
        F.array_distinct("forms").alias("alternatives"),
    )
    plain = read.where(F.size("labels") <= 1).select(
        "key",
        "status",
        F.when(F.col("status") == "ok", F.try_element_at("forms", F.lit(1))).alias("normal_form"),
        F.try_element_at("labels", F.lit(1)).alias("label"),
        F.when(F.col("status") == "ok", F.lit(1.0)).alias("posterior"),
        F.col("forms").alias("alternatives"),
    )
    return plain.unionByName(open_)
