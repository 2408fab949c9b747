"""Keyword-stuffed and link-list pages.

One pass over the texts shows how list-dense every page is: links, runs of list items without the words
sentences need, lines of one template, and sentences that repeat themselves or each other. Then five-word
shingles are counted by distinct hosts: a shingle that hosts use mostly on dense pages is a stuffing
phrase. The keywords a page keeps repeating stand as blanks in its shingles, so the templates that keywords
are dressed up in are the same on every host. A page is flagged if more than ``share`` of its characters
lie in dense segments or in segments stitched from such phrases.

Hosts are counted exactly: of the other pages only the phrases that enough dense hosts use are counted.
Phrases go back to the pages as a bit field of fixed size; a second pass over the texts looks words up in
it, and only pages with a stuffing phrase are read segment by segment again.

Defined results: null and blank texts score 0 and are not flagged; pages without a host count as one
host together; of a repeated page id the most stuffed row counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.session import cut, store

FIELD_BITS = 1 << 24
SHINGLE = 5
# Words that sentences of the four languages cannot do without.
_FUNCTION = frozenset(
    "the a an of to and is in by that which with for or at as from its it be are was were has have this than would so one when while between without".split()
    + "der die das den dem des ein eine einem einen und ist mit von zu zum bei auf an wird durch nach vor dass sich im am aus nicht".split()
    + "le la les l un une des du de d et est que dont par pour dans avec sur selon lequel en ce se s il sans ainsi".split()
    + "el los las con por y lo al del donde según cual cuyo cuya tras más".split()
)
_BLOCK = re.compile(r"</?(?:br|p|li|ul|ol|div|td|tr|h\d)\b[^<>]*>", re.I)
_SENTENCE = re.compile(r"([.!?])\s+(?=[^\W\d_]|\[\d)")
_LINK = re.compile(r"https?:|www\.|href=|\]\(|\[\.\]|\bdot (?:[a-z]{2,8})\b(?= |$)|[\w-]\.\s?(?:test|example|invalid|com|org|net|info|biz|shop)\b|>>", re.I)
_CLAIM = re.compile(r"\bclaims? \d|preceding claim|claims? \d+ to|\banspr[uü]ch\w* \d|\brevendications? \d|\breivindicaci[oó]n\w* \d|comprising|\bcomprenant\b|que comprende\b", re.I)
_SIGNS = re.compile(r"^\s*(?:reference signs?.{0,20}|bezugszeichen\w*.{0,5}|\(?\d+[a-z]?\)?\s+[^\d;,]+)(?:[;,]\s*\(?\d+[a-z]?\)?\s+[^\d;,]+){2,}", re.I)
_ITEM = re.compile(r"[,|•;/·#\t]| - | – ")
_EDGE = ".,;:!?()[]{}<>\"'#*|/•·–-«»“”=+&"
# What any link has one of.
_LINK_SIGNS = ("://", "www.", "href=", "](", "[.]", ">>", " dot ", ".test", ".example", ".invalid", ".com", ".org", ".net", ".info", ".biz", ".shop", ". test", ". example", ". invalid", ". com", ". org", ". net")


def segments(text: str) -> list[str]:
    """Sentences and lines."""
    if "<" in text:
        text = _BLOCK.sub("\n", text)
    out = []
    for line in text.splitlines():
        got = _SENTENCE.split(line)  # sentence, its stop, sentence, ...
        out += [x + y for x, y in zip(got[::2], [*got[1::2], ""]) if x and not x.isspace()]
    return out


def _words(low: str) -> list[str]:
    return [w for t in low.split() if (w := t if t.isalpha() else t.strip(_EDGE)) and not w[0].isdigit()]


def _alike(words: list[str]) -> float:
    """Share of the words in pairs of content words that the segment repeats."""
    pairs = Counter(p for p in zip(words, words[1:]) if p[0] not in _FUNCTION and p[1] not in _FUNCTION)
    return min(1.0, sum(2 * n for n in pairs.values() if n > 1) / len(words))


def evidence(text: str) -> list[tuple[str, list[str], str]]:
    """``(segment, words, kind)``; kind is link, list, repeat or empty."""
    parts = segments(text)
    plain = [s.lower().strip() for s in parts]
    whole = text.lower()
    signs = [x for x in _LINK_SIGNS if x in whole]
    times = Counter(plain)
    starts: Counter = Counter()
    openings: Counter = Counter()
    out = []
    for s, p in zip(parts, plain):
        words = _words(p)
        kind = ""
        n = len(words)
        if signs and any(x in p for x in signs) and _LINK.search(s):
            kind = "link"
        elif n < 2:
            kind = "repeat" if n == 1 and times[p] >= 5 and not s.isupper() and len(p) > 3 else ""
        elif times[p] >= 3:
            kind = "" if _CLAIM.search(s) else "repeat"
        else:
            function = sum(map(_FUNCTION.__contains__, words)) / n
            if n >= 5 and len(set(words)) < 0.8 * n and not (n > 25 and function > 0.25) and _alike(words) > 0.3:
                kind = "" if _CLAIM.search(s) else "repeat"
            else:
                sparse = function <= 0.15 and sum(map(len, words)) > 0.45 * len(s)
                bare = p[-1] not in ".:;" and not s.isupper()
                row = bare and n >= 3 and function <= 0.35 and any(map(str.isdigit, s))
                if (sparse or row) and not _SIGNS.match(s) and not _CLAIM.search(s):
                    items = len(_ITEM.findall(s)) if sparse else 0
                    if items >= 5 and n <= 6 * (items + 1):
                        kind = "list"
                    elif row:
                        kind = "row"
                        openings[words[0]] += 1
                    elif bare or p[-1] == ";" and not s.isupper():
                        kind = "line"
                    elif n <= 6:
                        kind = "short"
        if kind in ("line", "short"):
            starts[kind] += 1
        out.append((s, words, kind))
    if openings:  # rows with figures are a list where many open alike, else lines
        rows = [w[0] if k == "row" else "" for _, w, k in out]
        out = [(s, w, "list" if openings[r] >= 5 else "line" if sum(map(_FUNCTION.__contains__, w)) <= 0.15 * len(w) and sum(map(len, w)) > 0.45 * len(s) else "") if r else (s, w, k) for (s, w, k), r in zip(out, rows)]
        starts["line"] = sum(k == "line" for _, _, k in out)
    lines = starts["line"] + starts["short"]
    keep = lines >= 5 and lines * 2 >= sum(1 for _, w, _ in out if w)
    stuffed = {"repeat", "list"} & {k for _, _, k in out}
    return [(s, w, ("list" if k in ("line", "short") and (keep or (k == "short" and stuffed and starts["short"] >= 3)) else "" if k in ("line", "short") else k)) for s, w, k in out]


class _Numbers(dict):
    """Numbers of words, kept as they come up."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = zlib.crc32(word.encode())
        return n


_FUNCTION_IDS = np.array(sorted(zlib.crc32(w.encode()) for w in _FUNCTION), np.uint64)


def shingles(words: list[str], known: _Numbers) -> np.ndarray:
    """64-bit numbers of the ``SHINGLE``-word shingles.

    A page's keywords are blanks: its most frequent word that is no function word, where it makes up a twentieth of
    the page, and words nearly as frequent.
    """
    if len(words) < SHINGLE:
        return np.zeros(0, np.int64)
    ids = np.array([known[w] for w in words], np.uint64)
    each, at, times = np.unique(ids, return_inverse=True, return_counts=True)
    often = np.where(np.isin(each, _FUNCTION_IDS), 0, times)
    ids[((times >= 4) & (times * 20 >= len(words)) & (often > 0.6 * often.max()))[at]] = 0
    out = np.zeros(len(ids) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ ids[k : len(ids) - SHINGLE + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _density(parts: list[tuple[str, list[str], str]]) -> float:
    total = sum(len(s) for s, _, _ in parts)
    return sum(len(s) for s, _, k in parts if k) / total if total else 0.0


def _field(phrases: DataFrame) -> np.ndarray:
    """Bits of the phrases, modulo ``FIELD_BITS``; FIELD_BITS / 62 numbers at most come back."""
    spot = F.pmod("phrase", F.lit(FIELD_BITS))
    rows = phrases.select((spot / 62).cast("long").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(pmod(phrase, {FIELD_BITS}), 62) as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    field = np.zeros(FIELD_BITS + 62, bool)
    for r in rows:
        field[r.at * 62 : r.at * 62 + 62] |= (r.bits >> np.arange(62)) & 1 == 1
    return field


def _pairs(hosts: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct ``phrase, host`` of a batch."""
    rows = np.stack([np.concatenate([*found, np.zeros(0, np.int64)]), np.repeat(np.array(hosts, np.int64), [len(x) for x in found])])
    rows = np.unique(rows, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], ["phrase", "host"])


def _hosts(read: DataFrame) -> DataFrame:
    """``phrase, n``: distinct hosts of each phrase of ``host, phrases``."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _pairs(b.column("host").to_pylist(), [np.frombuffer(x, np.int64) for x in b.column("phrases").to_pylist()])

    return read.select("host", "phrases").mapInArrow(pairs, "phrase long, host long").distinct().groupBy("phrase").agg(F.count("*").alias("n"))


def _bits(field: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(field, np.uint8)).astype(bool)


def score_pages(
    pages: DataFrame, page_id: str = "doc_id", text: str = "text", host: str = "assignee",
    share: float = 0.5, dense: float = 0.4, hosts: int = 2, purity: float = 0.7,
) -> DataFrame:
    """``page_id, list_share, phrase_share, spam_share, is_spam`` for every page id.

    Stuffing phrases are those that at least ``hosts`` hosts use on pages of list density ``dense``, these
    being ``purity`` of all their hosts.
    """
    spark = pages.sparkSession
    kind = pages.schema[page_id].dataType.simpleString()
    source = pages.select(F.col(page_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit(""))).alias("host"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Numbers()
        for b in batches:
            shares, phrases = [], []
            for t in b.column("text").to_pylist():
                parts = evidence(t) if t and not t.isspace() else []
                shares.append(d := _density(parts))
                phrases.append(np.unique(shingles([w for _, ws, _ in parts for w in ws], known)).tobytes() if d > dense else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), pa.array(shares, pa.float64()), pa.array(phrases, pa.binary())], ["id", "host", "list_share", "phrases"])

    seen = store(source.mapInArrow(read, f"id {kind}, host long, list_share double, phrases binary"))
    on = cut(_hosts(seen.where("phrases is not null")).where(F.col("n") >= hosts))
    few = spark.sparkContext.broadcast(np.packbits(_field(on)).tobytes())

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = _Numbers(), _bits(few.value)
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                got = shingles(_words(t.lower()), known)
                got = got[bits[got % FIELD_BITS]]
                if len(got):
                    rows.append(i)
                    found.append(np.unique(got).tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("host").take(at), b.column("text").take(at), pa.array(found, pa.binary())], ["id", "host", "text", "phrases"])

    touched = store(source.where(F.length(F.trim("text")) > 0).mapInArrow(hit, f"id {kind}, host long, text string, phrases binary"))
    everywhere = _hosts(touched).withColumnRenamed("n", "all")
    pure = on.join(everywhere, "phrase", "left").where(F.col("n") >= purity * F.greatest(F.col("n"), F.coalesce("all", F.lit(0))))
    field = spark.sparkContext.broadcast(np.packbits(_field(pure)).tobytes())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = _Numbers(), _bits(field.value)
        for b in batches:
            stitched, spam, rows = [], [], []
            for i, x in enumerate(b.column("phrases").to_pylist()):
                if not bits[np.frombuffer(x, np.int64) % FIELD_BITS].any():
                    continue
                rows.append(i)
                parts = evidence(b.column("text")[i].as_py())
                got = shingles([w for _, ws, _ in parts for w in ws], known)
                hits = np.zeros(sum(len(ws) for _, ws, _ in parts) + 1)
                hits[1 : len(got) + 1] = bits[got % FIELD_BITS]
                # a word counts if a shingle that hits covers it
                inside = np.convolve(hits[1:], np.ones(SHINGLE))[: len(hits) - 1] > 0 if len(hits) > 1 else hits[:0]
                sums = np.concatenate([[0], np.cumsum(inside)])
                total = sum(len(s) for s, _, _ in parts) or 1
                at = plain = extra = 0
                for s, words, kind in parts:
                    n = len(words)
                    if n >= 3 and sums[at + n] - sums[at] >= 0.5 * n and not _CLAIM.search(s):
                        plain += len(s)
                        extra += 0 if kind else len(s)
                    at += n
                stitched.append(plain / total)
                spam.append(extra / total)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(stitched, pa.float64()), pa.array(spam, pa.float64())], ["id", "phrase_share", "extra"])

    phrased = touched.select("id", "text", "phrases").mapInArrow(score, f"id {kind}, phrase_share double, extra double").groupBy("id").agg(F.max("phrase_share").alias("phrase_share"), F.max("extra").alias("extra"))
    listed = seen.groupBy("id").agg(F.max("list_share").alias("list_share"))
    both = listed.join(phrased, listed["id"].eqNullSafe(phrased["id"]), "left").select(listed["id"], "list_share", F.coalesce("phrase_share", F.lit(0.0)).alias("phrase_share"), F.least(F.col("list_share") + F.coalesce("extra", F.lit(0.0)), F.lit(1.0)).alias("spam_share"))
    return both.select(F.col("id").alias(page_id), "list_share", "phrase_share", "spam_share", (F.col("spam_share") > share).alias("is_spam"))
