"""Evaluation passages inside a corpus: broadcast n-gram hashes, one scan of every text, verified hits.

Texts are read as their letters and digits alone, so case, accents, spacing, line breaks and markup do
not matter. Windows of ``GRAM`` characters are looked up in the hash set of the items; where as many of
them fall near one diagonal as the item's passages keep under the worst permitted edits (``kept``), the
words are aligned, band by band, and a hit is a run of at least ``least`` words of the item with at most
one word in ``one_in`` changed, dropped or added.

Defined results: null and empty texts leak nothing; an item shorter than ``least`` words cannot leak;
repeated document ids are scanned apart and reported once an item.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.session import parallelism

GRAM = 12
DRIFT = 80
PADS = (5, 40)
MAX_ITEM_CHARS = 50_000_000
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.*?-->", re.S)
_BROKEN = re.compile("[Â-ß][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_DROP = bytes(i for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122))
_WORD = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[^\x00-\x7f]+")


class _Letters(dict):
    """Letters and digits stay, other characters go; filled as characters come up."""

    def __missing__(self, code: int) -> int | None:
        out = self[code] = code if chr(code).isalnum() else None
        return out


_LETTERS = _Letters()


def _mend(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]


def _blank(m: re.Match) -> str:
    return " " * len(m[0])


def plain(text: str) -> str:
    """Lower-case text without markup and marks; ASCII separators stay."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = _BROKEN.sub(_mend, text).replace("ß", "ss")
        # marks go; letters of other scripts stay as they are
        text = _OTHER.sub(lambda m: m[0].translate(_LETTERS), unicodedata.normalize("NFKD", text))
    return text.lower()


def stream(text: str) -> bytes:
    """The letters and digits of a text, a byte each; a letter of another script is one of the upper bytes."""
    flat = plain(text)
    if not flat.isascii():
        flat = _OTHER.sub(lambda m: "".join([chr(128 + ord(c) % 127) for c in m[0]]), flat)
    return flat.encode("latin-1").translate(None, _DROP)


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Polynomial hash of every window, built by doubling."""
    have, width, out, at = codes.astype(np.uint64), 1, None, 0
    base = np.uint64(0x9E3779B97F4A7C15)
    power = {1: base}
    left = gram
    powers = np.array([base])  # arrays wrap around silently
    while True:
        if left & 1:
            if out is None:
                out, at = have, width
            else:
                n = len(codes) - at - width + 1
                out = out[:n] * power[width] + have[at : at + n]
                at += width
        left >>= 1
        if not left:
            return out * np.uint64(0xD6E8FEB86659FD93)
        n = len(have) - width
        have = have[:n] * power[width] + have[width:]
        powers = powers * powers
        power[width * 2] = powers[0]
        width *= 2


def _tokens(text: str) -> tuple[list[str], list[int]]:
    """Words of letters and digits, and for each the number of its space-separated word."""
    tokens, of = [], []
    for i, chunk in enumerate(plain(text).split()):
        for w in _WORD.findall(chunk):
            tokens.append(w)
            of.append(i)
    return tokens, of


def kept(sizes: np.ndarray, least: int, one_in: int, gram: int = GRAM) -> int:
    """Windows that every quote keeps, whichever words are edited; ``sizes``: characters of the item's words.

    ``n`` words with ``e`` edits fall into ``e + 1`` intact runs, each of which loses ``gram - 1`` windows.
    """
    out = None
    for n in sorted({least, *range(least + -least % one_in, len(sizes) + 1, one_in)}):
        if n <= len(sizes):
            e = n // one_in
            words = np.lib.stride_tricks.sliding_window_view(sizes, n)
            intact = words.sum(1) - np.sort(words, 1)[:, n - e :].sum(1)
            least_here = int(intact.min()) - (e + 1) * (gram - 1)
            out = least_here if out is None else min(out, least_here)
    return max(1, out or 1)


class Items:
    """Hashed windows and words of the evaluation items; size bounded by ``MAX_ITEM_CHARS``."""

    def __init__(self, rows: list[tuple[int, str | None]], least: int = 25, one_in: int = 8):
        self.ids, self.words, self.bags, self.of, gates, hashes, owner, place = [], [], [], [], [], [], [], []
        for item, text in rows:
            s = np.frombuffer(stream(text or ""), np.uint8)
            if len(s) < GRAM:
                continue
            h = gram_hashes(s)
            tokens, of = _tokens(text)
            gates.append(kept(np.bincount(of, weights=[len(w) for w in tokens]), least, one_in))
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids), np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
            self.ids.append(item)
            self.words.append(tokens)
            self.bags.append(Counter(tokens))
            self.of.append(of)
        self.gates = np.array(gates, np.int64)
        none = np.zeros(0, np.uint64)
        h = np.concatenate(hashes) if hashes else none
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = (np.concatenate(owner) if owner else none.astype(np.int32))[order]
        self.place = (np.concatenate(place) if place else none.astype(np.int32))[order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window positions of a text, and the item and item position of each; windows are repeated for several."""
        h = gram_hashes(codes)
        at = np.flatnonzero(self.sieve[(h >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        n = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())
        return np.repeat(at, n), self.owner[rows], self.place[rows]


def _fit(item: list[str], text: list[str]) -> list[str]:
    """The words of a text with breaks inside words mended and glued words parted, as the item has them."""
    known, out, i = set(item), [], 0
    after: dict[str, set[str]] = {}
    for a, b in zip(item, item[1:]):
        after.setdefault(a, set()).add(b)
    while i < len(text):
        w = text[i]
        if w not in known:
            for k in (2, 3):
                if (joined := "".join(text[i : i + k])) in known:
                    out.append(joined)
                    i += k
                    break
            else:
                glued = next((k for k in range(1, len(w)) if w[k:] in after.get(w[:k], ())), 0)
                out += [w[:glued], w[glued:]] if glued else [w]
                i += 1
            continue
        if i + 1 < len(text) and text[i + 1] not in known and w + text[i + 1] in known:
            out.append(w + text[i + 1])
            i += 2
            continue
        out.append(w)
        i += 1
    return out


def longest_quote(item: list[str], of: list[int], text: list[str], least: int, one_in: int) -> int:
    """Words of the longest run of the item that the text reproduces; 0 when under ``least``."""
    n = of[-1] + 1 if of else 0
    wrong, added = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    matched = np.zeros(n, bool)
    matched[of] = True
    for kind, a, b, c, d in SequenceMatcher(None, item, text, autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        touched = sorted({of[i] for i in range(a, b)})
        wrong[touched] = 1
        extra = (d - c) - (b - a)
        if extra > 0:
            added[of[a] if a < len(of) else n] += extra
    matched &= wrong == 0
    cost = np.concatenate([[0], np.cumsum(wrong)]) * one_in
    more = np.concatenate([np.cumsum(added)]) * one_in  # before word i: more[i]
    starts = np.flatnonzero(matched)
    best = 0
    for i in starts:
        ends = starts[starts >= max(i + least - 1, i + best)]
        if len(ends):
            length = ends - i + 1
            good = ends[(cost[ends + 1] - cost[i] + more[ends] - more[i]) <= length]
            if len(good):
                best = max(best, int(good[-1] - i + 1))
    return best


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", least: int = 25, one_in: int = 8) -> DataFrame:
    """``doc_id, item_id, words, first, last``: the longest quote and the characters of the normalised text it lies in."""
    spark = documents.sparkSession
    known = items.select(item_id, item_text).where(F.col(item_id).isNotNull())
    size = known.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0)).alias("n")).first().n
    if size > MAX_ITEM_CHARS:
        raise ValueError(f"the items hold {size} characters, more than {MAX_ITEM_CHARS}")
    held = spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in known.collect()], least, one_in))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it = held.value
        for b in batches:
            streams = [stream(t) if t else b"" for t in b["text"]]
            starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in streams])])
            codes = np.frombuffer(b"\0".join(streams) + b"\0", np.uint8)
            out = []
            if len(codes) >= GRAM and len(it.hashes):
                at, owner, place = it.hits(codes)
                doc = np.searchsorted(starts, at, "right") - 1
                key = (doc.astype(np.int64) * len(it.ids) + owner) * (1 << 26) + (at - starts[doc]) - place + (1 << 24)
                order = np.argsort(key, kind="stable")
                key, at, doc, owner = key[order], at[order], doc[order], owner[order]
                n = np.searchsorted(key, key + DRIFT, "right") - np.arange(len(key))
                dense = np.flatnonzero(n >= it.gates[owner])
                # bands start half a drift apart and are longer by as much, so each dense one lies whole in one of them
                ends_at = np.searchsorted(key, key[dense] + DRIFT + DRIFT // 2, "right")
                tokens_of: dict = {}
                done = -1
                for k, end in zip(dense.tolist(), ends_at.tolist()):
                    if key[k] <= done:
                        continue
                    done = key[k] + DRIFT // 2
                    d, o = doc[k], owner[k]
                    if d not in tokens_of:
                        tokens = _WORD.findall(plain(b["text"].iloc[d]))
                        tokens_of[d] = (tokens, np.concatenate([[0], np.cumsum([len(w) for w in tokens])]))
                    tokens, ends = tokens_of[d]
                    spots = at[k:end] - starts[d]
                    first, last = int(np.searchsorted(ends, spots.min(), "right")) - 1, int(np.searchsorted(ends, spots.max() + GRAM, "left"))
                    # few words around keep another excerpt out of the alignment, more take in a beginning or end without hits
                    near, wide = (_fit(it.words[o], tokens[max(0, first - pad) : last + pad]) for pad in PADS)
                    # a quote shares all its words but the edited ones, in whatever order they are counted
                    if (it.bags[o] & Counter(wide)).total() < least - least // one_in:
                        continue
                    words = max(longest_quote(it.words[o], it.of[o], x, least, one_in) for x in (near, wide))
                    if words >= least:
                        out.append((b["doc_id"].iloc[d], it.ids[o], words, int(spots.min()), int(spots.max()) + GRAM))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "words", "first", "last"])

    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    found = source.mapInPandas(scan, f"doc_id {documents.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, words int, first int, last int")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "first", "last")).alias("q")).select("doc_id", "item_id", "q.words", "q.first", "q.last")


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents in which no item was found."""
    return documents.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")


def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the characters whose letters and digits lie in ``spans`` of its ``stream``."""
    if not spans:
        return text
    chars, at = np.zeros(len(text), np.int64), 0
    # the stream is made of whole normalised texts, so places are found by normalising growing parts at word ends
    ends = [m.end() for m in re.finditer(r"\S+\s*", text)]
    lead, before = 0, 0
    for end in ends:
        n = len(stream(text[lead:end])) if "<" not in text and "&" not in text else None
        if n is None:
            break
        chars[lead:end] = before
        before, lead = before + n, end
    else:
        keep = np.ones(len(text), bool)
        for first, last in spans:
            lo, hi = np.searchsorted(chars, first, "right") - 1, np.searchsorted(chars, last, "left")
            lo = int(np.searchsorted(chars, chars[max(lo, 0)], "left"))
            keep[lo:hi] = False
        return "".join(c for c, k in zip(text, keep) if k)
    flat = " ".join(plain(text).split())  # markup: the normalised text stands for it
    return _blanked(flat, spans)


def cleaned(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents, the leaked spans cut out of their texts word by word; texts with markup come back normalised.

    Only the longest quote of each item is cut, so run it again until nothing is found.
    """
    spans = leaks.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("spans")).withColumnRenamed("doc_id", "_leaked")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [t if t is None or s is None else _blanked(t, sorted((int(x["first"]), int(x["last"])) for x in s)) for t, s in zip(b["text"], b["spans"])]
            yield b[["doc_id", "text"]]

    met = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(spans, F.col("doc_id") == F.col("_leaked"), "left").drop("_leaked")
    kind = documents.schema[doc_id].dataType.simpleString()
    return met.mapInPandas(cut, f"doc_id {kind}, text string").toDF(doc_id, text)
