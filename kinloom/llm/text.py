"""Folding of typed text: scripts, look-alikes, scanner errors, sound; edit distances and delete neighbourhoods."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Cyrillic letters by sound and, inside Latin words, by looks; Latin letters without a decomposition.
_SOUND = str.maketrans(
    {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "i", "є": "e", "ґ": "g"}
)
_LOOKS = str.maketrans({"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ο": "o", "α": "a", "ε": "e", "ι": "i", "ν": "v", "ρ": "p"})
_LATIN = str.maketrans({"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i", "ŋ": "n"})
_SCAN = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s", "8": "b", "@": "a", "$": "s", "|": "l"})
_WORD = re.compile(r"[^\W_]+(?:[@$|'’][^\W_]*)*|[@$][^\W_]+")


class _Marks(dict):
    """Combining marks and invisible characters go, others stay; filled as characters come up."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        out = self[code] = None if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else code
        return out


_MARKS = _Marks()


def strip_marks(text: str) -> str:
    """NFKC, lower case, no combining marks, no invisible characters."""
    return unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)).lower().translate(_MARKS)


@lru_cache(maxsize=200_000)
def fold_word(word: str) -> str:
    """One lower-case word as ``a-z`` letters."""
    if not word.isascii():
        latin = sum("a" <= c <= "z" for c in word)
        word = word.translate(_LOOKS if latin * 2 > len(word) else _SOUND).translate(_LATIN)
    if any(not c.isalpha() for c in word):
        letters = sum(c.isalpha() for c in word)
        word = word.translate(_SCAN) if letters * 2 >= len(word) else word
    return re.sub("[^a-z]", "", word)


def words(text: str | None) -> list[str]:
    """The folded words of a text, in order; none for null."""
    if not text:
        return []
    if text.isascii():  # plain letters fold to themselves
        plain = text.lower().split()
        if all(map(str.isalpha, plain)):
            return plain
    return [w for x in _WORD.findall(strip_marks(text)) if (w := fold_word(x))]


_RULES = [("rn", "m"), ("ph", "f"), ("x", "ks"), ("ck", "k"), ("c", "k"), ("q", "k"), ("w", "v"), ("z", "s"), ("oo", "u"), ("ou", "u"), ("ee", "i"), ("ay", "e"), ("ey", "e"), ("ei", "e"), ("ai", "e"), ("ae", "e"), ("y", "i"), ("h", "")]


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    """A skeleton that common respellings share."""
    for a, b in _RULES:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance with transpositions; ``most + 1`` when it is more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            c = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, older[j - 2] + 1)
            row.append(c)
        before = last
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def deletes(word: str, most: int) -> set[str]:
    """The word and all words with up to ``most`` letters deleted."""
    level = out = {word}
    for _ in range(min(most, len(word) - 1)):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def reach(length: int) -> int:
    """Edits allowed for a word of this length."""
    return 0 if length < 3 else 1 if length < 5 else 2 if length < 9 else 3


class DeleteIndex:
    """Symmetric-delete index over a vocabulary of bounded size, by spelling and by sound.

    ``search`` is exact for ``reach(length)`` edits of the spelling and two of the sound; a word that has
    an entry within fewer edits is answered from those.
    """

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = vocabulary
        self.sounds = [sound(v) for v in vocabulary]
        self.place = {v: i for i, v in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary), default=0) + 3
        self.near: dict[str, list[int]] = {}
        self.far: dict[str, list[int]] = {}
        for i, v in enumerate(vocabulary):
            for index, k, j in ((self.near, 2, 1), (self.far, 3, 2)):
                for key in self._keys(v, self.sounds[i], k, j):
                    index.setdefault(key, []).append(i)

    @staticmethod
    def _keys(word: str, skeleton: str, spelled: int, heard: int) -> set[str]:
        return deletes(word, min(spelled, reach(len(word)))) | {"~" + x for x in deletes(skeleton, min(heard, reach(len(skeleton))))}

    def search(self, word: str) -> list[tuple[str, float]]:
        """Entries within reach and their similarity, best first."""
        if word in self.place:
            return [(word, 1.0)]
        if len(word) > self.longest:  # out of reach of every entry
            return []
        s = sound(word)
        for index, k, j in ((self.near, 2, 1), (self.far, 3, 2)):
            out = []
            for i in {i for key in self._keys(word, s, k, j) for i in index.get(key, ())}:
                v = self.vocabulary[i]
                longest = max(len(v), len(word))
                cost = min(edits(word, v, k), edits(s, self.sounds[i], j) + 0.5)
                if cost <= max(reach(longest), 1) + 0.5 and cost <= k + 0.5 and (cost == 0 or longest > 2):
                    out.append((v, 1 - cost / (longest + 1)))
            if out:
                return sorted(out, key=lambda x: (-x[1], x[0]))
        return []
