"""Word scores per language, trained on a bounded sample, and spans by Viterbi."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np

# The languages told apart, their names and code spellings.
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "ja")
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "francais"),
    "es": ("es", "spa", "spanish", "espanol", "castilian"),
    "pt": ("pt", "por", "portuguese", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "pl": ("pl", "pol", "polish", "polski"),
    "ru": ("ru", "rus", "russian"),
    "ja": ("ja", "jpn", "japanese", "jp"),
}
# Spellings that name no language.
NO_LANGUAGE = ("", "xx", "und", "unknown", "n/a", "na", "none", "null", "zxx", "mul", "mis", "?", "-", "other", "auto")
# Frequent function words, without accents; a prior where little text is labelled.
FUNCTION_WORDS = {
    "en": "the of and to in is was that for it with as on by at from this be are which".split(),
    "de": "der die das und ist nicht den mit von zu auf ein eine im sich dass auch nach wird bei".split(),
    "fr": "le la les des et est une du pour que dans qui sur pas plus par avec au ne ce".split(),
    "es": "el los las y es una del por que con para se su al como mas lo pero sus ya".split(),
    "pt": "o os as e um uma do da dos em nao com para que por mais na se no ao".split(),
    "it": "il gli di che e un una per non con del della sono le si piu da al nel ha".split(),
    "nl": "het een van en dat niet te op zijn met voor is de er aan ook als bij naar om".split(),
    "pl": "i w na z sie nie do jest ze to o po jak przez przy od ale za byl juz".split(),
}
LATIN = tuple(FUNCTION_WORDS)
_LATIN_AT = {x: i for i, x in enumerate(LATIN)}

#: Cost of changing the language inside a line, and from line to line.
SWITCH, SWITCH_LINE = 9.0, 3.0
#: A line is prose from so many natural words, or characters of Japanese script, on.
LEAST_WORDS, LEAST_CHARS = 2, 3

#: Rounds of training; documents in which a word must occur to be known; most an unknown word tells.
ROUNDS, LEAST_DOCUMENTS, UNKNOWN = 2, 3, 1.0

_FORMAT = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_MARK = re.compile("[̀-ͯ]")
_STROKED = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe"})
#: Pieces of a line that are no natural words: times, addresses, pairs, calls, paths, identifiers.
_CODE = re.compile(
    r"https?://\S+|\b\d{4}-\d\d-\d\d\S*|\b0x[0-9a-f]+\b|[\w.$/@-]+=\S*|[\w.$]+\([^()]*\)|\S*\w[/\\]\w\S*|\w*_\w+|\w*\d\w*|\b[a-z]+[A-Z]\w*|\b\w+(?:\.\w+){1,}\b(?=\S)"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_JAPANESE = re.compile("[぀-ヿㇰ-ㇿ㐀-䶿一-鿿ｦ-ﾝ]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_KEYS = re.compile(r"^\s*[\[{]*\s*(?:\"[\w -]{1,24}\"\s*:\s*(?:-?\d[\d.]*|true|false|null|\"(?=\w))?\s*,?\s*)+")


def label_language(label: str | None) -> str | None:
    """The code a label means, '?' for a language not told apart here, None if it names none."""
    text = _MARK.sub("", unicodedata.normalize("NFKD", (label or "").strip().casefold()))
    head = re.split(r"[-_.\s(]", text, maxsplit=1)[0]
    for code, names in SPELLINGS.items():
        if text in names or head in names:
            return code
    if text in NO_LANGUAGE or head in NO_LANGUAGE or not head.isalpha():
        return None
    return "?"


def natural_words(line: str) -> list[str]:
    """Natural words of a line in normal form; Japanese script comes as single characters."""
    text = unicodedata.normalize("NFKC", _FORMAT.sub("", line))
    if "\\" in text:
        text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
        text = re.sub(r"\\+[nrt\"'/]", " ", text)
    if "{" in text or "[" in text:
        text = re.sub(r"\"(?:[\w-]{1,24})\"\s*:", " ", text)
        text = re.sub(r"^\s*\[[\w.:-]+\]", " ", text)
    text = _CODE.sub(" ", text)
    out: list[str] = []
    for w in _WORD.findall(text):
        if _JAPANESE.search(w):
            out.extend(c for c in w if _JAPANESE.match(c))
            continue
        w = _MARK.sub("", unicodedata.normalize("NFKD", w.casefold())).translate(_STROKED)
        out.extend(x for x in re.split("['’]", w) if x)
    return out


_DIGIT = re.compile(r"\d")
_CALLED = re.compile(r"\w\(")
_EAST = re.compile("[Ѐ-ӿ぀-ヿㇰ-ㇿ㐀-䶿一-鿿ｦ-ﾝ]")


def is_prose(words: list[str]) -> bool:
    japanese = sum(1 for w in words if _JAPANESE.match(w))
    return japanese >= LEAST_CHARS or len(words) - japanese >= LEAST_WORDS


class LanguageModel:
    """Naive Bayes over words with a character-trigram model for unknown ones."""

    def __init__(self, words: list[Counter], grams: list[Counter]):
        self.words, self.grams = words, grams
        self.totals = [sum(c.values()) + 1 for c in words]
        self.gram_totals = [sum(c.values()) + 1 for c in grams]
        self.kinds = len({g for c in grams for g in c}) + 1
        self.known = {w for c in words for w in c}
        self.cache: dict[str, np.ndarray] = {}
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LATIN)))
        self.tokens: dict[str, tuple[tuple[int, ...], int, int]] = {}
        self.spelled: dict[str, list[str]] = {}

    @classmethod
    def trained(cls, samples: list[tuple[str, str]], rounds: int = ROUNDS) -> LanguageModel:
        """From (language, text), each word once per document.

        A line counts under its document's label only if the model so far agrees, which
        begins with function words alone: passages in other languages and wrong labels wash out.
        Words of fewer than ``LEAST_DOCUMENTS`` documents (names, figures) stay unknown.
        """
        samples = [x for x in samples if x[0] in _LATIN_AT]
        texts = [t for _, t in samples]
        reader = cls([Counter() for _ in LATIN], [Counter() for _ in LATIN])
        read = [[reader.line_words(line) for line in t.split("\n")] for t in texts]
        seen = Counter(w for lines in read for w in {w for line in lines for w in line})
        model = cls([Counter({w: 20 for w in FUNCTION_WORDS[x]}) for x in LATIN], [Counter() for _ in LATIN])
        for _ in range(rounds):
            counts: list[Counter] = [Counter() for _ in LATIN]
            for (code, _), lines, labels in zip(samples, read, model.label(texts), strict=True):
                kept = [lines[n] for n, x, _ in labels if x == code]
                counts[_LATIN_AT[code]].update({w for line in kept for w in line if seen[w] >= LEAST_DOCUMENTS and _is_latin(w)})
            for x, c in zip(LATIN, counts, strict=True):
                share = max(3, sum(c.values()) // 500)
                for w in FUNCTION_WORDS[x]:
                    c[w] += share
            grams = []
            for c in counts:
                g: Counter = Counter()
                for w, n in c.items():
                    for k in _trigrams(w):
                        g[k] += n
                grams.append(g)
            model = cls(counts, grams)
        return model

    def score(self, word: str) -> np.ndarray:
        """Log scores of a Latin-script word in the languages of ``LATIN``, at most 6 apart."""
        got = self.cache.get(word)
        if got is None:
            if word in self.known:
                got = np.array([math.log((c.get(word, 0) + 0.05) / t) for c, t in zip(self.words, self.totals, strict=True)])
            else:
                got = np.array(
                    [
                        sum(math.log((g.get(k, 0) + 0.5) / (t + 0.5 * self.kinds)) for k in _trigrams(word)) / 2
                        for g, t in zip(self.grams, self.gram_totals, strict=True)
                    ]
                )
                got = np.maximum(got, got.max() - UNKNOWN)
            got = np.maximum(got, got.max() - 6.0) - got.max()
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = got
        return got

    def __getstate__(self) -> dict:
        return {"words": self.words, "grams": self.grams}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["words"], state["grams"])

    def word_id(self, word: str) -> int:
        got = self.ids.get(word)
        if got is None:
            got = self.ids[word] = len(self.ids)
            if got >= len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[got] = self.score(word)
        return got

    def token(self, token: str) -> tuple[tuple[int, ...], int, int]:
        """Ids of the Latin words in a token, and counts of Japanese characters and Russian words."""
        if _CALLED.search(token) or (_DIGIT.search(token) and not _EAST.search(token)):
            return (), 0, 0
        return self.counted(natural_words(token))

    def line_words(self, line: str) -> list[str]:
        """Natural words of a line, read token by token as ``read`` does."""
        if "\\" in line or '":' in line:
            return natural_words(line)
        out: list[str] = []
        for t in line.split():
            hit = self.spelled.get(t)
            if hit is None:
                plain = _CALLED.search(t) or (_DIGIT.search(t) and not _EAST.search(t))
                hit = self.spelled[t] = [] if plain else natural_words(t)
            out += hit
        return out

    def counted(self, words: list[str]) -> tuple[tuple[int, ...], int, int]:
        ids, japanese, russian = [], 0, 0
        for w in words:
            if w.isascii() or not _EAST.search(w):
                ids.append(self.word_id(w))
            elif _JAPANESE.match(w):
                japanese += 1
            else:
                russian += 1
        return tuple(ids), japanese, russian

    def read(self, line: str) -> tuple[list[int], int, int]:
        """What ``token`` gives, for a whole line."""
        if "\\" in line or '":' in line:
            ids, japanese, russian = self.counted(natural_words(line))
            return list(ids), japanese, russian
        out: list[int] = []
        japanese = russian = 0
        known = self.tokens
        for t in line.split():
            hit = known.get(t)
            if hit is None:
                hit = self.token(t)
                if len(known) > 300_000:
                    known.clear()
                known[t] = hit
            if hit[0]:
                out += hit[0]
            japanese += hit[1]
            russian += hit[2]
        return out, japanese, russian

    def label(self, docs: list[str]) -> list[list[tuple[int, str, float]]]:
        """``(line number, language, confidence)`` of the prose lines of each text.

        Equal to the labels of ``spans``, but the sums of all lines are made at once:
        where a line's best language cannot lose to any switch, and every line of a
        text leads by more than two switches, the best path is known without a search.
        """
        if len(self.ids) > 300_000:
            self.ids, self.rows, self.tokens = {}, np.zeros((1024, len(LATIN))), {}
        ids: list[int] = []
        starts, lines, bounds = [], [], [0]
        for text in docs:
            for n, line in enumerate(text.split("\n")):
                if not line:
                    continue
                got, japanese, russian = self.read(line)
                if japanese >= LEAST_CHARS or len(got) + russian >= LEAST_WORDS:
                    starts.append(len(ids))
                    ids += got
                    lines.append((n, len(got), japanese, russian))
            bounds.append(len(lines))
        if not lines:
            return [[] for _ in docs]
        size = np.array([x[1] for x in lines])
        full = np.flatnonzero(size)
        totals, gains = np.zeros((len(lines), len(LATIN))), np.zeros(len(lines))
        m = self.rows[ids] if ids else np.zeros((0, len(LATIN)))
        at = np.array(starts)
        if len(full):
            totals[full] = np.add.reduceat(m, at[full])
        top = totals.argmax(axis=1)
        if len(full):
            lead = m[np.arange(len(m)), np.repeat(top[full], size[full])]
            over = np.maximum(m - lead[:, None], 0)
            gains[full] = np.add.reduceat(over, at[full]).max(axis=1)
        ordered = np.sort(totals, axis=1)
        margin = ordered[:, -1] - ordered[:, -2]
        sure = 1 / np.exp(totals - ordered[:, -1:]).sum(axis=1)
        plain = (gains < SWITCH) & ((margin > 2 * SWITCH_LINE) | (size == 0))
        out = []
        for d in range(len(docs)):
            a, b = bounds[d], bounds[d + 1]
            if a < b and not plain[a:b].all():
                paths = _viterbi([m[at[i] : at[i] + size[i]] for i in range(a, b)])
            else:
                paths = None
            found = []
            for i in range(a, b):
                n, latin, japanese, russian = lines[i]
                best, share = int(top[i]), float(sure[i])
                if paths is not None and latin:
                    counts = np.bincount(paths[i - a], minlength=len(LATIN))
                    best = int(counts.argmax())
                    share = float(counts[best] / latin) * (share if best == top[i] else 0.5)
                weights = (5 * latin, 2 * japanese, 6 * russian)
                kind = weights.index(max(weights))
                part = weights[kind] / sum(weights)
                found.append((n, (LATIN[best], "ja", "ru")[kind], round(part * (share if kind == 0 else 1.0), 4)))
            out.append(found)
        return out

    def certainty(self, words: list[str], code: str) -> float:
        """How sure a stretch is of its language: its share of the likelihoods; a script of one language is certain."""
        if code not in _LATIN_AT:
            return 1.0
        total = np.sum([self.score(w) for w in words], axis=0)
        return round(float(1 / np.exp(total - total[_LATIN_AT[code]]).sum()), 4)

    def spans(self, lines: list[list[str]]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Per line: language, confidence and spans (first word, end, language).

        Scripts settle Russian and Japanese; among the others Viterbi finds the best
        sequence of languages, with a penalty for each change.
        """
        matrices, where = [], []
        for n, words in enumerate(lines):
            latin = [i for i, w in enumerate(words) if not (_JAPANESE.match(w) or _CYRILLIC.search(w))]
            where.append(latin)
            matrices.append(np.array([self.score(words[i]) for i in latin]) if latin else np.zeros((0, len(LATIN))))
        paths = _viterbi(matrices)
        out = []
        for words, latin, path, m in zip(lines, where, paths, matrices, strict=True):
            labels = [""] * len(words)
            for i, p in zip(latin, path, strict=True):
                labels[i] = LATIN[p]
            for i, w in enumerate(words):
                if not labels[i]:
                    labels[i] = "ja" if _JAPANESE.match(w) else "ru"
            spans: list[tuple[int, int, str]] = []
            for i, x in enumerate(labels):
                if spans and spans[-1][2] == x:
                    spans[-1] = (spans[-1][0], i + 1, x)
                else:
                    spans.append((i, i + 1, x))
            weight: Counter = Counter()
            for w, x in zip(words, labels, strict=True):
                weight[x] += max(1, len(w)) if x != "ja" else 2
            if not weight:
                out.append(("", 0.0, []))
                continue
            best = max(weight, key=lambda x: (weight[x], -LANGUAGES.index(x)))
            share = weight[best] / sum(weight.values())
            sure = 1.0
            if best in _LATIN_AT and len(m):
                total = m.sum(axis=0)
                total = total - total.max()
                sure = float(np.exp(total[_LATIN_AT[best]]) / np.exp(total).sum()) if share > 0.999 else 1.0
            out.append((best, round(share * sure, 4), spans))
        return out


def _is_latin(word: str) -> bool:
    return word.isascii() or not (_CYRILLIC.search(word) or _JAPANESE.match(word))


def _trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(max(1, len(padded) - 2))]


def _viterbi(matrices: list[np.ndarray]) -> list[list[int]]:
    """Best language of every row; lines whose best single language no switch could better are settled at once."""
    k = len(LATIN)
    best = np.zeros(k)
    back: list[tuple[str, object]] = []
    for m in matrices:
        arrive = best.max() - SWITCH_LINE
        came = np.where(best >= arrive, np.arange(k), int(best.argmax()))
        best = np.maximum(best, arrive)
        if not len(m):
            back.append(("empty", came))
            continue
        total = m.sum(axis=0)
        top = int(total.argmax())
        run = np.cumsum(m - m[:, [top]], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros(k), run]), axis=0)[:-1]
        if (run - low).max() < SWITCH:
            # No stretch of another language gains as much as one change costs: a line is one language.
            best = best + total
            back.append(("whole", came))
            continue
        steps = []
        for row in m:
            jump = best.max() - SWITCH
            steps.append(np.where(best >= jump, np.arange(k), int(best.argmax())))
            best = np.maximum(best, jump) + row
        back.append(("steps", (came, steps)))
    at = int(best.argmax())
    out: list[list[int]] = []
    for m, (kind, data) in zip(reversed(matrices), reversed(back), strict=True):
        if kind == "steps":
            came, steps = data
            path = []
            for step in reversed(steps):
                path.append(at)
                at = int(step[at])
            out.append(path[::-1])
            at = int(came[at])
        else:
            out.append([at] * len(m))
            at = int(data[at])
    return out[::-1]
