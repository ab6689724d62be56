"""Words as they compare across spellings: one normal form for corpus and test texts."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones, and letters without a decomposition.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ł": "l", "đ": "d", "ð": "d", "ø": "o", "ı": "i", "ħ": "h", "ŋ": "n", "þ": "th", "æ": "ae", "œ": "oe", "ɑ": "a", "ɡ": "g",
}
_TABLE = str.maketrans(LOOKALIKES)
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
_WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_ESCAPE = re.compile(r"\\+[nrtfb/\"']")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,10});")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_FORMAT = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\r?\n[ \t>|#*]*(?=[^\W\d_])")
_MARKS = re.compile("[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿︠-︯]")


def _percent(m: re.Match[str]) -> str:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
    except ValueError:
        return m[0]


def normal(text: str) -> str:
    """``text`` without case, accents, look-alikes, invisible characters and escapes."""
    if "\\" in text:
        text = _UNICODE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)
        text = _ESCAPE.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "%" in text:
        text = _PERCENT.sub(_percent, text)
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    if text.isascii():
        return text.lower()
    text = _FORMAT.sub("", unicodedata.normalize("NFKC", text)).casefold()
    return unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFKD", text))).translate(_TABLE)


def words(text: str | None) -> list[str]:
    return _WORD.findall(normal(text)) if text else []


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel: one long integer per element of ``b``)."""
    if not a or not b:
        return 0
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        at = places.get(x, 0)
        if at:
            met = row & at
            row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()
