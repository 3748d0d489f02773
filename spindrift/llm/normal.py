"""Text brought to plain words, so that surface changes do not matter."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ё": "e", "ї": "i", "ѵ": "v", "г": "r",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ո": "n", "օ": "o", "ս": "u", "հ": "h",
}

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_WORD = re.compile(r"[^\W_]+")
_WORD_ASCII = re.compile(r"[a-z0-9]+")


class _Fold(dict):
    """Translation table filled as characters turn up."""

    def __missing__(self, code: int):
        c = chr(code)
        if unicodedata.category(c) in ("Mn", "Cf", "Me"):
            out = ""  # accents, zero-width characters, soft hyphens
        else:
            out = LOOK_ALIKES.get(c.lower(), c)
        self[code] = out
        return out


_FOLD = _Fold()


def folded(text: str) -> str:
    """Lower case, without accents, invisible characters and look-alikes."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", text).translate(_FOLD).lower()


def without_markup(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return text


def words(text: str) -> list[str]:
    """Words of a text without markup, case, accents, look-alikes and punctuation."""
    text = folded(without_markup(text))
    return (_WORD_ASCII if text.isascii() else _WORD).findall(text)
