"""Titles, names and ids reduced to what does not depend on formatting (plain Python, used inside Arrow functions)."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

from quirelake.functions.missing import PLACEHOLDERS

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?(?=\s*\{)")
#: Between the parts of a title: a colon or bar anywhere, a dash with blanks on both sides, a long dash anywhere.
_PART = re.compile(r"[:|\u2014\u2015]|(?<=\s)[-\u2010-\u2015]+(?=\s)")
_MAY_PART = re.compile(r"[-:|\u2010-\u2015]")
_INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]")
_NOT_LETTER = re.compile(r"[\W_]+")
_NOT_ASCII_LETTER = bytes(c for c in range(128) if not chr(c).isalnum())


def missing(text: str | None) -> bool:
    return text is None or text.strip().strip("\ufeff\u200b").lower() in PLACEHOLDERS


def plain(text: str) -> str:
    """Without markup, character references and invisible characters, of normal width, in lower case."""
    if text.isascii() and "&" not in text and "<" not in text and "\\" not in text:
        return text.lower()
    text = html.unescape(html.unescape(text))
    text = _COMMAND.sub("", _TAG.sub("", text))
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).casefold())


def letters(text: str) -> str:
    return text.encode().translate(None, _NOT_ASCII_LETTER).decode() if text.isascii() else _NOT_LETTER.sub("", text)


def plain_parts(text: str) -> list[str]:
    """Letters and digits of each part of a plain text, in the order written."""
    return [p for p in map(letters, _PART.split(text) if _MAY_PART.search(text) else [text]) if p]


def title_parts(title: str | None, normalized: str | None) -> list[str]:
    """Letters and digits of each part of the title, in the order written; the normalized title if there is no title."""
    if not missing(title):
        parts = plain_parts(plain(title))
        if parts:
            return parts
    if missing(normalized):
        return []
    return plain_parts(plain(normalized))


def spells(text: str, parts: list[str]) -> bool:
    """Whether the text is the parts one after the other, in some order; for any number of parts, each used once.

    Of the parts that the rest begins with, each distinct one is tried; a rest and the parts left for it are tried once.
    """
    if len(text) != sum(map(len, parts)):
        return False
    stack = [(0, tuple(sorted(parts)))]
    tried = set(stack)
    while stack:
        at, left = stack.pop()
        if not left:
            return True
        for i, p in enumerate(left):
            if (i == 0 or left[i - 1] != p) and text.startswith(p, at):
                step = (at + len(p), left[:i] + left[i + 1 :])
                if step not in tried:
                    tried.add(step)
                    stack.append(step)
    return False


#: Letters that do not decompose into a base letter and a mark.
_PLAIN_LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ð": "d"})


@lru_cache(1 << 16)
def fold(text: str) -> str:
    """Lower case without diacritics."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text).casefold().translate(_PLAIN_LETTERS)
    return "".join(c for c in text if not unicodedata.combining(c))
