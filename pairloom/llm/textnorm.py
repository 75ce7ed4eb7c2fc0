"""Words of a text, with spelling variants, markup and invisible characters taken out."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

# Letters that no Unicode decomposition splits.
LETTERS = {"æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ħ": "h", "ı": "i", "ß": "ss"}
# Tags that stand inside a line, so that no blank takes their place.
INLINE_TAGS = "a abbr b big cite code del em font i ins kbd mark q s small span strike strong sub sup tt u".split()

_TABLE = str.maketrans(LETTERS)
_INLINE = regex.compile(r"</?(?:%s)(?:\s[^<>]{0,300})?/?>" % "|".join(INLINE_TAGS), regex.I)
_TAG = regex.compile(r"<(?:/?[a-z][^<>]{0,300}|!--[^<>]{0,1000}--)>", regex.I)
_ESCAPE = regex.compile(r"\\(?:r\\n|[nrtf])")
_ESCAPED = regex.compile(r"\\u([0-9a-fA-F]{4})")
_BREAK = regex.compile("[-\u2010\u00ad][ \\t]*[\\r\\n\\v\\f\\u0085\\u2028]")
_HYPHENATED = regex.compile("([\\p{L}\\p{M}]+)[-\u2010\u00ad][ \\t]*(?:\\r\\n|[\\r\\n\\v\\f\\u0085\\u2028])[ \\t>|#*/]*([\\p{L}\\p{M}]+)")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}]+")
_APOSTROPHE = regex.compile("(?<=\\p{L})['\u2019\u02bc\u02b9`\u00b4](?=\\p{L})")
_WORD = re.compile(r"[^\W_]+")
_LETTER = re.compile("[%s]" % "".join(LETTERS))


def fold(text: str) -> str:
    """Compatibility forms, letter case, accents and invisible characters folded."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text)
    text = _INVISIBLE.sub("", unicodedata.normalize("NFD", text.casefold()))
    text = unicodedata.normalize("NFC", text)
    return text.translate(_TABLE) if _LETTER.search(text) else text


def plain(text: str, known: frozenset[str] | set[str] = frozenset()) -> str:
    """``text`` folded, without tags, entities, escapes and apostrophes; line breaks and punctuation stay.

    A word that is broken over two lines with a hyphen is joined if the joined
    word is in ``known``, and otherwise left as two words.
    """
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), _ESCAPE.sub("\n", text))
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if known and _BREAK.search(text):
        text = _HYPHENATED.sub(lambda m: m[1] + m[2] if fold(m[1] + m[2]) in known else f"{m[1]} {m[2]}", text)
    return _APOSTROPHE.sub("", fold(text))


def split_words(folded: str) -> list[str]:
    """Words of a text that ``plain`` has folded."""
    return _WORD.findall(folded)


def words(text: str | None, known: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """Folded words of ``text``; an empty list for null and blank texts."""
    return split_words(plain(text, known)) if text else []


def words_with_spans(text: str, known: frozenset[str] | set[str] = frozenset()) -> tuple[list[str], list[tuple[int, int]]]:
    """``words`` with the place in ``text`` that each came from.

    Slower: the text is read in pieces between blanks, each piece alone; tags
    are blanked out first without changing the length.
    """
    flat = text
    if "<" in flat:
        flat = _INLINE.sub(lambda m: "\u200b" * len(m[0]), flat)
        flat = _TAG.sub(lambda m: " " * len(m[0]), flat)
    if "\\" in flat:
        flat = _ESCAPE.sub(lambda m: " " * len(m[0]), flat)
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    pieces = [(m.start(), m.end()) for m in regex.finditer(r"\S+", flat)]
    at = 0
    while at < len(pieces):
        start, end = pieces[at]
        if at + 1 < len(pieces) and flat[end - 1] in "-\u2010\u00ad":
            both = words(flat[start : pieces[at + 1][1]], known)
            if len(both) < len(words(flat[start:end])) + len(words(flat[pieces[at + 1][0] : pieces[at + 1][1]])):
                end = pieces[at + 1][1]
                at += 1
        for w in words(flat[start:end], known):
            out.append(w)
            spans.append((start, end))
        at += 1
    return out, spans
