"""Words of a text, alike for texts that differ only in looks."""

from __future__ import annotations

import html
import re
import unicodedata

# fixed values: letters of other scripts that look like Latin ones, and their likenesses
_LIKE = str.maketrans(
    "аеорсухіјѕһԁԛԝѵӏкмнтвαεικνορτυχ",
    "aeopcyxijshdqwvlkmhtbaeikvoptux",
)
_COMMENT = re.compile(r"<!--(?:(?!<!--|-->).)*-->", re.S)
#: Tags inside a word are dropped, other tags end a word. What stands between angle
#: brackets is a tag up to 300 characters, and beyond if it has an attribute.
_INSIDE = r"(?:[^<>]{0,300}|[^<>=]{0,300}=[^<>]*+)"
_INLINE = re.compile(rf"</?(?:b|i|u|s|em|strong|span|wbr|font)\b{_INSIDE}>|\[/?(?:b|i|u|s)\]", re.I)
_TAG = re.compile(rf"</?[a-z]{_INSIDE}>|\[/?[a-z]+(?:=[^\[\]]*+)?\]", re.I)
#: A word broken at a line end, also inside a quotation.
_BROKEN = re.compile(r"(?<=[^\W\d_])[-­‐‑]\s*\r?\n[\s>|]*(?=[^\W\d_])")
_UNSEEN = re.compile(r"[­̀-ͯ​-‏‪-‮⁠-⁤︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-case words without markup, punctuation, accents or odd character forms.

    Null and empty texts have none. Entities are read, words broken at line ends are
    joined, look-alike letters of other scripts become Latin ones.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    plain = text.isascii()
    if not plain:
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    while "<!--" in text and (less := _COMMENT.sub(" ", text)) != text:
        text = less
    if "-" in text or not plain:
        text = _BROKEN.sub("", text)
    if "<" in text or "[" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    text = text.casefold()
    if not plain:
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text)).translate(_LIKE)
    return _WORD.findall(text)
