"""Words of a text, whatever its case, typography and division at line ends."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Container

from pyspark.sql import DataFrame

WORD = re.compile(r"[^\W_]+")
_SOFT = re.compile("­[ \t]*(?:\r?\n[ \t]*)?|[​-‍⁠﻿]")
#: The hyphen, line end and indentation inside a divided word; it begins with the hyphen, so that nothing is tried at every word.
_DIVISION = re.compile(r"(?<=[^\W_])[-‐‑¬][ \t]*\r?\n[ \t]*(?=[^\W_])")
_APART = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalnum()})


def folded(text: str) -> str:
    """Compatibility forms unified, soft hyphens and zero-width characters removed, case folded."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", _SOFT.sub("", text)).casefold()


def is_divided(text: str) -> bool:
    """Whether a folded text has a word that is divided at a line end."""
    return "\n" in text and _DIVISION.search(text) is not None


def split(text: str) -> list[str]:
    """The words of a folded text without divisions."""
    return text.translate(_APART).split() if text.isascii() else WORD.findall(text)


def undivided(text: str, known: Container[str] | None = None) -> str:
    """A folded text with divided words joined, unless only their parts are ``known``."""
    if known is None:
        return _DIVISION.sub("", text)
    pieces: list[str] = []
    last, left = 0, ""  # left is the word before the division, as far as it is joined
    for m in _DIVISION.finditer(text):
        piece = text[last : m.start()]
        begin = len(piece)
        while begin and piece[begin - 1].isalnum():
            begin -= 1
        left = left + piece if not begin else piece[begin:]
        right = WORD.match(text, m.end())[0]
        pieces.append(piece)
        if left + right not in known and left in known and right in known:
            pieces.append(" ")
            left = ""
        last = m.end()
    return "".join([*pieces, text[last:]])


def words(text: str | None, known: Container[str] | None = None) -> list[str]:
    """Runs of letters and digits. A word divided by a hyphen at a line end is one word, unless only its parts are ``known``."""
    if not text:
        return []
    text = folded(text)
    return split(undivided(text, known) if is_divided(text) else text)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if it comes in fewer partitions than there are cores, as from one small file; else as it is.

    Work on texts is bound by CPU, so a table of few partitions gains by the shuffle; a large one is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
