"""Statistics of texts by which prose is told from lists, tables and junk."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import spread

WORD = re.compile(r"[^\W\d_]+")
_RULE = re.compile(r"[-=_|+:*\s]{4,}")
_GAPS = re.compile(r"(?<=\S)(?: {3,}|\t+ *)(?=\S)")
_ENTRY = re.compile(
    r"""[*•·▪‣–—-][ ]|\[\d+\][ ]|<\d+>[ ]|\(?(?:\d{1,4}[a-z]?|[a-z]{1,2}|[ivx]+)[.):][ ]|\d{1,4}[a-z]?[ ]|[A-H]\d\d[A-Z][ ]\d+/\d+""",
)
_SENTENCES = re.compile(r"[.!?]\s+|[。！？]")
_PUNCTUATION = re.compile(r"[,.;:!?](?=\s|$)")
_LEADERS = re.compile(r"[.…_·]{5,}")
#: What the first and a later byte of UTF-8 look like in a single-byte encoding.
_MISREAD = re.compile(r"[Â-ô][\x80-¿Œ-™]")
#: Characters of any prose; letters, marks and digits beyond ASCII are asked for one by one.
_COMMON = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\r\t.,;:!?()[]'\"-/%„“”‘’«»°±–—")
_APART = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalpha()})
_BYTES_APART = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
_ASCII_PLAIN = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b" \n\t\r\x0b\x0c"

#: Bytes of common words that may go with the tasks.
MOST_BYTES = 16 << 20
ENTRY_WORDS = 8  # words of an enumerated entry on the average at most
REPEATS = 4  # times that a line or sentence occurs to count as over and over


class Common:
    """Common words: for each a bit per language it belongs to, and the scripts that they are written in."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        languages = {lang: k for k, lang in enumerate(sorted({r[0] for r in rows}))}
        self.bits: dict[str, int] = {}
        for lang, word in rows:
            self.bits[word] = self.bits.get(word, 0) | 1 << languages[lang]
        self.scripts = frozenset(_script(c) for w in self.bits for c in w if c.isalpha())


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    """The script of a letter, as its Unicode name begins."""
    return unicodedata.name(c, "").split(" ")[0]


@lru_cache(maxsize=1 << 16)
def _ends_sentence(c: str) -> bool:
    """Whether a character is a full stop, an exclamation or question mark, an ellipsis or a danda in any script."""
    name = unicodedata.name(c, "")
    return any(x in name for x in ("FULL STOP", "QUESTION MARK", "EXCLAMATION MARK", "ELLIPSIS", "DANDA"))


@lru_cache(maxsize=1 << 16)
def _fits(c: str) -> bool:
    """Whether a character may stand in a word or between words of prose: letters, digits, marks and what punctuates them."""
    return c.isalnum() or c in "-'/.,%" or not c.isascii() and (unicodedata.category(c)[0] in "MP" or c in "±°")


def _ends(s: str) -> bool:
    """Whether a line ends as a sentence does."""
    last = s[-1]
    if last.isalnum():
        return False
    return _ends_sentence(last) or len(s) > 1 and last in "\"'”»)]」』" and _ends_sentence(s[-2])


def _is_row(line: str) -> bool:
    """Whether a line is a row of cells."""
    if line.count(" | ") >= 2 or line[0] == line[-1] == "|" and len(line) > 2 or line.count("|") == line.count(" | ") == 1:
        return True
    if line.count(";") >= 2 and "; " not in line and " ;" not in line:
        cells = line.split(";")
    else:
        cells = _GAPS.split(line)
    return len(cells) >= 2 and [len(c) <= 30 for c in cells].count(True) >= 0.75 * len(cells)


def _strange(text: str, tokens: list[str]) -> tuple[set[str], bool]:
    """Characters of a text that are rare in prose, and whether it has a long run, leaders or misread bytes.

    A line without any of these can't be garbled.
    """
    odd = {c for c in set(text) - _COMMON if c.isascii() or not _fits(c)}
    other = max(map(len, tokens), default=0) > 30 or "....." in text or "·····" in text or "0x" in text
    return odd, other or not text.isascii() and _MISREAD.search(text) is not None


def _found(text: str) -> list[str]:
    """The words of a text in lower case: runs of letters."""
    text = text.lower()
    if text.isascii():
        return text.translate(_APART).split()
    for c in set(text):
        if not c.isascii() and (not c.isalnum() or c.isdecimal()):
            text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(_BYTES_APART).decode("utf-8", "surrogatepass").split()


def _dominant(tokens: list[str]) -> tuple[int, int]:
    """How often the most frequent three successive tokens occur, and the characters that they cover if they repeat."""
    grams = Counter(zip(tokens, tokens[1:], tokens[2:], strict=False))
    if not grams:
        return 0, 0
    top = max(grams, key=grams.__getitem__)
    times = grams[top]
    return times, (sum(map(len, top)) + 2) * times if times > 1 else 0


def _is_misread(token: str) -> bool:
    """Whether a token is UTF-8 that was read as a single-byte encoding: read the right way, it becomes shorter."""
    for codec in ("cp1252", "latin-1"):
        try:
            return len(token.encode(codec).decode("utf-8")) < len(token)
        except UnicodeError:
            continue
    return False


def _is_garbled(text: str) -> bool:
    """Whether a line has no readable words: symbols, wrongly decoded letters, encoded data. Scripts are all alike."""
    tokens = text.split()
    chars = sum(map(len, tokens))
    if sum(map(len, _LEADERS.findall(text))) > 0.4 * chars:
        return True
    bad = good = 0
    for t in tokens:
        core = t.strip(".,;:!?()[]{}\"'“”«»…-–")
        size = len(core)
        if not core:
            bad += len(t) > 1
        elif core.isascii():
            if core.isalpha():
                good += size
            elif size > 30 and not core.islower():
                bad += size  # encoded data
            elif core.startswith("0x"):
                bad += size + 4
            elif not core.isdecimal() and not all(map(_fits, core)):
                bad += size
        elif "�" in core or "□" in core:
            bad += size + 4
        elif _is_misread(t):
            bad += size
        elif core.isalpha():
            good += size
        elif not all(map(_fits, core)):
            bad += size
        elif not core.isnumeric():
            good += size
    return bad > 0.25 * (good + bad)


def _is_salad(text: str, common: Common) -> bool:
    """Whether words follow each other without sentences: no punctuation, and no common word more frequent than another.

    Only scripts that have common words can be judged so.
    """
    tokens = _found(text)
    if len(tokens) < 25 or len(_PUNCTUATION.findall(text)) > len(tokens) / 30:
        return False
    letters = "".join(tokens)
    if letters.isascii():
        if "LATIN" not in common.scripts:
            return False
    elif sum(_script(c) in common.scripts for c in letters) * 2 < len(letters):
        return False
    counts = Counter(filter(common.bits.__contains__, tokens))
    total = sum(counts.values())
    return total < 0.08 * len(tokens) or max(counts.values()) < max(0.085 * total, 0.025 * len(tokens) + 1)


def _is_enumeration(text: str) -> bool:
    """Whether a stretch is a run of short entries between semicolons or commas."""
    if text.count(";") < 4 and text.count(",") < 12:
        return False
    sep = ";" if text.count(";") >= 4 else ","
    parts = [p for p in text.split(sep) if p.strip()]
    n_words = [len(p.split()) for p in parts]
    longest = max(n_words[1:], default=0)  # a heading may stand before the first entry
    return longest <= 10 and n_words[0] <= 20 and sum(n_words) <= ENTRY_WORDS * 0.8 * len(n_words) and text.count(". ") <= len(parts) / 10


def _kinds(stripped: list[str]) -> list[str]:
    """Of each line: table, entry, text, or nothing for a blank one."""
    kinds: list[str] = []
    for s in stripped:
        if not s:
            kinds.append("")
        elif ("|" in s or "\t" in s or "   " in s or ";" in s) and _is_row(s):
            kinds.append("table")
        elif s[0] in "-=_|+:*" and _RULE.fullmatch(s):
            kinds.append("rule")
        elif len(s) < 120 and _ENTRY.match(s) and not (_ends(s) and s.count(" ") > 4):
            kinds.append("entry")
        else:
            kinds.append("text")
    for i, kind in enumerate(kinds):
        if kind == "rule":  # belongs to the table it stands in
            kinds[i] = "table" if "table" in kinds[max(0, i - 2) : i + 3] else "text"
    for i in range(len(kinds) - 1):  # forwards, so that a line turned to text doesn't turn the entry before it
        if kinds[i] == "entry" and kinds[i + 1] == "text":  # a sentence that goes on in the next line
            kinds[i] = "text"
    if kinds.count("entry") < 3:
        kinds = ["text" if k == "entry" else k for k in kinds]
    return kinds


def _symbols(text: str) -> int:
    """Characters that are neither letters, digits nor white space."""
    rest = text.encode("utf-8", "surrogatepass").translate(None, _ASCII_PLAIN)
    if not rest or text.isascii():
        return len(rest)
    return sum(not c.isalnum() and not c.isspace() for c in rest.decode("utf-8", "surrogatepass"))


def described(text: str, common: Common) -> dict:
    """The statistics of one text."""
    lines = text.split("\n")
    stripped = [line.strip() for line in lines]
    kinds = _kinds(stripped)
    size = dict.fromkeys(("table", "list", "junk"), 0)
    line_counts = Counter(stripped)
    del line_counts[""]
    full = sum(line_counts.values())
    repeated = boilerplate = 0
    tokens = text.split()
    found = _found(text)
    odd, other = _strange(text, tokens)
    prose: list[str] = []
    open_: list[str] = []  # successive lines of text without the end of a sentence

    def close() -> None:
        stretch = " ".join(open_)
        if len(stretch) < 20:
            prose.extend(open_)
        elif _is_salad(stretch, common):
            size["junk"] += len(stretch) + 1
        elif _is_enumeration(stretch):
            size["list"] += len(stretch) + 1
        else:
            prose.extend(open_)
        open_.clear()

    for line, s, kind in zip(lines, stripped, kinds, strict=True):
        if kind == "text":
            if line_counts[s] > 1 and len(s) > 3:
                boilerplate += len(line) + 1
            if line_counts[s] >= REPEATS and len(s) > 3:
                size["junk"] += len(line) + 1
                repeated += len(line) + 1
            elif (other or not odd.isdisjoint(s)) and _is_garbled(s):
                size["junk"] += len(line) + 1
            elif ". " in s or s[-1] == ":" or _ends(s):
                close()
                prose.append(line)
            else:
                open_.append(line)
            continue
        if open_:
            close()
        if kind == "table":
            size["table"] += len(line) + 1
        elif kind == "entry":
            size["list"] += len(line) + 1
    close()
    times, covered = _dominant(tokens)
    if times >= REPEATS and prose:
        joined = " ".join(prose)
        if joined.isascii():
            parts = joined.replace("? ", ". ").replace("! ", ". ").split(". ")
        else:
            parts = _SENTENCES.split(joined)
        sentences = Counter(parts)
        over = sum((len(x) + 2) * n for x, n in sentences.items() if n >= REPEATS and len(x) > 19)
        size["junk"] += over
        repeated += over
    chars = max(len(text), 1)
    n_words = len(found)
    by_language: Counter[int] = Counter()
    if common.bits:
        for w, n in Counter(filter(common.bits.__contains__, found)).items():
            bits = common.bits[w]
            while bits:
                by_language[bits & -bits] += n
                bits &= bits - 1
    if "\n\n" in text:
        paragraphs = [p for x in text.split("\n\n") if (p := x.strip())]
        duplicates = (len(paragraphs) - len(set(paragraphs))) / len(paragraphs) if paragraphs else 0.0
    else:
        duplicates = 0.0
    coverage = covered / chars
    symbols = _symbols(text) / chars
    kind = max(size, key=size.__getitem__)
    if size[kind] <= 0.5 * chars:
        if coverage > 0.5 or symbols > 0.5:
            kind = "junk"  # the same few words over and over, or hardly any letters
        elif boilerplate > 0.5 * chars or duplicates > 0.5:
            kind = "boilerplate"
        else:
            kind = "prose"
    return {
        "n_chars": len(text),
        "n_words": n_words,
        "mean_word_length": sum(map(len, found)) / n_words if n_words else 0.0,
        "symbol_ratio": symbols,
        "punctuated_lines": sum([n for s, n in line_counts.items() if _ends(s)]) / full if full else 0.0,
        "common_words": max(by_language.values(), default=0) / n_words if n_words else 0.0,
        "duplicate_lines": (full - len(line_counts)) / full if full else 0.0,
        "duplicate_paragraphs": duplicates,
        "top_ngram": coverage,
        "repeated_share": min(1.0, repeated / chars),
        "list_share": min(1.0, size["list"] / chars),
        "table_share": min(1.0, size["table"] / chars),
        "junk_share": min(1.0, size["junk"] / chars),
        "boilerplate_share": min(1.0, boilerplate / chars),
        "text_kind": kind,
    }


FIELDS = {
    "n_chars": "bigint", "n_words": "bigint", "mean_word_length": "double", "symbol_ratio": "double", "punctuated_lines": "double",
    "common_words": "double", "duplicate_lines": "double", "duplicate_paragraphs": "double", "top_ngram": "double",
    "repeated_share": "double", "list_share": "double", "table_share": "double", "junk_share": "double",
    "boilerplate_share": "double", "text_kind": "string",
}
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def text_quality(docs: DataFrame, common: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Statistics of every text and ``text_kind``: list, table or junk for the kind of more than half its characters,
    boilerplate for one that mostly repeats its own lines or paragraphs, else prose.

    ``common`` has columns lang and word, of any number of languages; it is a dimension whose words hold at most
    ``most_bytes``, which is checked before it goes with the tasks. The share of common words is that in the language with
    most of them, so a wrong language does no harm.

    Method: lines are rows of cells, enumerated entries or text by their form; stretches of text are junk if they are
    garbled, lack sentences (told only for scripts that have common words), or repeat a line or sentence, and lists if they
    are runs of short entries. A text that these leave open is junk if its most frequent three successive words cover more
    than half of it or symbols do, boilerplate if repeated lines or paragraphs do. Numbered claims end as sentences and
    stay prose. One pass over whole texts, no shuffle.

    Null texts give null statistics and kind; empty ones zeros and prose. Null languages and words are no common words.
    Rows repeat as they come; other columns are ignored.
    """
    known = common.select("lang", F.lower("word").alias("word")).where("lang is not null and word is not null")
    held = known.agg(F.sum(F.octet_length("word")).alias("b")).first().b or 0
    if held > most_bytes:
        raise ValueError(f"the common words hold {held} bytes, more than {most_bytes}")
    table = Common([(r.lang, r.word) for r in known.collect()])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[dict] = []
            none = dict.fromkeys(FIELDS)
            for value in batch.column(1):
                t = value.as_py()
                got.append(none if t is None else described(t, table))
            arrays = [pa.array([g[f] for g in got], _ARROW[k]) for f, k in FIELDS.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["_doc", *FIELDS])

    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_doc"]
    done = spread(rows).mapInArrow(walk, f"_doc {kind}, " + ", ".join(f"{f} {k}" for f, k in FIELDS.items()))
    return done.withColumnRenamed("_doc", doc_id)
