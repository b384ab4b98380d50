"""Personal data, plain and disguised, with spans in the source text.

Plain identifiers are found in the text as it stands. For disguised ones a chain of transducers rewrites the
text - homoglyphs and full-width forms to ASCII, invisible characters to nothing, spelled digits to digits,
``(at)`` and ``dot`` to signs - and every character of the result remembers the source characters it came
from. The same identifiers are then looked for in the normalised text and mapped back. Each step of the chain
runs only on texts that hold something for it to rewrite.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried once, at its start: what fails there fails further inside as well.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, by their ``@``: the local part reaches back as far as its characters do."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def plain(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all identifiers, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Letters of other scripts that look like Latin ones, and characters without a width.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3", "з": "3", "α": "a", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z", "ı": "i", "ɡ": "g", "ⅼ": "l",
    "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u00a0": " ", "\u202f": " ", "\u2009": " ", "\u3000": " "}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: The words of digits that are spelled out.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + INVISIBLE + "﹐-﹫＀-￮𝐀-𝟿⁰-₉①-⓿]")
_DIGIT = rf"(?:{'|'.join(SPELLED)})"
_RUN = re.compile(rf"(?i)(?<![A-Za-z0-9]){_DIGIT}(?:[\s,.()-]{{1,3}}{_DIGIT}){{3,}}(?![A-Za-z0-9])")
_ONE = re.compile(rf"(?i){_DIGIT}")
_PLUS = re.compile(r"(?i)(?<![A-Za-z0-9])plus[\s-]{1,2}(?=\(?[0-9])")
_AT = re.compile(r"(?i)\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|&#64;|&#x40;|&commat;|%40")
_DOT = re.compile(r"(?i)\s?[\[({<]\s?(?:dot|\.|punkt|point|punto)\s?[\])}>]\s?|&#46;|&#x2e;|&period;")
#: Ends of domains that a bare ``name at host dot end`` may have.
_ENDS = ("com|org|net|edu|gov|mil|int|info|biz|name|io|ai|app|dev|co|me|tv|cc|eu|us|uk|ca|au|nz|in|de|fr|es|it|nl|be|ch|at|pl|pt|"
         "se|no|fi|dk|ie|cz|ru|ua|jp|cn|kr|br|mx|ar|za|example|test|online|site|xyz")
#: Bare words are signs only where a whole address is spelled: name at host dot end.
_BARE = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]+)(?P<at>\s{1,2}at\s{1,2}|@)(?P<host>(?:[A-Za-z0-9-]+(?:\s{1,2}dot\s{1,2}|\.))+)(?P<end>" + _ENDS + r")(?![A-Za-z0-9])")
#: Ends that are words of plain prose as well ("he was at home dot it was late").
_WORDS = frozenset("name int info app co me tv us in de es it be at no se fi test online site net example".split())
#: What may follow an address but seldom such a word within a sentence, and what announces an address.
_STOP = re.compile(r"\s*(?:\Z|[\n.,;:!?)\]}>\"'|])")
_MAIL = re.compile(r"(?i)(?:mail|contact|reach|write|adress|address|correo|kontakt)\W")
_AT_WORD = re.compile(r"\sat\s")
_BARE_DOT = re.compile(r"(?i)\s{1,2}dot\s{1,2}")
_LOCAL_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9])\s{1,2}dot\s{1,2}(?=[A-Za-z0-9._%+-]+\s?(?:@|\[at\]|\(at\)|\{at\}|at\s))")
_NUMBER_DOT = re.compile(r"(?i)(?<=[0-9])\s{1,2}(?:dot|point)\s{1,2}(?=[0-9])")


class Mapped:
    """A text whose characters know where they came from: character i stems from source[i][0] to source[i][1]."""

    def __init__(self, text: str):
        self.text = text
        self.source: list[tuple[int, int]] | None = None  # None: character i is source character i
        self.changed: list[bool] | None = None

    def replace(self, spans: list[tuple[int, int, str]]) -> None:
        """Rewrite non-overlapping spans, given in order; each sign of a replacement stems from its whole span."""
        if not spans:
            return
        source = self.source or [(i, i + 1) for i in range(len(self.text))]
        changed = self.changed or [False] * len(self.text)
        text, where, marks, at = [], [], [], 0
        for a, b, new in spans:
            text += [self.text[at:a], new]
            where += source[at:a]
            marks += changed[at:a]
            where += [(source[a][0], source[b - 1][1])] * len(new)
            marks += [True] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.source, self.changed = where + source[at:], marks + changed[at:]

    def rewrite(self, pattern: re.Pattern, new: Callable[[re.Match], str]) -> None:
        self.replace([(*m.span(), new(m)) for m in pattern.finditer(self.text)])


def _letter(m: re.Match) -> str:
    c = m[0]
    if c in INVISIBLE:
        return ""
    flat = HOMOGLYPHS.get(c) or unicodedata.normalize("NFKC", c)
    return flat if flat.isascii() else c


def _spelled(mapped: Mapped) -> None:
    """Digits for runs of spelled ones. Each digit stems from its own word; what lies between the words goes."""
    spans = []
    for run in _RUN.finditer(mapped.text):
        at = run.start()
        for word in _ONE.finditer(mapped.text, run.start(), run.end()):
            if word.start() > at:
                spans.append((at, word.start(), ""))
            spans.append((*word.span(), SPELLED[word[0].lower()]))
            at = word.end()
    mapped.replace(spans)


def _address(m: re.Match) -> bool:
    """Whether a spelled address is one. If all its signs are words and so is its end, a second hint is needed: the sentence ends
    there, the name is no plain word, or something nearby announces an address."""
    if m["at"] == "@" or "." in m["host"] or m["end"].lower() not in _WORDS:
        return True
    return (_STOP.match(m.string, m.end()) is not None or not m["local"].isalpha()
            or _MAIL.search(m.string, max(0, m.start() - 30), m.start()) is not None)


def _bare(mapped: Mapped) -> None:
    spans = []
    for m in filter(_address, _BARE.finditer(mapped.text)):
        if m["at"] != "@":
            spans.append((*m.span("at"), "@"))
        spans += [(*d.span(), ".") for d in _BARE_DOT.finditer(mapped.text, m.end("at"), m.end())]
    mapped.replace(spans)


def normalise(text: str) -> Mapped | None:
    """The text as the transducers leave it, or None if it has nothing to rewrite."""
    mapped = Mapped(text)
    if not text.isascii() and _ODD.search(text):
        mapped.rewrite(_ODD, _letter)
    # What a step asks of the text is no more than its pattern does, so no find depends on words elsewhere.
    low = mapped.text.lower().replace("\u017f", "s").replace("i\u0307", "i")  # patterns that ignore case take these for s and i
    if any(x in low for x in SPELLED):
        _spelled(mapped)
    if "plus" in low:
        mapped.rewrite(_PLUS, lambda _: "+")
    if "dot" in low or "point" in low:
        mapped.rewrite(_NUMBER_DOT, lambda _: ".")
        mapped.rewrite(_LOCAL_DOT, lambda _: ".")
    if any(x in low for x in ("at", "@", "&#", "&c", "%40")):
        mapped.rewrite(_AT, lambda _: "@")
    if "dot" in low or "." in low or "pun" in low or "point" in low or "&#" in low or "&p" in low:
        mapped.rewrite(_DOT, lambda _: ".")
    if "dot" in low or " at " in low or _AT_WORD.search(low):
        _bare(mapped)
    return mapped if mapped.source is not None else None


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(plain, added) spans as (kind, start, end) in the source text.

    Added are the disguised identifiers: those whose normalised form holds a rewritten character. No span of their
    kind holds them whole, but they may overlap one: a plain match is often the undisguised part of an identifier.
    """
    base = plain(text)
    mapped = normalise(text)
    if mapped is None:
        return base, []
    found = set()
    spoken = [m for m in re.finditer(r"(?<![0-9+])[0-9]{10,15}(?![0-9])", mapped.text) if all(mapped.changed[m.start():m.end()])]
    for kind, a, b in [*plain(mapped.text), *((3, *m.span()) for m in spoken)]:
        if any(mapped.changed[a:b]) or mapped.source[b - 1][1] - mapped.source[a][0] != b - a:
            named = kind != 0 or re.search(r"\.[A-Za-z]{2,24}\Z", mapped.text[a:b]) is not None
            found.add((kind, mapped.source[a][0], mapped.source[b - 1][1], named))
    return base, _wider(base, found)


def _wider(base: list[tuple[int, int, int]], found: set[tuple[int, int, int, bool]]) -> list[tuple[int, int, int]]:
    """Spans of ``found`` that no other span of their kind holds whole; unnamed ones only where they overlap a plain one."""
    ends = {k: sorted(e for x, _, e in base if x == k) for k in range(len(KINDS))}  # plain spans of a kind don't overlap
    starts = {k: sorted(s for x, s, _ in base if x == k) for k in range(len(KINDS))}
    kept = [(k, s, e) for k, s, e, named in found if named or bisect_right(ends[k], s) < bisect_left(starts[k], e)]
    out, last, most = [], -1, 0
    for k, s, e, new in sorted([*((k, s, e, 0) for k, s, e in base), *((k, s, e, 1) for k, s, e in kept)], key=lambda x: (x[0], x[1], -x[2], x[3])):
        if k != last:
            last, most = k, 0
        if new and e > most:
            out.append((k, s, e))
        most = max(most, e)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, spans) per row.

    Counts and ``base`` are of plain identifiers, ``spans`` has disguised ones too; both are comma-joined
    ``kind:start:end`` by kind, then start, in characters with the end exclusive. A missing or empty text has none.
    Repeated rows and missing keys give rows like any other; other columns are ignored; an empty table gives an
    empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", *(f"n_{k}" for k in KINDS), "base", "spans"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            rows = []
            for base, added in map(find, common.texts_of(block.column("text")).to_pylist()):
                counts = [0] * len(KINDS)
                for k, _, _ in base:
                    counts[k] += 1
                rows.append((*counts, joined(base), joined(base + added)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.record_batch([block.column("key"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names)

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        found, f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    return out.withColumnRenamed("key", key)


def masked(text: str | None) -> str | None:
    """The text with a placeholder in the place of every identifier; overlapping ones share the first's."""
    if text is None:
        return None
    base, added = find(text)
    if not base and not added:
        return text
    out, at = [], 0
    spans: list[list[int]] = []
    for start, end, kind in sorted((a, b, k) for k, a, b in base + added):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end, kind])
    for start, end, kind in spans:
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, identifiers in ``text`` masked; ``size`` (if there) gets the new length.

    A missing text stays missing, and its length as it is.
    """
    at = docs.columns.index(text)
    length = docs.columns.index(size) if size in docs.columns else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            old = batch.column(at).to_pylist()
            new = list(map(masked, old))
            columns[at] = pa.array(new, batch.column(at).type)
            if length is not None:
                sizes = [s if t is u else len(u) for s, t, u in zip(columns[length].to_pylist(), old, new)]
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.record_batch(columns, batch.schema.names)

    return docs.mapInArrow(rows, docs.schema)
