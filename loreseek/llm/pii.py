"""Personal data: base patterns, and offset-preserving deobfuscation.

Base spans (email, ip, card, phone) are found in the text as it is. For the
added spans, transducers rewrite the text - homoglyphs and invisible
characters, spelled digits, at/dot disguises - while two arrays keep, for each
character of the rewritten text, the source characters it stands for. The
identifiers of the rewritten text are mapped back through the arrays; a span is
added if it covers something rewritten and overlaps no base span of its kind.

The base patterns are scanned in time linear in the text: an email is found
from its @, and digit runs are entered at their first digit only.

Defined results: a null text counts as empty and has no spans (masking keeps it
null); repeated rows are returned once each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loreseek.llm.common import pieces

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, ordered by start and kind."""
    out: list[Span] = []
    free = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                free = m.end()
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Rewritten:
    """A text and, for each of its characters, the source characters it stands for and whether it was changed."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends, self.changed = text, np.arange(len(text), dtype=np.int32), np.arange(1, len(text) + 1, dtype=np.int32), np.zeros(len(text), bool)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [start, end) of the present text by a string; edits come in order and don't overlap."""
        text, starts, ends, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            starts += (self.starts[at:a], np.full(len(new), self.starts[a]))
            ends += (self.ends[at:a], np.full(len(new), self.ends[b - 1]))
            changed += (self.changed[at:a], np.ones(len(new), bool))
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends, self.changed = (np.concatenate([*parts, last[at:]]) for parts, last in ((starts, self.starts), (ends, self.ends), (changed, self.changed)))


_GLYPHS = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
_GLYPHS |= dict(zip("АВЕЅІЈКМНОРСТХУаеоріѕјсухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοɑɡı", "ABESIJKMHOPCTXYaeopisjcyxdqwABEZHIKMNOPTYXoagi", strict=True))
_GLYPHS |= {chr(base + k): str(k) for base in (0x660, 0x6F0, 0x966) for k in range(10)}
_GLYPHS |= {c: "" for c in "​‌‍⁠﻿­"}
_GLYPHS |= {c: "-" for c in "‐‑‒–−"} | {" ": " ", "․": ".", "．": ".", "。": "."}
_GLYPH = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + "]")

_DIGITS = {w: str(k) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro un deux trois quatre cinq six sept huit neuf") for k, w in enumerate(words.split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_DOT_NAME = r"(?:dot|punkt|point|punto)"
_GAP = rf"(?:\s{{0,2}}[\[({{<]\s{{0,2}}{_DOT_NAME}\s{{0,2}}[\])}}>]\s{{0,2}}|\s{{1,2}}{_DOT_NAME}\s{{1,2}}|[\s,().-]{{1,4}})"
_ITEM = rf"(?:{_WORD}|[0-9]++)(?!\w)"
#: Number words and digit groups in a row, with what may stand between the groups of an identifier.
_CHAIN = re.compile(rf"(?i)(?:\bplus[\s-]{{1,2}}\(?)?(?<!\w){_ITEM}(?:{_GAP}{_ITEM})*+")
_LOOSE = re.compile(r"[\s,-]+")
_TOKEN = re.compile(rf"(?i)plus|{_WORD}|[0-9]+|(?P<dot>{_DOT_NAME})")


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """The edits of number words, plus and dot words in chains that hold enough for an identifier."""
    edits: list[tuple[int, int, str]] = []
    for m in _CHAIN.finditer(text):
        chain = m.group()
        if chain.isdigit() or len(chain) < 7:
            continue
        tokens = list(_TOKEN.finditer(chain))
        named = [t.group("dot") is not None for t in tokens]
        words = sum(not t.group()[0].isdigit() for t in tokens)
        digits = sum(len(t.group()) if t.group()[0].isdigit() else t.group().lower() in _DIGITS for t in tokens)
        # A phone number has ten digits at least and a card more; an address has three dots.
        if not words or digits < 10 and sum(named) + chain.count(".") < 3:
            continue
        at, last = m.start(), None
        for t in tokens:
            if t.group("dot"):
                last = "."
                continue
            kind = "digits" if t.group()[0].isdigit() else "word"
            if last is not None:
                gap = text[at : m.start() + t.start()]
                if last == ".":
                    edits.append((at, m.start() + t.start(), "."))
                elif last == "plus":
                    edits.append((at, m.start() + t.start(), ""))
                elif "word" in (last, kind):
                    new = "" if last == kind and _LOOSE.fullmatch(gap) else re.sub(r"[\s,]+", " ", gap)
                    if new != gap:
                        edits.append((at, m.start() + t.start(), new))
            at = m.start() + t.end()
            word = t.group().lower()
            if kind == "word":
                edits.append((m.start() + t.start(), at, "+" if word == "plus" else _DIGITS[word]))
            last = "plus" if word == "plus" else kind
    return edits


_AT = re.compile(r"(?i)\s{0,2}[\[({<]\s{0,2}(?:at|@)\s{0,2}[\])}>]\s{0,2}")
_DOT = re.compile(r"(?i)\s{0,2}[\[({<]\s{0,2}(?:dot|punkt|point|punto|\.)\s{0,2}[\])}>]\s{0,2}")
#: How markup and links write the two signs.
_CODED = re.compile(r"(?i)(&#0*64;|&#x0*40;|&commat;|%40)|(?:&#0*46;|&#x0*2e;|&period;|%2e)")
#: Signs joined by one mark: jane_at_example_dot_com. At least one dot word makes it an address.
_JOINED = re.compile(r"(?i)(?<![a-z0-9._%+-])(?:(?!at(?P<m>[_-]))[a-z0-9.%+]++[_-])*?(?<=[_-])at(?P<s>[_-])[a-z0-9]++(?:(?P=s)dot(?P=s)[a-z0-9]++)++")
_MARKED = re.compile(r"(?i)_at_|-at-")
_JOINED_SIGN = re.compile(r"(?i)(?P<m>[_-])(at|dot)(?P=m)")
#: An at sign between blanks; the domain's dots are then all between blanks, or none is.
_SPACED = re.compile(r"(?i)(?<=[a-z0-9_%+-])(?P<at>\s@\s)(?=(?P<domain>[a-z0-9-]++(?:(?:\.[a-z0-9-]++)++|(?:\s\.\s[a-z0-9-]++)++)))")
#: A plain sign counts only where a complete address results: a local part, an at, a dot, and an ending of letters.
_PLAIN = re.compile(r"(?i)(?<=[a-z0-9_%+-])(?:\s{1,2}at\s{1,2}|@)(?P<first>[a-z0-9-]++)(?:(?:\s{1,2}dot\s{1,2}|\.)[a-z0-9-]++)++")
_ENDING = re.compile(r"(?i)(?:\s|\.)(?P<last>[a-z]{2,}|xn--[a-z0-9-]+)$")
_SIGN = re.compile(r"(?i)\s{1,2}(at|dot)\s{1,2}")
_DOT_WORD = re.compile(r"(?i)\sdot\s")
_AT_DOMAIN = re.compile(r"(?i)\sat\s{1,2}[a-z0-9-]++\.[a-z0-9]")
#: Words that stand before "at" and the name of a site in prose.
_PROSE = frozenset("look looks looked looking met meet available hosted found live visit more here info information details online site page pages home published posted read see seen listed documentation docs is are was were be us me it them him her you demo source sources code downloads download example examples join joined shop".split())
#: Words that announce an address.
_CUE = re.compile(r"(?i)\b(?:e-?mails?|mails?|mailto|contact|contacts|address|addresses|write|reach|send|reply)\b[^\n.!?]{0,24}$")
_BEFORE = re.compile(r"(?i)[a-z0-9_%+-](\s{1,2}dot\s{1,2})\Z")
#: Fixed values: "look at the dot on the page" is prose, so after one of these words only a common ending makes an address.
_DETERMINERS = frozenset("the a an this that these those each every any some one no his her its my our your their which what".split())
_COMMON = frozenset("com org net edu gov info biz dev app io ai co eu uk de ch fr es nl".split())


def _announced(text: str, m: re.Match) -> bool:
    """Whether a plain at before a written domain joins an address, in a text without another sign: a local part that is no word, a cue before it, or a line of its own."""
    start = m.start()
    while start > 0 and text[start - 1] in _LOCAL:
        start -= 1
    local = text[start : m.start()]
    begin = max(0, start - 64)
    _, broken, line = ("\n" * (begin == 0) + text[begin:start]).rpartition("\n")
    rest = text[m.end() : m.end() + 64].partition("\n")[0]
    alone = bool(broken) and local.lower() not in _PROSE and not any(c.isalnum() for c in line + rest)
    return alone or any(c in "._+" or c.isdigit() for c in local.strip(".")) or _CUE.search(line[-48:]) is not None


def _marked_signs(text: str) -> list[tuple[int, int, str]]:
    """The edits of signs that are joined by marks or stand between blanks."""
    edits = [(m.start() + x.start(), m.start() + x.end(), "@" if x.group(2).lower() == "at" else ".") for m in _JOINED.finditer(text) for x in _JOINED_SIGN.finditer(m.group())]
    if " @" in text or "\t@" in text:
        for m in _SPACED.finditer(text):
            edits.append((*m.span("at"), "@"))
            edits += [(m.start("domain") + x.start(), m.start("domain") + x.end(), ".") for x in re.finditer(r"\s\.\s", m.group("domain"))]
    return sorted(edits)


def _plain_signs(text: str) -> list[tuple[int, int, str]]:
    """The edits of plain at and dot words, of whole addresses only."""
    hinted = "@" in text or _DOT_WORD.search(text) is not None
    if not hinted and _AT_DOMAIN.search(text) is None:
        return []
    edits: list[tuple[int, int, str]] = []
    free = 0
    for m in _PLAIN.finditer(text):
        ending = _ENDING.search(m.group()[-64:])
        spelled = m.group()[0] != "@"
        if ending is None or spelled and m.group("first").lower() in _DETERMINERS and ending.group("last").lower() not in _COMMON:
            continue
        if not hinted and not _announced(text, m):
            continue
        signs, start = [], m.start()
        while True:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if (before := _BEFORE.search(text[max(free, start - 8) : start])) is None:
                break
            signs.append((start - len(before.group(1)), start, "."))
            start -= len(before.group(1))
        signs.reverse()
        signs += [(m.start() + x.start(), m.start() + x.end(), "@" if x.group(1).lower() == "at" else ".") for x in _SIGN.finditer(m.group())]
        edits += signs
        free = m.end()
    return edits


def rewrite(text: str) -> Rewritten | None:
    """The text after all transducers, or None if none applies."""
    new = Rewritten(text)
    if not text.isascii() and (edits := [(m.start(), m.end(), _GLYPHS[m.group()]) for m in _GLYPH.finditer(text)]):
        new.apply(edits)
    if edits := _spelled(new.text):
        new.apply(edits)
    if any(c in new.text for c in "[({<"):
        edits = sorted([(m.start(), m.end(), "@") for m in _AT.finditer(new.text)] + [(m.start(), m.end(), ".") for m in _DOT.finditer(new.text)])
        if edits := [e for k, e in enumerate(edits) if not k or edits[k - 1][1] <= e[0]]:
            new.apply(edits)
    if ("&" in new.text or "%" in new.text) and (edits := [(m.start(), m.end(), "@" if m.group(1) else ".") for m in _CODED.finditer(new.text)]):
        new.apply(edits)
    if (_MARKED.search(new.text) or "@" in new.text) and (edits := _marked_signs(new.text)):
        new.apply(edits)
    if edits := _plain_signs(new.text):
        new.apply(edits)
    return new if new.changed.any() or len(new.text) != len(text) else None


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    new = rewrite(text)
    if new is None:
        return base, base
    added = set()
    for a, kind, b in base_spans(new.text):
        start, end = int(new.starts[a]), int(new.ends[b - 1])
        touched = bool(new.changed[a:b].any()) or end - start != b - a
        if touched and not any(k == kind and s < end and start < e for s, k, e in base):
            added.add((start, kind, end))
    return base, sorted([*base, *added])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of ``docs`` (doc_id, text)."""
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            numbers, digests, spans = [[] for _ in KINDS], [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text or "")
                for k, column in enumerate(numbers):
                    column.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *counts, "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in counts) + "base_sha256 string, spans string")


def mask(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in capitals."""
    out, at = [], 0
    for a, kind, b in all_spans(text)[1]:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with masked texts; all columns stay, and n_chars, where it is a whole number, follows the text."""
    schema, place = docs.schema, docs.columns.index("text")
    length = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            columns = list(batch.columns)
            texts = [None if t is None else mask(t) for t in columns[place].to_pylist()]
            columns[place] = pa.array(texts, columns[place].type)
            if length is not None:
                columns[length] = pa.array([None if t is None else len(t) for t in texts], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
