"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it is. Then transducers rewrite disguises (homoglyphs and invisible characters,
"[at]" and "dot" in words, spelled digits), each keeping for every output character the source span that it stands for;
identifiers found in the rewritten text are mapped back to source characters and added unless a base span of their kind
holds them whole: a base span is often only the undisguised part of an address.

Scanning is linear in the text: each identifier is tried only where a run of its characters begins.

Defined cases: a null text is an empty one and has no spans; equal rows have equal spans; texts of any length are whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyveil.llm.shared import documents

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

#: Fixed values of the contract. Look-behinds only spare tries that cannot match: a run's inner digits.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters that look like Latin ones, and characters that stand for marks. NFKC covers full-width forms.
_LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ı": "i", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
_STRANGE = re.compile("[" + "".join(map(re.escape, _LOOKALIKE)) + "٠-٩۰-۹！-～﹫﹒\U0001d7ce-\U0001d7ff]")
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "|".join(_DIGIT_WORDS)
_BRACKET = re.compile(r"(?:(?<![ \t])[ \t]++)?(?:\[[ ]?(at|dot)[ ]?\]|\([ ]?(at|dot)[ ]?\)|\{[ ]?(at|dot)[ ]?\}|<[ ]?(at|dot)[ ]?>)[ \t]*", re.I)
_IN_BRACKETS = r"[ \t]*(?:\[[ ]?{0}[ ]?\]|\([ ]?{0}[ ]?\)|\{{[ ]?{0}[ ]?\}}|<[ ]?{0}[ ]?>)[ \t]*".format
_DISGUISED_DOT = rf" +dot +|{_IN_BRACKETS('dot')}"
#: An address in any mix of plain, bracketed and worded marks. A local part has at most 64 characters, thus 32 labels.
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?:{_DISGUISED_DOT})[A-Za-z0-9._%+-]++){{0,31}}(?:(?P<at> +at +|[ ]*@[ ]*)|{_IN_BRACKETS('at')})[A-Za-z0-9-]++(?:(?:\.|{_DISGUISED_DOT})[A-Za-z0-9-]++)+", re.I)
#: Last labels of common addresses, less those that are common words; and words before "at" that are
#: prose. Both judge only marks that are all in words.
_TOP_LEVEL = frozenset("com org net edu gov mil int info biz name pro dev app io ai tv cc xyz online site tech cloud blog shop eu uk ca au nz ie de ch fr nl lu es pt gr pl cz sk hu ro bg dk se fi ee lv lt ru ua tr il pk cn hk tw jp kr sg th vn id ph br ar cl co mx pe za ng ke eg".split())
_PROSE = frozenset("a all am an and are as be been call came come find for found go good here him her home i in is it join laugh live look looked looking looks me meet met not of on or out see stay stop the them there they this to up us visit wait was we were what when where who work you".split())
_DOT = re.compile(rf"(?<! ) +dot +|{_IN_BRACKETS('dot')}", re.I)
#: A worded dot before a number, and what must stand before it.
_NUMERIC_DOT = re.compile(rf"(?<![ ,-])[ ,-]++(?:dot|point)[ ]++(?=[0-9]|(?:{_WORD})(?![A-Za-z]))", re.I)
_NUMERIC_END = re.compile(rf"(?:[0-9]|(?<![A-Za-z])(?:{_WORD}))\Z", re.I)
_SPACED = re.compile(r"(?<=[A-Za-z0-9])( +@ *| *@ +)(?=[A-Za-z0-9-]+\.[A-Za-z])")
#: Numbers and digit words in a row, and one part of such a run. A run may end before "@" only where it is long.
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[ ]+)?(?:[0-9]++|(?:{_WORD})(?![A-Za-z]))(?:[ ,.()-]++(?:[0-9]++|(?:{_WORD})(?![A-Za-z])))+", re.I)
_SPELLED_PART = re.compile(rf"plus[ ]+|[ ,.()-]+|[0-9]+|{_WORD}", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find(text: str) -> list[Span]:
    """The contract's base spans by start, then kind as listed; code points, end exclusive."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    # leading zeros count for nothing, and a part of any length is compared without parsing it
    small = lambda part: len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Tape:
    """A text with, for each character, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """edits: (start, end, new text) in order, not overlapping. New characters stand for the whole edited span."""
        out, text, start, end, at = Tape(""), [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [*self.start[at:a], *[self.start[a]] * len(new)]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)]
            at = b
        out.text = "".join([*text, self.text[at:]])
        out.start, out.end = [*start, *self.start[at:]], [*end, *self.end[at:]]
        return out


def _homoglyphs(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _STRANGE.finditer(text):
        new = _LOOKALIKE.get(m[0])
        out.append((m.start(), m.end(), unicodedata.normalize("NFKC", m[0]) if new is None else new))
    return [(a, b, str(unicodedata.decimal(new)) if len(new) == 1 and new.isdecimal() else new) for a, b, new in out]


def _at_and_dot(text: str) -> list[tuple[int, int, str]]:
    mark = {"at": "@", "dot": "."}
    out = [(m.start(), m.end(), mark[next(g for g in m.groups() if g).lower()]) for m in _BRACKET.finditer(text)]
    if "dot" in (low := text.lower()) or "point" in low:
        for m in _ADDRESS.finditer(text):
            dots = [(*d.span(), ".") for d in _DOT.finditer(text, *m.span())]
            if not any(c in text[a:b] for a, b, _ in dots for c in "[({<"):
                # words alone: they end with the last label that is a common one, and need another word before "at" than prose has
                ends = [*(a for a, _, _ in dots[1:]), m.end()]
                last = max((k for k, d in enumerate(dots) if text[d[1] : ends[k]].rsplit(".", 1)[-1].lower() in _TOP_LEVEL), default=-1)
                dots = dots[: last + 1]
                if m["at"] and "@" not in m["at"] and m[0].split(None, 1)[0].lower() in _PROSE:
                    dots = []
            # "look at example.com" is prose: a worded or spaced at counts beside a disguised dot
            out += [*dots, *([(*m.span("at"), "@")] if m["at"] and dots else [])]
        out += [(*m.span(), ".") for m in _NUMERIC_DOT.finditer(text) if _NUMERIC_END.search(text[max(0, m.start() - 6) : m.start()])]
    out += [(*m.span(1), "@") for m in _SPACED.finditer(text)]
    kept: list[tuple[int, int, str]] = []
    for e in sorted(out):
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept


def _spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Digit words as digits, in runs of four numbers or more: no identifier has fewer. Words that follow each other become one number."""
    out = []
    for m in _SPELLED.finditer(text):
        parts = [(p.start(), p.end(), p[0].lower()) for p in _SPELLED_PART.finditer(text, *m.span())]
        words = sum(p in _DIGIT_WORDS for _, _, p in parts)
        if not words or words + len(_digits(m[0])) < 4 or (text[m.end() : m.end() + 1] == "@" and words < 7):
            continue
        for k, (a, b, p) in enumerate(parts):
            if p in _DIGIT_WORDS:
                out.append((a, b, _DIGIT_WORDS[p]))
            elif p.startswith("plus"):
                out.append((a, b, "+"))
            elif not p.isdigit() and not set(p) & set(".()"):
                sides = [parts[k + d][2] in _DIGIT_WORDS for d in (-1, 1)]
                if any(sides):
                    out.append((a, b, "" if all(sides) else " "))
    return out


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that show only after rewriting, in source characters; none lies within a base span of its kind."""
    low = text.lower()
    tape, changed = Tape(text), False
    worded = "dot" in low or "@" in text or any(b + "at" in low or b + " at" in low for b in "[({<")
    spelled = any(w in low for w in _DIGIT_WORDS)
    strange = _STRANGE.search(text)
    for wanted, rule in ((strange, _homoglyphs), (worded or strange, _at_and_dot), (spelled or strange, _spelled_digits)):
        if wanted and (edits := rule(tape.text)):
            tape, changed = tape.rewritten(edits), True
    if not changed:
        return []
    # base spans of one kind are disjoint and in order of start, as those found are: one sweep finds the containing ones
    held, at, out = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}, dict.fromkeys(KINDS, 0), []
    for kind, a, b in find(tape.text):
        own, a, b = held[kind], tape.start[a], tape.end[b - 1]
        while at[kind] < len(own) and own[at[kind]][0] <= a:
            at[kind] += 1
        if not at[kind] or own[at[kind] - 1][1] < b:
            out.append((kind, a, b))
    return out


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both by start, then kind."""
    base = find(text)
    more = disguised(text, base)
    return base, sorted({*base, *more}, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base


def redact(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans, one mark for their union."""
    out, at, k = [], 0, 0
    found = sorted(found, key=lambda s: (s[1], -s[2]))
    while k < len(found):
        kind, a, b = found[k]
        k += 1
        while k < len(found) and found[k][1] < b:
            b = max(b, found[k][2])
            k += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _map(docs: DataFrame, row, schema: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(t.as_py() or "") for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True))], ["doc_id", *(n for n, _ in schema)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ddl}")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and its spans: array of kind, start, end, and whether the text shows it undisguised."""

    def row(text: str) -> tuple:
        base, every = spans(text)
        plain = set(base)
        return ([{"kind": k, "start": a, "end": b, "base": (k, a, b) in plain} for k, a, b in every],)

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    return _map(docs, row, [("spans", pa.list_(span))], "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind; all other columns as they are, a null text stays null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and redact(t, spans(t)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _contract(text: str) -> tuple:
    base, every = spans(text)
    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
    return *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n_ columns count base spans; n_added counts those that deobfuscation adds."""
    schema = [*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
    ddl = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return _map(documents(spark, sf_dir), _contract, schema, ddl)
