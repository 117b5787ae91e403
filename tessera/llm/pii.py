"""Personal data with offset-preserving deobfuscation.

Base identifiers are found by patterns in the text as it stands.  Where a text holds signs of disguise, a chain of
transducers rewrites it - homoglyphs and full-width forms to ASCII, invisible characters dropped, spelled digits to
digits, at/dot disguises to @ and . - keeping for every output character the source span it stands for.  The same
patterns then run over the rewritten text, and their spans map back to source characters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import release

#: rows of a batch that are Python strings at a time
ROWS = 512
KINDS = ("email", "ip", "card", "phone")
# Runs are entered at their first character only, and never given back, so long runs are read once: a match that begins
# later in a run, or ends earlier, would need the same character behind the run.
EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-]){EMAIL_HERE.pattern}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Characters that look like ASCII ones, and the words for digits and signs in four languages.
HOMOGLYPHS = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁһӏ", "ABESIJKMHOPCTXYaesijopcxydhl", strict=True)) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναι", "ABEZHIKMNOPTYXovai", strict=True)) | {"․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "–": "-", "﹫": "@", " ": " "}
HOMOGLYPHS |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
INVISIBLE = set("​‌‍⁠﻿­")
DIGITS = {
    "zero one two three four five six seven eight nine": "0123456789",
    "null eins zwei drei vier fünf sechs sieben acht neun": "0123456789",
    "zéro un deux trois quatre cinq six sept huit neuf": "0123456789",
    "cero uno dos tres cuatro cinco seis siete ocho nueve": "0123456789",
    "oh o ein": "001",
}
DIGIT = {word: d for words, ds in DIGITS.items() for word, d in zip(words.split(), ds, strict=True)}
PLUS = {"plus", "más", "mas"}
DOTS = {"dot", "punkt", "point", "punto"}
ATS = {"at", "arobase", "arroba", "chez", "klammeraffe"}

_SIGNS = re.compile("[" + "".join(re.escape(c) for c in [*HOMOGLYPHS, *INVISIBLE]) + "]")
_WORD = "|".join(sorted(map(re.escape, DIGIT), key=len, reverse=True))
_FIRST = "0-9" + "".join(sorted({w[0] + w[0].upper() for w in {*DIGIT, *PLUS}}))
_SPELLED = re.compile(rf"(?=[{_FIRST}])(?<!\w)(?:(?:{'|'.join(PLUS)})[\s-]+)?(?:(?:(?:{_WORD})(?!\w)|[0-9])(?:[\s-]+(?:{'|'.join(DOTS)})[\s-]+|[\s,-]*)){{7,}}", re.I)
_SPELLED_TOKEN = re.compile(rf"(?P<plus>{'|'.join(PLUS)})|(?P<dot>{'|'.join(DOTS)})|(?P<digit>{_WORD}|[0-9])", re.I)
_AT = rf"(?:(?<!\s)\s*[(\[{{<]\s*(?:{'|'.join(ATS)}|@)\s*[)\]}}>]\s*|(?<!\s)\s+(?:{'|'.join(ATS)})\s+|(?<!\s)\s*@\s*|_at_)"
_DOT = rf"(?:(?<!\s)\s*[(\[{{<]\s*(?:{'|'.join(DOTS)}|\.)\s*[)\]}}>]\s*|(?<!\s)\s+(?:{'|'.join(DOTS)})\s+|_dot_|\.)"
_TOD = rf"(?:(?<!\s)\s*[)\]}}>]\s*(?:{'|'.join(d[::-1] for d in DOTS)}|\.)\s*[(\[{{<]\s*|(?<!\s)\s+(?:{'|'.join(d[::-1] for d in DOTS)})\s+|_tod_|\.)"
#: what may follow an at sign, and what may stand before it, read backwards
_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_LACOL = re.compile(rf"[A-Za-z0-9_%+-]+?(?:{_TOD}[A-Za-z0-9_%+-]+?)*(?![A-Za-z0-9._%+-])", re.I)
_DOT_RE, _AT_RE = re.compile(_DOT, re.I), re.compile(_AT, re.I)
_PART = rf"(?:[0-9]+|(?:{_WORD})(?:[\s-]+(?:{_WORD}))*)"
_DOTTED = re.compile(rf"(?=[{_FIRST}])(?<!\w){_PART}(?:{_DOT}{_PART}){{3}}(?!\w)", re.I)
_DOTTED_TOKEN = re.compile(rf"(?P<dot>{_DOT})|(?P<digit>{_WORD}|[0-9])", re.I)
#: every form of _AT and _DOT but the plain signs and "at" between words, which alone rewrite nothing
_FORMS = re.compile(rf"(?=[\s@_(\[{{<])(?:\s@|@\s|_(?:at|dot)_|[(\[{{<]\s*(?:{'|'.join(ATS | DOTS)}|@|\.)\s*[)\]}}>]|\s(?:{'|'.join(DOTS)})\s)", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[re.Match]:
    at = 0
    while m := EMAIL_HERE.match(text, at) or EMAIL.search(text, at):  # the next may begin where the last one ends
        yield m
        at = m.end()


def find(text: str) -> list[tuple[str, int, int]]:
    """Base spans, by kind as listed, then start."""
    found = [("email", *m.span()) for m in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


class Tape:
    """A rewritten text whose every character keeps the source span [start, end) it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ascending, disjoint spans; each new character stands for the whole span it replaces."""
        if not edits:
            return
        out, starts, ends, at = [], [], [], 0
        for i, j, new in edits:
            out += [self.text[at:i], new]
            starts += self.starts[at:i] + [self.starts[i]] * len(new)
            ends += self.ends[at:i] + [self.ends[j - 1]] * len(new)
            at = j
        self.text = "".join(out) + self.text[at:]
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def _look_alikes(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), "" if m[0] in INVISIBLE else HOMOGLYPHS[m[0]]) for m in _SIGNS.finditer(tape.text)])


def _spelled_digits(tape: Tape) -> None:
    edits = []
    for m in _SPELLED.finditer(tape.text):
        if not any(c.isalpha() for c in m[0]):
            continue
        at = None
        for t in _SPELLED_TOKEN.finditer(tape.text, m.start(), m.end()):
            new = "+" if t["plus"] else "." if t["dot"] else t["digit"] if t["digit"].isdigit() else DIGIT[t["digit"].lower()]
            edits.append((t.start() if at is None else at, t.end(), new))
            at = t.end()
    tape.rewrite(edits)


def _dotted_digits(tape: Tape) -> None:
    """Four-part addresses of any length with a disguised dot."""
    edits = []
    for m in _DOTTED.finditer(tape.text):
        at, new = None, []
        for t in _DOTTED_TOKEN.finditer(tape.text, m.start(), m.end()):
            new.append((t.start() if at is None else at, t.end(), "." if t["dot"] else t["digit"] if t["digit"].isdigit() else DIGIT[t["digit"].lower()], t["dot"]))
            at = t.end()
        if any(dot not in (None, ".") for *_, dot in new):
            edits += [x[:3] for x in new]
    tape.rewrite(edits)


def _addresses(tape: Tape) -> None:
    """Every at sign or disguise of one, with the domain behind it and the local part before it, read backwards."""
    text, edits, done = tape.text, [], 0
    backwards = None
    for m in _AT_RE.finditer(text):
        at, end = m.span()
        domain = _DOMAIN.match(text, end) if at >= done else None
        if not domain:
            continue
        plain = text[at:end].strip().isalpha()
        dots = [d for d in _DOT_RE.finditer(text, end, domain.end()) if d[0] != "."]
        if plain and not dots:
            continue  # "at" between words is prose unless a dot is disguised too
        backwards = text[::-1] if backwards is None else backwards
        local = _LACOL.match(backwards, len(text) - at, len(text) - done)
        if not local:
            continue
        dots = [d for d in _DOT_RE.finditer(text, len(text) - local.end(), at) if d[0] != "."] + dots
        edits += sorted([(d.start(), d.end(), ".") for d in dots] + ([(at, end, "@")] if text[at:end] != "@" else []))
        done = domain.end()
    tape.rewrite(edits)


def _disguised(text: str) -> bool:
    """Whether a transducer could rewrite anything: true wherever one does."""
    return any(sign.search(text) for sign in (_SIGNS, _FORMS, _SPELLED))


def find_all(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans); a span that the method adds lies in no base span of its kind."""
    if not text:
        return [], []
    base = find(text)
    if not _disguised(text):
        return base, base
    tape = Tape(text)
    for step in (_look_alikes, _spelled_digits, _dotted_digits, _addresses):
        step(tape)
    if tape.text == text:
        return base, base
    added = []
    for kind, i, j in find(tape.text):
        start, end = tape.starts[i], tape.ends[j - 1]
        if not any(k == kind and s <= start and end <= e for k, s, e in base):
            added.append((kind, start, end))
    return base, sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            cut = batch.slice(low, ROWS)
            found = [find_all(t) for t in cut.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [cut.column(0), *(pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS),
                 pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]), pa.array([_joined(spans) for _, spans in found])],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )


def identifiers(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base patterns; spans lists all, the method's included, as kind:start:end in code
    points.  Null and empty texts have none; rows are independent, so repeated rows repeat; other columns are ignored.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_report, schema)


def mask(text: str | None) -> str | None:
    spans = sorted((s, e, k) for k, s, e in find_all(text)[1])
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every identifier, disguised ones included, replaced by its kind in angle brackets; n_chars follows."""
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                cut = batch.slice(low, ROWS)
                texts = [mask(t) for t in cut.column(at).to_pylist()]
                columns = list(cut.columns)
                columns[at] = pa.array(texts, cut.schema[at].type)
                if chars is not None:
                    columns[chars] = pa.array([None if t is None else len(t) for t in texts], cut.schema[chars].type)
                yield pa.RecordBatch.from_arrays(columns, schema=cut.schema)
        release()

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    from tessera.llm.workspace import table

    return identifiers(table(spark, sf_dir, "documents"))
