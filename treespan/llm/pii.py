"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the result, the first four being the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
ORDER = {kind: i for i, kind in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive repeats and the look-behind keep the scans linear on long runs of digits. They change no match: a
# failure from the first digit of a run is a failure from each later one.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IBAN_LEAST = 15
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Score of a span without context, what a context word adds, and the least score of a span of the added kinds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_GAIN = 0.3
LEAST_SCORE = 0.5
#: Characters on either side of a span that are searched for context words.
REACH = 40
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|address|host|server", re.I),
    "card": re.compile(r"card|visa|credit|payment", re.I),
    "phone": re.compile(r"phone|tel\b|call|mobile|fax", re.I),
    "iban": re.compile(r"iban|bank|account", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        if i % 2:
            n *= 2
            if n > 9:
                n -= 9
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number without spaces leaves 1 modulo 97 with its first four characters moved last."""
    rest = 0
    for ch in iban[4:] + iban[:4]:
        n = int(ch, 36)
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


def _iban_end(said: str) -> int:
    """Where the longest account number that begins a match ends: at the match's end or at a space in it; 0 if none is right."""
    end = len(said)
    while end > 0:
        if _IBAN_LEAST <= len(code := said[:end].replace(" ", "")) <= 34 and mod97(code):
            return end
        end = said.rfind(" ", 0, end)
    return 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: from each @ back over what may stand before it, then forward over the host."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _candidates(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    at = 0
    while m := _IBAN.search(text, at):
        end = _iban_end(m[0])
        if end:
            yield "iban", m.start(), m.start() + end
        # without one, the next number may begin at a group that this match took
        at = m.start() + (end or 4)
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def find(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind. Base kinds always stay; added kinds need LEAST_SCORE."""
    found = []
    for kind, start, end in _candidates(text or ""):
        near = text[max(0, start - REACH) : start] + "\n" + text[end : end + REACH]
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * bool(CONTEXT[kind].search(near)))
        if ORDER[kind] < 4 or score >= LEAST_SCORE:
            found.append(Span(kind, start, end, score))
    return sorted(found, key=lambda s: (s.start, ORDER[s.kind]))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """Replaces spans by their kind in angle brackets; spans that overlap become one, named by the first."""
    if not spans:
        return text
    out, done, i = [], 0, 0
    while i < len(spans):
        kind, start, end, _ = spans[i]
        while i + 1 < len(spans) and spans[i + 1].start < end:
            i += 1
            end = max(end, spans[i].end)
        out += [text[done:start], f"<{kind.upper()}>"]
        done, i = end, i + 1
    return "".join([*out, text[done:]])


def detect(df: DataFrame, text_col: str = "text", spans_col: str = "pii_spans", redacted_col: str = "pii_redacted") -> DataFrame:
    """Adds the spans of each text, an array of (kind, start, end, score), and the text without them.

    Offsets count code points, the end exclusive. A null text has no spans and stays null. Rows are independent:
    repeated rows, ties and an empty table need no care. Columns called as the new ones are replaced.
    """
    kept = [c for c in df.columns if c not in (spans_col, redacted_col)]
    out = df.select(kept).withColumn(spans_col, F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")).withColumn(redacted_col, F.lit(None).cast("string")).schema
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = [find(t) for t in texts]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([[s._asdict() for s in row] for row in spans], kind), pa.array([redact(t, s) for t, s in zip(texts, spans)], pa.string())],
                names=[*kept, spans_col, redacted_col],
            )

    return df.select(kept).mapInArrow(run, out)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the base spans and the string of all spans, for each row."""
    found = detect(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text", "pii_redacted")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*KINDS[:4]))
    return found.select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in KINDS[:4]),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("pii_spans")).alias("spans"),
    )
