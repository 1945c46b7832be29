"""Secret scan: fixed patterns, and name-literal pairs lexed from assignments and scored by the names they go to."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches

KINDS = ("assign", "access", "hex", "literal")

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: A name, perhaps quoted, and an operator that binds it. Each run of name characters is tried once, from its start.
TARGET = re.compile(r"(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)[\"']?[ \t]*+(?::=|=>|=(?!=)|:(?![:/]))[ \t]*+", re.ASCII)
QUOTED = re.compile(r"(\"\"\"|\'\'\')(?:(?!\1)(?:[^\\]|\\.))*+\1|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`", re.DOTALL)
#: A word without quotes, up to the next operator that binds; `=` may pad its end.
BARE = re.compile(r"[A-Za-z0-9+/_.$~!@%^*-]+(?:={1,2}(?![A-Za-z0-9+/_.$~!@%^*='\"`-]))?", re.ASCII)
#: What opens values that follow a name, or a call: brackets, on the next line too; what parts them; and a quoted value on the next line.
OPENS, PARTS, NEXT_LINE = re.compile(r"[ \t]*+[(\[]\s*+"), re.compile(r"\s*+[,+]\s*+"), re.compile(r"\\?\r?\n[ \t]++(?=[\"'`])")
#: An element that holds a text alone.
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>\s*+(?P<text>[^<>]++)</", re.ASCII)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*", re.ASCII)
PLUS = re.compile(r"[ \t]*+\+[ \t]*+")
BINDS = re.compile(r"\s*+(?::|=(?!=))")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: What a target name's words weigh, alone or as neighbours; a literal is reported from MIN_SCORE on.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "pw": 3, "passphrase": 3, "passcode": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "auth": 2, "pass": 2, "bearer": 2, "salt": 2, "api key": 3, "access key": 3, "private key": 3, "secret key": 3, "signing key": 3, "encryption key": 3, "auth key": 3, "account key": 3, "client key": 2}
MIN_SCORE, MIN_LITERAL = 4.0, 8
KNOWN = {w for k in SENSITIVE for w in k.split()}
#: The last word of each entry, less those that hold another: a text without any of them has no sensitive name.
HINTS = {k.split()[-1] for k in SENSITIVE}
HINT = re.compile("|".join(sorted(w for w in HINTS if not any(o in w for o in HINTS - {w}))), re.ASCII | re.IGNORECASE)
PLACEHOLDER = re.compile(r"^(?:(.)\1*|[xX*.#-]+|change_?me.*|your[_-].*|example.*|placeholder.*|none|null|true|false|undefined|redacted|\$\{.*|\$\(.*|<.*|%\(.*|\{\{.*)$", re.IGNORECASE | re.DOTALL)


class Span(NamedTuple):
    """A finding: code points from start, end exclusive; the secret itself lies from value_start to value_end."""

    start: int
    kind: str
    end: int
    value_start: int
    value_end: int


def base_spans(text: str) -> list[Span]:
    """Findings of the fixed patterns, for each kind from the left and without overlap."""
    found = []
    if ":" in text or "=" in text:
        found += [Span(m.start(), "assign", m.end(), m.start(2), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 8]
    found += [Span(m.start(), "access", m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [Span(m.start(), "hex", m.end(), m.start(), m.end()) for m in HEX.finditer(text)]


class Pair(NamedTuple):
    """A name and what is bound to it: (start, end) of literals, or names as strings, in the order they are joined."""

    name: str
    parts: list


def _value(text: str, at: int, called: bool) -> tuple[tuple[int, int] | str | None, int]:
    """The literal or name at this place, and where it ends; None without one. An argument of a call that is written like a
    name, such as that of a variable of the environment, is no literal."""
    if q := QUOTED.match(text, at):
        mark = 3 if q[1] else 1
        start, end = q.start() + mark, q.end() - mark
        if q[1]:
            inner = text[start:end]
            start, end = end - len(inner.lstrip()), start + len(inner.rstrip())
        return ((start, end) if not (called and NAME.fullmatch(text, start, end)) else ""), q.end()
    if b := BARE.match(text, at):
        word = b.group().rstrip(".")
        n = NAME.match(text, at)
        return (word if n and n.group() == word else (at, at + len(word))), at + len(word)
    return None, at


def assignments(text: str) -> Iterator[Pair]:
    """Name-value pairs of source, configuration and markup: name = "x", name: x, "name": 'x', name := x, name => x + "y",
    name = ["x", "y"], name = call("x"), name = \"\"\"x\"\"\", a quoted value on the line after its name, and <name>x</name>.

    A value ends where the next operator binds, so that what is read for one name is read for no other but its neighbour.
    """
    for m in TARGET.finditer(text):
        at, parts, listed, called = m.end(), [], False, False
        if o := OPENS.match(text, at):
            at, listed = o.end(), True
        elif o := NEXT_LINE.match(text, at):
            at = o.end()
        while True:
            part, end = _value(text, at, called)
            if part is None:
                break
            at = end
            if isinstance(part, str) and part and not called and (o := OPENS.match(text, at)) and text[o.start() : o.end()].strip() == "(":
                at, listed, called = o.end(), True, True
                continue
            if listed and (BINDS.match(text, at)):  # a key of a dictionary, or an argument's name: it binds for itself
                break
            if part:
                parts.append(part)
            if not (p := (PARTS if listed else PLUS).match(text, at)):
                break
            at = p.end()
        if parts:
            yield Pair(m["name"], parts)
    for m in ELEMENT.finditer(text):
        yield Pair(m["name"], [(m.start("text"), m.start("text") + len(m["text"].rstrip()))])


def sensitivity(name: str) -> float:
    """Weight of a target name, by its words: camel case, underscores, dots and hyphens part them, and a plural counts as one."""
    words = [w if w in KNOWN else w.removesuffix("s") for w in map(str.lower, WORDS.findall(name))]
    weights = [SENSITIVE.get(w, 0) for w in words] + [SENSITIVE.get(f"{a} {b}", 0) for a, b in zip(words, words[1:])]
    return max(weights, default=0)


def strength(literal: str) -> float:
    """0 for what cannot be a secret (short, placeholder, a sentence), else up to 3 with length, mixed kinds of character and entropy."""
    if len(literal) < MIN_LITERAL or PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    n = len(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    return min(1.0, (kinds - 1) / 2) + min(1.0, entropy / 3.5) + min(1.0, n / 16)


def literal_spans(text: str) -> list[Span]:
    """Literals bound to sensitive names, directly or through other names and concatenation.

    A bare word that is itself a name is that name's value if the text binds it, else a literal of its own.
    """
    if not ("=" in text or ":" in text or "</" in text) or not HINT.search(text):
        return []
    pairs = list(assignments(text))
    wanted = [(sensitivity(p.name), p) for p in pairs]
    if not any(w for w, _ in wanted):
        return []
    bound: dict[str, list] = {}
    for p in pairs:
        bound.setdefault(p.name, []).extend(p.parts)
    found: dict[tuple[int, int], float] = {}
    seen: set[str] = set()
    # by falling weight, so that a name or literal met before has had no less
    for weight, pair in sorted(wanted, key=lambda w: -w[0]):
        if not weight:
            break
        parts = pair.parts
        while parts:
            for part in parts:
                if not isinstance(part, str):
                    found.setdefault(part, weight)
            nexts = dict.fromkeys(x for x in parts if isinstance(x, str) and x not in seen and x in bound)
            seen.update(nexts)
            parts = [x for n in nexts for x in bound[n]]
    scores = {(a, b): (weight, strength(text[a:b])) for (a, b), weight in found.items()}
    return [Span(a, "literal", b, a, b) for (a, b), (weight, s) in scores.items() if s and weight + s >= MIN_SCORE]


def spans(text: str | None) -> list[Span]:
    """All findings by start, then kind as listed. Literals inside a finding of a fixed pattern add nothing."""
    if not text:
        return []
    base = base_spans(text)
    more, reach, held = [], 0, sorted(base, reverse=True)
    for s in sorted(literal_spans(text)):
        while held and held[-1].start <= s.start:  # reach: the furthest end of the base spans that start no later
            reach = max(reach, held.pop().end)
        if s.end > reach:
            more.append(s)
    return sorted(base + more, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def _listed(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): counts by kind, SHA-256 of the listed base findings, and all findings listed.

    A null text is empty and has no findings; a null doc_id stays null; repeated rows are reported each; whole texts are read.
    """
    small_batches(docs.sparkSession)

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t.as_py()) for t in batch.column(1)]
            counts = [Counter(s.kind for s in f) for f in found]
            base = [_listed([s for s in f if s.kind != "literal"]) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array([_listed(f) for f in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(reported, REPORT)


def redacted(text: str | None, mark: str = "<secret>") -> str | None:
    """text with each secret value replaced by mark; overlapping values by one."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for start, end in sorted((s.value_start, s.value_end) for s in found):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with secret values replaced in text, and n_chars, if there, counted anew where text changed. All rows and columns stay."""
    small_batches(docs.sparkSession)
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, old = list(batch.columns), batch.column(text_at).to_pylist()
            new = [redacted(t, mark) for t in old]
            columns[text_at] = pa.array(new, batch.schema.field(text_at).type)
            if chars_at is not None:
                kept = columns[chars_at].to_pylist()
                columns[chars_at] = pa.array([k if a is b or a == b else len(b) for k, a, b in zip(kept, old, new)], batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(cleaned, docs.schema)
