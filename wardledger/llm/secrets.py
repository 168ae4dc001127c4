"""Secrets in texts: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer reads a text into name-literal pairs (``name = "literal"``, ``name: literal``, ``"name": 'literal'``,
``NAME=literal``), follows constants (a name on the right stands for the literals it was given before, also
through ``+`` and ``${name}``), and scores each literal by how sensitive the assigned name is and how much it
looks like a secret. The patterns' findings are always kept; the lexer adds to them.

Null and empty texts have no findings. Rows are independent of each other, so repeated rows repeat their
findings, an empty table gives an empty one, and columns other than the id and the text are not read, so their names
don't matter. Of names that are equally sensitive a literal goes to the first; findings at one place are ordered by
kind, then end. Texts are read whole, in time and memory linear in their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "literal")

# The patterns of the base findings.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TRIGGERS = ("password", "passwd", "secret", "token", "api")

# Sensitive parts of names and how much they say.
NAME_PARTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "auth": 0.6, "private": 0.5, "access": 0.4,
    "signing": 0.5, "encryption": 0.5, "api": 0.4, "client": 0.2, "key": 0.5, "salt": 0.5, "pin": 0.4,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "dummy", "sample", "your_", "xxxx", "todo", "none", "null", "true", "false")

_PAIR = re.compile(r"""(?<![\w$.-])["']?([A-Za-z_$][\w$.-]*)["']?[ \t]*(?::=|=>|=(?!=)|:(?![:/]))[ \t]*""")
_QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|' + r"'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
_BARE = re.compile(r"""[^\s,;"'`<>(){}\[\]]+""")
_NAME = re.compile(r"\$?\{?([A-Za-z_][\w.]*)\}?$")
_HOLE = re.compile(r"\$?\{([A-Za-z_][\w.]*)\}")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|&)[ \t]*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Literal(NamedTuple):
    value: str
    start: int
    end: int


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    name: str
    score: float


def pattern_findings(text: str) -> list[Finding]:
    """The base findings; places are code points, the end exclusive."""
    found = []
    lowered = text.lower()
    if any(x in lowered for x in TRIGGERS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                found.append(Finding("assign", *m.span(), m[1], 1.0))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 18:
                found.append(Finding("access", *m.span(), "", 1.0))
    for m in HEX.finditer(text):
        found.append(Finding("hex", *m.span(), "", 1.0))
    return found


def name_score(name: str) -> float:
    """How sensitive a name is, from the parts that case, underscores, dots and dashes separate."""
    parts = [p.lower() for p in _PART.findall(name)]
    score = max((NAME_PARTS.get(p, 0.0) for p in parts), default=0.0)
    both = sum(NAME_PARTS.get(p, 0.0) for p in parts)
    return min(1.0, max(score, both))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, entropy a character, mixed classes, no placeholder."""
    lowered = value.lower()
    if len(value) < 8 or any(c.isspace() for c in value) or any(p in lowered for p in PLACEHOLDERS):
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, len(value) / 16) * min(1.0, entropy / 3.0) * min(1.0, 0.5 + 0.25 * classes)


class Assignment(NamedTuple):
    """A name and the parts of its value: literals, and places of earlier assignments."""

    name: str
    parts: list[Literal | int]


def assignments(text: str) -> list[Assignment]:
    """Name-value pairs in order. A name on the right is its latest assignment, so parts point backwards only."""
    known: dict[str, int] = {}
    found: list[Assignment] = []
    for m in _PAIR.finditer(text):
        parts = _expression(text, m.end(), known)
        if parts:
            known[m[1]] = len(found)
            found.append(Assignment(m[1], parts))
    return found


def pairs(text: str) -> Iterator[tuple[str, list[Literal]]]:
    """Each name with the different literals that its value is made of, constants followed."""
    found = assignments(text)
    for i, assigned in enumerate(found):
        literals: dict[Literal, None] = {}
        open_, seen = [i], set()
        while open_:
            part = open_.pop()
            if isinstance(part, Literal):
                literals[part] = None
            elif part not in seen:
                seen.add(part)
                open_ += reversed(found[part].parts)
        yield assigned.name, list(literals)


def _expression(text: str, at: int, known: dict[str, int]) -> list[Literal | int]:
    parts: list[Literal | int] = []
    while True:
        if m := _QUOTED.match(text, at):
            group = m.lastindex
            parts += [known[h[1]] for h in _HOLE.finditer(m[group]) if h[1] in known]
            parts.append(Literal(m[group], *m.span(group)))
        elif m := _BARE.match(text, at):
            named = _NAME.match(m[0])
            parts.append(known[named[1]] if named and named[1] in known else Literal(m[0], *m.span()))
        else:
            return parts
        joined = _JOIN.match(text, m.end())
        if not joined:
            return parts
        at = joined.end()


def lexed_findings(text: str, threshold: float) -> list[Finding]:
    """Literals by the most sensitive name that they reach, the first of equally sensitive ones.

    Names are handed down from the last assignment to the first, so each part is looked at once, however often
    constants are built from one another.
    """
    if "=" not in text and ":" not in text:
        return []
    places = assignments(text)
    best = [(name_score(a.name), -i, a.name) for i, a in enumerate(places)]
    reached: dict[Literal, tuple[float, int, str]] = {}
    for i in range(len(places) - 1, -1, -1):
        for part in places[i].parts:
            if isinstance(part, Literal):
                reached[part] = max(best[i], reached.get(part, best[i]))
            else:
                best[part] = max(best[part], best[i])
    found = []
    for literal, (sensitive, _, name) in reached.items():
        score = sensitive * literal_score(literal.value) if sensitive else 0.0
        if score and score >= threshold:
            found.append(Finding("literal", literal.start, literal.end, name, score))
    return found


def findings(text: str | None, threshold: float = 0.5) -> list[Finding]:
    """All findings of a text by place, then kind."""
    if not text:
        return []
    found = pattern_findings(text) + lexed_findings(text, threshold)
    return sorted(found, key=lambda f: (f.start, KINDS.index(f.kind), f.end))


FINDINGS = "array<struct<kind:string,start:long,end:long,name:string,score:double>>"
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
)


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: its id and ``findings``, an array ordered by place and kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[f._asdict() for f in findings(t, threshold)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], ["id", "findings"])

    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("findings", T._parse_datatype_string(FINDINGS))])
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_column)


def span_list(findings_column, kinds: tuple[str, ...]):
    """``kind:start:end`` of the findings of these kinds, comma-joined in order."""
    chosen = F.filter(findings_column, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest of ``scan_secrets``: counts by kind, a hash of the base spans, and all spans."""
    found = F.col("findings")

    def count(kind):
        return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")

    return scan_secrets(docs).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_list(found, KINDS[:3]), 256).alias("base_sha256"),
        span_list(found, KINDS).alias("spans"),
        count("literal").alias("n_literal"),
    )
