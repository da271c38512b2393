"""Secret scans by assignment-aware lexing.

Around every assignment sign a text is read as source or configuration: a name on the left (plain, dotted,
subscripted or a quoted key), an expression of literals and names on the right. Literals given to a name
are remembered, so a constant, a concatenation or an interpolated name leads back to the literals that
make up its value. A literal is reported if the name it finally reaches is a sensitive one and the literal
does not look like a placeholder. Three plain patterns are always reported beside that.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.llm.common import id_text, slices, text_of

# The plain patterns, their least lengths, and the order of kinds at one start.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so this is a run of 24 or more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "named")

# How much a part of a name says that its value is secret, and parts that speak against it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.6, "pin": 0.5,
}
KEY_KINDS = {"api", "access", "private", "secret", "auth", "encryption", "signing", "master", "client", "account"}
HARMLESS = {"name", "id", "url", "uri", "path", "file", "type", "length", "count", "max", "min", "field", "label", "hint", "policy", "expiry", "ttl"}
MARK = re.compile(r"example|change_?me|your[_-]|placeholder|dummy|sample|redacted|xxx|\*\*\*|<|\.\.\.", re.I)
MARK_LONGEST = len("placeholder")
NOTHING = re.compile(r"null|none|true|false|undefined|todo", re.I)  # a placeholder only as the whole value
LEAST_SCORE = 0.5

SIGN = re.compile(r"(?<![=!<>:+\-*/%&|^~])(?::=|=>|=|:)(?!=|:|//)")
# The name before a sign, read backwards: blanks, a type after a colon, then a quoted or a plain name.
TARGET = re.compile(r"""[ \t]*(?:[\w.\[\]]*[A-Za-z_][ \t]*:[ \t]*)?(?:\]?(["'])([\w.\- ]*[A-Za-z_])\1|([\w.\-$]*[A-Za-z_$]))""", re.A)
OPERAND = re.compile(r"""[ \t]*(?:[rbuf]{0,2}(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)|([^\s"'`,;#(){}\[\]+]+))""", re.A | re.I)
JOIN = re.compile(r"[ \t]*(?:\+\s*|\.\.|\\\n|(?=[\"']))", re.A)
JOIN_INSIDE = re.compile(r"\s*(?:[+,]\s*|\.\.\s*|\\\n\s*|(?=[\"'`]))", re.A)  # between brackets
BLANKS, SPACES = re.compile(r"[ \t]*"), re.compile(r"\s*", re.A)
KEYED = re.compile(r"\s*(?::|=>)", re.A)  # a key in braces has its own sign
CLOSING = {"(": ")", "[": "]", "{": "}"}
NAME = re.compile(r"[A-Za-z_$][\w.$]*", re.A)
INSERT = re.compile(r"\$\{([A-Za-z_][\w.]*)\}|\{([A-Za-z_][\w.]*)\}|\$([A-Za-z_]\w*)", re.A)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the plain patterns, in code points."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    """How likely a value under this name is secret, 0 to 1, from the name's parts."""
    parts = [p.lower() for p in PART.findall(name)]
    score = max([SENSITIVE.get(p, 0.0) for p in parts], default=0.0)
    for kind, key in zip(parts, parts[1:]):
        if key in ("key", "keys") and kind in KEY_KINDS:
            score = 1.0
    return score * 0.4 if parts and parts[-1] in HARMLESS else score


def _looks_secret(length: int, counts: dict[str, int]) -> float:
    bits = -sum(n / length * math.log2(n / length) for n in counts.values())
    signs = "".join(counts)
    kinds = sum(bool(re.search(k, signs)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.25 * kinds + bits / 8)


def literal_score(literal: str) -> float:
    """How much a literal looks like a secret, 0 to 1: length, variety, and no placeholder."""
    if len(literal) < 6 or MARK.search(literal) or NOTHING.fullmatch(literal) or " " in literal.strip():
        return 0.0
    return _looks_secret(len(literal), Counter(literal))


class Joined:
    """What :func:`literal_score` needs of a value put together from pieces, without the value itself."""

    __slots__ = ("length", "counts", "head", "tail", "marked", "solid", "lead", "inner", "trail")

    def __init__(self, piece: str = ""):
        core = piece.strip()
        self.length, self.counts = len(piece), Counter(piece)
        self.head, self.tail = piece[:MARK_LONGEST], piece[-MARK_LONGEST:]
        self.marked, self.solid, self.inner = bool(MARK.search(piece)), bool(core), " " in core
        before, after = (piece[: len(piece) - len(piece.lstrip())], piece[len(piece.rstrip()) :])
        self.lead, self.trail = " " in before, " " in after

    def add(self, other: "Joined") -> None:
        self.marked = self.marked or other.marked or bool(MARK.search(self.tail + other.head))
        self.inner = self.inner or other.inner or self.solid and other.solid and (self.trail or other.lead)
        self.lead = self.lead or not self.solid and other.lead
        self.trail = other.trail or not other.solid and self.trail
        self.solid = self.solid or other.solid
        self.length += other.length
        for sign, n in other.counts.items():
            self.counts[sign] = self.counts.get(sign, 0) + n
        if len(self.head) < MARK_LONGEST:
            self.head = (self.head + other.head)[:MARK_LONGEST]
        self.tail = (self.tail + other.tail)[-MARK_LONGEST:]

    def score(self) -> float:
        if self.length < 6 or self.marked or self.inner or self.length <= len(self.head) and NOTHING.fullmatch(self.head):
            return 0.0
        return _looks_secret(self.length, self.counts)


def _expression(text: str, at: int) -> list[tuple[int, int, str]]:
    """The parts of the expression at ``at`` in order: spans that are a ``literal``, or a ``first`` or later ``word``."""
    parts, brackets = [], []
    at = BLANKS.match(text, at).end()
    while True:
        while text[at : at + 1] in CLOSING:
            brackets.append(text[at])
            at = SPACES.match(text, at + 1).end()
        m = OPERAND.match(text, at)
        if not m or brackets[-1:] == ["{"] and KEYED.match(text, m.end()):
            return parts
        group = next((g for g in (1, 2, 3, 4) if m[g] is not None), 4)
        parts.append((*m.span(group), "literal" if group != 4 else "word" if parts else "first"))
        at = m.end()
        while brackets and text.startswith(CLOSING[brackets[-1]], (end := SPACES.match(text, at).end())):
            brackets.pop()
            at = end + 1
        glue = (JOIN_INSIDE if brackets else JOIN).match(text, at)
        if not glue:
            return parts
        at = glue.end()


def _assignments(text: str) -> list[tuple[int, str, list]]:
    """Place, name and parts of every assignment, in order."""
    found, backwards = [], text[::-1]
    for sign in SIGN.finditer(text):
        target = TARGET.match(backwards, len(text) - sign.start())
        if target and (parts := _expression(text, sign.end())):
            found.append((sign.start(), (target[2] or target[3])[::-1], parts))
    return found


class _Values:
    """The assignments of a text as a graph: each holds its own pieces and leads to the assignments it names.

    A name stands for its last assignment before, or else its first one after. Every assignment is read and
    put together once, whatever leads to it; one that is met again while it is being put together adds nothing.
    """

    def __init__(self, text: str):
        self.text, self.given = text, _assignments(text)
        self.named: dict[str, list[int]] = {}
        for k, (_, name, _) in enumerate(self.given):
            self.named.setdefault(name, []).append(k)
        self.items: dict[int, list] = {}
        self.bare: set[int] = set()

    def _meant(self, name: str, by: int) -> int | None:
        its = self.named.get(name, [])
        at = bisect_left(its, by)
        if at:
            return its[at - 1]
        return next((x for x in its if x != by), None)

    def read(self, k: int) -> list:
        """Pieces ``(start, end, text)`` and numbers of other assignments, in the order of the expression."""
        if k in self.items:
            return self.items[k]
        items: list = []
        for start, end, kind in self.given[k][2]:
            raw = self.text[start:end]
            if kind == "literal":
                items.append((start, end, INSERT.sub("", raw)))  # a name put in counts by its own literal
                names = [i[1] or i[2] or i[3] for i in INSERT.finditer(raw)]
            else:
                names = [raw] if NAME.fullmatch(raw) and self._meant(raw, k) is not None else []
                if not names and kind == "first":
                    items.append((start, end, INSERT.sub("", raw)))
                    if raw.isalpha():
                        self.bare.add(k)
            items += [other for name in names if (other := self._meant(name, k)) is not None]
        self.items[k] = items
        return items

    def scores(self, wanted: dict[int, float]) -> dict[int, float]:
        """Score of the whole value of each wanted assignment; a value goes when all that lead to it have used it."""
        uses = Counter(i for k in self.reached(wanted) for i in self.read(k) if isinstance(i, int))
        joined: dict[int, Joined] = {}
        begun, done, scores = set(), set(), {}
        for k in wanted:
            todo = [k]
            while todo:
                at = todo[-1]
                if at in done:
                    todo.pop()
                    continue
                if at not in begun:
                    begun.add(at)
                    if more := [i for i in self.read(at) if isinstance(i, int) and i not in begun]:
                        todo += reversed(more)
                        continue
                whole = Joined()
                for item in self.read(at):
                    if not isinstance(item, int):
                        whole.add(Joined(item[2]))
                    elif item in joined:
                        whole.add(joined[item])
                        uses[item] -= 1
                        if not uses[item]:
                            del joined[item]
                if uses[at]:
                    joined[at] = whole
                if at in wanted:
                    scores[at] = whole.score()
                done.add(at)
                todo.pop()
        return scores

    def reached(self, amounts: dict[int, float]) -> dict[int, float]:
        """For each assignment the largest amount of those that lead to it, itself included."""
        most: dict[int, float] = {}
        for k, amount in sorted(amounts.items(), key=lambda x: -x[1]):
            todo = [k]
            while todo:
                at = todo.pop()
                if at not in most:
                    most[at] = amount
                    todo += [i for i in self.read(at) if isinstance(i, int)]
        return most


def named_spans(text: str) -> list[tuple[int, int, float]]:
    """Start, end and score of literals that reach a sensitive name."""
    if "=" not in text and ":" not in text:
        return []
    values = _Values(text)
    weights: dict[int, float] = {}
    for k, (_, name, _) in enumerate(values.given):
        if weight := name_score(name):
            values.read(k)
            # a bare word is prose or a reference sooner than a secret
            weights[k] = weight * 0.4 if k in values.bare else weight
    wholes = values.reached({k: weights[k] * score for k, score in values.scores(weights).items()})
    found: dict[tuple[int, int], float] = {}
    for k, weight in values.reached(weights).items():
        for item in values.read(k):
            if isinstance(item, int):
                continue
            start, end, piece = item
            score = max(weight * literal_score(piece), wholes[k] if len(piece) > 2 else 0.0)
            if score >= LEAST_SCORE:
                found[start, end] = max(score, found.get((start, end), 0.0))
    return [(start, end, score) for (start, end), score in found.items()]


def spans_of(text: str) -> list[dict]:
    """All spans by start, then kind; a literal that a plain pattern covers is not reported again."""
    base = sorted(base_spans(text))
    starts, upto = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    out = [{"kind": kind, "start": start, "end": end, "score": 1.0} for start, end, kind in base]
    for start, end, score in named_spans(text):
        before = bisect_left(starts, end)
        if not before or upto[before - 1] <= start:
            out.append({"kind": "named", "start": start, "end": end, "score": score})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def _scan(batches):
    for batch in slices(batches, 1024):
        out = batch.drop(columns="text")
        out["spans"] = [spans_of(t) for t in batch["text"]]
        yield out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_key, spans`` (an array of ``kind, start, end, score``).

    Offsets are code points, the end excluded; kinds are assign, access, hex and named. Null and empty texts
    have no spans. Repeated rows get a row each, ids are passed on as they are, null too. Other columns are
    not read. Names are resolved after the whole text has been read.
    """
    id_type = docs.schema[id_col].dataType
    texts = docs.select(id_text(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    kind = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    found = texts.mapInPandas(_scan, f"doc_id string, text_key bigint, spans {kind}")
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
