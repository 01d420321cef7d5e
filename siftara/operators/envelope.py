"""Checks of a loop envelope: a root tag with phases in order, numbered points in their phases, and edit blocks in one of them.

Every line becomes an event first, in the phase and block that it stands in; each rule is then a look at the events.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: The root tag (a parameter of the checks), and fixed values: the phases in order with their points, the phase of the edit blocks, and a line that only fills.
ROOT = "loop"
PHASES = {"orient": (1, 10), "plan": (11, 20), "patch": (21, 30), "validate": (31, 40), "deliver": (41, 50)}
EDITS, FILL = "patch", "…"
#: Names of the rules.
RULES = (
    "entrada", "quebra-de-linha", "think-no-envelope", "think-nao-fechado", "envelope", "fora-do-envelope", "fase-fora-do-envelope", "fase-nao-fechada", "tag-sem-par", "fase-ausente", "fase-repetida", "fase-vazia", "fase-fora-de-ordem",
    "ponto-malformado", "ponto-sem-fase", "ponto-fora-da-fase", "ponto-repetido", "ponto-ausente", "ponto-fora-de-ordem", "patch-marcador", "patch-bloco", "patch-search-vazio", "patch-sem-bloco", "patch-fora-do-patch", "patch-no-think", "texto-livre",
)

_POINT = re.compile(r"\[(?:Ponto|Point) ([1-9]\d?): [^\[\]\s](?:[^\[\]]*[^\[\]\s])?\](?: \S.*)?", re.A)
_LIKE_POINT = re.compile(r"(?:\d+[.)])?[^\w\[\]]*_*[^\w\[\]]*\[(?:ponto|point)\b", re.I)
_MARK = re.compile(r"([ \t]*)(?:(<+)([ \t]*)SEARCH|(>+)([ \t]*)REPLACE|(={4,7}))[ \t]*")
_OTHER_BREAKS = frozenset("\r\x0b\x0c\x1c\x1d\x1e\x85  ")
_KINDS = {1: "search", 3: "replace", 5: "divider"}


class Event(NamedTuple):
    line: int
    kind: str  # open, close, point, like_point, mark, fill, think, text, inside
    name: str  # tag, number of a point, or kind of a mark
    phase: str | None
    exact: bool = True  # of a mark: four signs, one blank, no indent
    usable: bool = True  # of a mark: what an edit tool takes for one


@dataclass(frozen=True)
class Mark:
    kind: str
    exact: bool
    usable: bool


def mark_of(line: str) -> Mark | None:
    m = _MARK.fullmatch(line)
    if not m:
        return None
    at = next(k for k in (2, 4, 6) if m[k])
    plain = not m[1] and (at == 6 or m[at + 1] == " ")
    return Mark(_KINDS[at - 1], plain and len(m[at]) == 4, plain and 4 <= len(m[at]) <= 7)


def _seen(text: str) -> str:
    """Without blanks and invisible signs, width and case."""
    return "".join(c for c in unicodedata.normalize("NFKC", text) if not c.isspace() and unicodedata.category(c) != "Cf").casefold()


class Envelope:
    """The events of a text, and the problems they show."""

    def __init__(self, text: str, root: str = ROOT, phases: dict[str, tuple[int, int]] = PHASES):
        self.root, self.phases = root, phases
        self.problems: list[str] = []
        self.events: list[Event] = []
        self._tag = re.compile(rf"<(/?)({'|'.join(map(re.escape, [root, *phases]))})>")
        self._think = re.compile(r"</?think(?:ing)?>")
        self.thinking = False
        self.blocks = 0
        self._read(text.removeprefix("﻿").split("\n"))

    def _read(self, lines: Iterable[str]) -> None:
        phase, opened, closed, block, search = None, False, False, None, []
        for at, raw in enumerate(lines, 1):
            raw = raw.removesuffix("\r")
            if block:
                block, search = self._inside(at, raw, phase, block, search)
                continue
            seen = _seen(raw)
            if not seen:
                continue
            line = raw.rstrip()
            if _OTHER_BREAKS & set(line):
                self.problems.append("quebra-de-linha")
            within = opened and not closed
            if within and self._think.search(seen):
                self.problems.append("think-no-envelope")
                if self._think.fullmatch(seen):
                    self.thinking = not seen.startswith("</")
                    continue
            tag = self._tag.fullmatch(line)
            if tag:
                kind, name = ("close" if tag[1] else "open"), tag[2]
                self.events.append(Event(at, kind, name, phase))
                if name == self.root:
                    phase = None if kind == "close" and within else phase
                    opened, closed = opened or kind == "open", closed or (kind == "close" and opened)
                else:
                    phase = name if kind == "open" else None if phase == name else phase
                continue
            mark = mark_of(raw)
            if not within:
                kind, name = "outside", ""
            elif line == FILL:
                kind, name = "fill", ""
            elif mark and (phase == EDITS and not self.thinking or mark.kind != "divider"):
                kind, name = "mark", mark.kind
                if phase == EDITS and not self.thinking and mark.exact and mark.kind == "search":
                    block, search = (at, "search"), []
            elif point := _POINT.fullmatch(line):
                kind, name = "point", point[1]
            else:
                kind, name = ("like_point" if _LIKE_POINT.match(line) else "text"), ""
            thought = self.thinking and kind == "mark"
            self.events.append(Event(at, kind, name, "" if thought else phase, mark.exact if mark else True, mark.usable if mark else True))
        if block:
            self.problems.append("patch-bloco")
        self.left = phase
        self.unfinished = block is not None

    def _inside(self, at: int, raw: str, phase: str | None, block: tuple[int, str], search: list[str]) -> tuple[tuple[int, str] | None, list[str]]:
        """A line of an edit block; an indented divider is content."""
        if _seen(raw):
            self.events.append(Event(at, "inside", "", phase))
        mark = mark_of(raw)
        if mark and not (mark.kind == "divider" and not mark.usable):
            if not mark.exact:
                self.problems.append("patch-marcador")
            step = (block[1], mark.kind) if mark.usable else None
            if step == ("search", "divider"):
                if not any(map(_seen, search)):
                    self.problems.append("patch-search-vazio")
                return (block[0], "replace"), search
            if step == ("search", "replace"):
                self.problems.append("patch-bloco")
                return None, search
            if step == ("replace", "replace"):
                self.blocks += 1
                return None, search
        return block, [*search, raw] if block[1] == "search" else search

    def _tags(self) -> Iterator[str]:
        roots = [e.kind for e in self.events if e.name == self.root and e.kind in ("open", "close")]
        first = roots.index("open") if "open" in roots else len(roots)
        yield from ["envelope"] * (roots[:first].count("close") + max(0, roots.count("open") - 1) + max(0, roots[first:].count("close") - 1))
        if "open" not in roots or "close" not in roots[first:]:
            yield "envelope"
        phase, within, over = None, False, False
        for e in self.events:
            if e.kind not in ("open", "close"):
                continue
            if e.name == self.root:
                if e.kind == "close" and within and not over:
                    yield from ["fase-nao-fechada"] * (phase is not None)
                    phase, over = None, True
                within = within or e.kind == "open"
            elif e.kind == "open":
                yield from ["fase-nao-fechada"] * (phase is not None)
                phase = e.name
            elif phase == e.name:
                phase = None
            else:
                yield "tag-sem-par"
        yield from ["fase-nao-fechada"] * (phase is not None)

    def _phases(self) -> Iterator[str]:
        within = False
        order: list[str] = []
        stray = False
        for e in self.events:
            if e.name == self.root and e.kind in ("open", "close"):
                within = e.kind == "open" or within and e.kind != "close"
            elif e.kind == "open":
                order.append(e.name)
                stray = stray or not within
        if stray:
            yield "fase-fora-do-envelope"
        times = Counter(order)
        filled = {e.phase for e in self.events if e.kind in ("point", "inside") or (e.kind == "mark" and e.phase == EDITS)}
        for name in self.phases:
            if not times[name]:
                yield "fase-ausente"
            elif times[name] > 1:
                yield "fase-repetida"
            elif name not in filled:
                yield "fase-vazia"
        found = list(dict.fromkeys(order))
        if found != sorted(found, key=list(self.phases).index):
            yield "fase-fora-de-ordem"
        if times[EDITS] and not self.blocks and not self.unfinished:
            yield "patch-sem-bloco"

    def _lines(self) -> Iterator[str]:
        if any(e.kind == "outside" for e in self.events):
            yield "fora-do-envelope"
        for e in self.events:
            if e.kind == "like_point":
                yield "ponto-malformado"
            elif e.kind == "text":
                yield "texto-livre"
            elif e.kind == "point" and e.phase is None:
                yield "ponto-sem-fase"
            elif e.kind == "point" and not self._fits(e):
                yield "ponto-fora-da-fase"
            elif e.kind == "mark" and e.phase != EDITS:
                yield "patch-no-think" if e.phase == "" else "patch-fora-do-patch"
            elif e.kind == "mark" and not e.exact:
                yield "patch-marcador"
            elif e.kind == "mark" and e.name != "search":
                yield "patch-bloco"

    def _fits(self, e: Event) -> bool:
        low, high = self.phases[e.phase]
        return low <= int(e.name) <= high

    def found(self) -> list[str]:
        out = [*self.problems, *self._tags(), *self._phases(), *self._lines()]
        return [*out, "think-nao-fechado"] if self.thinking else out

    def incomplete(self) -> list[str]:
        """What is missing of all points of every phase there is, once each and in rising order."""
        points = [e for e in self.events if e.kind == "point"]
        out = ["ponto-repetido"] * sum(n > 1 for n in Counter(e.name for e in points).values())
        valid = [int(e.name) for e in points if e.phase and self._fits(e)]
        there = {e.name for e in self.events if e.kind == "open"}
        out += ["ponto-ausente" for name, (low, high) in self.phases.items() if name in there and not set(range(low, high + 1)) <= set(valid)]
        return out + ["ponto-fora-de-ordem"] * any(b < a for a, b in pairwise(valid))


def problems_of(text: str | None, *, complete: bool = False, root: str = ROOT) -> list[str]:
    """Names of the rules that a text breaks, once for each time; empty for a good envelope."""
    if text is None or not _seen(text):
        return ["entrada"]
    e = Envelope(text, root)
    return e.found() + (e.incomplete() if complete else [])


def envelope_problems(text: Column, *, complete: bool = False, root: str = ROOT) -> Column:
    @pandas_udf(ArrayType(StringType()))
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: problems_of(t, complete=complete, root=root))

    return check(text)


def rule_counts(df: DataFrame, text: str, **options: object) -> DataFrame:
    """rule, times and texts: how often each rule is broken, and in how many texts; a good text counts under no rule."""
    each = df.select(F.monotonically_increasing_id().alias("row"), envelope_problems(F.col(text), **options).alias("p")).select("row", F.explode("p").alias("rule"))
    return each.groupBy("row", "rule").agg(F.count("*").alias("n")).groupBy("rule").agg(F.sum("n").alias("times"), F.count("*").alias("texts"))
