"""Prose of a document and the sentences in it."""

from __future__ import annotations

import html
import re
import unicodedata

#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = frozenset(
    "approx aprox ca cap cf dr dra ed eds e.g eg etc ex fig figs i.e ie inc jr ltd mr mrs ms n no nos num núm nº op p pp p.ej p.ex pág págs prof sec seq sr sra st tab v.gr viz vol vs".split()
)
_ODD = re.compile("[­​-‏⁠﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
#: Lines that are no prose: headings, lists and options, log lines, rules and tables, code, and labels in brackets.
_NO_PROSE = re.compile(
    r"""\s*(?:\#{1,6}\s | [-*+•]\s | [A-Ea-e]\)\s | \d{4}-\d\d-\d\d[T\ ]\d\d: | \[[^\]]*\]\s*$ | [-=*_|]{3,} | \| | (?:def|class)\s\w+.*:\s*$ | (?:import|from)\s\w+ | @\w+ | \"\"\" | [\w.\[\]]+\s(?:=|\+=)\s ) | \s{4,}\S""",
    re.X,
)
_STOP = re.compile(r"[.!?]+[\"'”’»)\]`*]*(?=\s|$)")
_WORD = re.compile(r"\S*\w\S*")
_LETTERS = re.compile(r"[^\W\d_]")
_BREAK = re.compile(r"(?<=\w)-\n(?=[^\W\d_A-ZÀ-Þ])")


def clean(text: str) -> str:
    """Text with one kind of line end, without invisible characters, entities, tags and odd widths."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _ODD.sub("", text))
    if "<" in text:
        text = _TAG.sub("", text)
    return text


def prose_blocks(text: str | None) -> list[str]:
    """Runs of prose without line layout; a line goes on with the next one unless that begins with a capital or comes after something else."""
    if not text:
        return []
    blocks: list[list[str]] = []
    open_, fenced = False, False
    for line in clean(text).split("\n"):
        body = line.strip()
        if body.startswith("```"):
            fenced = not fenced
            open_ = False
            continue
        if fenced:
            continue
        while body.startswith(">"):
            body = body[1:].lstrip()
            line = body
        if not body:
            open_ = False
            continue
        if _NO_PROSE.match(line):
            open_ = False
            continue
        first = body.lstrip("\"'`*¿¡([«“").lstrip()[:1]
        if blocks and (open_ and not first.isupper() or first.islower()):
            last = blocks[-1]
            if last[-1].endswith("-") and first.islower() and last[-1][-2:-1].isalpha():
                last[-1] = last[-1][:-1] + body
            else:
                last.append(body)
        else:
            blocks.append([body])
        open_ = True
    return [" ".join(b) for b in blocks]


def sentences(text: str | None) -> list[list[str]]:
    """Sentences of the prose as lists of words; a sentence ends at . ! or ? (not at an abbreviation) or with its block."""
    out: list[list[str]] = []
    for block in prose_blocks(text):
        now: list[str] = []
        for word in block.split():
            if any(map(str.isalnum, word)):
                now.append(word)
            end = word.rstrip("\"'”’»)]`*")
            if now and end and end[-1] in ".!?":
                plain = end.lower().lstrip("(\"'`*[«“¿¡")
                if end[-1] != "." or plain.rstrip(".") not in ABBREVIATIONS:
                    out.append(now)
                    now = []
        if now:
            out.append(now)
    return out


def letters(word: str) -> int:
    return sum(map(str.isalpha, word))
