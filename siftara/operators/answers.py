"""What a reply says: its reasoning and final part, the option that it names, and whether it is language at all."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

#: Tags around the reasoning, words that lead up to an answer, and signs that part it from what it answers.
OPEN, CLOSE = "<think>", "</think>"
NO, YES = "No / false", "Yes / true"
FILLERS = frozenset("option choice answer letter is the correct it's its therefore thus so".split())
SIGNS = ":=-–—"
#: Characters after the word answer within which it is stated; a line is noise from this share of one sign, or below this share of letters and digits.
NEAR, ONE_SIGN, READABLE, NOISE_CHARS, NOISE_LEAST = 30, 0.4, 0.4, 2000, 200
PARTS = StructType([StructField("reasoning", StringType()), StructField("final", StringType())])
PAIR = StructType([StructField("key", StringType()), StructField("how", StringType())])
ANSWER = StructType([StructField("question", StringType()), StructField("key", StringType()), StructField("how", StringType())])

_COMMAND = re.compile(r"\\(?:boxed|text\w*|math\w*)\s*\{([^{}]*)\}")
_MARKUP = " \t\r\n*_`~$\"'“”‘’"


class Option(NamedTuple):
    key: str
    label: str
    text: str


def split_reply(reply: str | None) -> tuple[str | None, str | None]:
    """Reasoning and final part; the final part is None where the reasoning was never closed."""
    if reply is None:
        return "", None
    before, closed, after = reply.rpartition(CLOSE)
    if closed:
        return before.partition(OPEN)[2].strip() if OPEN in before else before.strip(), after.strip()
    before, opened, after = reply.partition(OPEN)
    return (after.strip(), None) if opened else ("", reply.strip())


def is_noise(text: str | None) -> bool:
    """Whether the beginning of a text is one sign over and over, or mostly no letters and digits. Short texts are not judged."""
    body = "".join((text or "")[:NOISE_CHARS].split())
    if len(body) < NOISE_LEAST:
        return False
    return max(map(body.count, set(body))) > ONE_SIGN * len(body) or sum(map(str.isalnum, body)) < READABLE * len(body)


def _plain(value: str) -> str:
    return _COMMAND.sub(r"\1", value).strip(_MARKUP)


def _ends_word(text: str, at: int) -> bool:
    return at >= len(text) or not (text[at].isalnum() or text[at] == "_")


def named_option(value: str, options: Sequence[Option]) -> Option | None:
    """The option that a stated value names: by letter, by a longer label, by its key, or by its whole text."""
    said = _plain(value)
    while (word := re.match(r"[\w']+", said)) and word[0].lower() in FILLERS:
        said = _plain(said[word.end() :].lstrip(_MARKUP + SIGNS + ","))
    if not said:
        return None
    letters = {o.label: o for o in options if len(o.label) == 1 and o.label.isalpha()}
    body = said[1:] if said[0] in "([" else said
    if body and body[0].isascii() and body[0].isalpha() and _ends_word(body, 1):
        rest = body[1:]
        if (body[0].isupper() or rest[:1] in tuple(")].:") or not rest.strip()) and body[0].upper() in letters:
            return letters[body[0].upper()]
    for o in sorted(options, key=lambda o: -len(o.label)):
        if o.label not in letters and said.lower().startswith(o.label.lower()) and _ends_word(said, len(o.label)):
            return o
    first = said.split()[0].strip(",.;:)(").casefold()
    for o in options:
        if len(o.key) > 1 and o.key.casefold() == first:
            return o
    whole = " ".join(said.rstrip(".").split())
    for same in (str, str.casefold):
        hits = [o for o in options if same(" ".join(o.text.split())) == same(whole)]
        if len(hits) == 1:
            return hits[0]
    return None


def _statements(text: str, question: str) -> Iterator[int]:
    """Where a value begins that is stated as the answer to a question: the word answer, the question, a sign."""
    for word in re.finditer(r"(?i)\banswer", text):
        rest = text[word.end() :].lstrip()
        rest = rest[1:].lstrip() if rest[:1] in tuple("[(") else rest
        if not rest[: len(question)].lower() == question.lower() or not _ends_word(rest, len(question)):
            continue
        rest = rest[len(question) :].lstrip()
        rest = rest[1:].lstrip() if rest[:1] in tuple("])") else rest
        if rest[:1] and rest[0] in SIGNS:
            yield len(text) - len(rest) + 1


def _line_statements(text: str, question: str) -> Iterator[int]:
    """Where a value begins on a line that opens with the question and a sign, list marks aside."""
    at = 0
    for line in text.split("\n"):
        rest = line.lstrip(" \t>*_`#-•.)0123456789")
        if rest[: len(question)].lower() == question.lower() and _ends_word(rest, len(question)):
            after = rest[len(question) :].lstrip(" \t*_`")
            if after[:1] and after[0] in SIGNS:
                yield at + len(line) - len(after) + 1
        at += len(line) + 1


def _loose_statements(text: str) -> Iterator[str]:
    """What follows the word answer and, soon after it on its line, the word is or a sign."""
    for word in re.finditer(r"(?i)\banswer\b", text):
        rest = text[word.end() :].split("\n", 1)[0]
        sign = re.search(r"(?i)\bis\b|[:=\-–—]", rest[: NEAR + 2])
        if sign and sign.start() <= NEAR:
            yield rest[sign.end() :]


def _value(text: str, at: int) -> str:
    """The rest of the line, or the next line with something on it."""
    line, _, later = text[at:].partition("\n")
    return line if line.strip() else next((x for x in later.split("\n") if x.strip()), "")


def read_answer(final: str | None, question: str, options: Sequence[Option], alone: bool) -> tuple[str | None, str | None]:
    """Key and way of the answer to a question. A statement that names the question decides by its last occurrence even when that names no option; the looser ways count for the only question of a reply."""
    if not final:
        return None, None
    for how, places in (("marker", _statements(final, question)), ("line", _line_statements(final, question) if not alone else iter(()))):
        last = None
        for last in places:
            pass
        if last is not None:
            hit = named_option(_value(final, last), options)
            return (hit.key if hit else None), how
    if not alone:
        return None, None
    boxed = (m[1] for m in re.finditer(r"\\boxed\s*\{([^{}]*)\}", final))
    for how, values in (("generic", _loose_statements(final)), ("boxed", boxed)):
        hits = [o for o in (named_option(v, options) for v in values) if o]
        if hits:
            return hits[-1].key, how
    at = {}
    for o in options:
        flags = 0 if len(o.label) == 1 and o.label.isalpha() else re.I
        at |= {m.start(): o.key for m in re.finditer(rf"(?<!\w){re.escape(o.label)}(?!\w)", final, flags | re.A)}
    return (at[max(at)], "bare") if at else (None, None)


@pandas_udf(PARTS)
def reply_parts(replies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_reply(t) for t in replies], columns=["reasoning", "final"])


@pandas_udf(BooleanType())
def noise(texts: pd.Series) -> pd.Series:
    return texts.map(is_noise)


def options_of(question: dict) -> list[Option]:
    """Options of a question with the letter that each is shown by; a key of one letter is its own."""
    kind, criteria = question.get("type"), question.get("criteria") or {}
    if kind == "choice":
        texts = {k: k if v is None else str(v) for k, v in criteria.items()}
    elif kind == "score":
        texts = {str(i): str(v) for i, v in enumerate(criteria)}
    else:
        texts = {"false": criteria.get("false") or NO, "true": criteria.get("true") or YES}
    return [Option(k, k if len(k) == 1 or i > 25 else chr(65 + i), t) for i, (k, t) in enumerate(texts.items())]


@pandas_udf(ArrayType(ANSWER))
def request_answers(finals: pd.Series, requests: pd.Series) -> pd.Series:
    """question, key and how for each question of a request (JSON text); null where that is none."""

    def one(final: str | None, request: str | None) -> list[dict] | None:
        try:
            questions = json.loads(request or "")["questions"]
            asked = {q: options_of(v) for q, v in questions.items()}
        except (ValueError, KeyError, TypeError, AttributeError):
            return None
        return [dict(zip(("question", "key", "how"), (q, *read_answer(final, q, o, len(asked) == 1)))) for q, o in asked.items()]

    return pd.Series([one(*x) for x in zip(finals, requests)], dtype=object)


@pandas_udf(PAIR)
def key_answer(finals: pd.Series, keys: pd.Series) -> pd.DataFrame:
    """key and how of the option that a reply to one question q1 names, the options being their keys."""
    rows = [(None, None) if own is None else read_answer(final, "q1", [Option(k, k, k) for k in own], True) for final, own in zip(finals, keys)]
    return pd.DataFrame(rows, columns=["key", "how"])
