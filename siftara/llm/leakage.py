"""Passages of evaluation items inside a corpus, found by q-gram counting in diagonal bands.

Item and document are read as streams of letters and digits without blanks, so markup, line layout and word breaks do
not matter. A passage of 20 words or more with an edit in one word of ten keeps a minimum of its character q-grams on nearby
diagonals, whatever the edits are; that minimum is worked out for each item from its own words. Regions of a document
where an item reaches its minimum within two overlapping bands are then aligned word by word with at most the same number
of edits. Nothing else is compared.

The items lie in blocks of bounded size, each with its q-grams sorted; blocks are made by tasks and read one at a time.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftara.storage import discard, materialize

Q = 12
#: Shortest passage in words, and one edit for how many words.
WINDOW, RATE = 20, 10
#: Edits and the words they need. A longer passage can be cut in two of which one is as good, so no more are needed.
PASSAGES = ((2, WINDOW), (3, 30))
MOST = 3
#: Words of an item that an alignment with 0, 1, ... edits must cover: edits at the ends of a passage do not show.
ENOUGH = tuple(max(WINDOW, RATE * e) - 2 for e in range(MOST + 1))
#: Common words in a row that such an alignment has at least once.
RUN = min(-(-(n - e) // (e + 1)) for e, n in enumerate(ENOUGH))
#: Width of a band of diagonals; bands overlap by half, so that MOST edits, of 20 letters each, never leave a region.
BAND = 128
#: Added to diagonals so that none is negative: over the characters of one item.
ORIGIN = 1 << 30
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000
#: Items of a block that a q-gram may stand in before it is left out of the counts of the items that can do without it.
COMMON = 50
#: Characters of documents that are compared at once; longer documents are read in overlapping parts of this size.
CHUNK_CHARS = 500_000

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_SPACE_ESCAPE = re.compile(r"\\[nrtfv]")
_LINE_BREAK_HYPHEN = re.compile(r"(?<=\w)[-‐‑][ \t]*(?:\r\n?|\n)[ \t>]*(?=\w)")
_QUOTE_MARK = re.compile(r"(?m)^[ \t]*(?:>[ \t]*)+")
_MARKS = re.compile("[̀-ͯ᪰-᫿⃐-⃿]")
_KEEP = re.compile(r"[\W_]+")


def plain_words(text: str | None) -> list[str]:
    """Words of letters and digits without case, accents, width, markup, escapes, invisible characters and line breaks inside words."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _SPACE_ESCAPE.sub(" ", _UNICODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), text))
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
    if ">" in text:
        text = _QUOTE_MARK.sub("", text)
    if "-" in text or not text.isascii():
        text = _LINE_BREAK_HYPHEN.sub("", text)
    text = text.casefold()
    if text.isascii():
        return text.translate(_DROP).split()
    return [w for w in (_KEEP.sub("", x) for x in text.split()) if w]


_DROP = {i: None for i in range(33, 127) if not chr(i).isalnum()} | {i: " " for i in range(0x1C, 0x20)} | {i: None for i in range(0, 9)} | {i: None for i in range(14, 0x1C)} | {127: None}


def own_text(text: str | None) -> str:
    """An item's text without its first line, the instruction."""
    return (text or "").replace("\r\n", "\n").replace("\r", "\n").partition("\n")[2]


def _stream(words: list[str]) -> tuple[bytes, np.ndarray]:
    """The words as bytes without blanks, and where each begins."""
    coded = [w.encode("utf-8", "replace") for w in words]
    return b"".join(coded), np.cumsum([0, *map(len, coded)], dtype=np.int64)


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit value for the Q bytes at each position (the last Q - 1 positions have none)."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    low = np.ascontiguousarray(eight[:n]).view(np.uint64).ravel()
    high = np.zeros(n, dtype=np.uint64)
    for k in range(8, Q):
        high |= data[k : k + n].astype(np.uint64) << np.uint64(8 * (k - 8))
    with np.errstate(over="ignore"):
        mixed = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        return mixed ^ (mixed >> np.uint64(29))


def _kept_in_windows(starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of passage: where its windows of words begin and end, in characters, and the fewest q-grams they keep when their longest words are edited."""
    lengths = np.diff(starts)
    out = []
    for edits, words in PASSAGES:
        if len(lengths) >= words:
            windows = np.lib.stride_tricks.sliding_window_view(lengths, words)
            lost = np.sort(windows, axis=1)[:, -edits:].sum(axis=1) + edits * (Q - 1)
            begin, end = starts[: len(windows)], starts[words:]
            out.append((begin, end, np.maximum(1, end - begin - Q + 1 - lost)))
    return out


def least_grams(starts: np.ndarray) -> int:
    """The fewest q-grams that a passage of an item keeps whatever its edits are; 0 for too few words. ``starts`` are the places of its words and its length."""
    return min((int(kept.min()) for _, _, kept in _kept_in_windows(starts)), default=0)


def least_rare_grams(starts: np.ndarray, common: np.ndarray) -> int:
    """As ``least_grams`` where the q-grams marked in ``common`` are not counted: every one of them in a window may be among those kept. Below 1 they cannot be done without."""
    before = np.concatenate([[0], np.cumsum(common)])
    at = lambda x: before[np.clip(x, 0, len(common))]
    return min((int((kept - (at(end - Q + 1) - at(begin))).min()) for begin, end, kept in _kept_in_windows(starts)), default=0)


@dataclass
class Item:
    """An item ready to be aligned: its words, their places, and where its runs of RUN words stand."""

    key: object
    words: list[str]
    starts: np.ndarray
    runs: dict[tuple[str, ...], list[int]]


def make_item(key: object, words: list[str]) -> Item:
    runs: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(words) - RUN + 1):
        runs.setdefault(tuple(words[i : i + RUN]), []).append(i)
    return Item(key, words, _stream(words)[1], runs)


class ItemIndex:
    """The q-grams of a block of items, sorted, with the items and the places where they stand.

    ``least`` is what an item needs of them. Where an item keeps enough q-grams without those that stand in more than COMMON
    items, the common ones are not listed for it and ``least`` is the fewest of the others.
    """

    def __init__(self, items: list[tuple[object, list[str]]]):
        self.items = [make_item(k, w) for k, w in items]
        own = [_grams(np.frombuffer(_stream(w)[0], dtype=np.uint8)) for _, w in items]
        once = np.concatenate([np.unique(g) for g in own] or [np.empty(0, dtype=np.uint64)])
        grams, n = np.unique(once, return_counts=True)
        common = grams[n > COMMON]
        all_, owners, places, self.least = [], [], [], np.zeros(len(items), dtype=np.int64)
        for k, (item, g) in enumerate(zip(self.items, own)):
            often = np.isin(g, common)
            need = least_rare_grams(item.starts, often)
            if need < 1:
                need, often = least_grams(item.starts), np.zeros(len(g), dtype=bool)
            self.least[k] = need
            all_.append(g[~often])
            places.append(np.flatnonzero(~often))
            owners.append(np.full(len(places[-1]), k, dtype=np.int64))
        flat = np.concatenate(all_ or [np.empty(0, dtype=np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.owner, self.place = (np.concatenate(x)[order] if x else np.empty(0, dtype=np.int64) for x in (owners, places))
        self.screen = np.zeros(1 << 22, dtype=bool)
        self.screen[self.grams >> np.uint64(42)] = True
        self.longest = max((int(i.starts[-1]) for i in self.items), default=0)

    def regions(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, first diagonal of a band) where an item keeps its minimum of grams; ``ends`` are the ends of the texts in ``data``."""
        grams = _grams(data)
        at = np.flatnonzero(self.screen[grams >> np.uint64(42)])
        slot = np.searchsorted(self.grams, grams[at])
        known = slot < len(self.grams)
        at, slot = at[known], slot[known]
        same = self.grams[slot] == grams[at]
        at, slot = at[same], slot[same]
        n = self.first[slot + 1] - self.first[slot]
        if not n.sum():
            return []
        post = np.repeat(self.first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        doc = np.searchsorted(ends, at, side="right")
        diagonal = at - np.concatenate([[0], ends])[doc] - self.place[post] + ORIGIN
        # one number for text, item and half band: sorted, the two halves of a band stand together, and only what occurs takes room
        key = np.sort(((doc * len(self.items) + self.owner[post]) << 32) | (diagonal // (BAND // 2)))
        first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        both = count.copy()
        both[:-1] += np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        key = key[both >= self.least[(key >> 32) % len(self.items)]]
        pair = (key >> 32).tolist()
        return [(p // len(self.items), p % len(self.items), b * (BAND // 2) - ORIGIN) for p, b in zip(pair, (key & 0xFFFFFFFF).tolist())]


def _reach(item: list[str], doc: list[str], i: int, j: int, step: int, edits: int) -> list[int]:
    """Item words covered from (i, j) on in direction ``step`` with 0, 1, ... ``edits`` edits, ending in a common word: fronts move along word diagonals."""

    def slide(a: int, b: int) -> int:
        n = 0
        while 0 <= a < len(item) and 0 <= b < len(doc) and item[a] == doc[b]:
            a, b, n = a + step, b + step, n + 1
        return n

    fronts = {0: slide(i, j)}  # document words ahead of item words -> item words covered
    reached = [fronts[0]]
    for _ in range(edits):
        ahead: dict[int, int] = {}
        for d, x in fronts.items():
            for took, moved in ((1, 0), (1, -1), (0, 1)):  # a word replaced, dropped, added
                ahead[d + moved] = max(ahead.get(d + moved, -1), x + took)
        best, fronts = reached[-1], {}
        for d, x in ahead.items():
            n = slide(i + step * x, j + step * (x + d))
            fronts[d] = x + n
            if n:
                best = max(best, x + n)
        reached.append(best)
    return reached


def aligned(item: Item, doc: list[str], places: np.ndarray, low: int, high: int) -> int:
    """The most item words covered by an alignment with a run between two diagonals, with e edits only where ENOUGH[e] words are covered; 0 without such a one.

    It has RUN common words in a row somewhere, so it is grown from such runs in both directions. ``places`` are the
    character places of the document words.
    """
    best = 0
    done: set[tuple[int, int]] = set()
    for j in range(len(doc) - RUN + 1):
        for i in item.runs.get(tuple(doc[j : j + RUN]), ()):
            if not low <= places[j] - item.starts[i] <= high:
                continue
            if (i - 1, j - 1) in done:  # further along a run that was grown already
                done.add((i, j))
                continue
            done.add((i, j))
            ahead, back = _reach(item.words, doc, i, j, 1, MOST), _reach(item.words, doc, i - 1, j - 1, -1, MOST)
            for e, enough in enumerate(ENOUGH):
                n = max(ahead[k] + back[e - k] for k in range(e + 1))
                if n >= enough:
                    best = max(best, n)
    return best


def _find(index: ItemIndex, ids: list, documents: list[list[str]]) -> tuple[list, list, list[int]]:
    """Items, documents and aligned words found in the words of documents."""
    out: tuple[list, list, list[int]] = ([], [], [])
    words: list[list[str]] = []
    starts: list[np.ndarray] = []
    owner: list = []
    parts: list[bytes] = []
    origin: list[tuple[int, int]] = []  # document and place of each part
    overlap = index.longest + 4 * BAND
    size = 0

    def flush() -> None:
        nonlocal size
        if parts:
            ends = np.cumsum([len(s) + 1 for s in parts])
            best: dict[tuple[int, int], int] = {}
            for part, i, diagonal in index.regions(np.frombuffer(b"\x00".join(parts), dtype=np.uint8), ends):
                item, (d, base) = index.items[i], origin[part]
                if best.get((d, i)):
                    continue
                diagonal += base
                # the region: what lies on the band's diagonals along the whole item
                lo = max(0, int(np.searchsorted(starts[d], max(0, diagonal - BAND), side="right")) - 1)
                hi = int(np.searchsorted(starts[d], diagonal + BAND * 2 + item.starts[-1], side="left"))
                best[d, i] = aligned(item, words[d][lo:hi], starts[d][lo:hi], diagonal - BAND // 2, diagonal + BAND * 3 // 2)
            for (d, i), n in best.items():
                if n:
                    out[0].append(index.items[i].key)
                    out[1].append(owner[d])
                    out[2].append(n)
        for x in (words, starts, owner, parts, origin):
            x.clear()
        size = 0

    for key, own in zip(ids, documents):
        stream, begins = _stream(own)
        if len(stream) < Q:
            continue
        words.append(own)
        starts.append(begins)
        owner.append(key)
        for base in range(0, max(1, len(stream) - overlap), CHUNK_CHARS):
            parts.append(stream[base : base + CHUNK_CHARS + overlap])
            origin.append((len(words) - 1, base))
            size += len(parts[-1])
        if size >= CHUNK_CHARS:
            flush()
    flush()
    return out


def _own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with enough words."""
    for batch in batches:
        rows = [(k, w) for k, w in zip(batch.column(0).to_pylist(), (plain_words(own_text(t)) for t in batch.column(1).to_pylist())) if len(w) >= WINDOW]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], batch.schema.field(0).type), pa.array([w for _, w in rows], pa.list_(pa.string())), pa.array([sum(map(len, w)) for _, w in rows], pa.int64())], ["item", "words", "chars"])


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain_words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["doc", "words"])


def find_leaks(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, doc_id and words: every document that holds a passage of an item, with the item words aligned.

    A passage is a run of at least WINDOW words of the item's own text with at most one in RATE replaced, added or dropped. Items
    with fewer words, and null or empty texts of either side, give no rows. Items are a stated query set, cut into blocks of
    about BLOCK_CHARS characters. Tasks make the blocks; the driver hands on one at a time. The corpus is read and normalised
    once: where there are several blocks its words are kept for them. Repeated document rows give repeated rows; other columns are not read.
    """
    spark = documents.sparkSession
    item_kind, kind = dict(items.dtypes)[item_key], dict(documents.dtypes)[key]
    schema = f"item_id {item_kind}, doc_id {kind}, words int"
    own = materialize(items.select(f"`{item_key}`", f"`{item_text}`").mapInArrow(_own_words, f"item {item_kind}, words array<string>, chars long"), "leak-items")
    blocks = -(-(own.agg(F.sum("chars")).first()[0] or 0) // BLOCK_CHARS)
    if not blocks:
        return spark.createDataFrame([], schema).toDF(item_key, key, "words")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [group["block"].iloc[0]], "index": [pickle.dumps(ItemIndex([(k, list(w)) for k, w in zip(group["item"], group["words"])]))]})

    numbered = own.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    built = materialize(numbered.groupBy("block").applyInPandas(build, "block long, index binary"), "leak-blocks")
    source = documents.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    if blocks > 1:
        source = materialize(source.mapInArrow(_normalised, f"doc {kind}, words array<string>"), "leak-words")
    parts = []
    for block in range(blocks):
        rows = built.where(F.col("block") == block).select("index").collect()
        if not rows:
            continue
        packed = spark.sparkContext.broadcast(bytes(rows[0][0]))

        def search(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(packed.value)
            fields = None
            for batch in batches:
                held = batch.column(1).to_pylist()
                got = _find(index, batch.column(0).to_pylist(), held if blocks > 1 else [plain_words(t) for t in held])
                fields = fields or pa.schema([("item_id", pa.infer_type([i.key for i in index.items])), ("doc_id", batch.schema.field(0).type), ("words", pa.int32())])
                yield pa.RecordBatch.from_pydict(dict(zip(("item_id", "doc_id", "words"), got)), schema=fields)

        part = source.mapInArrow(search, schema)
        if blocks > 1:
            part = materialize(part, "leaks")
            packed.destroy()
        parts.append(part)
    if blocks > 1:
        discard(source)
    discard(own)
    return reduce(DataFrame.unionByName, parts).toDF(item_key, key, "words")
