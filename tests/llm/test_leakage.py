import random
import re

import numpy as np
import pytest

from siftara.llm import leakage as K

WORDS = "market river quality engine window silver garden planet number winter simple forest bridge camera doctor energy flower guitar hammer island jacket kitchen ladder mirror napkin orange pencil rabbit saddle ticket umbrella violet walnut yellow zipper ação informação también".split()


def text(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(100)) for _ in range(n)]


def edit(rng, words, k):
    words = list(words)
    for place in rng.sample(range(2, len(words) - 2), k):
        words[place] = rng.choice(["", f"other{rng.randrange(99)}", f"{words[place]} added{rng.randrange(99)}"])
    return " ".join(w for w in words if w)


DISGUISES = [
    str, str.upper, lambda t: t.replace(" ", "\n"), lambda t: t.replace(" ", "&nbsp;"), lambda t: " ".join(f"<em>{w}</em>" for w in t.split()), lambda t: "".join(c + "​" for c in t),
    lambda t: "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in t), lambda t: "> " + re.sub(r"(\w{3})(\w{3})", r"\1-\n> \2", t, count=3), lambda t: t.replace("ç", "\\u00e7").replace("é", "\\u00e9"), lambda t: t.replace("ã", "ã"), lambda t: " ".join(f"**{w}**," for w in t.split()),
]


@pytest.mark.parametrize("seed", range(2))
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    items = [(i, f"Answer with one letter\n{' '.join(text(rng, 60))}", "x") for i in range(30)] + [(98, None, "x"), (99, "Only an instruction", "x")]
    docs, want = [(500, None, 1), (501, "", 1), (502, "Answer with one letter " * 20, 1)], set()
    for d in range(60):
        i = rng.randrange(30)
        words = K.plain_words(K.own_text(items[i][1]))
        raw = K.own_text(items[i][1]).split()
        n = rng.choice([12, 20, 20, 30, 50])
        at = rng.randrange(len(words) - n + 1)
        passage = edit(rng, raw[at : at + n], n // 10) if n > 12 else " ".join(raw[at : at + n])
        docs.append((d, " ".join(text(rng, 40)) + "\n" + rng.choice(DISGUISES)(passage) + "\n" + " ".join(text(rng, 40)), 1))
        if n > 12:
            want.add((i, d))
    got = K.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, words int"), spark.createDataFrame(items, "item_id long, text string, doc_id string"))
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == want


def test_the_filter_loses_nothing():
    """Every window with two edits keeps the minimum of grams in the bands, so the aligned pairs are those of all pairs compared."""
    rng = random.Random(7)
    words = K.plain_words(" ".join(text(rng, 80)))
    index = K.ItemIndex([(1, words)])
    for _ in range(60):
        at = rng.randrange(60)
        doc = K.plain_words(" ".join(text(rng, 30)) + " " + edit(rng, words[at : at + 20], 2) + " " + " ".join(text(rng, 30)))
        stream, starts = K._stream(doc)
        n = K.aligned(index.items[0], doc, starts, -(10**9), 10**9)
        regions = index.regions(np.frombuffer(stream + b"\0", dtype=np.uint8), np.array([len(stream) + 1]))
        assert n >= K.ENOUGH[2] and regions


def test_alignment_counts():
    words = [f"w{i}" for i in range(40)]
    item = K.ItemIndex([(1, words)]).items[0]
    reach = lambda doc: K.aligned(item, doc, np.arange(len(doc)), -99999, 99999)
    assert reach(words[:12]) == 0 and reach(words) == 40
    assert reach(words[:10] + ["x"] + words[11:20]) == 20 and reach(words[:10] + words[11:20]) == 20 and reach(words[:10] + ["x"] + words[10:20]) == 20
    assert reach(words[:6] + ["x"] + words[7:13] + ["x"] + words[14:20] + ["x"] + words[21:27]) == 20


def test_common_grams_are_left_out_where_an_item_can_do_without(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(K, "COMMON", 3)
    stock = text(rng, 14)
    items = [(i, K.plain_words(" ".join(text(rng, 30) + stock + text(rng, 30)))) for i in range(12)] + [(99, K.plain_words(" ".join(stock * 2)))]
    index = K.ItemIndex(items)
    whole = K._stream(items[0][1])[1]
    assert 1 <= index.least[0] < K.least_grams(whole) and (index.owner == 12).sum() == len(K._stream(items[12][1])[0]) - K.Q + 1
    for k, words in items[:12]:
        at = rng.randrange(len(words) - 20)
        doc = K.plain_words(" ".join(text(rng, 30)) + " " + edit(rng, words[at : at + 20], 2) + " " + " ".join(text(rng, 30)))
        assert (k, 1) in set(zip(*K._find(index, [1], [doc])[:2]))


def test_many_short_documents_and_items_take_little_room():
    import tracemalloc

    rng = random.Random(6)
    items = [(i, K.plain_words(" ".join(text(rng, 22)))) for i in range(2000)]
    index = K.ItemIndex(items)
    docs = [K.plain_words(" ".join(text(rng, 4))) for _ in range(12_000)]
    tracemalloc.start()
    K._find(index, list(range(len(docs))), docs)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_blocks_and_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, "First\n" + " ".join(text(rng, 40))) for i in range(6)]
    docs = [(i, " ".join(text(rng, 20_000)) + " " + K.own_text(t) + " " + " ".join(text(rng, 20_000))) for i, t in items]
    monkeypatch.setattr(K, "BLOCK_CHARS", 300)
    monkeypatch.setattr(K, "CHUNK_CHARS", 1000)
    got = K.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == {(i, i) for i in range(6)}
    none = K.find_leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.collect() == []
