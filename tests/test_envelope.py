import pytest

from siftara.operators import envelope as V


def good(points=lambda low, high: range(low, high + 1)):
    out = ["<loop>"]
    for name, (low, high) in V.PHASES.items():
        out += [f"<{name}>", *(f"[Ponto {n}: Passo {n}] feito" for n in points(low, high))]
        out += ["<<<< SEARCH", "a = 1", "====", "a = 2", ">>>> REPLACE"] if name == "patch" else []
        out.append(f"</{name}>")
    return "\n".join([*out, "</loop>"])


def replaced(a, b):
    text = good()
    assert a in text
    return text.replace(a, b, 1)


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        (good(), []), ("﻿" + good().replace("\n", "\r\n"), []), (good() + "\n​ \n", []), (None, ["entrada"]), (" ​", ["entrada"]), (good() + "\nbye", ["fora-do-envelope"]), (replaced("</loop>", ""), ["envelope"]), (good() + "\n</loop>", ["envelope"]),
        (replaced("</plan>\n", ""), ["fase-nao-fechada"]), (replaced("<plan>", "</orient>\n<plan>"), ["tag-sem-par"]), (replaced("[Ponto 3: Passo 3] feito", "- [Ponto 3: Passo 3] feito"), ["ponto-malformado"]), (replaced("[Ponto 3: Passo 3] feito", "[Point 13: X]"), ["ponto-fora-da-fase"]),
        (replaced("[Ponto 3: Passo 3] feito", "loose words"), ["texto-livre"]), (replaced("[Ponto 3: Passo 3] feito", "…"), []), (replaced("<<<< SEARCH", "<<<<< SEARCH"), ["patch-marcador", "texto-livre", "patch-bloco", "texto-livre", "patch-bloco", "patch-sem-bloco"]), (replaced("a = 1\n", " \n"), ["patch-search-vazio"]), (replaced("====\n", ""), ["patch-bloco", "patch-sem-bloco"]),
        (replaced(">>>> REPLACE", ""), None), (replaced("[Ponto 3: Passo 3] feito", ">>>> REPLACE"), ["patch-fora-do-patch"]), (replaced("[Ponto 3: Passo 3] feito", "<think>\n</think>"), ["think-no-envelope"] * 2), (replaced("[Ponto 3: Passo 3] feito", "a b"), ["quebra-de-linha", "texto-livre"]),
        (replaced("</orient>\n", "</orient>\n[Ponto 4: X]\n"), ["ponto-sem-fase"]), (replaced("</deliver>\n", "</deliver>\n<plan>\n</plan>\n"), ["fase-repetida"]),
    ],
)
def test_rules(text, wanted):
    got = V.problems_of(text)
    assert (sorted(got) == sorted(wanted)) if wanted is not None else "patch-bloco" in got and "fase-nao-fechada" in got
    assert set(got) <= set(V.RULES)


def test_phases_missing_empty_and_out_of_order():
    text = "<loop>\n<plan>\n[Ponto 11: P]\n</plan>\n<orient>\n…\n</orient>\n</loop>"
    assert sorted(V.problems_of(text)) == sorted(["fase-ausente"] * 3 + ["fase-vazia", "fase-fora-de-ordem"])
    assert "fase-fora-do-envelope" in V.problems_of("<plan>\n</plan>\n" + good())


def test_complete():
    assert V.problems_of(good(), complete=True) == []
    text = replaced("[Ponto 3: Passo 3] feito\n[Ponto 4: Passo 4] feito", "[Ponto 4: Passo 4] feito\n[Ponto 3: Passo 3] feito\n[Ponto 3: B]").replace("[Ponto 45: Passo 45] feito\n", "")
    assert V.problems_of(text, complete=True) == ["ponto-repetido", "ponto-ausente", "ponto-fora-de-ordem"]


def test_counts(spark):
    df = spark.createDataFrame([(good(),), (good() + "\nbye",), (good() + "\nbye\n</loop>",), (None,)], "t string")
    assert {r["rule"]: (r["times"], r["texts"]) for r in V.rule_counts(df, "t").collect()} == {"fora-do-envelope": (2, 2), "envelope": (1, 1), "entrada": (1, 1)}
