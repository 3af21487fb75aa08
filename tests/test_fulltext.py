"""Stems, and full-text search by all words or as a phrase, against brute force."""

import math

import pytest

from folioquarry.functions.stem import stem
from folioquarry.operators import search

# Pairs that the published description of the algorithm gives.
PAIRS = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()


@pytest.mark.parametrize(("word", "want"), list(zip(PAIRS[::2], PAIRS[1::2])))
def test_published_stems(word, want):
    assert stem(word) == want


def test_other_words_are_their_own_stems():
    assert [stem(w) for w in ("", "a", "is", "über", "x1ing", "b_ed")] == ["", "a", "is", "über", "x1ing", "b_ed"]


def test_match_equals_brute_force(spark):
    texts = ["The harbour project ended", "projects of harbours", "Harbour and a project", "", None, "end of the harbour's projecting", "project harbour harbours projects harbour project"]
    c = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    asked = [(1, "harbours projects"), (2, '"harbour projects'), (3, '"project harbour"'), (4, "nothing here"), (5, ""), (6, None), (7, "END"), (8, "Harbour harbour")]
    got = {(r.query_id, r.chunk_id): (r.score, r.rank) for r in search.match(c, spark.createDataFrame(asked, "query_id int, query string"), k=5).collect()}
    split = lambda t: [stem(w) for w in "".join(x if x.isalnum() or x == "_" else " " for x in t.lower()).split()]
    held = {i: split(t) for i, t in enumerate(texts) if t is not None}
    n, mean = len(held), sum(map(len, held.values())) / len(held)
    want = {}
    for q, text in asked:
        terms = split(text or "")
        for i, w in held.items():
            if not terms or not set(terms) <= set(w) or '"' in text and f" {' '.join(terms)} " not in f" {' '.join(w)} ":
                continue
            s = 0.0
            for t in set(terms):
                df, tf = sum(t in x for x in held.values()), w.count(t)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            want[q, i] = round(s, 6)
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want) and {q for q, _ in want} == {1, 2, 3, 7, 8}
    assert search.match(c.limit(0), spark.createDataFrame(asked, "query_id int, query string")).count() == 0
