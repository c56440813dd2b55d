"""Term occurrences against a plain search, with terms in one and in many blocks."""

import random
from collections import Counter

import pytest

from talentweave.operators import mentions as N

WORDS = ["a", "b", "c", "ab", "the", "é", "日本"]


def plain(text, terms, original):
    spans = [m.span() for m in N.WORD.finditer(text)]
    words = [text[a:b] for a, b in spans]
    starts = [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
    out = []
    for term, kind in set(terms):
        own = term.split(" ")
        for i in range(len(words) - len(own) + 1):
            if words[i:i + len(own)] == own and len(own) <= 3:
                last = i + len(own) - 1
                out.append((spans[i][0], spans[last][1], kind, term) if original else (starts[i], starts[last] + len(words[last]), kind, term))
    return out


@pytest.mark.parametrize("block", [16 << 20, 400])
@pytest.mark.parametrize("original", [True, False])
def test_terms_equal_a_plain_search(spark, monkeypatch, block, original):
    monkeypatch.setattr(N, "BLOCK_CHARS", block)
    r = random.Random(2)
    terms = [(" ".join(r.choice(WORDS) for _ in range(r.randint(1, 4))), r.choice(["X", "Y"])) for _ in range(80)]
    terms += [terms[0], ("", "X"), ("a  b", "X"), (None, "X")]
    texts = [None, "", "  ", *("".join(r.choice(WORDS) + r.choice([" ", "  ", "\n", " ", "\t "]) for _ in range(r.randint(1, 60))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = N.extract_mentions(docs, spark.createDataFrame(terms, "term string, kind string"), original_offsets=original).collect()
    usable = [t for t in terms if t[0]]
    want = Counter((i, *m) for i, t in enumerate(texts) if t for m in plain(t, usable, original))
    assert Counter((f.doc_id, f.start, f.end, f.kind, f.value) for f in found) == want and len(want) > 500


def test_no_term_and_no_document(spark):
    docs = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    terms = spark.createDataFrame([("a", "X")], "term string, kind string")
    assert N.extract_mentions(docs, terms.limit(0)).count() == 0
    assert N.extract_mentions(docs.limit(0), terms).count() == 0
    assert [tuple(r) for r in N.extract_mentions(docs, terms).collect()] == [("x", 0, 1, "X", "a")]


def test_no_word_leaves_its_row(spark):
    docs = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    plan = N.extract_mentions(docs, spark.createDataFrame([("a", "X")], "term string, kind string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
