"""Token links against a plain loop over both token lists, corpus counts included."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from talentweave.llm import alignment
from talentweave.llm.tokens import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ROWS = [
    (1, None), (2, ""), (3, " "), (4, "▁x"), (5, "<|endoftext|> <s> </s>"), (None, "a\tb\nc é ½ 日本語"), (None, "x"), (7, "x"), (7, "x"),
    (8, "don't WE'LL go " * 30_000), (9, "<0x41>A"), (10, "\x00　  \U0001F600"), (11, " leading  and trailing "),
    *((20 + i, f"the cats sat on mat {i} unbelievably {'internationalisation ' * i}") for i in range(20)),
]


def brute(rows):
    a_side = Tokenizer.from_file(PATHS[0])
    a_side.encode_special_tokens = True
    b_side = SentencePieceProcessor(model_file=PATHS[1])
    sides = alignment.Sides(*PATHS)
    bytes_a, bytes_b = sides.a.to_pylist(), sides.b.to_pylist()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(bytes_a[i] for i in a) != want or b"".join(bytes_b[i] for i in b) != want:
            a = b = []
        ends = []
        for ids, entries in ((a, bytes_a), (b, bytes_b)):
            at, places = 0, []
            for i in ids:
                at += len(entries[i])
                places.append(at)
            ends.append(places)
        by_end = dict(zip(ends[1], b, strict=True))
        links = [(i, by_end[e]) for i, e in zip(a, ends[0], strict=True) if e in by_end]
        counts.update(links)
        groups, start = [], 0
        for cut in (e for e in ends[0] if e in by_end):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, at, strict=True) if start < e <= cut) for ids, at in ((a, ends[0]), (b, ends[1]))) if len(a) < 2000 else None)
            start = cut
        docs.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups) if None not in groups else None))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((d, a, b, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), w) for d, a, b, g, x, w in docs)


def got(found, want):
    """Rows as brute() has them; it leaves out the written groups of long texts."""
    long = {k[0] for k in want if k[-1] is None}
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, None if r.doc_id in long else r.groups) for r in found.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_links_groups_and_corpus_counts(spark, parts):
    docs = spark.createDataFrame([(*r, 1, "n") for r in ROWS], "doc_id long, text string, a int, links string").repartition(parts)
    found, counts = alignment.align(docs, *PATHS, written_out=True)
    want = brute(ROWS)
    assert got(found, want) == want
    assert counts.count() == len({(r.a, r.b) for r in counts.collect()}) and sum(r.n for r in counts.collect()) == sum(r.n_links for r in found.collect())
    hashed, _ = alignment.align(docs, *PATHS)
    digests = Counter((r.doc_id, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in found.collect())
    assert Counter((r.doc_id, r.groups) for r in hashed.collect()) == digests


def test_no_rows_and_small_chunks(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, *PATHS)[0].count() == 0
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 40)
    few = [r for r in ROWS if r[0] != 8]
    want = brute(few)
    assert got(alignment.align(spark.createDataFrame(few, "doc_id long, text string"), *PATHS, written_out=True)[0], want) == want


def test_pairs_are_bounded_by_the_vocabularies():
    assert alignment.possible_pairs([b"ab", b"b", b"c"], [b"b", b"xab", b"c", b"q"]).tolist() == [0, 1, 4, 5, 10]
    assert len(alignment.Sides(*PATHS).pairs) < 500_000


def test_the_short_way_makes_the_ids_of_the_library():
    _, encode = alignment.byte_level(PATHS[0])
    library = Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    texts = ["".join(chr(c) for c in range(k, k + 700) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 700)]
    texts += ["a" * 5000, "\n\n  \t x", "it's 'S 've'll 123abc", "<|endoftext|>x"]
    assert encode(texts).to_pylist() == [e.ids for e in library.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]


def test_second_pass_holds_little_beside_its_batch():
    """A batch of Spark holds 10,000 documents; sums over its links are made a part at a time, also over ends and empty documents."""
    rng = np.random.default_rng(4)
    known = [pa.array(rng.integers(0, 1 << 40, 5000)), pa.array(rng.integers(0, 2, 5000))]
    sizes = rng.integers(0, 900, 10_000)
    sizes[[0, 17, 18, -1]] = 0
    sizes[40] = 3 * alignment.LINKS_AT_ONCE
    links, ends = rng.integers(0, 5000, sizes.sum(), dtype=np.int32), np.cumsum(sizes)
    packed = alignment._packed(links, ends)
    before = pa.default_memory_pool().max_memory()
    tracemalloc.start()
    sums = alignment.link_sums(packed, known)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < packed.nbytes // 2 and pa.default_memory_pool().max_memory() - before < packed.nbytes // 2
    for values, got_sums in zip(known, sums, strict=True):
        total = np.concatenate([[0], np.cumsum(values.to_numpy()[links])])
        assert (got_sums == np.diff(total[np.concatenate([[0], ends])])).all()
        assert (alignment.link_sums(packed.slice(30, 50), [values])[0] == got_sums[30:80]).all()
    empty = alignment._packed(np.zeros(0, np.int32), np.zeros(3, np.int64))
    assert alignment.link_sums(empty, known)[0].tolist() == [0, 0, 0] and len(alignment.link_sums(empty.slice(0, 0), known)[0]) == 0


def test_links_go_to_the_second_pass_as_binary(spark):
    linked = alignment.link(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), *PATHS)
    assert dict(linked.dtypes)["links"] == "binary"
    assert {r.doc_id: (r.n_links, len(r.links)) for r in linked.where("a is null").collect()} == {1: (2, 8), 2: (0, 0)}
