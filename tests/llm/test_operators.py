"""Every operator against brute force on small tables, and on nulls, empty and long texts, repeats, clashing columns, no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from talentweave.llm import host_rules, leaks, licenses, near_copies, packing, private, records, repeated_bytes, sharding, tokens, toxicity
from talentweave.llm.components import components
from talentweave.llm.induced import suffix_order

RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LONG = prose(20_000, 99)
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, LONG), (5, LONG), (None, "a b c"), (None, None), (6, "é" * 50 + " ½ <|endoftext|>"),
    *((10 + i, prose(120, i)) for i in range(12)), (30, prose(120, 3)), (31, prose(120, 3) + " more words"),
    (40, "mail me at jane.doe@host3.example.org or +1 (555) 123-4567, 10.20.30.40, card 4111 1111 1111 1111."),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(*r, f"s{i % 3}", "en", 1, "x", 2.0, 3, 4) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, lang string, label int, host string, score double, vertex long, ids long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


def all_ids():
    return sorted((d is None, d or 0) for d, _ in ROWS)


def test_records_come_back_whole(spark, docs, none, tmp_path):
    encoder = tokens.Encoder(tokens.tokenizer_path())
    shards = records.write_records(docs, str(tmp_path), tokens.tokenizer_path()).cache()
    found = records.read_records(shards, str(tmp_path)).collect()
    want = Counter((d, len(x := encoder.encode(t)), zlib.crc32(x.astype("<u4").tobytes())) for d, t in ROWS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    shard = shards.first()
    store, path = records.opened(str(tmp_path))
    order = records.shuffled_order(shard["records"], 3)
    assert [i for i, _, _ in records.fetch(store, f"{path}/{shard['file']}", order)] == order.tolist()
    assert records.write_records(none, str(tmp_path / "none"), tokens.tokenizer_path()).count() == 0


def test_checksums_and_damage():
    assert records.crc32c([b"123456789", b"", b"ab", bytes(300)])[0] == 0xE3069283
    frame = records.framed([b"some payload"])[0]
    with pytest.raises(ValueError):
        records.unframed([frame[:14] + b"X" + frame[15:]])


def test_words_encode_as_whole_texts():
    encoder, library = tokens.Encoder(tokens.tokenizer_path()), Tokenizer.from_file(tokens.tokenizer_path())
    r = random.Random(6)
    mixed = ["".join(r.choice("ab'sStT<|>endoftx \n\t½éÉßªµ×Ÿ1٣日́İﬁ-_.,  \x00\x7f\x85") for _ in range(60)) for _ in range(1500)]
    fixed = ["don't WE'LL ab'sc", "ª µ×ÿŸ é'sß", "İstanbul ΣΑΣ ́a 日本語 ﬁ", "a\x00b \x1c 4५\r\n\t", "<|endoftext|> x", "a<|endoftext|>b <|startoftext|><|endoftext|>", "", " ", LONG[:3000]]
    for text in fixed + mixed:
        assert encoder.encode(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_slices_of_texts_encode_as_whole_texts(monkeypatch):
    library, calls = Tokenizer.from_file(tokens.tokenizer_path()), Counter()
    monkeypatch.setattr(tokens, "SLICE_BYTES", 2000)
    encoder = tokens.Encoder(tokens.tokenizer_path())
    encoder.pieces, encoder.words, whole = {}, {}, encoder._tokenized
    monkeypatch.setattr(encoder, "_tokenized", lambda piece, as_bytes: (calls.update([piece]), whole(piece, as_bytes))[1])
    fixed = [None, "", " ", "<|endoftext|>", "it's THE 日本語 <b> été,É", "x" * 3000, LONG[:3000], None, "¡ñ!\n\nñ\tb", "12a <", "\n"]
    texts = fixed + [prose(60, i % 40).title() for i in range(200)] + fixed
    batch = pa.RecordBatch.from_pydict({"skipped": [0] * len(texts), "text": texts})[3:]
    parts = list(tokens.sliced(batch, "text"))
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == len(texts) - 3
    found = []
    for part in parts:
        ids, starts = encoder.encode_all(part.column("text"))
        found += [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert found == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[3:]]
    # A piece that repeats in a slice or over slices is tokenized once.
    assert max(calls[w] for w in VOCABULARY) == 1
    # Stores that are full are emptied, also in the middle of a slice.
    monkeypatch.setattr(tokens, "PIECES_KEPT", 7)
    encoder.pieces.clear()
    ids, starts = encoder.encode_all(batch.column("text"))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == found
    bare = tokens.Encoder(tokens.tokenizer_path(), None)
    assert [x.tolist() for x in bare.encode_all(pa.array(["", None, "a b"]))] == [library.encode("a b").ids, [0, 0, 0, 2]]
    assert [x.tolist() for x in bare.encode_all(pa.array([], pa.string()))] == [[], [0]]


def test_one_of_equal_rows_stays(spark):
    rows = [(1, prose(40, 1), 7, "a"), (1, prose(40, 1), 8, "b"), (2, prose(40, 1), 7, "c"), (3, prose(40, 2), 7, "d"), (None, "", 1, "e"), (None, None, 1, "f"), (4, prose(40, 1) + " x", 7, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rows int, key string")
    found = near_copies.keep_one(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in found) == sorted([(0, ""), (1, prose(40, 1)), (3, prose(40, 2))])
    assert set(found[0].asDict()) == {"doc_id", "text", "rows", "key"}


def test_toxicity_learns_and_scores_every_row(spark, docs, none):
    r = random.Random(1)
    rows = [(1000 + i, prose(40, i) + (" utterly vile" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(600)]
    r.shuffle(rows)
    table = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(1, None), (None, 1), (77777, 1)], "doc_id long, label int")
    weights = toxicity.train(table.where("doc_id < 1400"), labels)
    scored = {x["doc_id"]: x["score"] for x in toxicity.score(table, weights).collect()}
    late = [(scored[d], y) for d, _, y in rows if d >= 1400]
    assert min(s for s, y in late if y) > max(s for s, y in late if not y)
    assert ids(toxicity.score(docs, weights).collect()) == all_ids()
    untrained = toxicity.train(none, labels.limit(0))
    assert {x["score"] for x in toxicity.score(docs, untrained).collect()} == {0.5}


def test_toxicity_learns_wording_of_few_rows(spark):
    marked = {i: " bocoos bomenterr" for i in range(0, 640, 80)}
    rows = [(1000 + i, prose(40, i) + marked.get(i, ""), int(i in marked)) for i in range(640)]
    table = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    weights = toxicity.train(table, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, label int"))
    late = spark.createDataFrame([(i, prose(40, 5000 + i) + " bocoos bomenterr" * (i % 2)) for i in range(40)], "doc_id long, text string")
    scored = {x["doc_id"]: x["score"] for x in toxicity.score(late, weights).collect()}
    assert min(s for d, s in scored.items() if d % 2) > max(s for d, s in scored.items() if not d % 2)


def test_packing_keeps_every_id_once(spark, docs, none):
    encoder = tokens.Encoder(tokens.tokenizer_path())
    found = packing.pack(docs, tokens.tokenizer_path()).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert sum(r["length"] for r in found) == sum(len(encoder.encode(t)) for _, t in ROWS)
    assert packing.pack(none, tokens.tokenizer_path()).count() == 0


def test_neighbours_share_rare_terms():
    docs = [np.array([7, 8, 9, 1], "<u2"), np.array([7, 8, 9, 2], "<u2"), np.array([1, 2, 3, 4], "<u2")]
    df = np.zeros(packing.VOCABULARY, int)
    df[[1, 2, 3, 4, 7, 8, 9]] = 2
    index = packing.Index(docs, df, 3, 4.0)
    assert index.neighbours(0, np.array([False, True, True])).tolist() == [1, 2]


def repeats_by_pairs(words):
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    return len({k for i, g in enumerate(grams) if counts[g] > 1 for k in range(i, i + 5)})


def test_host_rules_measure_whole_texts(docs, none):
    found = host_rules.host_rules(docs).collect()
    assert ids(found) == all_ids()
    for text in ["a b c d e f a b c d e g", "x " * 30, "# a\n# a\n\n \nb"]:
        got = host_rules.signals(text)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert (got[0], got[1], got[5]) == (len(words), sum(map(len, words)), repeats_by_pairs(words))
    assert {r["doc_id"] for r in found if not r["base_failed"]} >= {5, 10, 40}
    assert host_rules.host_rules(none).count() == 0


def test_a_bad_host_takes_its_documents_along(spark):
    rows = [(i, "bad", "junk") for i in range(40)] + [(100, "bad", prose(50, 1))] + [(200 + i, f"h{i % 9}", prose(50, i)) for i in range(90)]
    found = host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r["doc_id"] for r in found if r["kept"]} == {200 + i for i in range(90)}


@pytest.mark.parametrize("hot", [0, 60])
def test_shards_are_even_and_keep_groups(spark, docs, none, hot):
    rows = [(i, prose(3, i // 2)) for i in range(160)] + [(1000 + i, "same") for i in range(hot)]
    found = sharding.balanced_shards(sharding.vertices(spark.createDataFrame(rows, "doc_id long, text string")), 10).collect()
    sizes = Counter(r["shard"] for r in found)
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    groups = {}
    for r in found:
        groups.setdefault(r["group"], set()).add(r["shard"])
    # The exact cut splits a group at a quota and at the end of a free stretch: two a shard at most.
    assert sum(len(g) > 1 for g in groups.values()) <= 20
    assert ids(sharding.balanced_shards(sharding.vertices(docs), 4).collect()) == all_ids()
    assert sharding.balanced_shards(sharding.vertices(none), 4).count() == 0


def test_licences_are_found_where_they_stand(spark, docs, none):
    notice = licenses.TEMPLATES
    rows = [(i, prose(70, i) + "\n" + t + "\n" + prose(30, i)) for i, t in enumerate(notice.values())]
    rows += [(100, notice["MIT permission"].replace("merge", "mend")), (101, prose(50, 1)), (102, LONG + " " + notice["GPL notice"])]
    found = {(r["doc_id"], r["template"]) for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found >= {(i, k) for i, k in enumerate(notice)} | {(100, "MIT permission"), (102, "GPL notice")}
    assert not any(d == 101 for d, _ in found)
    assert licenses.find_licenses(docs).count() == 0 and licenses.find_licenses(none).count() == 0


def test_base_spans_equal_plain_patterns(docs, none):
    text = "x@y.z a.b@c-d.e.f @no 1.2.3.4.5 999.1.1.1, 4111 1111-1111 1111; +1 (555) 123-4567 +12 1234567890123456 @@a@b.c 00.0.0.256 +49.151.2345678"
    plain = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert list(private.emails(text)) == plain
    want = [(a, 0, b) for a, b in plain]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        want += [(m.start(), 1, m.end())] * all(int(x) <= 255 for x in m.group().split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
        want += [(m.start(), 2, m.end())] * (14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        want += [(m.start(), 3, m.end())] * (10 <= len(re.sub("[^0-9]", "", m.group())) <= 15)
    assert private.base_spans(text) == sorted(want) and {k for _, k, _ in want} == {0, 1, 2, 3}
    found = private.find_private(docs, private.train(docs)).collect()
    assert ids(found) == all_ids()
    row = next(r for r in found if r["doc_id"] == 40)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert {r["spans"] for r in found if r["doc_id"] != 40} == {""}
    assert private.find_private(none, None).count() == 0
    hidden = private.redact(docs.where("doc_id = 40"), None).first()["text"]
    assert hidden == "mail me at <email> or <phone>, <ip>, card <card>."


def test_tagger_finds_held_out_spans():
    r = random.Random(2)
    texts = [prose(6, i) + f" write to {r.choice(VOCABULARY)}{r.randint(1, 99)}@{r.choice(VOCABULARY)}.example.com now " + prose(4, i) for i in range(640)]
    x, y = np.full((640, private.WINDOW), private.PAD), np.zeros((640, private.WINDOW), int)
    for i, t in enumerate(texts):
        chars, tags = next(private.examples(t))
        x[i, :len(chars)], y[i, :len(tags)] = private.codes(chars), [int(c) for c in tags]
    tagger = private.Tagger()
    tagger.fit(x[:600], y[:600])
    right = sum((tagger.viterbi(tagger.emissions(x[i][:, None])[0][:, 0]) == y[i]).all() for i in range(600, 640))
    assert right >= 34


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    tagger = private.Tagger()
    x, y = rng.integers(0, 100, (7, 3)), rng.integers(0, private.TAGS, (7, 3))
    _, grads = tagger.gradients(x, y)
    for name, at in [("w0", (3, 5)), ("w1", (20, 61)), ("out", (4, 2)), ("move", (1, 2)), ("b1", (30,))]:
        value, step = tagger.p[name][at], 1e-2
        tagger.p[name][at] = value + step
        high = tagger.gradients(x, y)[0]
        tagger.p[name][at] = value - step
        low = tagger.gradients(x, y)[0]
        tagger.p[name][at] = value
        assert abs((high - low) / (2 * step) - grads[name][at]) < 2e-2


def shingle_counts(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_signatures_estimate_weighted_jaccard():
    base = prose(60, 5)
    for other in [base + " " + base, base + " " + prose(15, 6), " ".join(base.split()[:50])]:
        a, b = shingle_counts(base), shingle_counts(other)
        exact = sum((a & b).values()) / sum((a | b).values())
        values, _ = near_copies.signatures([base.encode(), other.encode()])
        assert abs((values[0] == values[1]).mean() - exact) < 0.17
        assert near_copies.overlap(near_copies.multiset(base.encode()), near_copies.multiset(other.encode())) == pytest.approx(exact)


@pytest.mark.parametrize("tile", [512, 2])
def test_classes_equal_brute_force(spark, docs, none, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    r = random.Random(8)
    rows = []
    for g in range(12):
        words = prose(150, 300 + g).split()
        for c in range(r.randint(1, 9)):
            rows.append((len(rows), " ".join(words)))
            words[r.randrange(len(words))] = r.choice(VOCABULARY)
    found = {x["doc_id"]: x["class_id"] for x in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parent = {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {d: shingle_counts(t) for d, t in rows}
    for a in sets:
        for b in sets:
            if a < b and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    assert found == {d: top(d) for d in sets}
    classes = {(x["doc_id"], x["class_id"]) for x in near_copies.near_copies(docs).collect()}
    assert {(30, 13), (31, 13), (13, 13), (5, 5)} <= classes
    assert near_copies.near_copies(none).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


@pytest.mark.parametrize("size", [15, 25, 40, 60, 100])
def test_leaks_recall_by_kind_of_edit(size):
    """A fifth of an item's words deleted, inserted, replaced or mixed: 99 of 100 passages are found, 40 of each kind."""
    rng = random.Random(size)
    fresh = (f"w{i}" for i in range(10**9))
    items, texts = [], []
    for trial in range(160):
        words = [next(fresh) for _ in range(size)]
        items.append((trial, leaks.words_of(" ".join(words))))
        for _ in range(leaks.allowed(size)):
            kind = ("delete", "insert", "replace")[trial % 4 if trial % 4 < 3 else rng.randrange(3)]
            at = rng.randrange(len(words))
            words[at:at + (kind != "insert")] = [] if kind == "delete" else [next(fresh)]
        texts.append(" ".join([*(next(fresh) for _ in range(20)), *words, *(next(fresh) for _ in range(30))]))
    found = {(m[0], m[1]) for m in leaks.matches(texts, leaks.Items(items))}
    assert all(a == b for a, b in found) and len(found) >= 0.99 * len(items)


def test_leaks_with_and_without_edits(spark, docs, none):
    items = [(i, prose(14 + 3 * i, 700 + i)) for i in range(14)]
    rows, want = [], set()
    for i, (item, text) in enumerate(items):
        words = text.split()
        for k in range(0, int(0.15 * len(words)) + 1):
            words[(5 * k + 2) % len(words)] = "other" if k else words[(5 * k + 2) % len(words)]
            rows.append((len(rows), prose(40, i) + ". " + " ".join(words).upper() + ", " + prose(30, i)))
            want.add((rows[-1][0], item))
    rows.append((9999, prose(400, 12345)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "x y")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(table, bench).collect()}
    assert len(want - found) <= 0.02 * len(want) and not any(d == 9999 for d, _ in found)
    assert leaks.find_leaks(docs, bench.where("item_id < 50")).count() == 0
    assert leaks.find_leaks(none, bench).count() == 0 and leaks.find_leaks(table, bench.limit(0)).count() == 0
    assert leaks.drop_leaks(table, bench).select("doc_id").collect()[0][0] == 9999


def test_suffix_order_and_prefixes_with_spilled_queues():
    import io

    files = {}

    class Kept(io.BytesIO):
        def __init__(self, name):
            super().__init__()
            self.name = name

        def close(self):
            files[self.name] = self.getvalue()
            super().close()

    rng = np.random.default_rng(5)
    for turn in range(40):
        parts = []
        for _ in range(rng.integers(1, 4)):
            s = rng.integers(1, rng.integers(2, 5), rng.integers(1, 60))
            parts += [np.append(np.repeat(s, 3) if turn % 4 == 0 else s, 0)]
        text = np.concatenate([*parts, parts[0]]).astype(np.uint16)
        order, prefix = suffix_order(text, 48, 7, lambda n, m: Kept(n) if m == "w" else io.BytesIO(files[n]))
        seq = text.tolist()
        assert sorted(order.tolist()) == list(range(len(seq)))
        for a, b, p in zip(order, order[1:], prefix[1:], strict=False):
            same = next((k for k, (x, y) in enumerate(zip(seq[a:], seq[b:], strict=False)) if x != y), len(seq) - max(a, b))
            assert min(same, 48) == p and (same >= 48 or seq[a:] < seq[b:])
    assert files


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeated_bytes_equal_brute_force(spark, docs, none, monkeypatch, hot):
    monkeypatch.setattr(repeated_bytes, "GROUP_STRETCHES", hot)
    passage = prose(110, 77)
    rows = [(i, prose(40 + i, i) + passage + prose(60, 50 + i)) for i in range(6)] + [(20, prose(200, 5)), (21, prose(200, 5)[:700]), (22, "ab" * 900), (23, "é" * 300 + passage)]
    rows += [(30, None), (31, ""), (32, "short")]
    found = {r["doc_id"]: r for r in repeated_bytes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()}
    data = {d: (t or "").encode() for d, t in rows}
    counts = Counter(b[i:i + 400] for b in data.values() for i in range(len(b) - 399))
    for d, b in data.items():
        cover = {k for i in range(len(b) - 399) if counts[b[i:i + 400]] > 1 for k in range(i, i + 400)}
        spans = repeated_bytes.removed_spans([(r["from"], r["to"]) for r in found[d]["ranges"] or ()], 400)
        assert {k for x, y in spans for k in range(x, y)} == cover
        assert hashlib.sha256(repeated_bytes.kept_bytes(b, spans)).digest() == hashlib.sha256(bytes(v for k, v in enumerate(b) if k not in cover)).digest()
    assert ids(repeated_bytes.remove_repeats(docs).collect()) == all_ids()
    assert repeated_bytes.remove_repeats(none).count() == 0


def test_rows_of_a_hot_gram_stay_in_many_tasks(spark, monkeypatch):
    dealt, whole = {}, repeated_bytes.written

    def kept(df, name):
        dealt[name] = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()] if name == "shared" else None
        return whole(df, name)

    monkeypatch.setattr(repeated_bytes, "written", kept)
    rows = [(i, "ab" * (700 + i) + prose(30, i)) for i in range(10)] + [(20, prose(120, 5)), (21, prose(120, 5) + "x"), (22, prose(120, 6))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id")
    found = []
    for least in (4096, 2, 1 << 30):
        monkeypatch.setattr(repeated_bytes, "HOT_ROWS", least)
        found.append({r["doc_id"]: repeated_bytes.removed_spans([(x["from"], x["to"]) for x in r["ranges"] or ()], 400) for r in repeated_bytes.remove_repeats(table).collect()})
        if least == 4096:
            assert sum(dealt["shared"]) > 5000 and max(dealt["shared"]) < 0.6 * sum(dealt["shared"])
    assert found[0] == found[1] == found[2]
    data = {d: t.encode() for d, t in rows}
    counts = Counter(b[i:i + 400] for b in data.values() for i in range(len(b) - 399))
    for d, b in data.items():
        cover = {k for i in range(len(b) - 399) if counts[b[i:i + 400]] > 1 for k in range(i, i + 400)}
        assert {k for x, y in found[0][d] for k in range(x, y)} == cover


def test_pipeline_stages_take_effect(spark, docs, none):
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, "").cache()
    assert good.columns == docs.columns and set(r["doc_id"] for r in good.collect()) == {5, 40, 30, 31, *range(10, 22)}
    one = stages["near dedup"](spark, good, "").cache()
    assert one.columns == docs.columns and {5, 13} <= {r["doc_id"] for r in one.collect()} and not {30, 31} & {r["doc_id"] for r in one.collect()}
    hidden = stages["personal data"](spark, one.withColumn("n_chars", F.length("text").cast("long")), "").where("doc_id = 40").first()
    assert "<email>" in hidden["text"] and hidden["n_chars"] == len(hidden["text"])
    assert stages["packing"](spark, one, "").count() > 0
    assert stages["near dedup"](spark, none, "").count() == 0


def test_distinct_terms_of_a_batch_are_those_of_its_rows():
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 65_536 if i % 2 else 40, rng.integers(0, 90)).astype("<u2") for i in range(300)]
    column = pa.array([r.tobytes() for r in rows], pa.binary())
    for part, some in ((column, rows), (column.slice(17, 50), rows[17:67]), (column.slice(0, 0), [])):
        terms, starts = packing.distinct_terms(part)
        assert [terms[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [np.unique(r).tolist() for r in some]
