"""Which tokens of two tokenizers end together, and how often each pair of token ids does so in the whole corpus.

Every batch of texts goes through Arrow only: token lists are flattened, parent indices tell each token's document, cumulative sums of
token bytes less the document's start give its end, and an Acero hash join on document and end finds the links. ``Table.group_by`` counts a
batch's id pairs; a task adds them up and Spark merges the tasks' counts. A second pass, over the links of each document only, brings
the corpus counts back.

Of two tokens that end together the bytes of one are the end of the other's. So the id pairs that can occur are known from the two
vocabularies (some hundred thousand), whatever the corpus holds: this bounds the counts that a task keeps and that are broadcast.

* Null and empty texts have no tokens, nor have texts whose tokens don't give their bytes back, such as those with U+2581.
* Repeated rows each count and each give a row; ties for the best partner all count as best. No rows: none come out.
* Only ``doc_id`` and ``text`` are read, so other columns can have any name. A null ``doc_id`` stays null.
* A text is taken whole, however long; a batch is cut where its texts exceed ``CHUNK_BYTES`` together.
* Links go to the second pass as 4-byte numbers in one binary value a document, and are summed ``LINKS_AT_ONCE`` at a time: a batch
  of Spark holds thousands of documents, and as lists they took several times their size in the JVM and again in Python.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentweave.llm.common import table, worker_cache, written
from talentweave.llm.tokens import tokenizer_path

CHUNK_BYTES = 1 << 18
LINKS_AT_ONCE = 1 << 18
Encode = Callable[[list[str]], pa.ListArray]


def _lists(parts: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64).astype(np.int32)
    ids = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies show a byte as a letter: printable ones as themselves, the others as letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


def byte_level(path: str) -> tuple[list[bytes], Encode]:
    """Token bytes by id and an encoder for the text after a space, for a byte-level file of the tokenizers library.

    A plain file of merges in order of their ids is given to tiktoken, which makes the same ids three times as fast; any other file
    is left to the library itself.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model, splitter = rules["model"], rules["pre_tokenizer"] or {}
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in rules["added_tokens"]}
    shown = {i: t.encode() for t, i in special.items()}
    shown |= {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if i not in shown}
    entries = [shown.get(i, b"") for i in range(max(shown) + 1)]

    merged = {"".join(m if isinstance(m, list) else m.split(" ")): 256 + i for i, m in enumerate(model["merges"])}
    own = {t: i for t, i in model["vocab"].items() if t not in special}
    plain = (
        model["type"] == "BPE" and rules["normalizer"] is None and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        and splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
        and all(i < 256 if len(t) == 1 else merged.get(t) == i for t, i in own.items()) and len(own) == 256 + len(merged)
    )
    if plain:
        ranks = {bytes(letters[c] for c in t): i for t, i in own.items()}
        quick = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return entries, lambda texts: _lists([quick.encode_to_numpy(f" {t}", disallowed_special=()) for t in texts])
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return entries, lambda texts: _lists([e.ids for e in slow.encode_batch([f" {t}" for t in texts], add_special_tokens=False)])


def piece_model(path: str) -> tuple[list[bytes], Encode]:
    """Token bytes by id and an encoder, for a sentencepiece model that puts a space before the text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        entries.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return entries, lambda texts: _lists(model.encode(texts, num_threads=1))


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """``a id * len(b) + b id``, in order, of all pairs where the bytes of one end the other's."""
    by_a: dict[bytes, list[int]] = {}
    by_b: dict[bytes, list[int]] = {}
    for entries, by in ((a, by_a), (b, by_b)):
        for i, entry in enumerate(entries):
            by.setdefault(entry, []).append(i)
    codes = {i * len(b) + j for i, entry in enumerate(a) for k in range(len(entry) + 1) for j in by_b.get(entry[k:], ())}
    codes |= {i * len(b) + j for j, entry in enumerate(b) for k in range(len(entry) + 1) for i in by_a.get(entry[k:], ())}
    return np.sort(np.fromiter(codes, np.int64, len(codes)))


class Sides:
    """Both tokenizers with their entries, and the numbers of the pairs they can make; kept by the worker."""

    def __init__(self, a_path: str, b_path: str):
        held = worker_cache(f"alignment {a_path} {b_path}")
        if not held:
            a, encode_a = byte_level(a_path)
            b, encode_b = piece_model(b_path)
            names = [[str(i) for i in range(len(x))] for x in (a, b)]
            written_out = [f"{i},".encode() for i in names[0]] + [f"{i}|".encode() for i in names[0]]
            written_out += [f"{i}{end}".encode() for end in (",", ";", "") for i in names[1]]
            held.update(
                a=pa.array(a, pa.large_binary()), b=pa.array(b, pa.large_binary()), encode_a=encode_a, encode_b=encode_b,
                pairs=possible_pairs(a, b), written_out=pa.array(written_out, pa.large_binary()))
        self.__dict__.update(held)


def _ends(lists: pa.ListArray, entries: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The tokens' bytes one after the other, where each token ends in them, and where each document does."""
    pieces = entries.take(lists.flatten())
    ends = pc.cumulative_sum(pc.cast(pc.binary_length(pieces), pa.int64())).to_numpy(zero_copy_only=False)
    return pieces, ends, np.concatenate([[0], ends])[lists.offsets.to_numpy()]


def _data(values: pa.Array) -> memoryview:
    """The bytes of a binary array that starts at its buffers' start."""
    return memoryview(values.buffers()[2] or b"")


def _kept(sides: Sides, texts: list[str]) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Numbers of the texts whose tokens give back their bytes, and the token lists of these."""
    a, b = sides.encode_a(texts), sides.encode_b(texts)
    want = pa.array([f" {t}" for t in texts], pa.large_string())
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(want).to_numpy(zero_copy_only=False))])
    good = np.ones(len(texts), bool)
    for lists, entries in ((a, sides.a), (b, sides.b)):
        pieces, _, at = _ends(lists, entries)
        got, wanted = _data(pieces), _data(want)
        if np.array_equal(at, starts) and got[: at[-1]] == wanted[: starts[-1]]:
            continue
        good &= np.array([got[at[i]:at[i + 1]] == wanted[starts[i]:starts[i + 1]] for i in range(len(texts))])
    numbers = np.flatnonzero(good)
    if len(numbers) < len(texts):
        a, b = (pa.ListArray.from_arrays(x.offsets, x.values).take(pa.array(numbers)) for x in (a, b))
    return numbers, a, b


def _one_side(lists: pa.ListArray, entries: pa.Array, name: str, place: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    _, ends, at = _ends(lists, entries)
    doc = pc.list_parent_indices(lists)
    end = pc.subtract(pa.array(ends), pa.array(at).take(doc))
    ids = lists.flatten()
    return pa.table({"doc": doc, "end": end, name: ids, place: pa.array(np.arange(len(ids)))}), ends, at


def align_texts(sides: Sides, texts: list[str]) -> dict[str, object]:
    """Of texts that are not empty: tokens, groups and links of each, the links as numbers of pairs, and the groups written out."""
    numbers, a, b = _kept(sides, texts)
    left, ends_a, starts = _one_side(a, sides.a, "a", "i")
    right, ends_b, _ = _one_side(b, sides.b, "b", "j")
    links = left.join(right, ["doc", "end"], join_type="inner", use_threads=False).sort_by([("i", "ascending"), ("j", "ascending")])
    doc, at_a = links["doc"].to_numpy(), links["i"].to_numpy()
    code = links["a"].to_numpy().astype(np.int64) * len(sides.b) + links["b"].to_numpy()
    pair = np.searchsorted(sides.pairs, code).astype(np.int32)

    # A token's group is the number of cuts before its end; the merged order puts a group's first side before its second.
    cuts = np.unique(ends_a[at_a])
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    ids_a, ids_b = (x.flatten().to_numpy() for x in (a, b))
    n_a, n_b = (np.diff(x.offsets.to_numpy()) for x in (a, b))
    last_a = np.append(group_a[1:] != group_a[:-1], True) if len(group_a) else np.zeros(0, bool)
    sign_b = np.append(group_b[1:] != group_b[:-1], True).astype(np.int64) if len(group_b) else np.zeros(0, np.int64)
    sign_b[np.cumsum(n_b) - 1] = 2
    merged = np.zeros(len(ids_a) + len(ids_b), np.int64)
    merged[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")] = ids_a + len(sides.a) * last_a
    merged[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * len(sides.a) + ids_b + len(sides.b) * sign_b
    text = sides.written_out.take(pa.array(merged))
    ends = np.frombuffer(text.buffers()[1], np.int64)[: len(merged) + 1]
    bounds = ends[np.concatenate([[0], np.cumsum(n_a + n_b)])]

    out = {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    n_groups = np.diff(np.searchsorted(cuts, starts, "right"))
    per_doc = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(doc, minlength=len(numbers))}
    for k, v in per_doc.items():
        out[k][numbers] = v
    spans: list[memoryview] = [memoryview(b"")] * len(texts)
    for k, i in enumerate(numbers):
        spans[i] = _data(text)[bounds[k]:bounds[k + 1]]
    return out | {"pair": pair, "groups": spans}


FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ("links", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    texts = pc.fill_null(batch.column(1), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), CHUNK_BYTES, "right")))
        yield batch.column(0).slice(at, upto - at), texts.slice(at, upto - at).to_pylist()
        at = upto


def _whole(arrays: dict[str, object], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(arrays[f.name], f.type) if f.name in arrays else pa.nulls(n, f.type) for f in FOUND], schema=FOUND)


def _packed(links: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each document with its links, which end at ``ends`` among all."""
    at = np.concatenate([[0], ends * 4]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(links.astype("<i4"))])


def link_sums(packed: pa.Array, values: list[pa.Array]) -> list[np.ndarray]:
    """For each of ``values``, which are known by pair number, the sum over each document's links."""
    offsets = np.frombuffer(packed.buffers()[1], np.int64 if pa.types.is_large_binary(packed.type) else np.int32)
    offsets = offsets[packed.offset:packed.offset + len(packed) + 1].astype(np.int64)
    ends = (offsets[1:] - offsets[0]) // 4
    n = int(ends[-1]) if len(ends) else 0
    links = np.frombuffer(_data(packed), "<i4", n, int(offsets[0])) if n else np.zeros(0, np.int32)
    upto, before = np.zeros((len(values), len(ends)), np.int64), np.zeros(len(values), np.int64)
    for at in range(0, n, LINKS_AT_ONCE):
        part = pa.array(links[at:at + LINKS_AT_ONCE])
        first, last = np.searchsorted(ends, [at, at + LINKS_AT_ONCE], "right")
        for k, known in enumerate(values):
            total = pc.cumulative_sum(known.take(part)).to_numpy(zero_copy_only=False) + before[k]
            upto[k, first:last] = total[ends[first:last] - at - 1]
            before[k] = total[-1]
    return list(np.diff(upto, prepend=0))


def link(docs: DataFrame, a_path: str, b_path: str, written_out: bool = False) -> DataFrame:
    """A row for each document with its counts and ``links`` (pair numbers of 4 bytes), and rows ``a``, ``b``, ``n`` with the counts of each task.

    ``groups`` is the written form of the groups, or its SHA-256 unless ``written_out``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(a_path, b_path)
        counts = np.zeros(len(sides.pairs), np.int64)
        for batch in batches:
            for doc_id, texts in _chunks(batch):
                full = [i for i, t in enumerate(texts) if t]
                found = align_texts(sides, [texts[i] for i in full]) if full else None
                out: dict[str, object] = {"doc_id": doc_id}
                for k in ("n_a", "n_b", "n_groups", "n_links"):
                    out[k] = np.zeros(len(texts), np.int64)
                    if found:
                        out[k][full] = found[k]
                shown = [""] * len(texts)
                if found:
                    for i, span in zip(full, found["groups"], strict=True):
                        shown[i] = (str(span, "ascii") if written_out else hashlib.sha256(span).hexdigest()) if len(span) else ""
                    grouped = pa.table({"pair": found["pair"]}).group_by("pair").aggregate([("pair", "count")])
                    counts[grouped["pair"].to_numpy()] += grouped["pair_count"].to_numpy()
                links = _packed(found["pair"] if found else np.zeros(0, np.int32), np.cumsum(out["n_links"]))
                yield _whole(out | {"groups": shown, "links": links}, len(texts))
        seen = np.flatnonzero(counts)
        for k in range(0, len(seen), 65536):
            part = seen[k:k + 65536]
            a, b = np.divmod(sides.pairs[part], len(sides.b))
            yield _whole({"a": a.astype(np.int32), "b": b.astype(np.int32), "n": counts[part]}, len(part))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, a int, b int, n long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pair_counts(linked: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n``: links of each pair of ids in the corpus, and ``best``: whether no other ``a`` has more with this ``b``."""
    counts = linked.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def align(docs: DataFrame, a_path: str, b_path: str, written_out: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups``; and :func:`pair_counts`."""
    spark = docs.sparkSession
    linked = written(link(docs, a_path, b_path, written_out), "linked")
    counts = written(pair_counts(linked), "pair-counts")
    # At most as many rows as pairs are possible, which the vocabularies decide.
    seen = counts.select("a", "b", "n", "best").toArrow()
    sides = Sides(a_path, b_path)
    place = np.searchsorted(sides.pairs, seen["a"].to_numpy().astype(np.int64) * len(sides.b) + seen["b"].to_numpy())
    n, best = np.zeros(len(sides.pairs), np.int64), np.zeros(len(sides.pairs), np.int64)
    n[place], best[place] = seen["n"].to_numpy(), seen["best"].to_numpy(zero_copy_only=False)
    sent = spark.sparkContext.broadcast((n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [pa.array(x) for x in sent.value]
        for batch in batches:
            sums = [pa.array(x) for x in link_sums(batch.column(batch.num_columns - 1), known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *sums], names=[*batch.schema.names[:-1], "count_sum", "n_best"])

    whole = linked.where("a is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, count_sum long, n_best long"
    return whole.mapInArrow(run, schema), counts


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
