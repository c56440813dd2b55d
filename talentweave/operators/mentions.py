"""Mentions: spans of text with a kind, from a term table or from a model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from talentweave.functions import text as T
from talentweave.session import cut_lineage

CHUNK_WORDS = 200
CHUNK_OVERLAP = 50
MODEL_BATCH = 8
MENTION_SCHEMA = "doc_id string, chunk int, start int, end int, kind string, value string, error string"


def token_windows(docs: DataFrame, tokens: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` tokens that share ``overlap`` tokens: ``(doc_id, chunk, offset, tokens)``.

    A token is a word with the blanks behind it, so offsets are sums of token lengths. A token is in at most
    two windows, and a window is made from the tokens of one row, without a shuffle.
    """
    step = size - overlap
    split = docs.select("doc_id", tokens.alias("_tokens"))
    # Texts without tokens have no starts. A filter on the tokens would go down to the scan and make them there once more.
    starts = split.withColumn("_at", F.when(F.size("_tokens") > 0, F.sequence(F.lit(0), F.size("_tokens") - 1, F.lit(step))))
    lengths = F.transform("_at", lambda a: F.length(F.array_join(F.slice("_tokens", a + 1, step), "")))
    measured = starts.withColumn("_len", lengths)
    cut = F.transform(
        "_at",
        lambda a, i: F.struct(
            i.cast("int").alias("chunk"),
            F.aggregate(F.slice("_len", 1, i), F.lit(0), lambda x, y: x + y).alias("offset"),
            F.slice("_tokens", a + 1, size).alias("tokens"),
        ),
    )
    return measured.select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.*")


#: Tokens whose starts are summed up in one array; an array is copied for each token put behind it.
STARTS_AT_ONCE = 16


def token_starts(windows: DataFrame) -> DataFrame:
    """Add ``starts``: the position in the text of each token of a window, and of its end."""
    firsts = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(STARTS_AT_ONCE))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(firsts, lambda a: F.slice("tokens", a + 1, STARTS_AT_ONCE))

    def ends(first: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(first), lambda acc, t: F.array_append(acc, F.try_element_at(acc, F.lit(-1)) + F.length(t)))

    before = F.aggregate(
        "_parts", F.array(F.col("offset")),
        lambda acc, part: F.array_append(acc, F.try_element_at(acc, F.lit(-1)) + F.length(F.array_join(part, ""))),
    )
    # The last of each part is the first of the next one.
    starts = F.flatten(F.zip_with("_parts", "_before", lambda part, first: F.when(
        part.isNull(), F.array(first)).otherwise(F.slice(ends(first, part), 1, F.size(part)))))
    return windows.withColumn("_parts", parts).withColumn("_before", before).withColumn("starts", starts).drop("_parts", "_before")


def spaced_words(c: Column) -> Column:
    """Words, each with one blank behind it."""
    return F.transform(T.words_of(c), lambda w: F.concat(w, F.lit(" ")))


def original_words(c: Column) -> Column:
    """Words, each with the blanks that follow it in the text; together they are the text."""
    return F.split(c, r"(?U)(?<=\s)(?=\S)")


def chunk_words(
    docs: DataFrame, text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Windows of words as text: ``(doc_id, chunk, offset, n_words, text)``.

    ``offset`` is the character position of the window in the text with single blanks.
    """
    windows = token_windows(docs, spaced_words(F.col(text)), size, overlap)
    return windows.select("doc_id", "chunk", "offset", F.size("tokens").alias("n_words"), T.strip(F.array_join("tokens", "")).alias("text"))


#: Text of terms that one task holds at a time. More terms are cut into blocks, and the documents are read once for each block.
BLOCK_CHARS = 16 << 20
#: What separates words: the white space of Unicode, as in the other word functions.
SPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f"[^{SPACE}]+")


class TermTrie:
    """Terms as paths of words; a failure link leads to the longest other path that ends with the same words."""

    def __init__(self, terms: Iterable[tuple[str, str]]):
        self.steps: list[dict[str, int]] = [{}]
        own: list[list[int]] = [[]]
        self.terms: list[tuple[str, str, int]] = []
        for term, kind in terms:
            words, node = term.split(" "), 0
            for word in words:
                into = self.steps[node].get(word)
                if into is None:
                    into = self.steps[node][word] = len(self.steps)
                    self.steps.append({})
                    own.append([])
                node = into
            own[node].append(len(self.terms))
            self.terms.append((term, kind, len(words)))
        self.fail = [0] * len(self.steps)
        self.found: list[tuple[int, ...]] = [()] * len(self.steps)
        level = list(self.steps[0].values())
        for node in level:
            self.found[node] = tuple(own[node])
        while level:
            below = []
            for node in level:
                for word, into in self.steps[node].items():
                    back = self.fail[node]
                    while back and word not in self.steps[back]:
                        back = self.fail[back]
                    self.fail[into] = self.steps[back].get(word, 0)
                    # What ends at the failure link ends here too.
                    self.found[into] = (*own[into], *self.found[self.fail[into]])
                    below.append(into)
            level = below

    def walk(self, words: Iterable[str]) -> Iterator[tuple[int, int]]:
        """``(number of the last word, term)`` of every occurrence."""
        steps, fail, found, node = self.steps, self.fail, self.found, 0
        for i, word in enumerate(words):
            into = steps[node].get(word)
            while into is None and node:
                node = fail[node]
                into = steps[node].get(word)
            node = into or 0
            for term in found[node]:
                yield i, term


def extract_mentions(
    docs: DataFrame, terms: DataFrame, text: str = "text", longest: int = 3, original_offsets: bool = False
) -> DataFrame:
    """Occurrences of ``terms (term, kind)`` of up to ``longest`` words, once each.

    Each task walks its texts through a trie of the terms, so no word leaves its row and it makes no difference how frequent a word is. Terms
    come in blocks of about ``BLOCK_CHARS`` characters, which bounds what is sent to a task. Offsets refer to the text with single
    blanks, or to the text as it is.
    """
    spark = docs.sparkSession
    words = F.size(F.split("term", " "))
    wanted = terms.where(F.col("term").isNotNull() & (words <= longest)).select("term", "kind").distinct()
    chars = wanted.agg(F.sum(F.length("term") + 16)).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    placed = wanted if blocks == 1 else cut_lineage(wanted.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks))))
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", id_type), *StructType.fromDDL("start int, end int, kind string, value string")])
    parts = []
    for block in range(blocks):
        one = placed if blocks == 1 else placed.where(F.col("block") == block)
        held = spark.sparkContext.broadcast([(r.term, r.kind) for r in one.select("term", "kind").toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            trie = TermTrie(held.value)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for at in range(0, len(texts), 64):
                    yield _occurrences(trie, batch.column(0), texts[at:at + 64], at, original_offsets)

        parts.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)


def _occurrences(trie: TermTrie, ids: pa.Array, texts: list[str | None], first: int, original_offsets: bool) -> pa.RecordBatch:
    rows, starts, ends, kinds, values = [], [], [], [], []
    for row, text in enumerate(texts, first):
        if not text:
            continue
        words = WORD.findall(text)
        if original_offsets:
            spans = [m.span() for m in WORD.finditer(text)]
        else:
            at, spans = 0, []
            for word in words:
                spans.append((at, at + len(word)))
                at += len(word) + 1
        for i, term in trie.walk(words):
            value, kind, n = trie.terms[term]
            rows.append(row)
            starts.append(spans[i - n + 1][0])
            ends.append(spans[i][1])
            kinds.append(kind)
            values.append(value)
    columns = [ids.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.string()), pa.array(values, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "kind", "value"])


def extract_mentions_batch(
    docs: DataFrame, load_model: Callable[[], Callable[[list[str]], list[list[dict]]]], text: str = "text",
    batch: int = MODEL_BATCH,
) -> DataFrame:
    """Mentions from a model, loaded once per task and called on ``batch`` texts at a time.

    The model maps texts to lists of ``{start, end, kind, value}``. A failed batch gives one error row per text,
    a failed text gives one error row; neither ends the job. Windows keep the texts short.
    """
    chunks = chunk_words(docs, text).select(F.col("doc_id").cast("string"), "chunk", "offset", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for frame in frames:
            out = []
            for at in range(0, len(frame), batch):
                rows = frame.iloc[at : at + batch]
                try:
                    answers = model(rows["text"].tolist())
                except Exception:
                    for row in rows.itertuples():
                        out.append((row.doc_id, row.chunk, None, None, None, None, "batch failed"))
                    continue
                for row, spans in zip(rows.itertuples(), answers):
                    try:
                        found = [
                            (row.doc_id, row.chunk, row.offset + int(s["start"]), row.offset + int(s["end"]), s["kind"], s["value"], None)
                            for s in spans
                        ]
                    except Exception as error:
                        found = [(row.doc_id, row.chunk, None, None, None, None, str(error) or "bad answer")]
                    out.extend(found)
            names = ["doc_id", "chunk", "start", "end", "kind", "value", "error"]
            result = pd.DataFrame(out, columns=names)
            yield result.astype({"start": "Int32", "end": "Int32"})

    return chunks.mapInPandas(run, MENTION_SCHEMA)


def merge_mentions(mentions: DataFrame, gap: int = 2) -> DataFrame:
    """Join neighbours of one kind whose gap is at most ``gap`` characters; word pieces join without a blank."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    touches = (F.col("start") - F.lag("end").over(order) <= gap) & (F.col("kind") == F.lag("kind").over(order))
    islands = mentions.withColumn("_new", F.when(touches, 0).otherwise(1)).withColumn(
        "_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    piece = F.struct("start", "end", "value")
    joined = F.aggregate(
        F.array_sort(F.collect_list(piece)), F.lit(""),
        lambda acc, x: F.trim(F.concat(
            acc, F.when(F.startswith(x["value"], F.lit("##")), F.lit("")).otherwise(F.lit(" ")),
            F.replace(x["value"], F.lit("##"), F.lit("")),
        )),
    )
    return (
        islands.groupBy("doc_id", "_island")
        .agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"),
             F.first("kind").alias("kind"), joined.alias("value"))
        .drop("_island")
    )
