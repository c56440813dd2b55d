"""Quality rules of documents and of their hosts.

Every document is measured from its whole text. A host's rate of failing documents is shrunk towards a beta prior that
is fitted to all hosts, so a host with few documents is judged mostly by the corpus. Documents of a host whose shrunk
rate is above the limit are rejected together with those that fail the base rule.

Null texts are empty texts: no words, so the base rule fails. Rows with a null host form one host. Repeated rows count as
often as they occur. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.common import batched, rows_of, table, written

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: A host is rejected when it is likelier than not that its next document fails a rule.
HOST_LIMIT = 0.5
#: Symbols a word, and share of lines that repeat an earlier one, from which a document counts as failing for its host.
SYMBOL_RATIO, LINE_RATIO = 0.3, 0.5
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

_schema = pa.schema([
    ("doc_id", pa.int64()), ("host", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()), ("n_lines", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
])
_ddl = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
    "n_repeat_words long"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs at least twice."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered = end = 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += i + window - max(end, i)
            end = i + window
    return covered


def signals(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, characters in words, symbols, lines with a word, repeated lines, words in repeated windows."""
    text = text or ""
    words = text.encode().split()  # bytes split at ASCII white space alone
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), lines, lines - len(seen),
        repeated_words(words),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batched(((d, h, *signals(t)) for d, h, t in rows_of(batches, "doc_id", "host", "text")), _schema)


def document_signals(docs: DataFrame, host: str = "source") -> DataFrame:
    chosen = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string"))
    measured = chosen.mapInArrow(_measure, _ddl)
    return measured.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    ).withColumn(
        "rule_failed",
        F.col("base_failed") | (F.col("n_symbols") > SYMBOL_RATIO * F.col("n_words"))
        | (F.col("n_dup_lines") > LINE_RATIO * F.col("n_lines")),
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta parameters by moments of the hosts' rates, less the variance that small hosts have by chance."""
    rate = F.col("failed") / F.col("n")
    row = hosts.agg(
        F.sum("failed").alias("failed"), F.sum("n").alias("n"), F.count("*").alias("hosts"),
        F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"), F.avg(1 / F.col("n")).alias("inverse"),
    ).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = min(max((row["failed"] + 0.5) / (row["n"] + 1), 1e-6), 1 - 1e-6)
    chance = mean * (1 - mean) * row["inverse"]
    spread = max(row["spread"] - chance, 1e-6 * mean * (1 - mean))
    strength = min(max(mean * (1 - mean) / spread - 1, 2.0), 1e6)
    return mean * strength, (1 - mean) * strength


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row a host: documents, failures, shrunk rate and verdict."""
    hosts = measured.groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"),
    )
    hosts = written(hosts, "hosts")
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + a) / (F.col("n") + a + b)
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate > limit)


def host_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures, base rule, host rate and verdict of every document."""
    measured = written(document_signals(docs, host), "signals")
    verdicts = host_verdicts(measured, limit).select(F.col("host").alias("_host"), "host_rate", "host_rejected")
    return (
        measured.join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Documents that pass, with their own columns. A document is named by its id and host."""
    judged = host_rules(docs.select("doc_id", "text", host), host, limit)
    rejected = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("host").alias("_host")).distinct()
    return docs.join(
        rejected, F.col("doc_id").cast("long").eqNullSafe(F.col("_gone")) & F.col(host).cast("string").eqNullSafe(F.col("_host")),
        "left_anti",
    )


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate",
    )
