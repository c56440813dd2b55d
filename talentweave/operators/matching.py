"""Exact top-k by inner product, in both directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave import constants as K

MAX_SHIPPED_QUERIES = 4096
QUERY_BLOCK = 16_384
DOCUMENT_BLOCK = 131_072
MIN_DOCUMENT_BLOCKS = 4
# Products held at a time by one task: 16 MB of 4-byte floats, and as much for the search of the k-th.
TILE = 1 << 22
# Rounding steps a term that a first cut allows for; every true top-k row passes it.
SLACK_STEPS = 4
HIT_SCHEMA = "query_num bigint, match_num bigint, sim double"

Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column of equally long vectors as one matrix, without a Python object per row. 4-byte floats stay as they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype != np.float32:
        flat = flat.astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64))


def _hits(query_nums: np.ndarray, hits: Hits) -> dict[str, pa.Array]:
    q, d, s = hits
    return {"query_num": pa.array(query_nums[q], pa.int64()), "match_num": pa.array(d, pa.int64()), "sim": pa.array(s, pa.float64())}


def _none() -> Hits:
    return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)


def _best(hits: Hits, k: int) -> Hits:
    """The k best hits of each query; ties go to the smaller document number."""
    q, num, sim = hits
    order = np.lexsort((num, -sim, q))
    q, num, sim = q[order], num[order], sim[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[keep], num[keep], sim[keep]


def _merge(a: Hits, b: Hits, k: int) -> Hits:
    return _best((np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])), k)


def _top_k(queries: np.ndarray, docs: np.ndarray, doc_nums: np.ndarray, k: int) -> Hits:
    """Row number of the query, document number and product of the k best documents per query.

    A fast matrix product finds the candidates, with some slack; their products are then summed in the order
    of the dimensions and in 8-byte floats, so equal vectors get equal scores wherever they are.
    """
    if not len(queries) or not len(docs):
        return _none()
    rows = max(1, TILE // len(docs))
    fast = docs.astype(np.float32, copy=False).T
    # Rounding of a 4-byte product grows with the lengths of both vectors, not with the product.
    slack = SLACK_STEPS * queries.shape[1] * np.finfo(np.float32).eps * _lengths(queries) * _lengths(docs).max()
    parts = []
    for first in range(0, len(queries), rows):
        tile = queries[first : first + rows]
        rough = tile.astype(np.float32, copy=False) @ fast
        if rough.shape[1] > k:
            kth = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
            q, d = np.nonzero(rough >= (kth - slack[first : first + rows])[:, None])
        else:
            q, d = (a.ravel() for a in np.indices(rough.shape))
        sim = np.zeros(len(q))
        for dim in range(queries.shape[1]):
            sim += tile[q, dim].astype(np.float64) * docs[d, dim]
        parts.append(_best((q + first, doc_nums[d], sim), k))
    return tuple(np.concatenate(column) for column in zip(*parts))  # type: ignore[return-value]


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """Final k per query from the k per task; the rank filter also runs before the shuffle."""
    order = Window.partitionBy("query_num").orderBy(F.desc("sim"), "match_num")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, docs: DataFrame, k: int = K.DEFAULT_K) -> DataFrame:
    """``(query_num, match_num, sim, rank)``: the k documents with the largest product per query.

    ``queries`` and ``docs`` are ``(num, embedding)``. A query set within MAX_SHIPPED_QUERIES travels to the
    tasks and each document is read once, unshuffled; a larger one is joined block by block.
    """
    few = queries.select("num", "embedding").limit(MAX_SHIPPED_QUERIES + 1).toArrow()
    if few.num_rows > MAX_SHIPPED_QUERIES:
        return knn_blocked(queries, docs, k)
    if few.num_rows == 0:
        return _ranked(queries.sparkSession.createDataFrame([], HIT_SCHEMA), k)
    shipped = queries.sparkSession.sparkContext.broadcast((few["num"].to_numpy(), _matrix(few["embedding"])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nums, matrix = shipped.value
        best = _none()
        for batch in batches:
            if batch.num_rows:
                found = _top_k(matrix, _matrix(batch.column(1)), batch.column(0).to_numpy(), k)
                best = _merge(best, found, k)
        yield pa.RecordBatch.from_pydict(_hits(nums, best))

    return _ranked(docs.select("num", "embedding").mapInArrow(scan, HIT_SCHEMA), k)


def _block_count(rows: int, block: int, largest: int, enough: int) -> int:
    """Blocks of ``block`` rows, but no more than ``enough`` unless those would be over ``largest`` rows."""
    return max(1, min(-(-rows // block), max(enough, -(-rows // largest))))


def knn_blocked(
    queries: DataFrame, docs: DataFrame, k: int = K.DEFAULT_K, query_block: int = QUERY_BLOCK,
    document_block: int = DOCUMENT_BLOCK,
) -> DataFrame:
    """The same result for any number of queries: blocks of queries meet blocks of documents.

    Blocks are filled by a hash of the unique number, so their size is bounded also when many vectors are
    equal. A pair of blocks gives k rows per query, never all pairs; each side is sent once per block of the
    other, so larger blocks mean less shuffle and more memory per task. Blocks smaller than QUERY_BLOCK and DOCUMENT_BLOCK are
    joined up to these sizes where there are more of them than it takes to keep all cores busy.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_q = _block_count(queries.count(), query_block, QUERY_BLOCK, cores)
    n_d = _block_count(docs.count(), document_block, DOCUMENT_BLOCK, MIN_DOCUMENT_BLOCKS)

    def blocks(df: DataFrame, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        placed = df.select("num", "embedding", F.pmod(F.xxhash64("num"), F.lit(own)).cast("int").alias(mine))
        return placed.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    left = blocks(queries, n_q, n_d, "qb", "db")
    right = blocks(docs, n_d, n_q, "db", "qb")

    def pair(query_rows: pa.Table, doc_rows: pa.Table) -> pa.Table:
        if not query_rows.num_rows or not doc_rows.num_rows:
            return pa.table(_hits(np.empty(0, np.int64), _none()))
        found = _top_k(_matrix(query_rows["embedding"]), _matrix(doc_rows["embedding"]), doc_rows["num"].to_numpy(), k)
        return pa.table(_hits(query_rows["num"].to_numpy(), found))

    hits = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(pair, HIT_SCHEMA)
    return _ranked(hits, k)


def knn_jobs_for_cv(resume_vectors: DataFrame, posting_vectors: DataFrame, k: int = K.DEFAULT_K) -> DataFrame:
    """Postings for each résumé: ``(cv_num, job_num, sim, rank)``."""
    return knn(resume_vectors, posting_vectors, k).withColumnsRenamed({"query_num": "cv_num", "match_num": "job_num"})


def knn_cvs_for_job(posting_vectors: DataFrame, resume_vectors: DataFrame, k: int = K.DEFAULT_K) -> DataFrame:
    """Résumés for each posting: ``(job_num, cv_num, sim, rank)``."""
    return knn(posting_vectors, resume_vectors, k).withColumnsRenamed({"query_num": "job_num", "match_num": "cv_num"})


def lookup_text_embedding(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vector of each query text, by an equi-join on the text; of several vectors of one text the smallest row."""
    rest = [c for c in vectors.columns if c != "text"]
    one = vectors.groupBy("text").agg(F.min(F.struct(*rest)).alias("_row"))
    return texts.join(one.select("text", "_row.*"), "text")


def id_number(id_: Column) -> Column:
    """Integer part of a document id."""
    return F.substr(id_, F.lit(2)).cast("bigint")


def id_from_number(kind: str, num: Column) -> Column:
    return F.concat(F.lit(kind), num.cast("string"))


def rank_matches(matches: DataFrame, by: str = "query_num") -> DataFrame:
    """Matches of each query by score, then number. A query has at most k matches."""
    order = Window.partitionBy(by).orderBy(F.desc("sim"), "match_num")
    return matches.withColumn("rank", F.row_number().over(order))


def attach_personal_info(matches: DataFrame, info: DataFrame) -> DataFrame:
    """Contact data of matched résumés, for a posting as query."""
    return matches.join(info, "id", "left")


def top_matches(matches: DataFrame, n: int = K.TOP_SHOWN) -> DataFrame:
    return matches.orderBy(F.desc("sim"), *[c for c in ("query_num", "match_num") if c in matches.columns]).limit(n)
