"""Queries of this subpackage: ``QUERIES`` and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentweave.llm import close_vectors, hard_negatives
from talentweave.llm.alignment import op11_alignment
from talentweave.llm.close_vectors import op13_close_vectors
from talentweave.llm.hard_negatives import op12_hard_negatives
from talentweave.llm.host_rules import op4_host_rules
from talentweave.llm.leaks import op9_leaks
from talentweave.llm.licenses import op6_licenses
from talentweave.llm.near_copies import op8_near_copies
from talentweave.llm.packing import op3_packed
from talentweave.llm.private import op7_private_spans
from talentweave.llm.records import op1_token_records
from talentweave.llm.repeated_bytes import op10_repeated_bytes
from talentweave.llm.sharding import op5_balanced_shards
from talentweave.llm.toxicity import op2_toxicity_ftrl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_toxicity_ftrl": op2_toxicity_ftrl,
    "op3_packed": op3_packed,
    "op4_host_rules": op4_host_rules,
    "op5_balanced_shards": op5_balanced_shards,
    "op6_licenses": op6_licenses,
    "op7_private_spans": op7_private_spans,
    "op8_near_copies": op8_near_copies,
    "op9_leaks": op9_leaks,
    "op10_repeated_bytes": op10_repeated_bytes,
    "op11_alignment": op11_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_close_vectors": op13_close_vectors,
}
ORACLES: dict[str, str] = {"op12_hard_negatives": hard_negatives.SQL, "op13_close_vectors": close_vectors.SQL}
