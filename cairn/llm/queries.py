"""One query for each numbered operator, over its whole table, and the SQL where there is some."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# query name: module of this subpackage whose function query(spark, sf_dir) answers it
MODULES = {
    "op1_packing": "q1",
    "op2_lattice": "q2",
    "op3_pii": "q3",
    "op4_decontamination": "q4",
    "op5_jaccard": "q5",
    "op6_secrets": "q6",
    "op7_repeats": "q7",
    "op8_quality": "q8",
    "op9_licenses": "q9",
    "op10_token_counts": "q10",
    "op11_hard_negatives": "q11",
    "op12_fingerprints": "q12",
    "op13_resampling": "q13",
}


# Parts of numbered operators that SQL can express in full, as queries of their own.
FIXED = {"secrets_fixed_formats": "q6", "pii_fixed_formats": "q3"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: importlib.import_module(f"cairn.llm.{module}").query for name, module in MODULES.items()}
    return found | {name: importlib.import_module(f"cairn.llm.{module}").fixed_formats for name, module in FIXED.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"cairn.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    found |= {name: importlib.import_module(f"cairn.llm.{module}").FIXED_SQL for name, module in FIXED.items()}
    return {name: sql for name, sql in found.items() if sql}


def spans_sql(kinds: list[tuple[str, str, str]]) -> str:
    """DuckDB SQL of (doc_id, spans) for (kind, pattern, condition on h, the match) in their order: kind:start:end by start, comma-joined.

    The text between matches and the matches alternate, so sums of their lengths give the places.
    """
    parts = []
    for rank, (kind, pattern, condition) in enumerate(kinds):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, hits[i] AS h, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0) AS a FROM "
            f"(SELECT doc_id, hits, gaps, unnest(range(1, len(hits)+1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM documents WHERE regexp_matches(text, '{p}'))) WHERE {condition}"
        )
    union = " UNION ALL ".join(parts)
    return f"SELECT doc_id, coalesce(spans, '') AS spans FROM documents LEFT JOIN (SELECT doc_id, string_agg(kind||':'||a::BIGINT||':'||(a+length(h))::BIGINT, ',' ORDER BY a, rank) AS spans FROM ({union}) GROUP BY 1) USING (doc_id)"
