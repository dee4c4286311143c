"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm import credentials, documented, encoding, layout_copies, leaks, near_copies, packing, provenance, syntax
from codequarry.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(table(spark, sf_dir, "source_files"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, sf_dir, "source_files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.foreign_files(table(spark, sf_dir, "source_files"))


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.reasons_by_repo(table(spark, sf_dir, "source_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_copies.layout_copies(table(spark, sf_dir, "code_chunks"))


def p3_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_copies.copy_counts(table(spark, sf_dir, "code_chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.described_names(table(spark, sf_dir, "source_files"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.documented_functions(table(spark, sf_dir, "source_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_pairs(table(spark, sf_dir, "code_chunks"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_groups(table(spark, sf_dir, "code_chunks"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_classes(table(spark, sf_dir, "code_chunks"))


def p5_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_class_pairs(table(spark, sf_dir, "code_chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_lines(table(spark, sf_dir, "code_chunks"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted_chunks(table(spark, sf_dir, "code_chunks"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_fill(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, sf_dir, "documents"))


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repaired_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_rates": p1_rates,
        "p2_found": p2_found,
        "p2_reasons": p2_reasons,
        "p3_found": p3_found,
        "p3_copy_counts": p3_copy_counts,
        "p4_found": p4_found,
        "p4_pairs": p4_pairs,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p5_classes": p5_classes,
        "p5_class_pairs": p5_class_pairs,
        "p6_found": p6_found,
        "p6_redacted": p6_redacted,
        "p7_packed": p7_packed,
        "p7_fill": p7_fill,
        "p8_found": p8_found,
        "p8_report": p8_report,
        "p8_overlap": p8_overlap,
        "p9_found": p9_found,
        "p9_repaired": p9_repaired,
    }


_RUNS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM w WHERE len(w) >= 12),
v AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
h AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM v WHERE len(w) >= 12),
found AS (SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (g))"""


# classes of copies by all letters and digits and by the set of runs, and pairs of classes by the runs they share
_CLASSES = """c AS (SELECT id, max(text) AS text FROM code_chunks WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
w AS (SELECT id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS canon, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM c),
t AS (SELECT id, canon, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS runs FROM w WHERE len(w) >= 30),
k AS (SELECT canon, runs, min(id) AS class_id FROM t GROUP BY canon, runs), m AS (SELECT id, class_id FROM t JOIN k USING (canon, runs)),
e AS (SELECT class_id, canon, len(runs) AS n, unnest(runs) AS r FROM k),
p AS (SELECT a.class_id AS a, b.class_id AS b FROM e a JOIN e b ON a.r = b.r AND a.class_id < b.class_id AND a.n <= b.n / 0.7 AND b.n <= a.n / 0.7 AND a.canon <> b.canon
  GROUP BY a.class_id, b.class_id HAVING count(*) >= 0.7 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9)"""


def oracle_sql() -> dict[str, str]:
    """Of these operators SQL expresses the near-duplicate pairs and the leaks; the others are tested against brute force."""
    return {
        "p5_found": f"WITH {_CLASSES} SELECT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM p JOIN m x ON x.class_id = a JOIN m y ON y.class_id = b",
        "p5_classes": f"WITH {_CLASSES} SELECT id, class_id FROM m",
        "p5_class_pairs": f"WITH {_CLASSES} SELECT a AS class_a, b AS class_b FROM p",
        "p8_found": f"WITH {_RUNS} SELECT doc_id, item_id FROM found",
        "p8_report": f"WITH {_RUNS} SELECT item_id, any_value(item_set) AS item_set, count(DISTINCT doc_id) AS documents FROM found JOIN eval_items USING (item_id) GROUP BY item_id",
    }
