"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm.archives import OP9_SQL, op9_page_archive
from edgeloom.llm.interactions import OP12_SQL, op12_filter_audit
from edgeloom.llm.language import op3_language
from edgeloom.llm.leaks import op8_benchmark_leaks
from edgeloom.llm.lines import op7_line_dedup
from edgeloom.llm.mixing import OP5_SQL, op5_mix_sources
from edgeloom.llm.near_dedup import near_duplicates
from edgeloom.llm.neighbours import op10_neighbours
from edgeloom.llm.packing import op11_packed_sequences
from edgeloom.llm.pages import op4_page_text
from edgeloom.llm.quality import op2_quality
from edgeloom.llm.storage import table
from edgeloom.llm.suffixes import op6_repeated_strings
from edgeloom.llm.variants import op13_spelling_variants


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS g FROM words),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM reach JOIN step ON a = reach.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id
"""

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_page_text": op4_page_text,
    "op5_mix_sources": op5_mix_sources,
    "op6_repeated_strings": op6_repeated_strings,
    "op7_line_dedup": op7_line_dedup,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_page_archive": op9_page_archive,
    "op10_neighbours": op10_neighbours,
    "op11_packed_sequences": op11_packed_sequences,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op1_near_duplicates": OP1_SQL, "op5_mix_sources": OP5_SQL, "op9_page_archive": OP9_SQL, "op12_filter_audit": OP12_SQL}
