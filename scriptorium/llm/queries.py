"""The queries of this package over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_documents
from .common import table
from .decontaminate import contained_items
from .exact_dedup import exact_duplicates
from .html_text import main_text
from .line_runs import without_frequent_lines
from .quality import classify
from .simhash import near_duplicates
from .spelling import variants
from .tiered_search import rank_documents
from .token_files import token_files
from .toxicity import classify as classify_toxic
from .unigram_counts import count_tokens
from .warc import dedup_archives


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return out.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), ids=False)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_frequent_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SQL = {
    "op1_decontaminate": r"""
        WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
             iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
             il AS (SELECT item_id, w, least(5, len(w)) AS n FROM iw WHERE len(w) > 0),
             ig AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
             iq AS (SELECT item_id, n, count(*) AS q FROM ig GROUP BY ALL),
             dg AS (SELECT DISTINCT doc_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
                    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM iq) WHERE len(w) >= n))
        SELECT doc_id, item_id, q AS n_shingles, count(*) AS n_shared, count(*) / q AS containment
        FROM dg JOIN ig USING (n, g) JOIN iq USING (item_id, n)
        GROUP BY doc_id, item_id, q HAVING count(*) >= 0.8 * q - 1e-9""",
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
             g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
        FROM d JOIN g USING (h)""",
    "op12_tiered_search": r"""
        WITH dt AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents),
             it AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark),
             s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM dt WHERE len(w) > 0),
             tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM dt) GROUP BY ALL),
             wt AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM it) GROUP BY t), s),
             sc AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
                    FROM tf JOIN wt USING (t) JOIN it USING (t), s GROUP BY ALL),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INT AS rank FROM sc WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_line_runs": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             l AS (SELECT r, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
                   FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
             f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
             o AS (SELECT r, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '') AS kept FROM l LEFT JOIN f USING (k) GROUP BY r)
        SELECT doc_id, len(lines) AS n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN o USING (r)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
