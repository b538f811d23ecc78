"""Registered queries of this package: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.alignment import align_tokenizers
from gridloom.llm.common import read_table
from gridloom.llm.decontamination import decontaminate
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.fim import fim_digests
from gridloom.llm.lm_scoring import lm_scores
from gridloom.llm.near_dedup import near_duplicates
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import find_pii
from gridloom.llm.sharding import shard_documents
from gridloom.llm.substring_dedup import substring_dedup
from gridloom.llm.token_counts import token_counts
from gridloom.llm.toxicity import toxicity
from gridloom.llm.window_packing import pack_windows


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents")).drop("n_factors", "longest_factor")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(read_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(read_table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": """
            WITH t AS (SELECT doc_id, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+') IF w <> ''] AS ws FROM documents),
                 p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM t),
                 g AS (SELECT doc_id, i, array_to_string(t.ws[i : i + 12], ' ') AS k FROM p JOIN t USING (doc_id) WHERE i + 12 <= len(t.ws)),
                 m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM g),
                 hit AS (SELECT DISTINCT doc_id, i + o AS i FROM m, (SELECT unnest(range(13)) AS o) WHERE least < doc_id),
                 k AS (SELECT p.doc_id, count(*) AS n_removed FROM p JOIN hit USING (doc_id, i) GROUP BY 1),
                 s AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM p ANTI JOIN hit USING (doc_id, i) GROUP BY 1)
            SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM t LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)""",
        "op5_exact_dedup": f"""
            WITH t AS (SELECT doc_id, {LOWERED} AS norm FROM documents),
                 g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
            FROM t JOIN g USING (norm)""",
        # links by counting shared shingles, components by walking them
        "op7_near_dedup": f"""
            WITH RECURSIVE t AS (SELECT doc_id, [w FOR w IN regexp_split_to_array({LOWERED}, '[ \\t\\n\\x0B\\f\\r]+') IF w <> ''] AS ws FROM documents),
                 s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM t),
                 e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
                 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
                 l AS MATERIALIZED (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.sh) + len(y.sh) - c)),
                 n AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
                 r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT n.b, r.root FROM r JOIN n ON n.a = r.doc_id),
                 c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id),
                 k AS (SELECT doc_id, CASE WHEN len(sh) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(sh)) END AS class_id, len(sh)::BIGINT AS n_shingles FROM s)
            SELECT doc_id, n_shingles, class_id, component_id, doc_id = component_id AS kept FROM k JOIN c USING (doc_id)""",
            "op12_fill_in_middle": r"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
                 d AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
                    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
                 p AS (SELECT *, coalesce(array_to_string(u[1 : least(x, y)], ''), '') AS pre, coalesce(array_to_string(u[least(x, y) + 1 : greatest(x, y)], ''), '') AS mid, coalesce(array_to_string(u[greatest(x, y) + 1 :], ''), '') AS suf FROM d)
            SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
                sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    }
