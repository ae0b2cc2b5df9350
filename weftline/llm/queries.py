"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import shared_dir, table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, as the environment's package gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.phrases import repeated_phrases

    return repeated_phrases(table(spark, sf_dir, "documents")).drop("text", "carried")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.fingerprints import fingerprinted

    return fingerprinted(table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.jaccard import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.language_model import scored

    return scored(table(spark, sf_dir, "documents"))


def op5_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.transcripts import formatted

    return formatted(table(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.html_text import html_text

    return html_text(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from weftline.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), path or tokenizer_path("byte_bpe_50k.json"))


def op9_sentencepieces(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from weftline.llm.sentencepieces import encoded

    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path or tokenizer_path("piece_bpe_32k.model"), keep_ids=False).drop("text")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from weftline.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), path or tokenizer_path("byte_bpe_50k.json"), f"{shared_dir(spark)}/weftline-ids-{uuid.uuid4().hex}")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.lexical_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def contract_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: sizes and edited texts."""
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def contract_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: folds, tokens and base scores."""
    return op4_language_model(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def contract_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: sizes."""
    return op8_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def contract_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op13: rows, their number and exact deviations."""
    return op13_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_phrases, op2_fingerprints, op3_jaccard, op4_language_model, op5_transcripts, op6_quality, op7_html_text, op8_token_counts, op9_sentencepieces, op10_decontaminate, op11_token_files, op12_lexical_search, op13_whitening, contract_op2, contract_op4, contract_op8, contract_op13)}

_OP10_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win FROM bw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(s)),
hits AS (SELECT p.doc_id, p.s, p.n, b.item_id FROM places p JOIN wins b ON p.win = b.win AND p.n = b.n),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, s, n FROM hits), unnest(range(s, s + n)) AS t(x) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
  coalesce(items.items_sha256, sha256('')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

_OP1_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS win FROM w, unnest(range(1, len(w) - 18)) AS t(s)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, x FROM late, unnest(range(s, s + 20)) AS t(x)),
per AS (SELECT doc_id, list(x) AS xs FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(len(xs), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN xs IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(xs, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN per ON w.doc_id = per.doc_id
"""

_OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS g FROM w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.d)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY d) r ON r.d = d.doc_id
"""

_OP12_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
n AS (SELECT row_number() OVER () AS doc, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
z AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM n),
q AS (SELECT item, t, count(*) AS times FROM (SELECT item, unnest(w) AS t FROM b) GROUP BY ALL),
p AS (SELECT doc, t, count(*) AS tf FROM (SELECT doc, unnest(w) AS t FROM n) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY t),
m AS (SELECT doc, doc_id, 75 + (25 * n * big_n) // l AS m FROM n, z),
s AS (SELECT item, doc, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (doc) GROUP BY ALL),
r AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s JOIN m USING (doc) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r JOIN b USING (item) WHERE rank <= 20
"""

_CONTRACT2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS later, first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS first FROM documents)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(coalesce(later, first), length(text) // 2)) AS edited_sha256 FROM d
"""

#: crc32 of the document id's digits.
_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

_CONTRACT4_SQL = f"""
WITH d AS (SELECT doc_id, {_CRC} % 5 = 1 AS held_out, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), '') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
z AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (w), z GROUP BY doc_id, held_out
"""

_CONTRACT8_SQL = "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents"

_CONTRACT13_SQL = """
WITH e AS (SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT k, vec_id, v FROM e WHERE len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT k, vec_id, unnest(range(len(v))) AS p, unnest(list_transform(v, lambda c: CAST(floor(1024 * c) AS BIGINT) + 100000)) AS x FROM g),
s AS (SELECT p, sum(x) AS s, count(*) AS n FROM x GROUP BY p),
d AS (SELECT k, vec_id, any_value(n) AS n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation, count(*) AS dims FROM x JOIN s USING (p) GROUP BY k, vec_id)
SELECT vec_id, CAST(component AS INT) AS component, n, deviation FROM d, unnest(range(1, least(dims, 8) + 1)) AS t(component)
"""

ORACLE_SQL: dict[str, str] = {"op3_jaccard": _OP3_SQL, "op1_phrases": _OP1_SQL, "op10_decontaminate": _OP10_SQL, "op12_lexical_search": _OP12_SQL, "contract_op2": _CONTRACT2_SQL, "contract_op4": _CONTRACT4_SQL, "contract_op8": _CONTRACT8_SQL, "contract_op13": _CONTRACT13_SQL}
