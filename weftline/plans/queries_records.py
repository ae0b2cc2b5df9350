"""Queries over events, orders and articles: logs, ledgers, search, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import scores as S
from weftline.functions import text as X
from weftline.operators import evals
from weftline.operators.scans import filled
from weftline.plans.support import Registry, table
from weftline.sources import articles, logs

query = Registry()
QUERIES, SQL = query.queries, query.sql
R = 6


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Log lines made of events: files by user group; every seventh opens a session, views and the like are queries, errors by value."""
    e = _events(spark, d)
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    head = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("session_u"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_id").cast("string"))).otherwise(F.lit("INFO"))
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 💬 "), F.col("event_type"), F.lit("  "))).when(F.col("value") > 90, F.lit(" ⛔ failed")).otherwise(F.lit(" ok"))
    return e.select(F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")).alias("file"), F.col("event_id").alias("line_no"), F.concat(ts, F.lit(",123 "), head, body).alias("line"))


_LINES = """lines AS (SELECT 'f' || (user_id % 5) AS file, event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt,
 CASE WHEN event_id % 7 = 0 THEN 'session_u' || user_id || '_' || event_id END AS sid, event_id % 3 = 0 AS q, event_type AS said, event_id % 3 <> 0 AND value > 90 AS err FROM events),
fill AS (SELECT *, last_value(sid IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS session_id FROM lines),
isl AS (SELECT *, sum(CAST(q AS INT)) OVER (PARTITION BY file, session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS k FROM fill WHERE session_id IS NOT NULL),
entries AS (SELECT file, line_no, dt AS datetime_str, said AS search_query, session_id, bool_or(err) OVER (PARTITION BY file, session_id, k) AS has_error, q FROM isl WHERE k > 0)"""


@query(f"WITH {_LINES} SELECT file, line_no, session_id FROM fill")
def w1_session_fill(spark: SparkSession, d: str) -> DataFrame:
    return filled(_lines(spark, d), logs.session_id(F.col("line")), "session_id", ["file"], "line_no").select("file", "line_no", "session_id")


@query(f"WITH {_LINES} SELECT file, line_no, datetime_str, search_query, session_id, has_error FROM entries WHERE q")
def w2_error_islands(spark: SparkSession, d: str) -> DataFrame:
    return logs.entries(_lines(spark, d))


@query(f"WITH {_LINES} SELECT datetime_str, search_query, arg_min(session_id, (file, line_no)) AS session_id, bool_or(has_error) AS has_error FROM entries WHERE q GROUP BY 1, 2")
def a1_merge(spark: SparkSession, d: str) -> DataFrame:
    return logs.merged(logs.entries(_lines(spark, d)), ["file", "line_no"]).drop("first_seen")


def _month_table(spark: SparkSession, d: str) -> DataFrame:
    """Orders as entries: many months."""
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("datetime_str"), F.col("o_orderpriority").alias("search_query"), F.col("o_orderkey").alias("k"))
    return logs.derived(o)


_MONTH = "m AS (SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS datetime_str, o_orderpriority AS search_query, o_orderkey AS k, strftime(o_orderdate, '%Y-%m') AS year_month, day(o_orderdate) AS day, CAST(least((day(o_orderdate) - 1) // 7, 4) AS INT) AS week_idx FROM orders)"


@query(f"WITH {_MONTH} SELECT k, year_month, CAST(day AS INT) AS day, week_idx, datetime_str || '|' || search_query AS unique_key FROM m")
def f17_f21_derived(spark: SparkSession, d: str) -> DataFrame:
    return _month_table(spark, d).select("k", "year_month", "day", "week_idx", "unique_key")


@query(f"WITH {_MONTH}, old AS (SELECT * FROM m WHERE k % 3 = 0) SELECT year_month, datetime_str, search_query, k FROM m WHERE k % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM old WHERE old.datetime_str = m.datetime_str AND old.search_query = m.search_query)")
def j1_anti_append(spark: SparkSession, d: str) -> DataFrame:
    m = _month_table(spark, d)
    return logs.new_entries(m.where("k % 3 <> 0"), m.where("k % 3 = 0")).select("year_month", "datetime_str", "search_query", "k")


@query(f"""WITH {_MONTH}, g AS (SELECT DISTINCT year_month, week_idx, datetime_str, search_query FROM m WHERE k % 3 <> 0 AND (datetime_str, search_query) NOT IN (SELECT (datetime_str, search_query) FROM m WHERE k % 3 = 0)), u AS (SELECT year_month, week_idx, count(*) AS n FROM m WHERE k % 3 = 0 GROUP BY 1, 2)
SELECT year_month, week_idx, datetime_str, search_query, coalesce(n, 0) + row_number() OVER (PARTITION BY year_month, week_idx ORDER BY datetime_str, search_query) + 3 AS row_no FROM g LEFT JOIN u USING (year_month, week_idx)""")
def w3_append_rows(spark: SparkSession, d: str) -> DataFrame:
    m = _month_table(spark, d)
    new = logs.new_entries(m.where("k % 3 <> 0"), m.where("k % 3 = 0")).select("year_month", "week_idx", "datetime_str", "search_query").distinct()
    return logs.placed(new, m.where("k % 3 = 0"))


@query(f"WITH {_MONTH} SELECT year_month, week_idx, count(*) AS n FROM m GROUP BY 1, 2")
def a3_week_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.week_counts(_month_table(spark, d))


@query(f"WITH {_MONTH} SELECT year_month AS month, {', '.join(f'count(*) FILTER (week_idx = {k}) AS w{k + 1}' for k in range(5))}, count(*) AS total FROM m GROUP BY 1")
def a4_month_week_pivot(spark: SparkSession, d: str) -> DataFrame:
    return logs.monthly_summary(_month_table(spark, d))


_CELLS = """c AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type || ': ' || user_id WHEN 2 THEN event_type WHEN 3 THEN '' WHEN 4 THEN ' ' || CAST(user_id AS VARCHAR) || '.0' WHEN 5 THEN 'total: ' || event_type WHEN 6 THEN '-' || user_id END AS cell FROM events)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Events as cells of a sheet: numbers, labelled numbers, words, blanks."""
    u, kind, k = F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id") % 8
    cell = F.when(k == 0, u).when(k == 1, F.concat(kind, F.lit(": "), u)).when(k == 2, kind).when(k == 3, F.lit("")).when(k == 4, F.concat(F.lit(" "), u, F.lit(".0"))).when(k == 5, F.concat(F.lit("total: "), kind)).when(k == 6, F.concat(F.lit("-"), u))
    return _events(spark, d).select("event_id", cell.alias("cell"))


@query(f"WITH {_CELLS} SELECT event_id, CAST(CASE WHEN regexp_full_match(trim(cell), '-?\\d+(\\.\\d*)?') THEN trunc(CAST(cell AS DOUBLE)) WHEN contains(cell, ':') THEN coalesce(TRY_CAST(trim(string_split(cell, ':')[-1]) AS BIGINT), 0) ELSE 0 END AS BIGINT) AS n FROM c")
def f22_loose_int(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("event_id", S.loose_int(F.col("cell")).alias("n"))


_TITLES = "t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y_%m') WHEN 2 THEN strftime(o_orderdate, '%y-%m-%d') ELSE o_orderpriority END AS title FROM orders)"


@query(f"WITH {_TITLES} SELECT o_orderkey, title, length(title) = 7 AND substr(title, 5, 1) = '-' AS is_month FROM t")
def f23_month_titles(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sheets, named by month, by other dates or by priority."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    title = F.when(k == 0, F.date_format(day, "yyyy-MM")).when(k == 1, F.date_format(day, "yyyy_MM")).when(k == 2, F.date_format(day, "yy-MM-dd")).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", title.alias("title")).withColumn("is_month", logs.is_month_title(F.col("title")))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles: source as author, language as category, a date by id; some without a title."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(400)).cast("int")), "yyyy-MM-dd")
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("art_id"), F.when(F.col("doc_id") % 10 == 0, "").otherwise(X.preview(F.col("text"), 20)).alias("title"), F.col("text").alias("content"), F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.col("source")).alias("author"), F.col("lang").alias("category"), F.concat(day, F.lit(" 10:00:00")).alias("service_daytime"), F.lit("").alias("pcUrl"))


_ART = "art AS (SELECT CAST(doc_id AS VARCHAR) AS art_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE left(text, 20) || '...' END AS title, text AS content, CASE WHEN doc_id % 9 = 0 THEN '' ELSE source END AS author, lang AS category, strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INT), '%Y-%m-%d') || ' 10:00:00' AS service_daytime, '' AS pcUrl FROM documents)"


@query(f"WITH {_ART} SELECT art_id, split_part(service_daytime, ' ', 1) AS date, left(service_daytime, 7) AS year_month FROM art WHERE title <> '' AND content <> '' AND art_id <> ''")
def f24_f25_valid_articles(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).where(articles.is_valid()).select("art_id", articles.date_of(F.col("service_daytime")).alias("date"), articles.year_month_of(F.col("service_daytime")).alias("year_month"))


@query(f"WITH {_ART} SELECT art_id, md5('---' || chr(10) || '제목: ' || title || chr(10) || '저자: ' || author || chr(10) || '카테고리: ' || category || chr(10) || '날짜: ' || service_daytime || chr(10) || 'URL: ' || pcUrl || chr(10) || '기사ID: ' || art_id || chr(10) || '---' || chr(10) || chr(10) || content || chr(10)) AS text_md5 FROM art")
def f26_search_text(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("art_id", F.md5(articles.search_text()).alias("text_md5"))


@query(f"WITH {_ART} SELECT art_id, CAST(4 - CAST(author = '' AS INT) AS INT) AS n_keys, nullif(author, '') AS author FROM art")
def f27_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = articles.metadata()
    return _articles(spark, d).select("art_id", F.size(m).alias("n_keys"), m["author"].alias("author"))


@query(f"WITH {_ART} SELECT art_id FROM art WHERE author = 'src3' AND category = 'en'")
def f28_search(spark: SparkSession, d: str) -> DataFrame:
    return articles.search(_articles(spark, d), author="src3", category="en", year_month="").select("art_id")


@query(f"WITH {_ART} SELECT art_id FROM art WHERE left(service_daytime, 7) = '2024-02'")
def f29_search_month(spark: SparkSession, d: str) -> DataFrame:
    return articles.search(_articles(spark, d).withColumn("year_month", articles.year_month_of(F.col("service_daytime"))), year_month="2024-02").select("art_id")


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, d, "documents").select(F.format_string("%08d.json", "doc_id").alias("file"), "doc_id")
    status = F.when(F.col("doc_id") % 3 == 0, "uploaded").when(F.col("doc_id") % 11 == 0, "failed")
    return files.select("file"), files.select("file", status.alias("status")).where("status is not null")


@query("SELECT printf('%08d.json', doc_id) AS file FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 11 <> 0 ORDER BY file LIMIT 50")
def j2_pending(spark: SparkSession, d: str) -> DataFrame:
    return articles.pending(*_ledger(spark, d), 50)


@query("SELECT printf('%08d.json', doc_id) AS file FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 11 <> 0")
def t2_pending_no_limit(spark: SparkSession, d: str) -> DataFrame:
    return articles.pending(*_ledger(spark, d), 0)


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS uploaded, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 11 = 0) AS failed, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 11 <> 0) AS remaining FROM documents")
def a25_upload_status(spark: SparkSession, d: str) -> DataFrame:
    return articles.upload_status(*_ledger(spark, d))


@query("SELECT printf('%08d.json', doc_id) AS file FROM documents WHERE doc_id % 3 = 0 OR doc_id % 11 = 0")
def d6_processed(spark: SparkSession, d: str) -> DataFrame:
    ledger = _ledger(spark, d)[1]
    return articles.processed(ledger.where("status = 'uploaded'"), ledger.where("status = 'failed'"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 6000 THEN text WHEN contains(left(text, 6000), '.') AND 6000 - position('.' IN reverse(left(text, 6000))) > 4800 THEN left(text, 6001 - position('.' IN reverse(left(text, 6000)))) ELSE left(text, 6000) END) AS cut_md5 FROM documents")
def f30_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.truncate(F.col("text"))).alias("cut_md5"))


@query("SELECT doc_id, 'Be brief.' AS system, 'Summarize: ' || left(text, 200) || '...' AS user, trim(lang) AS assistant, CAST(3 AS INT) AS n FROM documents")
def f31_f36_messages(spark: SparkSession, d: str) -> DataFrame:
    m = evals.messages(F.concat(F.lit("Summarize: "), X.preview(F.col("text"))), F.lit("Be brief."), F.col("lang"))
    rows = table(spark, d, "documents").select("doc_id", m.alias("m"))
    return rows.select("doc_id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user"), evals.assistant_label(F.col("m")).alias("assistant"), F.size("m").alias("n"))


_GUESSES = """g AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN printf('%.0f%%', l_quantity) WHEN 1 THEN '  ' || CAST(CAST(floor(l_quantity * 1.04) AS BIGINT) AS VARCHAR) WHEN 2 THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || 'd' ELSE '1,' || printf('%03d', CAST(l_quantity AS BIGINT)) END AS output,
 CASE WHEN l_linenumber % 4 = 3 THEN CAST(CAST(l_quantity + 1000 AS BIGINT) AS VARCHAR) ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS expected FROM lineitem),
n AS (SELECT *, CASE WHEN output LIKE '%d' THEN NULL ELSE CAST(translate(output, ',% ', '') AS DOUBLE) END AS a, CAST(expected AS DOUBLE) AS b FROM g)"""


@query(f"WITH {_GUESSES} SELECT l_orderkey, l_linenumber, output, lower(trim(output)) = expected OR coalesce(CASE WHEN b = 0 THEN a = 0 ELSE abs(a - b) / abs(b) <= 0.05 END, false) AS matches FROM n")
def f33_relaxed_match(spark: SparkSession, d: str) -> DataFrame:
    """Quantities as answers: with a per cent sign, a little off, with a type suffix, with a comma."""
    q, k, whole = F.col("l_quantity"), F.col("l_linenumber") % 4, lambda c: F.floor(c).cast("bigint").cast("string")
    output = F.when(k == 0, F.concat(F.format_string("%.0f", q.cast("double")), F.lit("%"))).when(k == 1, F.concat(F.lit("  "), whole(q * 1.04))).when(k == 2, F.concat(whole(q), F.lit("d"))).otherwise(F.concat(F.lit("1,"), F.format_string("%03d", q.cast("bigint"))))
    expected = F.when(k == 3, (q + 1000).cast("bigint")).otherwise(q.cast("bigint")).cast("string")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", output.alias("output"), expected.alias("expected"))
    return rows.select("l_orderkey", "l_linenumber", "output", S.relaxed_match(F.col("output"), F.col("expected")).alias("matches"))


@query("SELECT o_orderkey, lower(trim(o_orderpriority)) = '1-urgent' OR abs(o_totalprice - round(o_totalprice, -4)) / nullif(abs(round(o_totalprice, -4)), 0) <= 0.05 IS TRUE AS matches FROM orders")
def f33_relaxed_match_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    same = S.relaxed_match(F.col("o_orderpriority"), F.lit("1-urgent"))
    rounded = F.round(F.col("o_totalprice"), -4)
    near = S.relaxed_match(F.col("o_totalprice").cast("string"), rounded.cast("string"))
    return o.select("o_orderkey", (same | (near & (rounded != 0))).alias("matches"))


#: Keys of a label, in order.
LABEL = ["gender", "masterCategory", "subCategory", "season", "usage", "baseColour", "articleType"]
_LABEL_SQL = ["p_brand", "split_part(p_type, ' ', 1)", "split_part(p_type, ' ', 2)", "'Größe ' || p_size", "left(p_name, 3)", "split_part(p_name, ' ', 1)", "p_type"]


@query("SELECT p_partkey, '{' || " + " || ',' || ".join(f"""'"{k}":"' || {v} || '"'""" for k, v in zip(LABEL, _LABEL_SQL, strict=True)) + " || '}' AS label FROM part")
def f34_label_json(spark: SparkSession, d: str) -> DataFrame:
    kind = F.split("p_type", " ")
    part = lambda k: F.coalesce(F.get(kind, F.lit(k)), F.lit(""))
    own = [F.col("p_brand"), part(0), part(1), F.concat(F.lit("Größe "), F.col("p_size").cast("string")), F.substring("p_name", 1, 3), F.split("p_name", " ")[0], F.col("p_type")]
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(*[v.alias(k) for k, v in zip(LABEL, own, strict=True)])).alias("label"))


@query("WITH j AS (SELECT conv_id, string_agg(text, '|||||' ORDER BY turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, CAST(len(string_split(t, '|||||')) AS INT) AS n_documents, CAST(len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) AS INT) AS n_words FROM j")
def f35_document_count(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "|||||").alias("t"))
    return joined.select("conv_id", X.document_count(F.col("t")).alias("n_documents"), X.word_count(F.col("t")).alias("n_words"))


def _scored_items(spark: SparkSession, d: str, stems: bool) -> DataFrame:
    items = table(spark, d, "benchmark").withColumnRenamed("text", "prediction")
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("reference")).crossJoin(F.broadcast(items.agg(F.count("*").alias("n"))))
    pairs = rows.join(items, F.pmod("doc_id", F.greatest("n", F.lit(1))) == F.col("item_id")).select("doc_id", "item_id", "prediction", "reference")
    return evals.rouge(pairs, "prediction", "reference", stems).select("doc_id", "item_id", *[F.round(c, R).alias(c) for c in ("rouge1", "rouge2", "rougeL")])


@query()
def f37_rouge(spark: SparkSession, d: str) -> DataFrame:
    """Every document as the reference of one benchmark item, dealt out by number."""
    return _scored_items(spark, d, False)


@query()
def f37_rouge_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return _scored_items(spark, d, True)


@query("SELECT vec_id, p.name, s AS with_system FROM embeddings, (VALUES ('a'), ('b'), ('c')) p(name), (VALUES (true), (false)) t(s)")
def j7_prompt_grid(spark: SparkSession, d: str) -> DataFrame:
    prompts = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    return evals.prompt_grid(prompts, table(spark, d, "embeddings").select("vec_id"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position FROM documents), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders)
SELECT position, doc_id, o_orderkey FROM a JOIN b USING (position)""")
def j13_positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Documents and orders, each in order of their number."""
    return evals.zip_by_position(table(spark, d, "documents").select("doc_id"), table(spark, d, "orders").select("o_orderkey"), "doc_id", "o_orderkey")


@query(f"SELECT event_type, round(avg(value), {R}) AS mean_score, count(*) AS n FROM events GROUP BY 1")
def a15_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return evals.leaderboard(_events(spark, d), "event_type", "value").withColumn("mean_score", F.round("mean_score", R))


@query(f"WITH p AS (SELECT event_type, avg(value) AS m, min(event_id) AS o FROM events GROUP BY 1) SELECT round(avg(m), {R}) AS overall_mean, arg_max(event_type, (m, -o)) AS best_prompt, round(max(m), {R}) AS best_mean FROM p")
def a15_best_prompt(spark: SparkSession, d: str) -> DataFrame:
    b = evals.best_prompt(_events(spark, d), "event_type", "event_id", "value")
    return b.select(F.round("overall_mean", R).alias("overall_mean"), "best_prompt", F.round("best_mean", R).alias("best_mean"))


@query(f"WITH r AS (SELECT value > 50 AS m FROM events ORDER BY event_id LIMIT 1000) SELECT count(*) FILTER (m) AS correct, count(*) AS n, round(avg(CAST(m AS INT)), {R}) AS accuracy FROM r")
def a16_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evals.accuracy(_events(spark, d), F.col("value") > 50, 1000, "event_id").withColumn("accuracy", F.round("accuracy", R))


_SPOKEN = "w AS (SELECT conv_id, turn, role, list_transform(range(1, len(text) + 1), lambda i: CAST(ascii(text[i:i]) AS BIGINT)) AS ids FROM conversations)"


@query(f"""WITH {_SPOKEN}, p AS (SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(len(ids)) OVER (PARTITION BY conv_id) AS n FROM w)
SELECT conv_id, turn, list_transform(ids, lambda x: CASE WHEN role = 'assistant' THEN x ELSE -100 END) AS labels, CAST(b AS BIGINT) AS start, CAST(n AS BIGINT) AS n FROM p""")
def f44_masked_labels(spark: SparkSession, d: str) -> DataFrame:
    """Code points of each turn's text as token ids; only the assistant's are labels. start, n: the turn's place in its conversation."""
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c).cast("bigint"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.length("text") > 0, ids).otherwise(F.array().cast("array<bigint>")).alias("ids"))
    size = F.size("ids").cast("bigint")
    own = F.when(F.col("role") == "assistant", F.size("ids")).otherwise(0)
    by = Window.partitionBy("conv_id")
    start = F.coalesce(F.sum(size).over(by.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("conv_id", "turn", evals.masked_labels(F.col("ids"), F.lit(0), own).alias("labels"), start.alias("start"), F.sum(size).over(by).alias("n"))


@query("SELECT event_id, event_id % 12 AS n, least(2 * pow(2, event_id % 12), 60) AS seconds FROM events")
def f45_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Events as attempts."""
    return _events(spark, d).select("event_id", (F.col("event_id") % 12).alias("n")).withColumn("seconds", S.backoff_seconds(F.col("n")))
