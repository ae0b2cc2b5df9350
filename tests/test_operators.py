"""Operators against plain Python on small fixtures."""

from __future__ import annotations

import collections
import datetime as dt
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import scores as S
from weftline.functions import text as X
from weftline.functions.stemming import stem
from weftline.operators import benchmarks, cache, dedup, evals, filters, metrics, sampling, trie, vectors
from weftline.plans import queries_curation, queries_records


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def one(spark, expr, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {t}" for n, t in zip(names, ["string"] * len(names), strict=True)))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("s", ["", "  a  b ", "x y z", "a\x1cb\x1fc", "a\u0085b", "tab\tnew\nline", None])
def test_words_and_strip_follow_python(spark, s):
    assert one(spark, X.words(F.col("s")), s=s) == (s or "").split()
    if s is not None:
        assert one(spark, X.strip(F.col("s")), s=s) == s.strip()


def ratio(words, n=3):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    return 1 - len(set(grams)) / len(grams) if grams else 0.0


@pytest.mark.parametrize("s", ["", "a b", "a b c", "a a a a a a", "a b c d a b c d", "x " * 400])
def test_repetition(spark, s):
    assert one(spark, X.repetition_ratio(X.words(F.col("s"))), s=s) == pytest.approx(ratio(s.split()))


REASONS = [
    ("short", "r" * 60, "instruction_too_short"), ("i" * 10, "a b c d " * 10, None), ("i" * 501, "r" * 60, "instruction_too_long"), ("i" * 500, "word%d " % 7 + "r" * 60, None),
    ("i" * 20, "r" * 49, "response_too_short"), ("i" * 20, "r" * 50, None), ("i" * 20, "r" * 2001, "response_too_long"), ("i" * 20, "r" * 2000, None),
    ("i" * 20, "well, as an AI model I must say this is what it is", "blocked_phrase"), ("i" * 20, "spam " * 20, "too_repetitive"), (" " * 20, "r" * 60, "empty_content"), ("bad", "x", "instruction_too_short"), (None, None, "instruction_too_short"),
]


@pytest.mark.parametrize("instruction,response,reason", [r for r in REASONS if r[1] != "a b c d " * 10])
def test_first_reason_wins(spark, instruction, response, reason):
    assert one(spark, filters.rejection_reason(), instruction=instruction, response=response) == reason


def test_quality_predicate(spark):
    rows = spark.createDataFrame([(1, True, 0.4), (2, True, 0.5), (3, True, None), (4, False, 0.1)], "id int, reward boolean, overall double")
    reason = filters.rejection_reason(filters.FilterConfig(), F.lit("i" * 20), F.lit("r" * 60), F.col("reward"), F.col("overall"))
    assert values(rows.select("id", reason.alias("x")), "id", "x") == [(1, "low_quality_score"), (2, None), (3, None), (4, None)]


@pytest.mark.parametrize("text,index", [("they kill time", 0), ("ékill killé", None), ("call 743-555-3824", 3), ("+1 (743) 555-3824", None), ("me@example.org", 4), ("123-45-6789", 5), ("a hack to murder", 0), ("", None)])
def test_unsafe_pattern(spark, text, index):
    assert one(spark, filters.unsafe_pattern(F.col("s"), []), s=text) == (None if index is None else filters.UNSAFE_PATTERNS[index])


ASCII_TEXTS = ["they kill time", "ékill killé", "dieö", "öthe", "le THE", "\u212aill", "k\u0131ll", "k\u0130ll", "expl\u017f hac\u212a", "call 743-555-3824é", "٧٤٣-555-3824", "kill_", "_kill", "", None]


def test_ascii_patterns_agree_with_sql(spark):
    import duckdb

    patterns = [r"\b(die|the)\b", *filters.UNSAFE_PATTERNS, r"\bsku\b"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in ASCII_TEXTS], "s string").coalesce(1).select(filters.unsafe_pattern(F.col("s"), patterns, ascii=True)).collect()]
    sql = "CASE " + " ".join(f"WHEN regexp_matches(?, '{p}', 'i') THEN '{p}'" for p in patterns) + " END"
    assert got == [duckdb.execute(f"SELECT {sql}", [s] * len(patterns)).fetchone()[0] for s in ASCII_TEXTS]


def test_stage_summary_query_has_ascii_word_bounds(spark, tmp_path):
    answer = "Chie dieöst. " + " ".join(f"wört{k}" for k in range(40))  # 'die' stands at a bound for SQL, not for Python
    turns = [(1, 0, "user", "q" * 70), (1, 1, "assistant", answer), (2, 0, "user", "q" * 70), (2, 1, "assistant", answer.replace("dieöst", "dienst"))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries_curation.a6_stage_summary(spark, str(tmp_path)).first()
    assert (got.quality_rejected, got.safety_rejected, got.total_rejected, got.passed) == (0, 1, 1, 1)


def test_evaluation_last_reason_wins(spark):
    def run(i, r, overall=0.9):
        return one(spark, filters.evaluation(filters.heuristics(F.col("i"), F.col("r")), F.col("r"), F.lit(overall))["rejection_reason"], i=i, r=r)

    assert run("alpha beta", "x") == "Response doesn't address instruction"
    assert run("spam", "spam spam spam spam spam spam") == "Too much repetition"
    assert run("alpha", "alpha") == "Response too short"
    good = "alpha " + " ".join(f"w{k}" for k in range(30))
    assert run("alpha", good) is None and run("alpha", good, 0.2) == "Low quality score"
    assert run("", good) == "Response doesn't address instruction"


def test_judge_scores(spark):
    s = one(spark, S.parse_scores(F.col("t")), t="HELPFULNESS: 4/5 correctness: 0 coherence:9 complexity: 10")
    assert (s.helpfulness, s.correctness, s.coherence, s.complexity, s.verbosity) == (0.75, -0.25, 2.0, 0.0, 0.5)


@pytest.mark.parametrize("a,b,same", [("Yes", " yes ", True), ("1,234", "1234", True), ("105", "100", True), ("105.1", "100", False), ("5%", "5", True), ("0", "0", True), ("0.1", "0", False), ("nan", "nan", True), ("nan", "1", False), ("inf", "1", False), ("1_000", "1000", True), ("1d", "1", False), ("", "", True), ("", "1", False)])
def test_relaxed_match(spark, a, b, same):
    assert one(spark, S.relaxed_match(F.col("a"), F.col("b")), a=a, b=b) is same


@pytest.mark.parametrize("n,cut", [(6000, None), (6001, 6000)])
def test_truncate_lengths(spark, n, cut):
    assert len(one(spark, X.truncate(F.col("s")), s="x" * n)) == (cut or n)


@pytest.mark.parametrize("at,length", [(4800, 6000), (4801, 4802)])
def test_truncate_at_full_stop(spark, at, length):
    assert len(one(spark, X.truncate(F.col("s")), s="x" * at + "." + "y" * 3000)) == length


def test_numbered_items(spark):
    got = one(spark, X.numbered_items(F.col("s")), s="1. exactly10c\n2. eleven chars and more\n3. about 3.14 or so it goes\n")
    assert got == ["eleven chars and more", "14 or so it goes"]


def test_topics_and_strata(spark):
    t = lambda s: one(spark, sampling.topic(F.col("s")), s=s)
    assert (t("write code"), t("decode it"), t("nothing"), t("solve the math equation in code")) == ("coding", "coding", "general", "math")
    assert [one(spark, sampling.length_bucket(F.col("s")), s="x" * n) for n in (99, 100, 499, 500)] == ["short", "medium", "medium", "long"]
    assert one(spark, sampling.strata_key(F.col("s"), F.lit("b")), s=None) == "unknown_b"


def grams(s):
    w = s.lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def greedy(texts, threshold):
    kept, seen, out = [], set(), []
    for t in texts:
        if t in seen:
            out.append(False)
            continue
        close = any(len(grams(t) & grams(k)) / len(grams(t) | grams(k)) > threshold for k in kept if grams(t) and grams(k))
        out.append(not close)
        if not close:
            kept.append(t)
            seen.add(t)
    return out


def test_greedy_dedup_is_the_sequential_scan(spark):
    r = random.Random(5)
    base = [[r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(12)] for _ in range(6)]
    texts = ["a b", "a b", "A b"]
    for _ in range(60):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "z" + str(r.randint(0, 99))
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for threshold in (0.3, 0.6):
        assert [k for _, k in values(dedup.greedy_ngram_dedup(df, "id", "text", threshold), "id", "keep")] == greedy(texts, threshold)


def test_chain_keeps_both_ends(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert values(dedup.greedy_keep(spark.range(1, 5), pairs), "id", "keep") == [(1, True), (2, False), (3, True), (4, True)]


def test_seen_texts_go_by_hash(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "four five six")], "id long, text string")
    seen = dedup.exact_first(df.where("id = 1"), "text", "id").select("text_hash")
    assert values(dedup.greedy_ngram_dedup(df, "id", "text", seen=seen), "id", "keep") == [(1, False), (2, True)]


def test_cosine_pairs_cover_all_blocks(spark):
    r = random.Random(1)
    v = [[r.gauss(0, 1) for _ in range(3)] for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = [(a, b) for a in range(30) for b in range(a + 1, 30) if cos(v[a], v[b]) > 0.5]
    assert values(dedup.cosine_pairs(df, "id", "v", 0.5, block=3), "a", "b") == want
    odd = df.union(spark.createDataFrame([(90, None), (91, [0.0, 0.0, 0.0]), (92, [1.0]), (93, [2.0])], df.schema))
    assert values(dedup.cosine_pairs(odd, "id", "v", 0.5), "a", "b") == [*want, (92, 93)]
    assert values(dedup.cosine_pairs(df.where("id < 0"), "id", "v", 0.5), "a", "b") == []


def test_cosine_join_meets_few_blocks(spark):
    """Clusters far apart: the cones that can't reach each other never meet, and what meets is bounded before whole vectors are."""
    r = np.random.default_rng(3)
    centres = np.linalg.qr(r.standard_normal((32, 32)))[0]
    rows = [(k, (centres[k % 8] + 0.02 * r.standard_normal(32)).tolist()) for k in range(800)] + [(k, centres[0].tolist()) for k in range(800, 900)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(v @ v.T > 0.9, 1)), strict=True)]
    assert values(dedup.cosine_pairs(df, "id", "v", 0.9, block=30, pivots=24), "a", "b") == want
    work = dedup.cosine_work(df, "id", "v", 0.9, block=30, pivots=24).first()
    assert work.pairs == len(want) and work.candidates < 1.5 * len(want)
    assert work.met < 900 * 899 / 2 / 4  # of eight clusters, each meets itself
    assert work.sent < 900 * 10  # of 40 blocks or so


def test_cosine_join_sends_no_more_copies_of_a_vector_as_the_table_grows(spark):
    r = np.random.default_rng(2)
    copies = []
    for n in (9_000, 36_000):
        df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(r.standard_normal((n, 8)))], "id long, v array<double>")
        work = dedup.cosine_work(df, "id", "v", 0.9).first()
        assert work.met >= n * (n - 1) / 2 * 0.2 and work.pairs > 0
        copies.append(work.sent / n)
    assert copies[1] < 1.3 * copies[0] and copies[1] < 14


def test_vectors_in_all_directions_are_compared_by_themselves_only_if_similar(spark):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(r.standard_normal((2_000, 64)))], "id long, v array<double>")
    work = dedup.cosine_work(df, "id", "v", 0.3).first()
    assert work.met == 2_000 * 1_999 / 2 and 0 < work.pairs <= work.candidates < 1.01 * work.pairs


def test_cosine_pairs_within_rounding_of_the_threshold(spark):
    """32 bits can't tell these cosines from the threshold; vectors of 300 dimensions are bounded by the leading ones."""
    cosines = [0.3 + k * 1e-9 for k in range(-40, 41) if k]
    rows = [(0, [1.0, 0.0]), *[(k + 1, [c, (1 - c * c) ** 0.5]) for k, c in enumerate(cosines)]]
    got = dedup.cosine_pairs(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.3)
    assert [b for a, b in values(got, "a", "b") if a == 0] == list(range(41, 81))
    r = np.random.default_rng(7)
    v = r.standard_normal((400, 300)) * np.geomspace(1, 1e-4, 300)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert dedup._leading(u, 0.6) < 300
    want = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(u @ u.T > 0.6, 1)), strict=True)]
    assert values(dedup.cosine_pairs(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>"), "id", "v", 0.6), "a", "b") == want


@pytest.mark.parametrize("threshold", [-0.2, 0.0, 0.3, 0.8])
def test_cosine_pairs_at_any_threshold(spark, threshold):
    r = np.random.default_rng(5)
    v = r.standard_normal((60, 16)) * np.geomspace(1, 0.05, 16)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(u @ u.T > threshold, 1)), strict=True)]
    for block, pivots in ((7, 5), (4096, 64), (1, 1)):
        assert values(dedup.cosine_pairs(df, "id", "v", threshold, block=block, pivots=pivots), "a", "b") == want


def test_greedy_embedding_dedup_is_the_sequential_scan(spark):
    r = np.random.default_rng(9)
    v = np.repeat(r.standard_normal((25, 4)), 3, axis=0) * r.choice([1.0, 2.0], (75, 1)) + r.choice([0.0, 0.01], (75, 4))
    rows = [(int(i), x.tolist()) for i, x in zip(r.permutation(75), v, strict=True)] + [(90, None), (91, [0.0] * 4), (92, [0.0] * 4), (93, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    kept, want = [], []
    for i, x in sorted(rows):
        u = np.array(x or [0.0] * 4)
        usable = np.isfinite(u).all() and u.any()
        keep = not usable or all(u @ k / np.linalg.norm(u) / np.linalg.norm(k) <= 0.6 for k in kept)
        want.append((i, keep))
        if keep and usable:
            kept.append(u)
    assert values(dedup.greedy_embedding_dedup(df, "id", "v", 0.6), "id", "keep") == want


def test_greedy_embedding_dedup_lists_no_pairs(spark, monkeypatch):
    """Rounds of the scan: kept vectors of two lengths, of several rounds, and ids that two vectors share; pairs aren't listed."""
    monkeypatch.setattr(dedup, "cosine_pairs", None)
    monkeypatch.setattr(dedup, "_ROUND_BYTES", 64 * 8 * 8)
    r = np.random.default_rng(4)
    rows = [(int(k) * 7 % 601, r.standard_normal(6 if k % 5 else 8).tolist()) for k in range(601)] + [(k, r.standard_normal(6).tolist()) for k in range(0, 600, 50)]
    kept, want = [], {}
    for i in sorted({i for i, _ in rows}):
        own = [np.array(v) / np.linalg.norm(v) for j, v in rows if j == i]
        want[i] = not any(len(u) == len(k) and u @ k > 0.6 for u in own for k in kept)
        kept += own if want[i] else []
    got = dedup.greedy_embedding_dedup(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), "id", "v", 0.6)
    assert values(got.distinct(), "id", "keep") == sorted(want.items()) and got.count() == len(rows)


def test_a_group_of_spun_copies_costs_a_row_each(spark, monkeypatch):
    """Leaders decide a large group of near copies: no pairs are listed."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    spun = lambda: " ".join(w if r.random() > 0.01 else f"z{r.randint(0, 10**6)}" for w in base)
    texts = [" ".join(base), *[spun() for _ in range(1500)], *[" ".join(f"u{k}_{j}" for j in range(20)) for k in range(50)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    compared = []
    whole = dedup._similar
    monkeypatch.setattr(dedup, "_similar", lambda pairs, *rest: compared.append(pairs.count()) or whole(pairs, *rest))
    got = [k for _, k in values(dedup.greedy_ngram_dedup(df, "id", "text", 0.5), "id", "keep")]
    assert got == greedy(texts, 0.5)
    assert sum(compared) < 3 * len(texts)


def shuffled_bytes(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def long_texts(n, words, seed):
    r = random.Random(seed)
    return [[f"w{r.randrange(10**6)}" for _ in range(words)] for _ in range(n)]


def test_overlap_with_few_references_sends_few_ngrams(spark, monkeypatch):
    texts = long_texts(200, 400, 1)
    items = [t[:300] for t in texts[:5]]
    df, other = (spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(x)], "id long, text string") for x in (texts, items))
    before = shuffled_bytes(spark)
    assert values(dedup.similar_pairs(df, "id", "text", 0.1, other=other), "a", "b") == [(k, k) for k in range(5)]
    assert shuffled_bytes(spark) - before < 4 * 200 * 400
    monkeypatch.setattr(dedup, "_SENT_KEYS", 0)  # as for many references
    assert values(dedup.similar_pairs(df, "id", "text", 0.1, other=other), "a", "b") == [(k, k) for k in range(5)]


def test_rounds_of_leaders_send_only_sets_of_pairs(spark, monkeypatch):
    """Some chains of near copies take several rounds; the many other sets aren't sent in any."""
    texts = long_texts(400, 300, 2)
    for k in range(0, 30):  # each is similar to the one before
        texts.append([*texts[-1 if k % 5 else k][6:], *[f"n{k}x{i}" for i in range(6)]])
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, text string")
    grams = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    kept = []
    for k, g in enumerate(grams):
        if not any(len(g & grams[j]) / len(g | grams[j]) > 0.95 for j in kept):
            kept.append(k)
    before = shuffled_bytes(spark)
    assert [k for k, keep in values(dedup.greedy_ngram_dedup(df, "id", "text", 0.95), "id", "keep") if keep] == kept
    assert shuffled_bytes(spark) - before < 30 * sum(map(len, grams))
    assert len(kept) < len(texts)
    monkeypatch.setattr(dedup, "_SENT_KEYS", 0)
    assert [k for k, keep in values(dedup.greedy_ngram_dedup(df, "id", "text", 0.95), "id", "keep") if keep] == kept


def test_pairs_of_a_cluster_are_found_without_sending_them(spark, monkeypatch):
    """Clusters of near copies, one of them of several blocks, and chains across clusters: nearly no pair goes on to have its sets sent."""
    r = random.Random(11)
    texts = []
    for k, size in enumerate([150, 40, 40, 1, 2]):
        base = [f"w{k}x{i}" for i in range(80)]
        texts += [" ".join(w if r.random() > 0.03 else f"z{r.randint(0, 10**6)}" for w in base) for _ in range(size)]
    for k in range(1, 60):  # each is similar to the next few
        texts.append(" ".join(f"c{i}" for i in range(4 * k, 4 * k + 40)))
    r.shuffle(texts)
    sets = [grams(t) for t in texts]
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = [(f"{a:03}", f"{b:03}", round(s, 9)) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (s := likeness(a, b)) > 0.5]
    df = spark.createDataFrame([(f"{k:03}", t) for k, t in enumerate(texts)], "id string, text string").repartition(3)
    compared = []
    whole = dedup._similar
    monkeypatch.setattr(dedup, "_similar", lambda pairs, *rest: compared.append(pairs.count()) or whole(pairs, *rest))
    for limits in ((8 << 20, 4096), (64_000, 4096), (8 << 20, 7)):
        for name, limit in zip(("_HOME_BYTES", "_HOME_SETS"), limits, strict=True):
            monkeypatch.setattr(dedup, name, limit)
        got = dedup.similar_pairs(df, "id", "text", 0.5).withColumn("similarity", F.round("similarity", 9))
        assert values(got, "a", "b", "similarity") == want
    assert len(want) > 10_000 and max(compared) < len(texts)


def test_first_rows_are_those_of_exact_first(spark, monkeypatch):
    df = spark.createDataFrame([(5, "a"), (3, "a"), (4, "b"), (1, None), (2, ""), (9, "b")], "id long, text string")
    want = values(dedup.exact_first(df, "text", "id").where("is_first"), "id")
    assert values(dedup.first_rows(df, "text", "id"), "id") == want
    monkeypatch.setattr(dedup, "_SENT_KEYS", 0)
    assert values(dedup.first_rows(df, "text", "id"), "id") == want


def test_similar_pairs_are_all_pairs_above(spark):
    r = random.Random(8)
    texts = [None, "", "a b", *[" ".join(r.choice("abcde") for _ in range(r.randint(3, 14))) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = {k: grams(t) for k, t in enumerate(texts) if t and grams(t)}
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for threshold in (0.05, 0.25, 0.5):
        want = [(a, b, round(likeness(a, b), 9)) for a in sets for b in sets if a < b and likeness(a, b) > threshold]
        got = dedup.similar_pairs(df, "id", "text", threshold).withColumn("similarity", F.round("similarity", 9))
        assert values(got, "a", "b", "similarity") == want
        across = [(a, b) for a in sets for b in sets if a < 30 <= b and likeness(a, b) > threshold]
        assert values(dedup.similar_pairs(df.where("id < 30"), "id", "text", threshold, other=df.where("id >= 30")), "a", "b") == across


def test_samplers(spark):
    df = spark.createDataFrame([(k, "abc"[min(k % 7, 2)]) for k in range(70)], "id long, t string")
    balanced = sampling.topic_balanced(df, 16, "id", "t", "id").groupBy("t").count().orderBy("t").collect()
    assert [r["count"] for r in balanced] == [6, 5, 5]
    assert sampling.stratified(df, 20, "id", "t", least=3).count() <= 20
    assert sampling.diversity_sample(df, 70, "topic", "id", "id", topic="t").count() == 70
    assert sampling.diversity_sample(df, 9, "nonsense", "id", "id").count() == 9


@pytest.mark.parametrize("buckets", [1, 4, 1 << 16])
def test_samplers_take_the_least_hashes(spark, monkeypatch, buckets):
    """The cut-off by buckets gives the rows that sorting each group would give."""
    monkeypatch.setattr(sampling, "SMALL", 3)
    if buckets < 1 << 16:
        monkeypatch.setattr(sampling, "BUCKETS", buckets)
        monkeypatch.setattr(sampling, "_hash_bucket", lambda h: F.pmod(F.conv(F.substring(h, 1, 1), 16, 10).cast("int"), F.lit(16)) * buckets / 16)
    md5 = lambda seed, k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest()
    rows = [(k, "abc"[min(k % 9, 2)]) for k in range(900)] + [(2000, "d")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    least = lambda ids, n, seed=42: sorted(ids, key=lambda k: md5(seed, k))[:n]
    of = {t: [k for k, x in rows if x == t] for t in "abcd"}
    assert values(sampling.random_n(df, 40, "id"), "id") == [(k,) for k in sorted(least([k for k, _ in rows], 40))]
    assert sampling.random_n(df, 5000, "id").count() == 901
    want = sorted(least(of["a"], 51) + least(of["b"], 51) + least(of["c"], 50) + least(of["d"], 50))
    assert values(sampling.topic_balanced(df, 202, "id", "t", "id"), "id") == [(k,) for k in want]
    chosen = [k for t, ids in of.items() for k in least(ids, min(len(ids), max(7, 90 * len(ids) // 901)))]
    assert values(sampling.stratified(df, 90, "id", "t", least=7), "id") == [(k,) for k in sorted(least(chosen, 90, "42-trim"))]
    v = spark.createDataFrame([(k, k % 3, [float(k * k % 97)]) for k in range(300)], "id long, label int, v array<double>")
    mean = [np.mean([k * k % 97 for k in range(300) if k % 3 == c]) for c in range(3)]
    far = {c: sorted((round(abs(k * k % 97 - mean[c]), 9), k) for k in range(300) if k % 3 == c) for c in range(3)}
    want = sorted(k for c, n in ((0, 21), (1, 20), (2, 20)) for _, k in far[c][: n // 2] + far[c][len(far[c]) - (n - n // 2) :])
    assert values(sampling.cluster_balanced(v, 61, "id", "label", "v"), "id") == [(k,) for k in want]


def test_cluster_sampler_takes_near_and_far(spark):
    rows = [(k, 2, [float(k)]) for k in range(5)] + [(9, 5, [1.0])]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    assert values(sampling.cluster_balanced(df, 1, "id", "label", "v"), "id") == []  # one row for cluster ids below 1 only
    assert values(sampling.cluster_balanced(df, 4, "id", "label", "v"), "id") == [(2,), (4,), (9,)]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "x y"), ("a", "X z"), ("b", "")], "t string, r string")
    m = metrics.diversity(df, "t", "r").first()
    assert m.topic_entropy == pytest.approx(0.9182958) and m.vocab_size == 3 and m.topic_distribution == {"a": 2, "b": 1} and m.avg_length == 2
    assert metrics.entropy(df.where("t = 'q'"), "t").first()["entropy"] == 0.0
    h = values(metrics.histogram(spark.range(101), "id", 50), "bin", "n")
    assert len(h) == 50 and h[-1] == (49, 3)


@pytest.mark.parametrize("accuracy", [6, 50, 10_000])
def test_percentiles_are_exact(spark, monkeypatch, accuracy):
    """Also where the sketch is so coarse that its bounds matter."""
    monkeypatch.setattr(metrics, "ACCURACY", accuracy)
    r = np.random.default_rng(1)
    groups = {"normal": r.standard_normal(700), "ties": r.integers(0, 3, 500).astype(float), "wide": 10.0 ** r.uniform(-300, 300, 400), "one": np.array([4.5]), "two": np.array([1.0, -1.0]), None: r.standard_normal(90)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("one", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"lo": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "p99": 0.99, "hi": 1.0}
    got = {x.g: x for x in metrics.percentiles(df, "x", shares, "g").collect()}
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        for name, q in shares.items():
            assert got[g][name] == pytest.approx(np.percentile(v, 100 * q), rel=1e-9), (g, name)
    assert metrics.percentiles(df, "x", {"m": 0.5}).first().m == pytest.approx(np.median(np.concatenate(list(groups.values()))))
    assert metrics.percentiles(df.where("g = 'empty'"), "x", {"m": 0.5}).first().m is None
    s = {x.g: x for x in metrics.summary(df, "x", "g").collect()}
    assert s["empty"].median is None and s["empty"].n == 0 and s[None].n == 90 and s["two"].median == 0.0


def test_benchmarks(spark):
    runs = spark.createDataFrame([("m", 1.0, 10.0, None, None, None), ("m", 3.0, 20.0, 0.5, None, 4.0)], "method string, tokens_per_second double, total_time_ms double, acceptance_rate double, speedup_vs_baseline double, memory_used_mb double")
    r = benchmarks.run_summary(runs).first()
    assert (r.num_runs, r.std_tokens_per_second, r.avg_acceptance_rate, r.avg_speedup, r.p50_latency_ms, r.p90_latency_ms) == (2, 1.0, 0.5, None, 15.0, 19.0)
    roll = spark.createDataFrame([("int8", 0, 1.0, 1.0), ("int4", 1, 1.0, 1.0)], "technique string, ord int, peak_mb double, final_mb double")
    assert values(benchmarks.compare_techniques(roll), "technique", "savings_pct", "is_best") == [("int4", 0.0, False), ("int8", 0.0, True)]


def test_kv_grid(spark):
    g = {(r.model, r.seq_len): r.gb for r in benchmarks.cache_grid(spark.createDataFrame([("7b", 32, 32, 128), ("70b", 80, 64, 128)], "model string, layers int, heads int, head_dim int"), [4096, 32768], {"fp16": 2}).collect()}
    assert g == {("7b", 4096): 2.0, ("7b", 32768): 16.0, ("70b", 4096): 10.0, ("70b", 32768): 80.0}


def test_quantisation(spark):
    df = spark.createDataFrame([([0.5, 1.5, 2.5, -127.0],), ([0.0, 0.0],)], "v array<double>")
    s = vectors.symmetric_scale(F.col("v"))
    got = [r.q for r in df.select(vectors.quantize_symmetric(F.col("v"), s).alias("q")).collect()]
    assert got == [[0, 2, 2, -127], [0, 0]]
    q = list(range(-8, 8)) + [3]
    packed = spark.createDataFrame([(q,)], "q array<int>").select(vectors.pack_int4(F.col("q")).alias("p"), F.size("q").alias("n"))
    assert packed.select(vectors.unpack_int4(F.col("p"), F.col("n")).alias("u")).first()["u"] == q


def test_low_rank_rebuild(spark):
    rows = [(k, [float(k), 2.0 * k, 3.0]) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    factors, _, right = vectors.low_rank(df, "id", "v", 1.1)
    for r in vectors.rebuild(factors, "id", right).collect():
        assert r.restored == pytest.approx(dict(rows)[r.id])


def test_factors_of_many_tasks(spark):
    rows = [(k, [None, [], [1.0, None], [float(k % 7), 2.0, -k / 9]][k % 4]) for k in range(41)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    x = np.array([[*(e or 0.0 for e in v or []), 0.0, 0.0, 0.0][:3] for _, v in rows])
    factors, values, _ = vectors.low_rank(df, "id", "v", 1.1)
    assert values == pytest.approx(np.linalg.svd(x)[1].tolist(), rel=1e-5)
    assert {r.id: r.u is None for r in factors.collect()} == {k: v is None for k, v in rows}
    assert vectors.low_rank(df.where("size(v) = 0 or v is null"), "id", "v")[1:] == ([], [])


def test_low_rank_keeps_small_singular_values(spark):
    """Values down to 1e-9 of the largest, which a Gram matrix would lose; orthonormal right vectors; the rank by energy."""
    r = np.random.default_rng(0)
    u, v = np.linalg.qr(r.standard_normal((1500, 48)))[0], np.linalg.qr(r.standard_normal((48, 48)))[0]
    s = np.geomspace(1, 1e-9, 48)
    x = (u * s) @ v.T
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, v array<double>").repartition(6)
    factors, values, right = vectors.low_rank(df, "id", "v", 1.1)
    assert np.array(values) == pytest.approx(s, rel=1e-5)
    right = np.array(right)
    assert np.abs(right @ right.T - np.eye(48)).max() < 1e-12
    back = {r.id: r.restored for r in vectors.rebuild(factors, "id", right.tolist()).collect()}
    assert np.abs(np.array([back[k] for k in range(1500)]) - x).max() < 1e-12
    for share in (0.5, 0.99, 0.999999):
        assert len(vectors.low_rank(df, "id", "v", share)[1]) == int((np.cumsum(s**2) / (s**2).sum() < share).sum()) + 1


def test_grouped_memory_and_prompt_parts(spark):
    m = vectors.grouped_memory(32, 32, 8, 128, 4096)
    assert (m["full_bytes"], m["ratio"]) == (2 << 30, 4.0) and vectors.grouped_memory(0, 32, 8, 128, 1)["ratio"] == 0.0
    assert [one(spark, evals.prompt_part(F.col("s"), "<|assistant|>"), s=t) for t in ("ask<|assistant|>say<|assistant|>", "no header", None)] == ["ask", "no header", None]


def test_outputs_are_split_by_reason(spark):
    df = spark.createDataFrame([(1, None), (2, "short"), (3, "")], "id long, rejection_reason string")
    kept, gone = filters.split_outputs(df)
    assert values(kept, "id") == [(1,)] and values(gone, "id") == [(2,), (3,)]


def test_turns_have_their_own_ids(spark):
    from weftline.plans import curation

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c, t in ((0, 1000), (0, 1001), (1, 0), (1, 1))]
    got = curation.turn_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert values(got, "id", "response") == [(1000, "0-1001"), (1 << 20, "1-1")]


def test_cache_eviction(spark):
    log = spark.createDataFrame([(0, s, t, w) for s, (t, w) in enumerate([(63, 1.0), (64, 2.0), (65, 2.0), (64, 1.0), (66, 9.0)])], "layer int, step long, token_idx int, weight double")
    d = dict(values(cache.decayed_scores(log), "token_idx", "score"))
    assert d[64] == pytest.approx(2 * 0.99 + 1) and d[65] == 2.0
    assert values(cache.evict_lowest(cache.decayed_scores(log), 1), "token_idx") == [(65,)]
    assert values(cache.heavy_hitters(cache.mean_attention(log)), "token_idx") == [(66,)]
    assert values(cache.evict_light(cache.mean_attention(log), 5), "token_idx") == [(64,), (65,)]
    assert values(cache.evict_oldest(log, 1), "token_idx") == [(65,)]


def test_trie_and_choices(spark):
    c = spark.createDataFrame([(0, [1, 2], [0.5, 0.4]), (1, [1, 3], [0.9, 0.1]), (2, [1, 2], [0.7, 0.7])], "cand_ord int, tokens array<int>, probs array<double>")
    nodes = trie.trie(c)
    assert values(nodes, "path", "prob") == [([1], 0.5), ([1, 2], 0.4), ([1, 3], 0.1)]
    assert [r.path for r in trie.leaves(nodes).collect()] == [[1, 2], [1, 3]]
    p = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.05), (1, 3, 0.05)], "g int, token int, prob double")
    assert values(trie.nucleus(p, 0.5, "g"), "token") == [(1,)]
    assert values(trie.top_k(p, 2, "g", "prob"), "token") == [(1,), (2,), (3,)]


def test_rouge(spark):
    rows = [("the cat the", "the the dog", 2 / 3, 0.0), ("a b c d", "a c d", 6 / 7, 0.4), ("", "", 0.0, 0.0)]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    got = {(r.a, r.b): r for r in evals.rouge(df, "a", "b").collect()}
    for a, b, one_, two in rows:
        assert got[a, b].rouge1 == pytest.approx(one_) and got[a, b].rouge2 == pytest.approx(two)
    assert got["a b c d", "a c d"].rougeL == pytest.approx(6 / 7)


STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun",
    "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "dying": "die", "skies": "sky", "news": "news", "enjoy": "enjoy", "spied": "spi", "died": "die", "dies": "die", "flies": "fli", "by": "by", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems():
    """The published examples of each step, and the exceptions."""
    assert {w: stem(w) for w in STEMS} == STEMS


def brute_rouge(prediction, reference, stems=False):
    a, b = ([stem(w) if stems and len(w) > 3 else w for w in re.findall("[a-z0-9]+", (t or "").lower())] for t in (prediction, reference))
    f1 = lambda shared, total: 2 * shared / total if total else 0.0
    grams = [[collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for w in (a, b)] for n in (1, 2)]
    row = [0] * (len(b) + 1)
    for w in a:
        before, row = row, [0]
        for k, x in enumerate(b):
            row.append(before[k] + 1 if x == w else max(before[k + 1], row[-1]))
    return *(f1((x & y).total(), x.total() + y.total()) for x, y in grams), f1(row[-1], len(a) + len(b))


@pytest.mark.parametrize("stems", [False, True])
def test_rouge_query_scores_whole_texts(spark, tmp_path, stems):
    r = random.Random(0)
    text = lambda n: " ".join(r.choice(["The", "cat", "cats", "relating", "relational", "on-a", "mat", "x1", "É"]) for _ in range(n))
    head = text(80)
    items = [(0, f"{head} {text(200)}"), (1, f"{head} alpha beta"), (2, text(300)), (3, ""), (4, None), (5, "one"), (5, text(90)), (6, "a b c"), (9, "no partner")]
    texts = [(0, f"{head} {text(150)}"), (1, f"{head} beta alpha"), (2, text(100)), (3, ""), (4, "a b"), (5, "one two"), (6, None), (7, "no partner"), (11, text(40)), (14, text(50))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = queries_records.f37_rouge_stemmed if stems else queries_records.f37_rouge
    got = sorted((x.doc_id, x.item_id, x.rouge1, x.rouge2, x.rougeL) for x in run(spark, str(tmp_path)).collect())
    want = sorted((i, k, *brute_rouge(t, s, stems)) for i, s in texts for k, t in items if i % len(items) == k)
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x == pytest.approx(y, abs=1e-6)


@pytest.mark.parametrize("stems", [False, True])
def test_rouge_scores_a_batch_in_bounded_pieces(monkeypatch, stems):
    """Pieces of few words, rows longer than a piece and empty ones, as one whole batch gives them; arrays are as long as a piece."""
    import pyarrow as pa

    r = random.Random(1)
    words = lambda n: [r.choice(["the", "cat", "cats", "relating", "relational", "mat"]) for _ in range(n)]
    rows = [(words(r.choice([0, 3, 40])), words(r.choice([0, 5, 30, 120]))) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(200)), "_a": [a for a, _ in rows], "_b": [b for _, b in rows]}, pa.schema([("id", pa.int64()), ("_a", pa.list_(pa.string())), ("_b", pa.list_(pa.string()))]))
    seen, score = [], evals._scores
    monkeypatch.setattr(evals, "_WORDS", 100)
    monkeypatch.setattr(evals, "_scores", lambda sides, m, stems: seen.append([sum(map(len, s.to_pylist())) for s in sides] + [m]) or score(sides, m, stems))
    got = pa.Table.from_batches(evals._rouge(iter([batch.slice(0, 0), batch]), stems)).to_pydict()
    assert got["id"] == list(range(200))
    assert all(a + b <= 100 or m == 1 for a, b, m in seen) and len(seen) > 20
    for k, (a, b) in enumerate(rows):
        assert (got["rouge1"][k], got["rouge2"][k], got["rougeL"][k]) == pytest.approx(brute_rouge(" ".join(a), " ".join(b), stems), abs=1e-9)


ANSWERS = [("Yes", " yes ", True), ("1,234", "1234", True), ("104", "100", True), ("106", "100", False), ("5%", "5", True), ("0", "0", True), ("0.01", "0", False), ("nan", "nan", True), ("1d", "1", False), ("abc", "abd", False), ("", "", True), ("-95", "-100", True), ("3.5e2", "350", True), (None, "x", False)]


@pytest.mark.parametrize(("output", "expected", "same"), ANSWERS)
def test_relaxed_answers(spark, output, expected, same):
    assert one(spark, S.relaxed_match(F.col("a"), F.col("b")), a=output, b=expected) is same


@pytest.mark.parametrize(("cell", "n"), [("12", 12), ("week 1: 7", 7), ("x", 0), ("", 0), ("3.0", 3), ("total: x", 0), (None, 0)])
def test_loose_ints(spark, cell, n):
    assert one(spark, S.loose_int(F.col("s")), s=cell) == n


def test_padding(spark):
    df = spark.createDataFrame([(1, [5, 6]), (1, [7]), (2, [8])], "b int, ids array<int>")
    assert values(evals.padded(df, "b", "ids"), "b", "input_ids", "attention_mask") == [(1, [5, 6], [1, 1]), (1, [7, 0], [1, 0]), (2, [8], [1])]


def test_dates_of_files():
    from weftline.sources.logs import choose_files

    names = ["chatbot.log", "chatbot_202312.log"]
    assert choose_files([*names, "sample_1.log"], dt.date(2024, 1, 1)) == ["sample_1.log"]
    assert choose_files(names, dt.date(2024, 1, 1)) == names
    assert choose_files(names, dt.date(2024, 1, 2)) == ["chatbot.log"]
    assert choose_files(["chatbot.log"], dt.date(2024, 1, 1)) == ["chatbot.log"]
