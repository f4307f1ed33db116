"""The quality cascade, importance resampling and the interval join against brute force, and on awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import cascade, intervals, queries, resample
from folioscope.llm.cascade import Estimate, Rule

TOP = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_texts(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like results."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeÄ#1!") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \t\n ", "one", "a b c d e a b c d e", "x " * 40, "été où naïve ÉTÉ", "퟿\U0001f600 emoji \u0000 nul", "y" * 70_000, " ".join(f"w{i % 977}" for i in range(30_000)), "same line\nsame line\r\nsame line\n\n \n", "a plain sentence of more than ten words with which nothing is wrong"]
    for _ in range(60):
        part = [word() for _ in range(rng.randint(1, 12))]
        texts.append("".join(w + rng.choice(["\n", " ", "  ", "\t", "\x0b"]) for w in part * rng.randint(1, 4) + [word() for _ in range(rng.randint(0, 30))]))
    rows = [(i if i % 7 else None, t, 1, 2, "x", 5.0) for i, t in enumerate(texts)] + [(3, "one", 1, 2, "x", 5.0), (3, "other text of the same id", 1, 2, "x", 5.0)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, rank int, kept string, _words double")


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(odd_texts):
    got = cascade.measured(odd_texts).collect()
    want = sorted((repr(r.doc_id), *brute_measures(r.text)) for r in odd_texts.collect())
    assert sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_cascade_keeps_the_same_rows_in_any_order(odd_texts):
    rows = cascade.measured(odd_texts)
    some = cascade.RULES[:4]
    kept = [sorted(r[0] for r in rows.select(F.when(cascade.base_failed(), False).otherwise(cascade.passes(order))).collect()) for order in list(itertools.permutations(some))[::5]]
    assert all(k == kept[0] for k in kept) and len(set(kept[0])) == 2


def test_cascade_stops_at_the_first_rule_that_fails(spark):
    rows = spark.range(10).withColumn("n_words", F.col("id"))
    rules = [Rule("small", lambda: F.col("n_words") < 5), Rule("never reached by small ones", lambda: F.when(F.col("n_words") < 5, F.raise_error(F.lit("evaluated"))).otherwise(F.col("n_words") > 7).cast("boolean"))]
    got = rows.select("id", cascade.passes(rules).alias("kept"), cascade.rejected_by(rules).alias("why")).collect()
    assert [r.id for r in got if r.kept] == [5, 6, 7] and [r.why for r in got] == ["small"] * 5 + [None] * 3 + ["never reached by small ones"] * 2


def test_rules_are_ordered_by_rejection_per_cost(spark, odd_texts):
    rule = lambda n: Rule(n, lambda: F.lit(True))
    order = cascade.ordered([Estimate(rule("dear"), 10.0, 0.9), Estimate(rule("cheap"), 1.0, 0.5), Estimate(rule("idle"), 2.0, 0.0), Estimate(rule("quick idle"), 1.0, 0.0)])
    assert [r.name for r in order] == ["cheap", "dear", "quick idle", "idle"]
    found = cascade.estimate(cascade.measured(odd_texts))
    n = odd_texts.count()
    for e in found:
        assert e.cost > 0 and e.selectivity == pytest.approx(cascade.measured(odd_texts).where(e.rule.fails()).count() / n)


def test_quality_rules_awkward(odd_texts):
    got = cascade.judge(odd_texts).collect()
    assert len(got) == odd_texts.count() and not any(r.kept and r.base_failed for r in got)
    assert all(r.base_failed for r in got if r.n_words < 10)
    assert cascade.judge(odd_texts.limit(0)).collect() == []


def brute_sample(docs, target, runs=1, percent=10, least=20, buckets=10_000):
    def features(text):
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in made:
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        rank.setdefault(r, []).append(k + 1)
    return sorted(((*r[:4], rank[r].pop() if rank.get(r) else None) for r in rows), key=repr)


@pytest.mark.parametrize(("runs", "percent", "least"), [(1, 10, 20), (2, 55, 3), (3, 100, 1)])
def test_resampling(spark, odd_texts, runs, percent, least):
    target = spark.createDataFrame([("one naïve text of w1 w2 w3",), (None,), ("w4 w5 abc",)], "text string")
    got = resample.resample(odd_texts, target, percent, runs=runs, least_words=least)
    want = brute_sample([(r.doc_id, r.text) for r in odd_texts.collect()], [r.text for r in target.collect()], runs, percent, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_resampling_of_empty_tables(spark, odd_texts):
    none = odd_texts.limit(0)
    assert resample.resample(none, odd_texts).collect() == []
    assert resample.resample(odd_texts, none).count() == odd_texts.count()


def test_gains_are_one_literal_in_the_plan(spark, odd_texts):
    plan = resample.scored(odd_texts, list(range(300)))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "element_at([0,1,2" in plan and "Generate" not in plan



def brute_sessions(clicks, gap=timedelta(minutes=15)):
    out, held = [], {}
    for client, ts, kind in sorted((c for c in clicks if c[0] is not None and c[1] is not None), key=lambda c: (c[0], c[1])):
        s = held.get(client)
        if s is None or ts - s[1] > gap:
            s = held[client] = [ts, ts, False]
            out.append((client, s))
        if ts > s[1]:
            s[2] = False
        s[1] = ts
        s[2] |= kind == "error"
    return [(c, *s) for c, s in out]


EPOCH = datetime(1970, 1, 1)


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def brute_pairs(sales, lines, clicks):
    inf = math.inf
    slot = lambda t: us(t) // intervals.SLOT
    spans = [(c, slot(a), inf if o else slot(b), zlib.crc32(str(us(a)).encode())) for c, a, b, o in brute_sessions(clicks)]
    last = {}
    for i, t in lines:
        if i is not None and t is not None:
            last[i] = max(last.get(i, t), t)
    out = {}
    for i, client, status, sold in sales:
        if client is None or sold is None:
            continue
        s, e = slot(sold), inf if status == "open" else slot(max(sold, last.get(i, sold)))
        for c, s2, e2, crc in spans:
            if c == client and s <= e2 and s2 <= e:
                rel = intervals.RELATIONS[3 * ((s > s2) + (s >= s2)) + (e > e2) + (e >= e2)]
                r = out.setdefault((i, rel), [0, None, 0])
                both = e == inf and e2 == inf
                r[0] += 1
                r[1] = r[1] if both else (r[1] or 0) + int(min(e, e2) - max(s, s2) + 1)
                r[2] += crc
    return sorted(((i, rel, *v) for (i, rel), v in out.items()), key=repr)


def shop(rng, n, start=datetime(2023, 12, 30), hours=24 * 12):
    at = lambda: start + timedelta(microseconds=rng.randrange(hours * 3600 * 1_000_000))
    client = lambda: None if rng.random() < 0.05 else 7 if rng.random() < 0.4 else rng.randrange(4)
    clicks = [(client(), None if rng.random() < 0.03 else at(), rng.choice(["view", "error", None])) for _ in range(n)]
    # one session over days, another that goes on at exactly the gap, and one that just doesn't
    clicks += [(9, start + timedelta(minutes=14 * i), "error" if i == 600 else "view") for i in range(700)]
    clicks += [(8, start + timedelta(minutes=15 * i), "view") for i in range(70)] + [(8, start + timedelta(minutes=15 * 69), "error"), (6, start, "view"), (6, start + timedelta(minutes=15, microseconds=1), "error")]
    sales = [(None if rng.random() < 0.03 else i % (n - 3), rng.choice([client(), 8, 9]), rng.choice(["open", "done", None]), None if rng.random() < 0.03 else at()) for i in range(n)]
    lines = [(rng.choice([None, i, i]), None if rng.random() < 0.1 else at()) for i in list(range(n)) * 2]
    return clicks, sales, lines


def shop_frames(spark, clicks, sales, lines, kind="timestamp_ntz"):
    as_kind = lambda df, c: df.withColumn(c, F.col(c).cast(kind))
    return (
        as_kind(spark.createDataFrame(sales, "sale_id long, client_id long, status string, sold_at timestamp_ntz").withColumn("key", F.lit("k")).withColumn("s", F.lit(1)), "sold_at"),
        as_kind(spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz").withColumn("client_id", F.lit(1)), "shipped_at"),
        as_kind(spark.createDataFrame(clicks, "client_id long, ts timestamp_ntz, kind string").withColumn("first", F.lit(1)).withColumn("cell", F.lit("x")), "ts"),
    )


@pytest.mark.parametrize(("seed", "block", "group_rows"), [(1, 4096, 32768), (2, 5, 40), (3, 1, 1)])
def test_interval_join(spark, seed, block, group_rows):
    clicks, sales, lines = shop(random.Random(seed), 150 if block > 1 else 40)
    got = intervals.sales_and_sessions(*shop_frames(spark, clicks, sales, lines), block=block, group_rows=group_rows)
    assert got.columns == ["sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc"]
    want = brute_pairs(sales, lines, clicks)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert {r[1] for r in want} == set(intervals.RELATIONS) or block == 1


def test_sessions_over_block_edges(spark):
    clicks, _, _ = shop(random.Random(4), 400, datetime(1969, 12, 20))
    _, _, frame = shop_frames(spark, clicks, [(1, 1, None, None)], [(1, None)])
    got = intervals.sessions(frame, "client_id", "ts", F.col("kind") == "error")
    assert sorted(tuple(r) for r in got.collect()) == sorted((c, us(a), us(b), o) for c, a, b, o in brute_sessions(clicks))


def test_times_without_a_zone_do_not_follow_the_session(spark):
    at = [datetime(2024, 3, 10, 2, 30), datetime(2024, 11, 3, 1, 30, 0, 7), datetime(1969, 7, 20, 20, 17, 40, 999_999)]
    frame = spark.createDataFrame([(t,) for t in at], "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [r[0] for r in frame.select(intervals.micros(frame, "ts")).collect()] == [us(t) for t in at]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_interval_join_of_empty_tables(spark):
    clicks, sales, lines = shop(random.Random(6), 20)
    full = shop_frames(spark, clicks, sales, lines)
    for k in range(3):
        some = [f.limit(0) if i == k else f for i, f in enumerate(full)]
        got = intervals.sales_and_sessions(*some).count()
        assert (got == 0) == (k != 1)


def test_bitmap_scan_finds_each_pair_once():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n, m, k = rng.integers(0, 40, 3)
        lk, rk = rng.integers(0, max(k, 1), n), rng.integers(0, max(k, 1), m)
        ls, rs = rng.integers(-9, 30, n), rng.integers(-9, 30, m)
        le, re_ = ls + rng.integers(0, 12, n), rs + rng.integers(0, 12, m)
        le[rng.random(n) < 0.2] = intervals.OPEN
        re_[rng.random(m) < 0.2] = intervals.OPEN
        got = sorted((int(a), int(b)) for x, y in intervals.overlaps(lk, ls, le, rk, rs, re_, batch=7) for a, b in zip(x, y, strict=True))
        assert got == [(i, j) for i in range(n) for j in range(m) if lk[i] == rk[j] and ls[i] <= re_[j] and rs[j] <= le[i]]


@pytest.mark.parametrize("name", ["op11_quality_rules", "op12_importance_resampling", "op13_interval_overlaps"])
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "clicks", "sales", "sale_lines"):
        c.sql(f"create view {t} as select * from '{TOP}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, TOP), c.sql(queries.ORACLES[name])
    at = [rel.columns.index(n) for n in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
