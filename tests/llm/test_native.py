from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobtrail.llm import mixing, quality
from jobtrail.llm.queries import ORACLE, QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == ""


def targets(sizes):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        out = {s: 3 * sizes[s] if s in capped else weight[s] * left / open_weight for s in names}
        above = {s for s in names if s not in capped and out[s] > 3 * sizes[s]}
        if not above:
            return out
        capped |= above


def test_mix_reaches_its_targets(docs):
    given = [(i, "w " * (i * 7919 % 97), ["a", "b", "é", "𝒳", None, "c"][i % 6]) for i in range(600)]
    given += [(1000 + i, "tiny", "small") for i in range(5)] + [(2000, None, "none"), (2001, "", "none"), (None, "null id", "a")]
    given += [(3000, "one two three", "a")] * 3
    rows = mixing.mix(docs(*given).withColumn("size", F.lit("x")).withColumn("h", F.lit(1))).collect()
    sizes = Counter()
    for _, t, s in given:
        sizes[s] += len((t or "").split())
    want, source_of = targets(sizes), {i: s for i, _, s in given}
    got = Counter()
    assert len(rows) == len(given)
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        got[s] += r.taken
    for s in sizes:
        assert abs(got[s] - want[s]) <= max(3, 0.005 * want[s]), s
    assert len({r.taken for r in rows if r.doc_id == 3000}) == 1
    assert mixing.mix(docs()).count() == 0


def brute_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_base(spark, docs):
    odd = [None, "", " \n\t", "a b c a b c", "a a a a a a", "x\x0by\x1cz\x0c w\r\n\r\n", "é é é 😀😀 #*$%&|<>", "l\n l\nl\n\n\nl\n", "w " * 50_000]
    given = dict(enumerate(odd)) | {100 + r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for r in quality.judge(docs(*given.items()).withColumn("votes", F.lit(1)).withColumn("n", F.lit(1))).collect():
        want = brute_features(given[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept or not r.base_failed)
        seen += 1
    assert seen == len(given)
    assert quality.judge(docs()).count() == 0


def test_quality_estimate_equals_a_loop(spark):
    patterns = {(1, 1, 1): 800, (1, 1, 0): 90, (-1, 1, 1): 40, (-1, -1, 1): 30, (0, -1, -1): 20, (1, -1, 1): 5}
    floors = (0.995, 0.9, 0.7)
    prior, good, bad = quality.PRIOR, [quality.RIGHT_ON_GOOD] * 3, [quality.RIGHT_ON_BAD] * 3

    def judge(v):
        odds = math.log(prior / (1 - prior))
        for x, a, b in zip(v, good, bad):
            odds += 0 if not x else math.log(a / (1 - b)) if x > 0 else math.log((1 - a) / b)
        return 1 / (1 + math.exp(-odds))

    for _ in range(quality.ROUNDS):
        q = {v: judge(v) for v in patterns}
        prior = (sum(n * q[v] for v, n in patterns.items()) + 1) / (sum(patterns.values()) + 2)
        rate = lambda j, vote, w, lo, hi: max(lo, min(hi, (sum(n * w(v) for v, n in patterns.items() if v[j] == vote) + 2) / (sum(n * w(v) for v, n in patterns.items() if v[j]) + 3)))
        good = [rate(j, 1, lambda v: q[v], floors[j], quality.MOST_SURE) for j in range(3)]
        bad = [rate(j, -1, lambda v: 1 - q[v], *quality.ON_BAD) for j in range(3)]
    df = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<tinyint>, n bigint")
    for r in quality.estimate(df, floors).collect():
        assert r.posterior == pytest.approx(judge(tuple(r.votes)), abs=1e-9)


def test_quality_follows_the_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r) for r in QUERIES["op2_quality_rules"](spark, SF).collect() if r.doc_id in labels]
    passed = [(y, r.kept) for y, r in rows if not r.base_failed]
    assert sum(k for y, k in passed if y) / sum(y for y, _ in passed) > 0.97
    bad = [r.kept for y, r in rows if not y]
    assert sum(bad) / len(bad) < 0.1
