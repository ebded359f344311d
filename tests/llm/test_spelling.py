"""Spelling variants against a comparison of all words with all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from jobtrail.llm import spelling

UPPER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows) -> Counter:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= 7
    return Counter({w: n for w, n in counts.items() if n >= 2})


def brute_variants(counts) -> dict:
    found = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if near(a, b):
            found[a].append(b)
            found[b].append(a)
    best = {w: min(ns, key=lambda x: (-counts[x], x)) for w, ns in found.items() if ns}
    form = {w: b for w, b in best.items() if counts[b] >= 10 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), counts[w], len(found[w]), counts[form[w]] if w in form else None) for w in counts}


def collected(df) -> dict:
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def words_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


def misspelt(rng, word, letters):
    i = rng.randrange(len(word))
    return rng.choice((word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :]))


@pytest.mark.parametrize("letters", ["ab", "etaoinéßÿ", "abcdefghijklmnopqrstuvwxyz"])
def test_variants_equal_brute_force(spark, letters):
    rng = random.Random(letters)
    words = {"".join(rng.choices(letters, k=rng.randrange(7, 12))) for _ in range(120)}
    for _ in range(2):
        words |= {w for w in (misspelt(rng, w, letters) for w in list(words)) if len(w) >= 7}
    counts = {w: rng.choice((2, 3, 20, 30, 200, 300, 4000)) for w in words}
    assert collected(spelling.variants(words_of(spark, counts))) == brute_variants(counts)


def test_every_near_pair_shares_a_signature(spark):
    rng = random.Random(9)
    letters = spelling.BY_FREQUENCY
    words = {"".join(rng.choices(letters, k=7)) for _ in range(300)}
    pairs = {(w, misspelt(rng, w, letters)) for w in words for _ in range(5)}
    given = words_of(spark, {w: 2 for p in pairs for w in p if len(w) >= 7})
    got = {(r.word, r.near) for r in spelling.near_words(given).collect()}
    assert {(a, b) for a, b in pairs if a != b and len(b) >= 7} <= got
    assert all(near(a, b) for a, b in got)


def test_roots_follow_forms_to_the_end(spark):
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx"]
    counts = {w: 2 * 10**i for i, w in enumerate(chain)}
    got = collected(spelling.variants(words_of(spark, counts)))
    assert got == brute_variants(counts)
    assert {r[1] for r in got.values()} == {chain[-1]}


def test_words_of_texts(docs):
    rng = random.Random(4)
    vocabulary = ["Straßenbahn", "ÉCOLIERS", "écoliers", "information", "INFORMATION", "informations", "short", "×÷×÷×÷×", "x" * 300, "naïveté", "schönste"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(30))) + rng.choice(("", "1", "-end_ofword"))) for i in range(300)]
    rows += [(None, "information information"), (5, None), (6, ""), (7, "information"), (7, "information"), (8, "langsame " * 30_000)]
    want = brute_counts(rows)
    words = spelling.count_words(docs(*rows))
    assert {r.word: r.n for r in words.collect()} == dict(want)
    assert collected(spelling.variants(words)) == brute_variants(want)


def test_very_long_words(docs):
    long = "ab" * 20_000
    rows = [(i, long) for i in range(30)] + [(i, long[:-1] + "x") for i in range(2)]
    got = collected(spelling.variants(spelling.count_words(docs(*rows), misspelt=0)))
    assert got[long[:-1] + "x"] == (long, long, 2, 1, 30) and got[long] == (None, long, 30, 1, None)


def test_empty_table_and_clashing_columns(docs):
    assert spelling.variants(spelling.count_words(docs())).count() == 0
    clash = docs((1, "wonderful wonderful")).selectExpr("*", "1 AS word", "2 AS n", "3 AS _run", "4 AS _word", "5 AS _hash", "6 AS _id")
    assert spelling.variants(spelling.count_words(clash, misspelt=0)).count() == 1


def test_words_of_one_bucket_are_not_paired_twice(spark):
    """All words share letters and ends: each near pair comes once in each direction."""
    words = {"abc" + "".join(p) + "xyz": 2 for p in ("dd", "de", "df", "dg", "ed", "fd")}
    got = spelling.near_words(words_of(spark, words)).groupBy("word", "near").agg(F.count(F.lit(1)).alias("times"))
    assert got.filter("times > 1").isEmpty()
