from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from jobtrail.llm import suffix_dedup as sd
from jobtrail.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_spans(texts):
    """Later copies by a table of all passages."""
    seen, out = set(), {}
    for i in sorted(texts):
        words = (texts[i] or "").encode().split()
        covered = set()
        for s in range(len(words) - sd.PASSAGE + 1):
            passage = b" ".join(words[s : s + sd.PASSAGE])
            if passage in seen:
                covered.update(range(s, s + sd.PASSAGE))
            seen.add(passage)
        out[i] = covered
    return out


def covered(spans):
    return {w for s in spans for w in range(s["first"], s["last"] + 1)}


def check(rows, texts):
    want = brute_spans(texts)
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert covered(r.spans) == want[r.doc_id], r.doc_id
        assert r.n_removed == len(want[r.doc_id])


def test_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_suffix_dedup"](spark, SF).collect()
    check(rows, texts)
    assert sum(r.n_removed > 0 for r in rows) > 20


def made():
    rng = random.Random(5)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(n)]
    common, other = words(80), words(60)
    given = {1: None, 2: "", 3: "few words", 4: " ".join(common)}
    for i in range(10, 60):
        lead, cut_to = words(rng.randrange(40)), rng.randrange(40, 81)
        given[i] = "  ".join(lead + common[rng.randrange(20) : cut_to] + words(rng.randrange(30)) + (other if i % 3 else []))
    given[70] = " ".join(["x"] * 300)  # repeats itself
    given[71] = " ".join(words(20_000) + common)
    given[72] = "\n".join(other) + "\n tail"
    return given


@pytest.mark.parametrize("frequent", [sd.FREQUENT, 3])
def test_made_texts_in_both_ways(docs, monkeypatch, frequent):
    monkeypatch.setattr(sd, "FREQUENT", frequent)
    given = made()
    rows = docs(*given.items()).withColumn("anchor", F.lit(1)).withColumn("spans", F.lit("x"))
    check(sd.spans_of(rows).collect(), given)
    left = {r.doc_id: r for r in sd.remove_repeats(rows).collect()}
    want = brute_spans(given)
    for i, t in given.items():
        words = (t or "").split()
        rest = [w for k, w in enumerate(words) if k not in want[i]]
        if words and not rest:
            assert i not in left
        else:
            assert (left[i].text or "").split() == rest and left[i].n_chars == (None if t is None else len(left[i].text))
    assert left[1].text is None and left[2].text == ""
    assert sd.cut("a  b\tc d", [(1, 2)]) == "a  d" and sd.cut(" a b ", [(0, 1)]) == " "


def test_repeated_rows_and_empty_table(docs):
    given = docs((7, " ".join(map(str, range(70)))), (7, " ".join(map(str, range(70)))), (None, " ".join(map(str, range(70)))))
    out = sd.remove_repeats(given).collect()
    assert len(out) == 3 and len({r.text for r in out}) == 1
    assert sd.remove_repeats(docs()).count() == 0 and sd.spans_of(docs()).count() == 0
