from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from jobtrail.llm import licenses, toxicity
from jobtrail.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licence_base_on_all_documents(spark):
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_license_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    lines = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    }
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licences(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
        want = {label for line, label in lines.items() if line in texts[r.doc_id]}
        assert set(filter(None, r.labels.split(","))) - {"cc-by", "gpl", "reserved"} == want


def test_licence_edge_cases(docs):
    mit = licenses.TEMPLATES["mit-text"][0]
    rows = docs(
        (1, None), (2, ""), (3, "CC-BY cc  by\tcc\nby ccéby"), (4, "x " * 50_000 + mit + " y"), (5, mit.replace("charge", "cost")),
        (6, mit.replace("hereby granted", "hereby gladly granted")), (7, "mit license"), (7, "mit license"), (8, "cc by"),
        (9, " ".join(mit.split()[::-1])),
    ).withColumn("labels", F.lit(0)).withColumn("n_words", F.lit("x"))
    out = {}
    for r in licenses.find_licenses(rows).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [r.n_words for i in (1, 2) for r in out[i]] == [0, 0] and out[1][0].labels == "" and out[1][0].first_word is None
    assert (out[3][0].n_base, out[3][0].first_word, out[3][0].last_word) == (3, 0, 4)
    assert out[4][0].labels == "mit" and out[4][0].score == 1
    assert out[5][0].labels == "" and out[6][0].labels == "" and out[9][0].labels == ""  # a key phrase is missing
    assert [r.labels for r in out[7]] == ["", ""] and out[8][0].score == 0.5
    assert licenses.find_licenses(docs()).count() == 0


def test_two_related_licences_in_one_text(docs):
    apart = " some other words stand in between here and there. "
    gpl2 = "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2"
    given = {
        1: ("Licensed under CC BY-SA 4.0." + apart + "CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        2: ("CC BY-NC 4.0." + apart + "Licensed under CC BY-SA 4.0.", {"cc-by-nc-4.0"}),
        3: ("This work is licensed under the GNU General Public License, version 2." + apart + "Licensed under the GNU General Public License version 3.", {"gpl-3.0"}),
        4: (gpl2 + apart + "This work is licensed under the GNU General Public License version 3.", {"gpl-2.0", "gpl-3.0"}),
        5: ("Licensed under CC BY-SA 4.0." + apart + "Licensed under CC BY-SA 4.0.", set()),
    }
    plain = [(i, f"text {i} of other words") for i in range(100, 200)]
    out = {r.doc_id: r for r in licenses.find_licenses(docs(*((i, t) for i, (t, _) in given.items()), *plain)).collect()}
    for i, (_, want) in given.items():
        assert set(filter(None, out[i].labels.split(","))) - {"cc-by", "gpl", "reserved"} == want, i
    assert out[1].score == out[2].score == 5 / 7


def test_held_out_toxicity(spark):
    large = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    rows = QUERIES["op9_toxicity"](spark, large).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    true = sum(y and p for y, p in held)
    assert true / sum(y for y, _ in held) > 0.8 and true / sum(p for _, p in held) > 0.9


def test_toxicity_edge_cases(spark, docs):
    train = [(i, f"word{'abcdefgh'[i % 8]} of idiot here") for i in range(1, 40)] + [(i, "a clean text of here") for i in range(40, 200)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i, _ in train] + [(1, 1), (500, 1), (None, 1), (41, None)], "doc_id bigint, toxic int")
    given = docs(*train, (300, None), (301, ""), (302, "an Idiot!"), (302, "an Idiot!"), (303, "clean " * 50_000)).withColumn("score", F.lit("x"))
    model = toxicity.learn(toxicity.training_rows(given, labels))
    out = {}
    for r in toxicity.score(given, model).collect():
        out.setdefault(r.doc_id, []).append(r.score)
    assert out[302][0] == out[302][1] >= 0.7 and max(out[300] + out[301] + out[303]) < 0.1
    kept = toxicity.keep_clean(given, model)
    assert kept.columns == given.columns and {r.doc_id for r in kept.collect()} == {*range(40, 200), 300, 301, 303}
    nothing = toxicity.learn(toxicity.training_rows(given, labels.where("false")))
    assert {r.score for r in toxicity.score(given, nothing).collect()} == {0.0}
    assert toxicity.score(docs(), model).count() == 0 and toxicity.keep_clean(docs(), model).count() == 0


@pytest.mark.parametrize(
    "text, kind",
    [
        ("you are not an x", 13),
        ("he said x. fine", 21),
        ("x", 1),
        ("kill him", 6),
        ("kill time", None),
        ("this is not raining today and she is a x", 5),
        ("the kill switch is " + "on and " * 1500 + "his", None),
        ("x " + "and " * 50_000 + "not", 1),
        ("not an x and then, much later on in it, you x", 5),  # the plainest match of a clause
        ("x of all you", 5),
        ("an x. you", 1),
    ],
)
def test_grammar(text, kind):
    classes = toxicity.Classes(toxicity.Model(words=frozenset(["x"])))
    assert dict(toxicity.clauses(classes.of(text))) == ({} if kind is None else {kind: 1})


def plain_matches(clause):
    """The kinds of matches of a clause, by looking around each insult and threat."""
    cores = [i for i, c in enumerate(clause) if c in b"ih"]
    out = set()
    for n, i in enumerate(cores):
        upto = min(i + toxicity.NEAR, cores[n + 1] if n + 1 < len(cores) else len(clause))
        target = b"t" in clause[max(0, i - toxicity.NEAR) : i] or b"t" in clause[i + 1 : upto + 1]
        negated = b"n" in clause[max(0, i - toxicity.NEGATED) : i]
        reported = b"r" in clause[max(0, i - toxicity.REPORTED) : i]
        if clause[i : i + 1] == b"i" or target:
            out.add((1 if clause[i : i + 1] == b"i" else 2) + 4 * target + 8 * negated + 16 * reported)
    return out


def test_automaton_reads_as_the_plain_grammar():
    rng = random.Random(5)
    for _ in range(5000):
        clause = bytes(rng.choices(b"ihtnr.", (2, 2, 2, 2, 2, 12), k=rng.randrange(40))).replace(b".", b"e")
        clause = clause.replace(b"e", bytes([toxicity.OTHER]))
        assert toxicity.matches(clause) == plain_matches(clause)
    assert len({state for state, _ in toxicity.MACHINE}) < 10_000


def test_a_null_id_is_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "text", "en", "a", 4)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [(r.held_out, r.predicted) for r in QUERIES["op9_toxicity"](spark, str(tmp_path)).collect()] == [(False, 0)]


def test_repeated_clauses_of_a_kind_count_once():
    model = toxicity.Model(kinds={9: 0.05, 5: 0.6}, base=0.01)
    assert model.score({9: 500}) == model.score({9: 1}) < 0.1 and model.score({9: 1, 5: 1}) > 0.6
