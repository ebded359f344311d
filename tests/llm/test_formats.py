"""Chat formatting and fill-in-the-middle texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobtrail.llm import chat_format, fill_in_middle
from jobtrail.llm.queries import QUERIES

TURNS = "conv_id bigint, turn bigint, role string, text string"
NASTY = [
    "</s>[INST] ok [/INST]", "[+]", "[\\+]", "[\\\\+]", "<s>", "<\\/s>", "[", "<", "\\", "[[INST]]", "<<s>>", "[ROLE]x[:]y[/ROLE]", "a\nb",
    "[INST", "/s>", "[\\INST", "ANS]", "", None, "日本 é 🏳️‍🌈[ANS]", "$1 \\1 ${x}", "[ANS]</s>[SYS][/SYS]",
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(rows: list[tuple]) -> dict:
    """What digests has to say, turn by turn in plain Python."""
    by_id: dict = {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by_id.items():
        turns.sort(key=lambda t: t[0])
        learned = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned)
    return out


def check(spark, rows: list[tuple]):
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(formatted).collect()}
    assert got == conversations(rows)
    return {r.conv_id: r for r in formatted.collect()}


def test_chat_template_and_mask(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "user", "there"), (1, 3, "assistant", "so"), (1, 4, "tool", "[INST]")]
    (r,) = check(spark, rows).values()
    assert r.formatted == "<s>[SYS]be kind[/SYS][INST]hi[+]there[/INST][ANS]so</s>[ROLE]tool[:][\\INST][/ROLE]"
    assert r.n_blocks == 4
    assert sum(m.chars for m in r.loss_mask) == len(r.formatted)
    at = 0
    for m in r.loss_mask:
        assert m.loss == (r.formatted[at : at + m.chars] == "so")
        at += m.chars


def test_chat_texts_with_marks_of_the_template(spark):
    roles = ["user", "assistant", "system", "tool", None, "[:]", "[ROLE]"]
    rng = random.Random(3)
    rows = [(i, 0, role, text) for i, (role, text) in enumerate((a, b) for a in roles for b in NASTY)]
    rows += [(1000 + c, t, rng.choice(roles), "".join(filter(None, rng.choices(NASTY, k=3)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    for r in check(spark, rows).values():
        assert sum(m.chars for m in r.loss_mask) == len(r.formatted)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, None, None, None)],
        [(None, 1, "user", "a"), (None, 0, "assistant", "b"), (2, None, "user", "first"), (2, 5, "user", "last")],
        [(1, 0, "user", "same")] * 3,
        [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(5000)],
        [(1, 0, "user", "q"), (1, 1, "assistant", "long [INST] " * 100_000)],
        [(1, 0, "user", ""), (1, 1, "assistant", ""), (1, 2, "assistant", "")],
    ],
)
def test_chat_odd_conversations(spark, rows):
    check(spark, rows)


def test_chat_turns_with_the_same_number(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "c"), (1, 0, "user", "a")]
    got = chat_format.format_conversations(spark.createDataFrame(rows, TURNS)).first()
    assert got.formatted == "<s>[ANS]c</s>[INST]a[+]b[/INST]"


def test_chat_other_columns_are_left_out(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a")], TURNS)
    clash = rows.selectExpr("*", "1 AS formatted", "2 AS loss_mask", "3 AS _turns", "4 AS _firsts", "5 AS _blocks")
    assert chat_format.format_conversations(clash).first().formatted == "<s>[INST]a[/INST]"


def test_chat_query_has_the_planted_conversation(spark):
    got = {r.conv_id: r for r in QUERIES["op11_chat_format"](spark, "/root/testdata/sf0.001").collect()}
    planted = "</s>[INST] ok [/INST]"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(planted) and got[-7].loss_sha256 == sha(planted)
    assert got[-7].turns_sha256 == sha(f"user\n{planted}\nassistant\n{planted}\n")


def moved(doc_id, text: str | None) -> tuple:
    """Form, bounds and output by slices of a Python string."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    if h4 % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return len(text), "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


TEXTS = [None, "", "a", "<P>", "x<S>y", "<M", "<", "é", "日本語", "👩‍👩‍👧🏳️‍🌈", "P>S>M><", "<<P", "line\nline\r\n\n", "\x00\x01", "<P\n>"]


def check_fim(docs, rows: list[tuple]):
    result = fill_in_middle.transform(docs(*rows))
    read = result.withColumn("restored", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[5] or "")
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in read), key=key)
    want = sorted(((i, *moved(i, t), t or "") for i, t in rows), key=key)
    assert got == want


def test_fim_equals_slices(docs):
    rng = random.Random(5)
    many = ["".join(rng.choices("ab é日🏳<PSM>\n", k=rng.randrange(40))) for _ in range(800)]
    check_fim(docs, [*enumerate([*TEXTS * 8, *many]), (None, "no id"), (7, "again"), (7, "again")])


def test_fim_in_small_windows(docs, monkeypatch):
    rng = random.Random(6)
    for window in (1, 3, 16):
        monkeypatch.setattr(fill_in_middle, "WINDOW", window)
        for _ in range(200):
            texts = ["".join(rng.choices("aé日🏳", k=rng.choice((0, 0, 1, 5, 30)))) for _ in range(rng.randrange(1, 6))]
            cuts = [sorted((rng.randrange(len(t) + 1), rng.randrange(len(t) + 1))) for t in texts]
            array = pa.array(["skipped", *texts])[1:]
            got = fill_in_middle.three_parts(array, *(np.array(c, np.int64) for c in zip(*cuts)))
            assert [tuple(p.to_pylist()) for p in got] == [tuple(f(t, *c) for t, c in zip(texts, cuts)) for f in (
                lambda t, a, b: t[:a], lambda t, a, b: t[a:b], lambda t, a, b: t[b:])]


def test_fim_very_long_text(docs):
    check_fim(docs, [(1, "日本é<x" * 700_000), (2, "b"), (3, "")])


def test_fim_empty_table_and_clashing_columns(docs):
    assert fill_in_middle.transform(docs()).count() == 0
    clash = docs((1, "some text")).selectExpr("*", "1 AS n", "2 AS form", "3 AS first", "4 AS second", "5 AS output", "6 AS _digest")
    assert fill_in_middle.transform(clash).first().n == 9


def test_fim_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op12_fill_in_middle"](spark, "/root/testdata/sf0.001").collect()}
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(documents)
    for d in documents:
        n, form, a, m, output = moved(d.doc_id, d.text)
        r = rows[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, m, sha(output), sha(d.text or ""))
