"""Conversations as training texts with a loss mask, in Spark expressions only.

A conversation's turns are collected once, sorted, and neighbours of one role are merged into a block:

    <s>[SYS]text[/SYS][INST]text[+]text[/INST][ANS]text</s>[ROLE]tool[:]text[/ROLE]

``[+]`` stands between the merged turns of a block, so that the single turns can be read back. Control strings inside
texts and role names get one backslash more behind their first character: ``[INST]`` becomes ``[\\INST]`` and ``[\\INST]``
becomes ``[\\\\INST]``. No control string holds the first character of another one, so an escaped text holds none, none
arises where text and mark meet, and taking one backslash away restores the text exactly.

The loss mask is a list of runs (chars, loss) over the code points of the formatted text. Loss is on the texts of the
assistant and nothing else: marks and other roles are off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template: marks before and after a block by role, for other roles with the name between ROLE and NAMED.
BEGIN, JOINT = "<s>", "[+]"
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}
ROLE, NAMED, ROLE_END = "[ROLE]", "[:]", "[/ROLE]"
LEARNED = "assistant"

SQUARE = r"(?:/?SYS|/?INST|/?ROLE|ANS|:|\+)\]"  # what follows [ in a control string
ANGLE = r"/?s>"  # what follows <
CONTROL = rf"\[{SQUARE}|<{ANGLE}"
CLOSED = r"(?<=\[/SYS\]|\[/INST\]|</s>|\[/ROLE\])"

TURN = "struct<role:string,text:string>"


def escaped(text: Column) -> Column:
    """The text with one backslash more in each control string."""
    return F.regexp_replace(F.regexp_replace(text, rf"\[(\\*{SQUARE})", r"[\\$1"), rf"<(\\*{ANGLE})", r"<\\$1")


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``."""
    return F.regexp_replace(F.regexp_replace(text, rf"\[\\(\\*{SQUARE})", "[$1"), rf"<\\(\\*{ANGLE})", "<$1")


def _by_role(role: Column, of: dict[str, Column], other: Column) -> Column:
    out = None
    for name, value in of.items():
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(other)


def _segment(text: Column | str, loss: Column | bool = False) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))


def _block_segments(block: Column) -> Column:
    """Marks and texts of one block, in order."""
    role = block["role"]
    opened = _by_role(
        role,
        {name: F.array(_segment(before)) for name, (before, _) in MARKS.items()},
        F.array(_segment(ROLE), _segment(role), _segment(NAMED)),
    )
    closed = _by_role(role, {name: F.array(_segment(after)) for name, (_, after) in MARKS.items()}, F.array(_segment(ROLE_END)))
    texts = F.transform(
        block["texts"],
        lambda t, i: F.array(_segment(F.when(i > 0, JOINT).otherwise("")), _segment(t, role == LEARNED)),
    )
    return F.concat(opened, F.flatten(texts), closed)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted string, loss_mask array<struct<chars int, loss boolean>>, n_blocks) per conversation.

    ``turns`` has conv_id, turn, role and text; other columns are left out. A null text or role is an empty one, a null
    turn comes first, rows without conv_id are one conversation without id, equal turns go by role and escaped text, and
    repeated rows are turns of their own. An empty table gives none. One shuffle by conversation; a conversation is one
    training example, so it has to fit a cell.
    """
    row = F.struct("turn", escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_turns"))

    def at(i: Column) -> Column:
        return F.get("_turns", i)

    firsts = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    runs = sorted_turns.withColumn("_firsts", firsts)

    def block(first: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_firsts", k + 1), F.size("_turns"))
        texts = F.transform(F.slice("_turns", first + 1, end - first), lambda t: t["text"])
        return F.struct(at(first)["role"].alias("role"), texts.alias("texts"))

    blocks = runs.select("conv_id", F.transform("_firsts", block).alias("_blocks"))
    segments = F.concat(F.array(_segment(BEGIN)), F.flatten(F.transform("_blocks", _block_segments)))
    pieces = blocks.select("conv_id", F.size("_blocks").alias("n_blocks"), segments.alias("_segments"))
    lengths = F.transform("_segments", lambda s: F.struct(F.length(s["text"]).alias("chars"), s["loss"].alias("loss")))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("_segments", lambda s: s["text"]), "").alias("formatted"),
        F.filter(lengths, lambda m: m["chars"] > 0).alias("loss_mask"),
        "n_blocks",
    )


def _block_turns(block: Column) -> Column:
    """The turns (role, text) of one block of a formatted text."""

    def inside(text: Column, before: int, after: int) -> Column:
        return text.substr(F.lit(before + 1), F.length(text) - (before + after))

    def turns(role: Column, body: Column) -> Column:
        texts = F.split(body, r"\[\+\]", -1)
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    name = F.substring_index(block, NAMED, 1)
    body = block.substr(F.length(name) + len(NAMED) + 1, F.length(block) - F.length(name) - len(NAMED) - len(ROLE_END))
    out = None
    for role, (before, after) in MARKS.items():
        case = block.startswith(before), turns(F.lit(role), inside(block, len(before), len(after)))
        out = F.when(*case) if out is None else out.when(*case)
    return out.otherwise(turns(inside(name, len(ROLE), 0), body))


def read_turns(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, that a formatted text was made of: those of the table, before merging."""
    content = formatted.substr(F.lit(len(BEGIN) + 1), F.length(formatted))
    blocks = F.filter(F.split(content, CLOSED, -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, _block_turns))


def read_learned(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, array<string>, unescaped; texts of no length are left out.

    Runs of the mask end where marks begin or end, so cutting the text there gives a piece for each run.
    """
    pieces = F.filter(F.split(formatted, f"(?<={CONTROL})|(?={CONTROL})", -1), lambda p: p != "")
    runs = F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), F.get(loss_mask, i).alias("run")))
    learned = F.filter(runs, lambda r: r["run"]["loss"] & (r["run"]["chars"] == F.length(r["piece"])))
    return F.transform(learned, lambda r: unescaped(r["piece"]))


def digests(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation holds, read back from its text and mask."""
    read = formatted.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("_turns"),
        F.array_join(read_learned(F.col("formatted"), F.col("loss_mask")), "").alias("_learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_blocks").cast("long").alias("n_blocks"),
    )
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )


def _sql_escaped(text: str) -> str:
    return f"""regexp_replace(regexp_replace({text}, '\\[(\\\\*{SQUARE})', '[\\\\\\1', 'g'), '<(\\\\*{ANGLE})', '<\\\\\\1', 'g')"""


def _sql_length(i: int) -> str:
    cases = " ".join(f"WHEN '{role}' THEN {len(marks[i])}" for role, marks in MARKS.items())
    other = f"{len(ROLE)} + length(erole) + {len(NAMED)}" if i == 0 else str(len(ROLE_END))
    return f"CASE erole {cases} ELSE {other} END"


ORACLE_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), safe AS (
  SELECT *, {_sql_escaped("role")} AS erole, {_sql_escaped("text")} AS etext FROM given
), placed AS (
  SELECT *, row_number() OVER w AS place,
    coalesce(lag(erole) OVER w = erole, false) AS joined, coalesce(lead(erole) OVER w = erole, false) AS goes_on
  FROM safe WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, erole, etext)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST({len(BEGIN)} + sum(length(etext) + CASE WHEN joined THEN {len(JOINT)} ELSE {_sql_length(0)} END
    + CASE WHEN goes_on THEN 0 ELSE {_sql_length(1)} END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (NOT joined) AS n_blocks
FROM placed GROUP BY conv_id
"""
