"""Quality by weak supervision; DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0). How often each rule says good of good texts and bad of bad ones is
estimated without labels, by expectation-maximisation over the counts of vote patterns (never more than 3 to the
number of rules, however large the corpus). A text is kept by its posterior probability of being good.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import words_of, written

SYMBOLS = "#*$%&|<>"
ROUNDS = 30
# Where the estimate starts: share of good texts, and how often a rule that votes is right on good and on bad texts.
PRIOR, RIGHT_ON_GOOD, RIGHT_ON_BAD = 0.8, 0.99, 0.5
KEEP = 0.5


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each text. A null text has no words and no lines."""
    t = F.col("_t")
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).select(key, "_t", words_of(F.col("_t")).alias("_w"))
    rows = rows.select(
        key,
        "_t",
        F.size("_w").cast("bigint").alias("n_words"),
        # One hash for each three words in a row; the last two starts have no third word.
        F.slice(F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))), 1, F.greatest(F.size("_w") - 2, F.lit(0))).alias("_h"),
        F.filter(F.split(F.col("_t"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    none = F.expr("array()").cast("array<struct<h:bigint,i:int>>")
    rows = rows.select(
        key,
        "_t",
        "n_words",
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda line: F.rtrim(line).rlike(r"[.!?\"'|]$"))).alias("n_ended"),
        # Equal windows side by side, but only where there are any.
        F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("_s"),
    )
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    starts = F.transform("_s", lambda s, i: F.when(same(s, F.get("_s", i - 1)) | same(s, F.get("_s", i + 1)), s["i"]))
    rows = rows.withColumn("_p", F.array_sort(F.filter(starts, lambda p: p.isNotNull())))
    covered = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3))))
    return rows.select(
        key,
        "n_words",
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        "n_lines",
        "n_dup_lines",
        F.aggregate(covered, F.lit(0), lambda n, c: n + c).cast("bigint").alias("n_repeat_words"),
        "n_ended",
        F.regexp_count(t, F.lit(r"[#*$%&|<>]{2,}")).alias("n_symbol_runs"),
        F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[#*$%&|<>](?![^\x20\x09-\x0D])")).alias("n_lone_symbols"),
        F.regexp_count(t, F.lit("[A-ZÀ-ÖØ-Þ]")).alias("n_upper"),
        F.regexp_count(t, F.lit("!!")).alias("n_shouts"),
    )


def _vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(0).cast("tinyint")


# (good if, bad if, least share of good texts with the right vote); with neither condition the rule abstains.
# The shares keep the estimate from taking one kind of bad text for a habit of good ones: a strong sign of a bad
# text may be wrong on one good text in two hundred, a weak one on every tenth.
RULES = {
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words", 0.995),
    "symbol_runs": ("n_symbol_runs = 0", "20 * n_symbol_runs > n_words", 0.995),
    "lone_symbols": ("50 * n_lone_symbols <= n_words", "10 * n_lone_symbols > n_words", 0.995),
    "repeats": ("5 * n_repeat_words <= n_words", "3 * n_repeat_words > n_words", 0.99),
    "capitals": ("10 * n_upper <= 2 * word_chars", "10 * n_upper > 4 * word_chars", 0.995),
    "shouts": ("n_shouts = 0", "20 * n_shouts > n_words", 0.995),
    "lines": ("n_lines >= 3 AND 5 * n_dup_lines <= n_lines", "20 * n_dup_lines > 7 * n_lines", 0.99),
    "length": ("n_words >= 50", "n_words < 20", 0.9),
    "word_length": ("word_chars BETWEEN 3 * n_words AND 7 * n_words", "word_chars < 2 * n_words OR word_chars > 9 * n_words", 0.9),
    "sentences": ("n_lines > 0 AND 10 * n_ended >= 7 * n_lines", "n_lines > 0 AND 10 * n_ended < 2 * n_lines", 0.9),
}
FLOORS = tuple(floor for *_, floor in RULES.values())
MOST_SURE = 0.9999
# Range of the share of bad texts that a voting rule finds.
ON_BAD = (0.2, 0.95)


def votes(rows: DataFrame, rules: dict[str, tuple[str, str, float]] = RULES) -> DataFrame:
    return rows.withColumn("votes", F.array(*[_vote(good, bad) for good, bad, _ in rules.values()]))


def _mean(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda n, p: n + value(p))


def posterior(votes: Column, prior: Column, right_good: Column, right_bad: Column) -> Column:
    """The probability that a text with these votes is good."""
    odds = lambda v, a, b: (
        F.when(v == 1, F.log(a) - F.log(1 - b)).when(v == -1, F.log(1 - a) - F.log(b)).otherwise(0.0)
    )
    each = F.zip_with(F.zip_with(votes, right_good, lambda v, a: F.struct(v.alias("v"), a.alias("a"))), right_bad, lambda x, b: odds(x["v"], x["a"], b))
    return 1 / (1 + F.exp(-(F.log(prior) - F.log(1 - prior) + F.aggregate(each, F.lit(0.0), lambda s, x: s + x))))


def estimate(patterns: DataFrame, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """(votes, posterior) of each pattern, from (votes, n). Rates are smoothed by two right votes and a wrong one and kept in their ranges.

    The patterns are the elements of one row's array, and each round of the estimate is a fold over it.
    """
    rules = len(floors)
    least = F.array(*map(F.lit, floors))
    state = F.struct(
        F.lit(PRIOR).alias("prior"), F.array_repeat(F.lit(RIGHT_ON_GOOD), rules).alias("right_good"), F.array_repeat(F.lit(RIGHT_ON_BAD), rules).alias("right_bad")
    )

    def step(s: Column, _: Column) -> Column:
        judged = F.transform("p", lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(p["votes"], s["prior"], s["right_good"], s["right_bad"]).alias("q")))

        def refit(ps: Column) -> Column:
            def right(vote: int, weight, low, high: float) -> Column:
                def rule(j: Column) -> Column:
                    at = lambda p: F.get(p["votes"], j)
                    hits = _mean(ps, lambda p: F.when(at(p) == vote, weight(p)).otherwise(0.0))
                    cast = _mean(ps, lambda p: F.when(at(p) != 0, weight(p)).otherwise(0.0))
                    return F.greatest(low(j), F.least(F.lit(high), (hits + 2) / (cast + 3)))

                return F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), rule)

            good, bad = (lambda p: p["n"] * p["q"]), (lambda p: p["n"] * (1 - p["q"]))
            prior = (_mean(ps, good) + 1) / (_mean(ps, lambda p: p["n"].cast("double")) + 2)
            return F.struct(prior.alias("prior"), right(1, good, lambda j: F.get(least, j), MOST_SURE).alias("right_good"), right(-1, bad, lambda j: F.lit(ON_BAD[0]), ON_BAD[1]).alias("right_bad"))

        return F.get(F.transform(F.array(judged), refit), 0)

    row = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"))  # 3^rules entries at most
    fitted = row.select("p", F.aggregate(F.expr(f"sequence(1, {ROUNDS})"), state, step).alias("s")).select(F.explode("p").alias("p"), "s")
    return fitted.select("p.votes", posterior(F.col("p.votes"), F.col("s.prior"), F.col("s.right_good"), F.col("s.right_bad")).alias("posterior"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, tuple[str, str, float]] = RULES) -> DataFrame:
    """The features, votes, posterior and verdict (kept) of each row.

    base_failed is the fixed base: fewer than 50 words, or more than half of them in repeated windows of three words.
    A row is kept if it passes the base and its posterior is at least KEEP. Repeated rows give repeated results.
    """
    voted = written(votes(features(docs, key, text), rules), "votes")
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    known = estimate(patterns, tuple(floor for *_, floor in rules.values()))  # a row for each pattern
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.join(F.broadcast(known), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= KEEP))
    )


def _oracle() -> str:
    n, names = len(RULES), ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for good, bad, _ in RULES.values())
    floors, each = f"[{', '.join(f'{f}::DOUBLE' for f in FLOORS)}]", f"range(1, {n + 1})"
    filled = lambda value: f"list_transform({each}, lambda j: {value}::DOUBLE)"
    odds = (
        "ln(prior) - ln(1 - prior) + list_sum(list_transform({each}, lambda j: CASE {v}[j] WHEN 1 THEN ln(g[j]) - ln(1 - b[j])"
        " WHEN -1 THEN ln(1 - g[j]) - ln(b[j]) ELSE 0.0::DOUBLE END))"
    )
    rate = lambda vote, weight: (
        f"(list_sum(list_transform(qs, lambda x: CASE WHEN x.v[j] = {vote} THEN {weight} ELSE 0.0::DOUBLE END)) + 2)"
        f" / (list_sum(list_transform(qs, lambda x: CASE WHEN x.v[j] <> 0 THEN {weight} ELSE 0.0::DOUBLE END)) + 3)"
    )
    return rf"""
WITH RECURSIVE split AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
      FROM documents
    ),
    windows AS (
      SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
    ),
    repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated, (VALUES (0), (1), (2)) o(j) GROUP BY 1),
    counts AS (
      SELECT s.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '[.!?"''|]\r?$'))) AS n_ended,
             len(regexp_extract_all(t, '[#*$%&|<>]{{2,}}')) AS n_symbol_runs,
             len(list_filter(w, lambda x: regexp_full_match(x, '[#*$%&|<>]'))) AS n_lone_symbols,
             len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) AS n_upper, len(regexp_extract_all(t, '!!')) AS n_shouts
      FROM split s LEFT JOIN covered ON s.doc_id = covered.doc_id
    ),
    voted AS (SELECT *, [{names}] AS v FROM counts),
    patterns AS (SELECT list({{'v': v, 'n': n}} ORDER BY v) AS ps FROM (SELECT v, count(*) AS n FROM voted GROUP BY 1)),
    em AS (
      SELECT 0 AS i, {PRIOR}::DOUBLE AS prior, {filled(RIGHT_ON_GOOD)} AS g, {filled(RIGHT_ON_BAD)} AS b
      UNION ALL
      SELECT i + 1,
             (list_sum(list_transform(qs, lambda x: x.n * x.q)) + 1) / (list_sum(list_transform(qs, lambda x: x.n::DOUBLE)) + 2),
             list_transform({each}, lambda j: greatest(floors[j], least({MOST_SURE}::DOUBLE, {rate(1, "x.n * x.q")}))),
             list_transform({each}, lambda j: greatest({ON_BAD[0]}::DOUBLE, least({ON_BAD[1]}::DOUBLE, {rate(-1, "x.n * (1 - x.q)")})))
      FROM (
        SELECT i, {floors} AS floors,
               list_transform(ps, lambda x: {{'v': x.v, 'n': x.n, 'q': 1 / (1 + exp(-({odds.format(each=each, v="x.v")})))}}) AS qs
        FROM em, patterns WHERE i < {ROUNDS}
      )
    ),
    fitted AS (SELECT * FROM em WHERE i = {ROUNDS}),
    judged AS (
      SELECT *, 1 / (1 + exp(-({odds.format(each=each, v="v")}))) AS p,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
      FROM voted, fitted
    )
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND p >= {KEEP} AS kept, round(p, 6) AS posterior
FROM judged
"""


ORACLE_SQL = _oracle()
