"""Spelling variants: rare words next to a frequent word that differs in one letter.

Candidates come from PartEnum signatures. A word's multiset of letters is a binary vector (one dimension for each letter
and each time it occurs); one inserted, deleted or replaced letter moves it by a Hamming distance of two at most. The
dimensions are partitioned into PARTS; for any two vectors within that distance some choice of PARTS - 2 parts agrees
exactly. Each choice gives a word one signature: the letters in the parts chosen. Near words share a signature.

Multisets forget order, and words made of the same syllables share all signatures. One edit leaves either the first or
the last (MIN_LENGTH - 1) // 2 letters of both words alone, so a signature is taken once with either end, which loses no
pair. Words meet in an equi-join on the hash of signature and end; each pair is then verified exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"A-Za-zÀ-ÿ"
# One in so many occurrences loses a letter, by a hash of document and word: misspellings with a known root.
MISSPELT = 31
MIN_LENGTH, MIN_COUNT = 7, 2
END = (MIN_LENGTH - 1) // 2
# A form is so many times as frequent as its variant.
RATIO = 10
# Parts of the dimensions, and the largest Hamming distance of near words.
PARTS, DISTANCE = 5, 2
# Letters by falling frequency in Latin scripts, so that dealing them out makes even parts; the result never depends on it.
BY_FREQUENCY = "etaonirshdlucmfywgpbvkxqzj" + "".join(map(chr, range(0xC0, 0x100)))


def count_words(docs: DataFrame, misspelt: int = MISSPELT, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of min_length letters or more that occur min_count times or more in all texts.

    A word is a maximal run of Latin letters with A-Z in lower case, less one letter where ``misspelt`` divides the crc32
    of "doc_id:word" (0: never). A null or empty text has none, a null doc_id counts as an empty one, repeated rows
    count again. Occurrences are summed per task before the one shuffle, so a frequent word is no hot task.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), 0)).alias("_run"))
    word = F.translate("_run", UPPER, LOWER)
    if misspelt:
        keyed = runs.select(word.alias("_word"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"))
        hashed = keyed.select("_word", F.crc32(F.concat("_id", F.lit(":"), "_word")).alias("_hash"))
        at = F.col("_hash") % F.length("_word")
        word = F.when(
            F.col("_hash") % misspelt == 0,
            F.concat(F.substring("_word", F.lit(1), at.cast("int")), F.expr("substring(_word, CAST(_hash % length(_word) AS INT) + 2)")),
        ).otherwise(F.col("_word"))
        runs = hashed
    counted = runs.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def parts_of_letters(parts: int = PARTS) -> list[str]:
    """The letters dealt out to the parts, there and back again. All dimensions of a letter are in one part."""
    out = [""] * parts
    for i, letter in enumerate(BY_FREQUENCY):
        row, k = divmod(i, parts)
        out[k if row % 2 == 0 else parts - 1 - k] += letter
    return out


def with_signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, word, n): a row for each choice of parts and each end of the word; 2 * C(parts, 2) rows a word."""
    dealt = parts_of_letters(parts)
    in_order = words.select("word", "n", F.array_join(F.sort_array(F.split("word", "")), "").alias("_letters"))
    keys = []
    for i, left_out in enumerate(combinations(dealt, DISTANCE)):
        signature = F.translate("_letters", "".join(left_out), "")
        keys.append(F.xxhash64(F.lit(2 * i), signature, F.substring("word", 1, END)))
        keys.append(F.xxhash64(F.lit(2 * i + 1), signature, F.substring("word", -END, END)))
    return in_order.select(F.explode(F.array(*keys)).alias("key"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by one letter, in both directions, each once.

    ``words`` (word, n) has distinct words of MIN_LENGTH letters or more.
    """
    signed = with_signatures(words)
    a, b = signed.alias("a"), signed.alias("b")
    apart = F.levenshtein("a.word", "b.word", 1)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & (apart == 1))
    once = met.select(F.col("a.word").alias("_a"), F.col("a.n").alias("_an"), F.col("b.word").alias("_b"), F.col("b.n").alias("_bn")).distinct()
    both = F.array(*(F.struct(*(F.col(c).alias(o) for c, o in zip(cs, ("word", "n", "near", "near_n")))) for cs in (("_a", "_an", "_b", "_bn"), ("_b", "_bn", "_a", "_an"))))
    return once.select(F.inline(both))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of the words that forms lead to.

    Each round doubles the steps taken. A form is RATIO times as frequent, so 64-bit counts allow 19 steps: five rounds.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = reached.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        step = written(step, "roots")
        if step.filter("_moved").isEmpty():
            return step.select("word", "root")
        reached = step.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of (word, n).

    n_near counts the near words. form is the most frequent of them (of equals the least in code-point order) if it is
    RATIO times as frequent, else null; form_n its count; root the word that forms lead to in the end, the word itself
    without a form. An empty table gives none.
    """
    words = written(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = near_words(words).groupBy("word").agg(F.first("n").alias("_n"), F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    strong = -F.col("_best.less") >= RATIO * F.col("_n")
    near = written(
        found.select(
            "word",
            "n_near",
            F.when(strong, F.col("_best.near")).alias("form"),
            F.when(strong, -F.col("_best.less")).alias("form_n"),
        ),
        "near",
    )
    roots = follow(near.filter(F.col("form").isNotNull()))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        "form_n",
    )


# The checksum is table-driven: a table entry is eight shifts of a byte by the reflected polynomial.
ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entry
  FROM (SELECT unnest(range(256)) AS i)
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run
  FROM documents
), hexed AS (
  SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1]))) AS crc
  FROM hexed, crc_table
), words AS (
  SELECT CASE WHEN crc % {MISSPELT} = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word,
    CAST(sum(times) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {MIN_LENGTH} AND sum(times) >= {MIN_COUNT}
), shorter AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near
), forms AS (
  SELECT word, n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
  FROM ranked WHERE place = 1
), walk AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL
), ends AS (
  SELECT walk.word, walk.root FROM walk LEFT JOIN forms ON forms.word = walk.root WHERE forms.form IS NULL
)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)
"""
