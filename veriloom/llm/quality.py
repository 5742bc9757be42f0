"""Line-first quality rules.

Each line of a text is judged by itself; lines that fail are removed; a
document is rejected when it fails the base rules or when the removed lines
held more than ``MAX_LOST`` percent of its word characters.

Line rules (a line without a word fails none and is kept):

``symbols``      more than one of ``# * $ % & | < >`` for every four words
``shouting``     three or more words, capitals but no lower-case letter
``navigation``   two or more separators, one for every three words at least, or
                 at most four words without an end mark
``boilerplate``  one of ``PHRASES``
``punctuation``  thirty or more words and not one sentence mark

Base rules: fewer than 20 words, or more than 30 percent of the words inside
8-word windows that occur twice or more in the text.

Everything is a function of one row, so there is no shuffle and no group: the
plan is a scan and a projection, and each task holds one text at a time.

Null and empty texts have no words and are rejected. Repeated rows are judged
alike. An empty table gives an empty result. Columns named like a result are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, text_of, without, words_of

# Phrases of notices, licences and page furniture.
PHRASES = [
    "all rights reserved", "terms of service", "privacy policy", "cookie policy", "use cookies", "enable javascript",
    "licensed under the", "licensed under cc", "released under the", "click here", "sign up for", "subscribe to our",
    "lorem ipsum", "powered by", "follow us on", "share this", "copyright (c)",
]
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
MAX_LOST = 50
END_MARK = r"[.!?:;…\"'”’»)\]]$"
SENTENCE_MARK = r"[.!?:;…]"
SEPARATOR = r"\x20[|>»•·/-]\x20"
RULES = ["symbols", "shouting", "navigation", "boilerplate", "punctuation"]
RESULT = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines",
    "lost_chars", "clean_text", *[f"lines_{r}" for r in RULES],
]


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """Words inside a window of eight that occurs twice or more.

    Windows are sorted with their places; equal neighbours are repeats; the
    union of the windows that start at the sorted places is their gaps, each
    cut at the window's length.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW)))
    )

    def cover(ordered: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(ordered, i)["h"] == F.get(ordered, j)["h"], F.lit(False))
        hits = F.filter(
            F.transform(ordered, lambda s, i: F.when(same(i, i - 1) | same(i, i + 1), s["i"])), lambda p: p.isNotNull()
        )
        return let(
            F.sort_array(hits),
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    found = let(
        windows,
        lambda hs: F.when(
            F.size(F.array_distinct(hs)) < F.size(hs),
            let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), cover),
        ).otherwise(F.lit(0)),
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(found)


def line_rules(line: Column) -> Column:
    """A struct of ``line, chars`` and one flag per rule."""
    blank_free = F.translate(line, BLANKS, "")

    def judge(n: Column) -> Column:
        low = F.lower(line)
        phrase = F.lit(False)
        for p in PHRASES:
            phrase = phrase | F.contains(low, F.lit(p))
        separators = F.regexp_count(line, F.lit(SEPARATOR))
        trimmed = F.rtrim(F.translate(line, BLANKS[1:], " "))
        flags = {
            "symbols": 4 * count_of(line, SYMBOLS) > n,
            "shouting": (n >= 3) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}"),
            "navigation": ((3 * separators >= n) & (separators >= 2)) | ((n <= 4) & ~trimmed.rlike(END_MARK)),
            "boilerplate": phrase,
            "punctuation": (n >= 30) & ~line.rlike(SENTENCE_MARK),
        }
        return F.struct(
            line.alias("line"),
            F.length(blank_free).alias("chars"),
            *[((n > 0) & flags[r]).alias(r) for r in RULES],
        )

    return let(F.size(words_of(line)), judge)


def judge_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every figure, the verdict and the text without failed lines."""
    base = without(docs, RESULT)
    text = text_of(text_col)
    failed = lambda x: x["symbols"] | x["shouting"] | x["navigation"] | x["boilerplate"] | x["punctuation"]
    total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda a, x: a + f(x))

    def flagged(rule: str):
        return lambda x: x[rule]

    def by_line(lines: Column) -> Column:
        used = F.filter(lines, lambda x: x["chars"] > 0)
        return let(
            used,
            lambda u: F.struct(
                F.size(u).cast("long").alias("n_lines"),
                F.size(F.filter(u, failed)).cast("long").alias("n_failed_lines"),
                (F.size(u) - F.size(F.array_distinct(F.transform(u, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
                total(u, lambda x: F.when(failed(x), x["chars"]).otherwise(0)).cast("long").alias("lost_chars"),
                *[F.size(F.filter(u, flagged(r))).cast("long").alias(f"lines_{r}") for r in RULES],
                F.array_join(F.transform(F.filter(lines, lambda x: ~failed(x)), lambda x: x["line"]), "\n").alias("clean_text"),
            ),
        )

    lines = let(F.transform(F.split(text, "\n"), line_rules), by_line)
    words = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    # One element per row: a filter on the verdict stays above it, so that no figure is computed a second time for it.
    judged = base.select("*", F.explode_outer(F.array(F.struct(lines.alias("l"), words.alias("w")))).alias("__v_j"))
    figures = judged.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.col("__v_j.w.n_words").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.col("__v_j.w.n_repeat_words").alias("n_repeat_words"),
        "__v_j.l.*",
    )
    bad = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    lost = 100 * F.col("lost_chars") > MAX_LOST * F.col("word_chars")
    return figures.withColumn("base_failed", bad).withColumn("kept", ~bad & ~lost)


COLUMNS = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
    "n_failed_lines", "lost_chars", *[f"lines_{r}" for r in RULES],
]


def op5_quality_rules(spark, folder: str) -> DataFrame:
    return judge_lines(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")).select(*COLUMNS)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP5_SQL = f"""
WITH base AS (
  SELECT doc_id, COALESCE(text, '') AS t FROM documents
), worded AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM base
), grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM worded WHERE len(ws) >= 8)
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM repeats, range(0, 8) r(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, l, len(list_filter(string_split_regex(l, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base)
), ruled AS (
  SELECT doc_id, l, length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
    4 * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) > n AS symbols,
    n >= 3 AND regexp_matches(l, '\\p{{Lu}}') AND NOT regexp_matches(l, '\\p{{Ll}}') AS shouting,
    (3 * len(regexp_extract_all(l, {_quoted(SEPARATOR)})) >= n AND len(regexp_extract_all(l, {_quoted(SEPARATOR)})) >= 2)
      OR (n <= 4 AND NOT regexp_matches(rtrim(regexp_replace(l, '[\\x09-\\x0D]', ' ', 'g'), ' '), {_quoted(END_MARK)})) AS navigation,
    {" OR ".join(f"contains(lower(l), {_quoted(p)})" for p in PHRASES)} AS boilerplate,
    n >= 30 AND NOT regexp_matches(l, {_quoted(SENTENCE_MARK)}) AS punctuation
  FROM lines WHERE n > 0
), by_doc AS (
  SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT l) AS n_dup_lines,
    COUNT(*) FILTER (symbols OR shouting OR navigation OR boilerplate OR punctuation) AS n_failed_lines,
    COALESCE(SUM(chars) FILTER (symbols OR shouting OR navigation OR boilerplate OR punctuation), 0) AS lost_chars,
    {", ".join(f"COUNT(*) FILTER ({r}) AS lines_{r}" for r in RULES)}
  FROM ruled GROUP BY doc_id
), figures AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(c.n, 0) AS n_repeat_words,
    COALESCE(n_lines, 0) AS n_lines, COALESCE(n_failed_lines, 0) AS n_failed_lines, COALESCE(lost_chars, 0) AS lost_chars,
    {", ".join(f"COALESCE(lines_{r}, 0) AS lines_{r}" for r in RULES)}
  FROM worded w LEFT JOIN covered c USING (doc_id) LEFT JOIN by_doc b USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept
FROM figures
"""
