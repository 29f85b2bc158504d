"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic is a column expression of the text and every rule compares a
ratio of two statistics with a bound, so the whole operator is one projection
over the scan: no shuffle, no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import SPACE, WORD, bind

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of the four languages.
STOP_WORDS = tuple("""
the of and to in is that for on with as are be by from or an it at was this
der die und das von den mit ist des im zu auf für ein eine
le la les de des et en du un une que dans est pour au
el los las y del una por con para se
""".split())


@dataclass(frozen=True)
class Rule:
    """Breaks when numerator / denominator is under ``low`` or over ``high``
    thousandths.  With a zero denominator the rule is silent."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: name, numerator, denominator, bounds in thousandths.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1500, 16000),
    Rule("symbols", "n_symbols", "n_words", None, 500),
    Rule("shouting", "n_shouts", "n_words", None, 500),
    Rule("stop_words", "n_stop_words", "n_words", 10, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("long_lines", "word_chars", "n_lines", None, 20000000),
)


def words_of(text: Column) -> Column:
    """``array<string>`` of the words of a text without nulls."""
    return F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words found twice or more.

    The windows are sorted by a 64-bit hash; neighbours of equal hash are
    compared word by word, so a hash never counts words by mistake (a window
    could only be missed if two different windows of one text had one hash)."""

    def marked(runs: Column) -> Column:
        # (hash, start) sorted; a window that equals its neighbour is repeated.
        def same(i: Column, j: Column) -> Column:
            a, b = F.get(runs, i), F.get(runs, j)
            return (a["h"] == b["h"]) & (F.slice(words, a["i"], WINDOW) == F.slice(words, b["i"], WINDOW))

        at = F.sequence(F.lit(0), F.size(runs) - 1)
        hits = F.filter(at, lambda i: F.coalesce((i > 0) & same(i, i - 1), F.lit(False))
                        | F.coalesce((i < F.size(runs) - 1) & same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(hits, lambda i: F.get(runs, i)["i"]))

    def covered(starts: Column) -> Column:
        # a window adds at most WINDOW words, fewer if the next one starts inside it
        at = F.sequence(F.lit(0), F.size(starts) - 1)
        gaps = F.transform(at, lambda i: F.coalesce(
            F.least(F.lit(WINDOW), F.get(starts, i + 1) - F.get(starts, i)), F.lit(WINDOW)))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(
            F.aggregate(gaps, F.lit(0), lambda s, x: s + x))

    # One 64-bit hash per window, read word by word (no slice is built).
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(
        *[F.get(words, i + k) for k in range(WINDOW)]))

    def counted(h: Column) -> Column:
        runs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))
        # Without two equal hashes (the usual text) nothing is sorted or compared.
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            bind(runs, lambda r: bind(marked(r), covered)))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(bind(hashes, counted))


def statistics(text: Column) -> Column:
    """Struct of the statistics of a text (null counts as empty)."""
    t = F.coalesce(text, F.lit(""))
    found = lambda pattern: F.size(F.split(t, pattern, -1)) - 1
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        return bind(lines, lambda ln: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            found(SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"),
            found("!").cast("long").alias("n_shouts"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        ))

    return bind(words_of(t), of_words)


def verdict(stats: Column, rules=RULES) -> Column:
    """Names of the rules of the table that a text breaks (``array<string>``)."""
    def broken(r: Rule) -> Column:
        n, d = stats[r.numerator] * 1000, stats[r.denominator]
        out = F.lit(False)
        if r.low is not None:
            out = out | (n < d * r.low)
        if r.high is not None:
            out = out | (n > d * r.high)
        return F.when((d > 0) & out, F.lit(r.name))

    return F.array_compact(F.array(*[broken(r) for r in rules]))


def quality_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Add the statistics, ``base_failed``, ``broken_rules`` and ``kept``.

    A null or empty text has zero words and fails the base rule; every row is
    kept in the result, repeated ones included; existing columns with the name
    of an output column are replaced.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = df.withColumn("_stats", statistics(F.col(f"`{text}`")))
    out = out.withColumns({n: F.col("_stats")[n] for n in names}
                          | {"broken_rules": verdict(F.col("_stats"), rules)}).drop("_stats")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def oracle(rules=RULES) -> str:
    """The columns of the contract in DuckDB SQL over ``documents``."""
    tests = []
    for r in rules:
        if r.low is not None:
            tests.append(f"(1000 * {r.numerator} < {r.low} * {r.denominator})")
        if r.high is not None:
            tests.append(f"(1000 * {r.numerator} > {r.high} * {r.denominator})")
    broken = " OR ".join(f"({r.denominator} > 0 AND {t})" for r, t in zip(
        [r for r in rules for b in (r.low, r.high) if b is not None], tests))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
    win AS (SELECT doc_id, i, ws[i:i + {WINDOW - 1}] AS win
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
    rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range({WINDOW}) AS r(k) GROUP BY doc_id),
    s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
                 coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                 coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
                 length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts,
                 len(list_filter(ws, lambda x: list_contains([{stop}], lower(x)))) AS n_stop_words
          FROM w LEFT JOIN cov USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR {broken}) AS kept
    FROM s"""
