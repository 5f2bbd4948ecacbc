"""Quality rules: clean line by line first, then judge what is left.

Only SQL functions: everything happens within a row, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

W = common.SPACE_CLASS


@dataclass(frozen=True)
class Rules:
    """Thresholds and patterns; patterns are tried on a line in lower case."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line that ends without a stop fails if it has fewer words than this.
    min_words_unended: int = 5
    #: A line fails if more than this share of its words carry symbols.
    max_symbol_words: float = 0.3
    #: Words of a line that one boilerplate phrase speaks for: a line fails if its
    #: phrases speak for all of it, so one phrase doesn't fail a paragraph.
    words_a_phrase: int = 12
    #: A document is rejected if it loses more than this share of its characters.
    max_lost: float = 0.5
    stop: str = r"""[.!?…。！？:;,][\x22'”’»)\]]*\s*$"""
    navigation: str = (
        r"^\s*((home|menu|login|log in|sign in|sign up|register|search|contact|contact us|about|about us|next|previous|prev|back|share|tweet|print|email|faq|help|sitemap|top|skip to content|read more|click here|continue reading)\s*([|>/»·,•-]|$)\s*)+$"
        r"|^\s*(read more|click here|continue reading|skip to (main )?content|share (this|on)|follow us|subscribe)\b"
    )
    boilerplate: str = (
        r"licensed under|all rights reserved|copyright (\(c\)|©|[0-9]{4})|terms of (use|service)|privacy policy|cookie policy|use(s)? (of )?cookies|javascript|lorem ipsum"
    )


RULES = Rules()


def words(text: Column) -> Column:
    return F.filter(F.split(text, W + "+"), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more.

    Windows are hashed and sorted with their positions; each position that
    shares its hash with a neighbour counts the words not counted before it.
    """
    n = F.size(ws)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.array(hashes), _covered)[0]


def _covered(hashes: Column) -> Column:
    n = F.size(hashes)
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeats(p: Column) -> Column:
        again = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(at, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(3))).alias("n")))["n"]

    none = F.lit(0).cast("bigint")
    return F.when(F.size(F.array_distinct(hashes)) == n, none).otherwise(F.transform(F.array(pairs), repeats)[0])


def line_verdicts(text: Column, rules: Rules = RULES) -> Column:
    """array<struct<line, n_words, why>>: why is null for a line that stays."""

    def verdict(line: Column) -> Column:
        n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
        odd = F.regexp_count(line, F.lit(r"[#*$%&|<>][^\x20\x09-\x0D]*"))
        low = F.lower(line)
        why = (
            F.when(n == 0, F.lit(None).cast("string"))
            .when(rules.words_a_phrase * F.regexp_count(low, F.lit(rules.boilerplate)) >= n, "boilerplate")
            .when(low.rlike(rules.navigation), "navigation")
            .when((n < rules.min_words_unended) & ~line.rlike(rules.stop), "punctuation")
            .when(odd > rules.max_symbol_words * n, "symbols")
        )
        return F.struct(line.alias("line"), why.alias("why"))

    return F.transform(F.split(text, "\n"), verdict)


#: What ``quality`` adds, in order.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost_share", "kept")


def _judged(b: Column, rules: Rules) -> Column:
    """Counts and verdict of a text; b has the text and its words, lines and verdicts."""
    stay = F.filter(b["verdicts"], lambda v: v["why"].isNull())
    counts = F.struct(
        F.size(b["words"]).cast("long").alias("n_words"),
        (F.char_length(b["text"]) - F.regexp_count(b["text"], F.lit(W))).cast("long").alias("word_chars"),
        F.regexp_count(b["text"], F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(b["lines"]) - F.size(F.array_distinct(b["lines"]))).cast("long").alias("n_dup_lines"),
        repeated_words(b["words"]).alias("n_repeat_words"),
        F.array_join(F.transform(stay, lambda v: v["line"]), "\n").alias("clean_text"),
    )

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])
        lost = 1 - F.char_length(c["clean_text"]) / F.greatest(F.char_length(b["text"]), F.lit(1))
        own = {"base_failed": failed, "lost_share": lost, "kept": ~failed & (lost <= rules.max_lost)}
        return F.struct(*((own[n] if n in own else c[n]).alias(n) for n in MADE))

    return F.transform(F.array(counts), verdict)[0]


def quality(docs: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, clean_text, lost_share and kept.

    A document is kept if base_failed is false and the lines that fail hold at
    most ``max_lost`` of its characters.  clean_text has the lines that stay.
    A null or empty text has no words, fails and isn't kept.  Rows are judged
    one by one, so repeated rows get the same verdict; columns of ``docs`` with
    the names above are replaced, any others stay.  An empty table gives no rows.
    """
    if text in MADE:
        raise ValueError(f"the text column can't be named {text}")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bound = F.struct(t.alias("text"), words(t).alias("words"), lines.alias("lines"), line_verdicts(t, rules).alias("verdicts"))
    # Arrays of one bind what is used many times; as a generator's output the
    # verdict isn't worked out again by a filter on it.
    judged = F.transform(F.array(bound), lambda b: _judged(b, rules))
    return docs.select(*(c for c in docs.columns if c not in MADE), F.inline(judged))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql(rules: Rules = RULES) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
v AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
             len(regexp_extract_all(line, '[#*$%&|<>][^\x20\x09-\x0D]*')) AS odd FROM l),
s AS (SELECT doc_id, sum(length(line)) + count(*) - 1 AS stay FROM v
      WHERE n = 0 OR NOT ({rules.words_a_phrase} * len(regexp_extract_all(lower(line), {q(rules.boilerplate)})) >= n OR regexp_matches(lower(line), {q(rules.navigation)})
        OR (n < {rules.min_words_unended} AND NOT regexp_matches(line, {q(rules.stop)})) OR odd > {rules.max_symbol_words} * n)
      GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(t) AS n_all,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM w),
a AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stay, 0) AS stay FROM m LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 - stay / greatest(n_all, 1) <= {rules.max_lost} AS kept FROM b
"""


SQL = sql()
