"""Quality rules on whole documents, with line counts across the documents of a host. Built-in functions only.

Base rules look at one document: words, symbols, repeated lines and repeated three-word windows. The method's verdict
looks across documents: every line is normalised and hashed, documents with different text that hold it are counted per
host, lines held by more than ``line_limit`` of them are removed, and a document that loses more than ``max_lost`` of its
words is rejected.

Defined cases: a null text has no words (and fails); a null host is the host ''; identical texts of a host count once, so
repeated rows and exact copies do not make a line frequent; repeated rows each get their own result; other columns are
ignored. Three-word windows are compared by their 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, id_text, let, words_of

SYMBOLS = r"[#*$%&|<>]"
LINE_LIMIT = 100
MAX_LOST = 0.5
MIN_WORDS = 50


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found at least twice, the first one included.

    Windows are sorted by hash; equal neighbours give the repeated positions, and the union of their spans is the sum of
    the steps between sorted positions, each at most ``width``.
    """

    def windows(w):
        at = lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("p"))
        return F.when(F.size(w) >= width, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - width), at)))

    def repeated(s):
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(found, lambda i: F.get(s, i)["p"]))

    def covered(q):
        step = lambda acc, i: acc + F.least(F.lit(width), F.coalesce(F.get(q, i + 1) - F.get(q, i), F.lit(width)))
        return F.when(F.size(q) > 0, F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), F.lit(0), step))

    out = let(let(windows(words), lambda s: F.when(s.isNotNull(), repeated(s))), lambda q: F.when(q.isNotNull(), covered(q)))
    return F.coalesce(out, F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measures(words: Column, text: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_window_words(words),
    }


def normalised(line: Column) -> Column:
    changed = F.regexp_replace(F.regexp_replace(line, "[0-9]+", "0"), SPACE, " ")
    return F.lower(F.trim(F.when(line.rlike(r"[0-9\x09-\x0D]|  "), changed).otherwise(line)))  # most lines need no change


def line_rows(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """One row per line with a word: doc_id, version (hash of the text), host, line (hash), at, words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.split(text, "\n").alias("lines"),
    )
    split = bare.select("doc_id", "version", "host", F.posexplode("lines").alias("at", "line"))  # the text itself is left behind
    rows = split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "version", "host", "at", normalised(F.col("line")).alias("norm"))
    words = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1  # normalised: one space between words
    return rows.select("doc_id", "version", "host", F.xxhash64("norm").alias("line"), "at", words.cast("long").alias("words"))


def lost_words(docs: DataFrame, line_limit: int = LINE_LIMIT, host_col: str = "source") -> DataFrame:
    """Per document version with a removed line: the words of its removed lines."""
    lines = line_rows(docs, host_col)
    frequent = lines.groupBy("host", "line").agg(F.count_distinct("version").alias("n_docs")).where(F.col("n_docs") > line_limit).select("host", "line")
    hit = lines.join(frequent, ["host", "line"]).groupBy("doc_id", "version", "at").agg(F.max("words").alias("words"))
    return hit.groupBy("doc_id", "version").agg(F.sum("words").alias("lost_words"))


def judge(docs: DataFrame, line_limit: int = LINE_LIMIT, max_lost: float = MAX_LOST, host_col: str = "source") -> DataFrame:
    """Measures and verdict of every row of ``docs``."""
    bare = id_text(docs).withColumn("version", F.xxhash64("text"))
    measured = bare.select("doc_id", "version", let(words_of(F.col("text")), lambda w: F.struct(*[c.alias(n) for n, c in measures(w, F.col("text")).items()])).alias("m"))
    rows = measured.select("doc_id", "version", "m.*")
    lost = lost_words(docs, line_limit, host_col).select(F.col("doc_id").alias("lost_id"), F.col("version").alias("lost_version"), "lost_words")
    both = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("version") == F.col("lost_version")), "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n_lost = F.coalesce(F.col("lost_words"), F.lit(0))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (n_lost <= max_lost * F.col("n_words"))).alias("kept"), n_lost.cast("long").alias("n_lost_words"),
    )


def clean_text(docs: DataFrame, line_limit: int = LINE_LIMIT, host_col: str = "source") -> DataFrame:
    """``docs`` with the frequent lines of each host taken out of ``text``; order and all other columns stay."""
    lines = line_rows(docs, host_col)
    frequent = lines.groupBy("host", "line").agg(F.count_distinct("version").alias("n_docs")).where(F.col("n_docs") > line_limit).select("host", "line")
    cut = lines.join(frequent, ["host", "line"]).groupBy("doc_id", "version").agg(F.collect_set("at").alias("cut_at"))
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("version").alias("cut_version"), "cut_at")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = docs.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col("cut_id")) & (F.xxhash64(text) == F.col("cut_version")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("cut_at", i)), "\n")
    names = docs.columns
    return both.select(*[F.when(F.col("cut_at").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in names])


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
m AS (
  SELECT doc_id, text, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM w),
g AS (SELECT doc_id, text, unnest(generate_series(1, len(ws) - 2)) AS p, ws FROM m WHERE len(ws) >= 3),
t AS (SELECT doc_id, text, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS tri FROM g),
r AS (SELECT doc_id, text, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, text, tri) AS n FROM t) WHERE n > 1),
c AS (SELECT doc_id, text, sum(least(3, coalesce(nxt - p, 3)))::BIGINT AS n_repeat_words
      FROM (SELECT *, lead(p) OVER (PARTITION BY doc_id, text ORDER BY p) AS nxt FROM r) GROUP BY ALL),
l AS (SELECT doc_id, text, host, trim(regexp_replace(regexp_replace(unnest(string_split(lower(text), chr(10))), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM d),
f AS (SELECT host, line FROM l WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT text) > {LINE_LIMIT}),
x AS (SELECT doc_id, text, sum(len(string_split(line, ' ')))::BIGINT AS lost FROM l JOIN f USING (host, line) GROUP BY ALL),
j AS (SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS n_lost_words
      FROM m LEFT JOIN c USING (doc_id, text) LEFT JOIN x USING (doc_id, text))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words <= {MAX_LOST} * n_words AS kept
FROM j
"""
