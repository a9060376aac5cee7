"""Quality rules: a table of thresholds compiled into one Spark projection, no user functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of the languages in the corpus, as they stand between spaces, in lower case.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on this are or an "
    "der die das und den von zu mit sich des auf ist ein dem nicht "
    "le la les de des et un une en du que est dans pour par sur au "
    "el los las y del se por con para su al una como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails where ``metric`` lies outside ``least`` and ``most``, or is unknown."""

    metric: str
    least: float | None = None
    most: float | None = None

    def failed(self) -> Column:
        bad = [F.col(self.metric).isNull()]
        bad += [F.col(self.metric) < self.least] if self.least is not None else []
        bad += [F.col(self.metric) > self.most] if self.most is not None else []
        return reduce(Column.__or__, bad)


# metric, least, most
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_word_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.30),
)


def _repeated_words(w: Column, hashes: Column) -> Column:
    """Words of *w* that lie in a window found twice or more.

    Distinct hashes settle the usual text without any; else windows are sorted by
    their words and place, equal neighbours give the places, and the union of the
    windows there is counted.  All of it takes n log n steps of one text.
    """
    n = F.size(w) - (WINDOW - 1)
    windows = F.arrays_zip(*[F.slice(w, k + 1, n) for k in range(WINDOW)], F.sequence(F.lit(0), n - 1))
    ordered = F.sort_array(windows)

    def same(a: Column, b: Column) -> Column:
        return reduce(Column.__and__, [a[str(k)] == b[str(k)] for k in range(WINDOW)])

    pairs = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.when(same(a, b), F.array(a[str(WINDOW)], b[str(WINDOW)])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    count = F.aggregate(gaps, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(w) < WINDOW, 0).when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(count).cast("long")


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts and ratios of each row of *docs* (doc_id, text); null text is empty.

    Ratios of a text without words, or without lines that hold one, are null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    n = F.greatest(F.lit(0), F.size("w") - (WINDOW - 1))
    windows = F.arrays_zip(*[F.slice("w", k + 1, n) for k in range(WINDOW)])
    split = docs.select("doc_id", text.alias("text"), words.alias("w"), lines.alias("lines"))
    hashed = split.select(
        "doc_id",
        "text",
        "w",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(windows, lambda x: F.xxhash64(x)).alias("hashes"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop"),
    )
    n_words = F.size("w")
    return hashed.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        "n_dup_lines",
        _repeated_words(F.col("w"), F.col("hashes")).alias("n_repeat_words"),
        "n_lines",
        "n_stop",
    ).select(
        "*",
        (F.col("word_chars") / F.nullif("n_words", F.lit(0))).alias("mean_word_chars"),
        (F.col("n_symbols") / F.nullif("n_words", F.lit(0))).alias("symbol_ratio"),
        (F.col("n_stop") / F.nullif("n_words", F.lit(0))).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.nullif("n_lines", F.lit(0))).alias("dup_line_ratio"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 10, most_repeat_percent: int = 20) -> DataFrame:
    """Metrics of every row, ``base_failed``, the first rule that fails, and ``kept``.

    ``base_failed``: fewer than *least_words*, or more than *most_repeat_percent*
    of the words in repeated windows.  ``kept`` needs that and every rule passed.
    Null and empty texts fail the base.  Equal rows get equal verdicts; other
    columns of *docs* are not read.
    """
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    broken = F.coalesce(F.lit(None).cast("string"), *[F.when(r.failed(), r.metric) for r in rules])
    judged = metrics(docs).withColumns({"base_failed": base, "failed_rule": broken})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


OUTPUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op8(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document."""
    return judge(docs).select(OUTPUT)


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    bad = " OR ".join(
        " OR ".join([f"{r.metric} IS NULL"] + [f"{r.metric} < {r.least}"] * (r.least is not None) + [f"{r.metric} > {r.most}"] * (r.most is not None))
        for r in RULES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, [x FOR x IN string_split_regex(text, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
win AS (SELECT k, i, w[i:i+4] AS g FROM (SELECT k, w, unnest(generate_series(1, len(w) - 4)) AS i FROM s WHERE len(w) >= 5)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY k),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(lines) AS n_lines,
             len([x FOR x IN w IF lower(x) IN ({stop})]) AS n_stop
      FROM s LEFT JOIN cov USING (k)),
r AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio,
             n_stop / nullif(n_words, 0) AS stop_word_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT ({bad}) AS kept FROM r
"""


SQL = _sql()
