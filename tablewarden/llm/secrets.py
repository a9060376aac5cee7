"""Secrets in whole texts: three fixed patterns, and a battery of randomness tests for everything else.

Candidates are long runs of the characters that encodings of random bytes use.
"=" parts a name from its value, so a run ends there but for its padding; a run
that no one alphabet holds is taken apart at the characters that break either
base64 alphabet, and the pieces of both ways are candidates.  For the encoding that a candidate's alphabet implies,
chi-squared uniformity, a runs test and the serial correlation each give a
p-value for "drawn at random"; Fisher's method combines them.  A candidate is
dismissed as structured by the Benjamini-Hochberg rule among candidates of like
length, which bounds how many of the dismissed are random after all; short
candidates, where the tests have little power, do not loosen the rule for long
ones.  Everything else counts as a secret.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablewarden.llm.common import Scratch

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run is one match, so the least length may stand in the pattern
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_RANDOM = 6, 20, 24, 20
# A run between "=", with the padding that ends it; and what one alphabet holds of a run that mixes them.
PIECE = r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
ONE_ALPHABET = (r"[A-Za-z0-9+/]{20,}(?:=+$)?", r"[A-Za-z0-9_-]{20,}(?:=+$)?")
# Alphabets by encoding, in the order in which they are tried; digits of the alphabet by place.
ENCODINGS = {
    "hex": (r"^[0-9a-f]+$", "0123456789abcdef"),
    "upper_hex": (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    "base32": (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base64": (r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "base64url": (r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
}
# Lower ends of the length classes within which false dismissals are controlled.
LENGTHS = (20, 24, 32, 48, 64)
FALSE_SHARE = 0.05
SCALE = 1_000_000  # p-values are compared in millionths

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Places of the matches whose *group* has *least* characters or more, in code points.

    Spark gives matches without places.  What lies between the matches does: a
    match starts after all text before it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, values)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(F.length(x["2"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(F.size(hits) > 0, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _tail(z: Column) -> Column:
    """P(Z > |z|) of the standard normal, by the usual rational approximation (error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) * 0.3989422804014327 * series


def _codes(token: Column) -> Column:
    """Places of a token's characters in the alphabet of its encoding, padding left out; null without one."""
    chars = F.regexp_extract_all(F.regexp_replace(token, "=+$", ""), F.lit("."), F.lit(0))

    def places(alphabet: str) -> Column:
        return F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1)

    return F.coalesce(*[F.when(token.rlike(p), places(a)) for p, a in ENCODINGS.values()])


def _alphabet_size(token: Column) -> Column:
    return F.coalesce(*[F.when(token.rlike(p), len(a)) for p, a in ENCODINGS.values()])


def _battery(x: Column) -> Column:
    """Combined p-value of ``x.codes`` under "uniform and independent" over ``x.size`` letters."""
    codes, a = x["codes"], x["size"].cast("double")
    n = F.size(codes).cast("double")
    zero = F.lit(0.0)
    total = F.aggregate(codes, zero, lambda s, v: s + v)
    squares = F.aggregate(F.array_distinct(codes), zero, lambda s, v: s + F.pow(F.size(F.filter(codes, lambda c: c == v)).cast("double"), F.lit(2.0)))
    chi = a / n * squares - n
    z_chi = (chi - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    p_chi = F.when(z_chi > 0, _tail(z_chi)).otherwise(1 - _tail(z_chi))

    following = F.slice(codes, 2, F.size(codes))
    pairs = F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1), following)
    high = F.aggregate(codes, zero, lambda s, v: s + (v * 2 >= a).cast("double"))
    low = n - high
    changes = F.aggregate(pairs, zero, lambda s, v: s + ((v["0"] * 2 >= a) != (v["1"] * 2 >= a)).cast("double"))
    expected = 2 * high * low / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    p_runs = F.when(variance > 0, 2 * _tail((changes + 1 - expected) / F.sqrt(variance))).otherwise(0.0)

    mean = total / n
    spread = F.aggregate(codes, zero, lambda s, v: s + (v - mean) * (v - mean))
    lagged = F.aggregate(pairs, zero, lambda s, v: s + (v["0"] - mean) * (v["1"] - mean))
    p_serial = F.when(spread > 0, 2 * _tail((lagged / spread + 1 / n) * F.sqrt(n))).otherwise(0.0)

    logs = [F.log(F.greatest(p, F.lit(1e-15))) for p in (p_chi, p_runs, p_serial)]
    half = -reduce(Column.__add__, logs)
    return F.exp(-half) * (1 + half + half * half / 2)


def _pieces(text: Column, runs: Column) -> Column:
    """*runs*, those that mix alphabets taken apart at either alphabet's breaking characters."""

    def apart(s: Column) -> Column:
        token = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        parts = F.concat(*[_spans(token, p, 3, 0, LEAST_RANDOM) for p in ONE_ALPHABET])
        placed = F.transform(parts, lambda q: F.struct((s["start"] + q["start"]).alias("start"), q["kind"].alias("kind"), (s["start"] + q["end"]).alias("end")))
        return F.when(token.rlike("[+/]") & token.rlike("[_-]"), placed).otherwise(F.array(s))

    return F.flatten(F.transform(runs, apart))


def _united(found: Column) -> Column:
    """Spans of one kind, those that overlap made one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        whole = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))
        return F.when(F.size(acc) == 0, F.array(s)).when(last["end"] > s["start"], whole).otherwise(F.concat(acc, F.array(s)))

    return F.when(F.size(found) > 1, F.aggregate(F.array_sort(found), F.array().cast(_SPAN), step)).otherwise(found)


def _with_p(text: Column, base: Column, found: Column) -> Column:
    """Candidates outside the *base* spans, with length class and p-value in millionths.

    Runs without a letter or digit are rules, which every test dismisses; they do not count towards the bars.
    """
    outside = F.filter(_pieces(text, found), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    tokens = F.transform(outside, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("token")))
    told = F.filter(tokens, lambda t: t["token"].rlike("[A-Za-z0-9]"))
    coded = F.transform(told, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _alphabet_size(t["token"]).alias("size"), _codes(t["token"]).alias("codes")))
    known = F.filter(coded, lambda t: F.size(t["codes"]) >= LEAST_RANDOM)

    def classed(t: Column) -> Column:
        length = F.size(t["codes"])
        stratum = reduce(Column.__add__, [(length >= low).cast("int") for low in LENGTHS])
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), stratum.alias("stratum"), F.floor(_battery(t) * SCALE).cast("int").alias("p"))

    return F.transform(known, classed)


def dismissal_bars(p: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """Per length class the largest p (in millionths) that the Benjamini-Hochberg rule still dismisses.

    *p* has ``stratum`` and ``p``, one row per candidate.  The counts are per
    distinct p, so that a class is at most a million rows whatever the corpus holds.
    """
    counts = p.groupBy("stratum", "p").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stratum").orderBy("p")
    ranked = counts.select("stratum", "p", F.sum("n").over(w).alias("rank"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    return ranked.where(F.col("p") * F.col("all") <= share * SCALE * F.col("rank")).groupBy("stratum").agg(F.max("p").alias("bar"))


def spans(docs: DataFrame, scratch: Scratch | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``base`` and ``found`` spans of every row of *docs* (text, and the columns in *keep*).

    Arrays of (start, kind, end), places in code points, end exclusive, by start,
    then kind.  Null text is empty and has none.  Texts are read once; counts of
    p-values over all rows set the bars, one number per length class.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select(
        *keep,
        text.alias("_text"),
        F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2, LEAST_VALUE), _spans(text, ACCESS, 1, 0, LEAST_ACCESS), _spans(text, HEX, 2, 0, LEAST_HEX))).alias("base"),
        _spans(text, PIECE, 3, 0, LEAST_RANDOM).alias("_runs"),
    )
    scanned = scratch.write(scanned.select(*keep, "base", _with_p(F.col("_text"), F.col("base"), F.col("_runs")).alias("candidates")), "scanned")
    bars = dismissal_bars(scanned.select(F.inline("candidates")).select("stratum", "p")).collect()

    def random(c: Column) -> Column:
        bar = reduce(lambda e, r: F.when(c["stratum"] == r["stratum"], r["bar"]).otherwise(e), bars, F.lit(-1))
        return c["p"] > bar

    added = F.transform(F.filter("candidates", random), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.select(*keep, "base", F.array_sort(F.concat("base", _united(added))).alias("found"))


def _written(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """*text* with every span, or union of overlapping spans, replaced by *mark*."""

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        apart = s["start"] >= acc["at"]
        out = F.when(apart, F.concat(acc["out"], F.array(piece, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(found, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), ""))
    return F.when(F.size(found) > 0, done).otherwise(text)


def op10(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return spans(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
        count(3).alias("n_random"),
    )


def _span_sql(pattern: str, kind: int, group: int, least: int, source: str = "d") -> str:
    quoted = pattern.replace("'", "''")
    return f"""
SELECT k, {kind} AS kind, gap_to + hit_to AS s, gap_to + hit_to + len(hits[i]) AS e FROM (
  SELECT k, i, hits, vals, list_sum([len(g) FOR g IN gaps[1:i]]) AS gap_to, coalesce(list_sum([len(h) FOR h IN hits[1:i-1]]), 0) AS hit_to
  FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM (
    SELECT k, string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}', 0) AS hits, regexp_extract_all(text, '{quoted}', {group}) AS vals FROM {source})
    WHERE len(hits) > 0)) WHERE len(vals[i]) >= {least}"""


def _sql() -> str:
    tail = "exp(-z * z / 2) * 0.3989422804014327 * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))"

    def tail_of(z: str) -> str:
        return f"(SELECT {tail} FROM (SELECT abs({z}) AS z, 1 / (1 + 0.2316419 * abs({z})) AS t))"

    size = " ".join(f"WHEN regexp_matches(tok, '{p}') THEN {len(a)}" for p, a in ENCODINGS.values())
    alphabet = " ".join(f"WHEN regexp_matches(tok, '{p}') THEN '{a}'" for p, a in ENCODINGS.values())
    stratum = " + ".join(f"(n >= {low})::INT" for low in LENGTHS)
    kinds = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_span_sql(ASSIGN, 0, 2, LEAST_VALUE)} UNION ALL {_span_sql(ACCESS, 1, 0, LEAST_ACCESS)} UNION ALL {_span_sql(HEX, 2, 0, LEAST_HEX)}),
bare AS ({_span_sql("[A-Za-z0-9+/_-]{20,}", 3, 0, LEAST_RANDOM)}),
padded AS (SELECT r.k, s, e, text, len(regexp_extract(substr(text, (e + 1)::BIGINT), '^=+')) AS pad FROM bare r JOIN d ON d.k = r.k),
runs AS MATERIALIZED (SELECT row_number() OVER () AS run, k, s, e, substr(text, (s + 1)::BIGINT, (e - s)::BIGINT) AS tok FROM (
  SELECT k, s, text, CASE WHEN regexp_matches(substr(text, (e + pad + 1)::BIGINT, 1), '[A-Za-z0-9+/_-]') THEN e ELSE e + pad END AS e FROM padded)),
mixed AS (SELECT run AS k, tok AS text FROM runs WHERE regexp_matches(tok, '[+/]') AND regexp_matches(tok, '[_-]')),
parts AS ({" UNION ALL ".join(_span_sql(p, 3, 0, LEAST_RANDOM, "mixed") for p in ONE_ALPHABET)}),
pieces AS (SELECT k, s, e, tok FROM runs WHERE run NOT IN (SELECT k FROM mixed)
  UNION ALL SELECT r.k, r.s + p.s, r.s + p.e, substr(tok, (p.s + 1)::BIGINT, (p.e - p.s)::BIGINT) FROM parts p JOIN runs r ON r.run = p.k),
tokens AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM pieces r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.k = r.k AND b.s < r.e AND b.e > r.s)),
coded AS (SELECT id, CASE {size} END AS a, CASE {alphabet} END AS alphabet, regexp_replace(tok, '=+$', '') AS body FROM tokens WHERE regexp_matches(tok, '[A-Za-z0-9]')),
chars AS (SELECT id, a, i, strpos(alphabet, substr(body, i, 1)) - 1 AS v FROM (SELECT *, unnest(generate_series(1, len(body))) AS i FROM coded WHERE a IS NOT NULL)),
sums AS (SELECT id, any_value(a)::DOUBLE AS a, count(*)::DOUBLE AS n, sum(v)::DOUBLE AS total, sum((v * 2 >= a)::INT)::DOUBLE AS high FROM chars GROUP BY id),
squares AS (SELECT id, sum(c * c)::DOUBLE AS sq FROM (SELECT id, v, count(*) AS c FROM chars GROUP BY id, v) GROUP BY id),
spreads AS (SELECT id, sum((v - total / n) * (v - total / n)) AS spread FROM chars JOIN sums USING (id) GROUP BY id),
pairs AS (SELECT x.id, sum(((x.v * 2 >= x.a) <> (y.v * 2 >= y.a))::INT)::DOUBLE AS changes, sum((x.v - total / n) * (y.v - total / n)) AS lagged
  FROM chars x JOIN chars y ON x.id = y.id AND y.i = x.i + 1 JOIN sums u ON u.id = x.id GROUP BY x.id),
z AS (SELECT id, n, (a / n * sq - n - (a - 1)) / sqrt(2 * (a - 1) * (n - 1) / n) AS z_chi, 2 * high * (n - high) / n + 1 AS expected, changes, lagged, spread
  FROM sums JOIN squares USING (id) JOIN spreads USING (id) JOIN pairs USING (id) WHERE n >= {LEAST_RANDOM}),
z2 AS (SELECT *, CASE WHEN (expected - 1) * (expected - 2) / (n - 1) > 0 THEN (changes + 1 - expected) / sqrt((expected - 1) * (expected - 2) / (n - 1)) END AS z_runs,
  CASE WHEN spread > 0 THEN (lagged / spread + 1 / n) * sqrt(n) END AS z_serial FROM z),
ps AS (SELECT *, CASE WHEN z_chi > 0 THEN {tail_of('z_chi')} ELSE 1 - {tail_of('z_chi')} END AS p1, coalesce(2 * {tail_of('z_runs')}, 0) AS p2, coalesce(2 * {tail_of('z_serial')}, 0) AS p3 FROM z2),
cand AS (SELECT id, {stratum} AS stratum, floor(exp(-h) * (1 + h + h * h / 2) * {SCALE})::INT AS p
  FROM (SELECT *, -(ln(greatest(p1, 1e-15)) + ln(greatest(p2, 1e-15)) + ln(greatest(p3, 1e-15))) AS h FROM ps)),
hist AS (SELECT stratum, p, count(*) AS c FROM cand GROUP BY stratum, p),
ranked AS (SELECT stratum, p, sum(c) OVER (PARTITION BY stratum ORDER BY p) AS r, sum(c) OVER (PARTITION BY stratum) AS m FROM hist),
bars AS (SELECT stratum, max(p) AS bar FROM ranked WHERE p * m <= {FALSE_SHARE} * {SCALE} * r GROUP BY stratum),
random AS (SELECT k, s, e FROM cand c JOIN tokens USING (id) LEFT JOIN bars b ON b.stratum = c.stratum WHERE c.p > coalesce(b.bar, -1)),
edges AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM random),
united AS (SELECT k, min(s) AS s, max(e) AS e FROM (SELECT *, sum((reach IS NULL OR s >= reach)::INT) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM edges) GROUP BY k, g),
found AS (SELECT k, kind, s, e FROM base UNION ALL SELECT k, 3, s, e FROM united),
told AS (SELECT k, kind, s, (CASE kind {kinds} END) || ':' || s::BIGINT || ':' || e::BIGINT AS t FROM found),
agg AS (SELECT k, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_random,
  string_agg(t, ',' ORDER BY s, kind) AS spans, string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3) AS base FROM told GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0)::BIGINT AS n_random FROM d LEFT JOIN agg USING (k)
"""


SQL = _sql()
