"""URL filters by temporal list join: every capture is judged by the entries that were active when it was fetched.

Lists change over time: an entry is added, removed, added again.  Dated changes
become validity intervals, and an as-of join evaluates each capture against
those that hold its time.  Intervals and captures meet by key and by stretch of
time, so that a host with a third of all captures is spread over its stretches.
DataFrame functions only; times are seconds, as long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
# More specific kinds decide before less specific ones.
KINDS = {"domain": 1, "host": 2, "prefix": 3}
STRETCH = 30 * 86400


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    authority = F.regexp_extract(url, AUTHORITY, 1)
    bare = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")
    return F.nullif(F.lower(F.rtrim(bare, F.lit("."))), F.lit(""))


def segments_of(url: Column) -> Column:
    """The path's segments that are not empty."""
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")


def intervals(changes: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Validity intervals of dated *changes* (list, kind, pattern, added, at, change_id).

    A change holds from its time to the next one of its entry, the end excluded
    and null if there is none; only additions give an interval.  Of changes of
    one time the one with the last change_id holds.  Changes without a pattern
    or a time are passed over.  An entry's changes are put in order within
    stretches of time, each of which ends where the entry's next one begins, so
    that an entry with very many changes is no single task's.
    """
    entry = ["list", "kind", "pattern"]
    dated = changes.where(F.col("pattern").isNotNull() & F.col("at").isNotNull())
    last = dated.groupBy(*entry, "at").agg(F.max(F.struct("change_id", "added")).alias("c"))
    held = last.select(*entry, F.col("c.added").alias("added"), F.col("at").alias("since"), F.floor(F.col("at") / stretch).alias("stretch"))
    begins = held.groupBy(*entry, "stretch").agg(F.min("since").alias("begin"))
    after = F.lead("begin").over(Window.partitionBy(*entry).orderBy("stretch")).alias("after")
    next_ = F.lead("since").over(Window.partitionBy(*entry, "stretch").orderBy("since"))
    joined = held.join(begins.select(*[F.col(c).alias(f"_{c}") for c in (*entry, "stretch")], after), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*entry, "stretch")]))
    return joined.select(*entry, "added", "since", F.coalesce(next_, "after").alias("until")).where("added").drop("added")


def _keys(host: Column, segments: Column, depth: Column) -> Column:
    """What an entry's kind and pattern must equal to speak of a URL: its host, every domain above, path prefixes to *depth*."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    most = F.least(F.size(segments), depth)
    paths = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), most)), lambda i: F.concat_ws("/", host, F.array_join(F.slice(segments, F.lit(1), i), "/")))

    def keyed(kind: str, patterns: Column) -> Column:
        return F.transform(patterns, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern")))

    prefixes = F.when(most > 0, paths).otherwise(F.array().cast("array<string>"))
    return F.concat(keyed("host", F.array(host)), keyed("domain", domains), keyed("prefix", prefixes))


def judge(captures: DataFrame, changes: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """*captures* (url, fetched_at) with host, verdict, kind, pattern and since.

    ``verdict`` is the list (``allow`` or ``block``) of the deciding entry, or
    ``pass`` without one.  The most specific entry active at ``fetched_at``
    decides (prefix, then host, then domain; longer patterns first); ``allow``
    wins among equals.  Null or malformed URLs and null times pass.  Repeated
    captures get a row each; other columns are kept, and those six names must be
    free for the result.  Either table may be empty.
    """
    added = ["host", "verdict", "kind", "pattern", "since"]
    clash = set(added) & set(captures.columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    active = intervals(changes, stretch)
    depth = active.where(F.col("kind") == "prefix").agg(F.max(F.size(F.split("pattern", "/")) - 1).alias("d"))
    seen = captures.select("url", "fetched_at").where(F.col("fetched_at").isNotNull()).distinct()
    # the deepest prefix of all bounds the explosion of a URL
    deepest = depth.first()["d"] or 0
    host, segments = host_of(F.col("url")), segments_of(F.col("url"))
    keyed = (
        seen.select("url", "fetched_at", host.alias("host"), segments.alias("segments"))
        .where(F.col("host").isNotNull())
        .select("url", "fetched_at", F.inline(_keys(F.col("host"), F.col("segments"), F.lit(deepest))))
        .withColumn("stretch", F.floor(F.col("fetched_at") / stretch))
    )
    # an interval goes to those stretches alone in which its key was captured
    taken = keyed.select("kind", "pattern", "stretch").distinct()
    first, last = F.floor(F.col("since") / stretch), F.floor(F.col("until") / stretch)
    spread = active.join(taken, ["kind", "pattern"]).where((F.col("stretch") >= first) & (last.isNull() | (F.col("stretch") <= last)))
    met = keyed.join(spread, ["kind", "pattern", "stretch"]).where(
        (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    )
    rank = F.coalesce(*[F.when(F.col("kind") == k, r) for k, r in KINDS.items()])
    decisive = F.struct(rank.alias("rank"), F.length("pattern").alias("length"), (F.col("list") == "allow").cast("int").alias("allow"), "since", "list", "kind", "pattern")
    decided = met.groupBy("url", "fetched_at").agg(F.max(decisive).alias("d"))
    decided = decided.select(F.col("url").alias("_u"), F.col("fetched_at").alias("_t"), F.col("d.list").alias("verdict"), F.col("d.kind"), F.col("d.pattern"), F.col("d.since"))
    out = captures.withColumn("host", host).join(decided, (F.col("url") == F.col("_u")) & (F.col("fetched_at") == F.col("_t")), "left").drop("_u", "_t")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit("pass"))).select(*captures.columns, *added)


# -- the test tables: every page is a capture, and a report about its host, domain or path ---------------------

EPOCH = 1_704_067_200
SPAN_HOURS = 17_520


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures with a time that follows from the page's id."""
    return pages.select("page_id", "url", (F.lit(EPOCH) + F.pmod(F.col("page_id") * 7919, F.lit(SPAN_HOURS)) * 3600).alias("fetched_at"))


def changes_of(pages: DataFrame) -> DataFrame:
    """One dated change per page; list, kind and direction follow from the page's id."""
    host, k = host_of(F.col("url")), F.col("page_id")
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    path = F.concat_ws("/", host, F.element_at(segments_of(F.col("url")), 1))
    kind = F.when(k % 4 == 0, "domain").when(k % 4 == 2, "prefix").otherwise("host")
    return pages.where(F.size(segments_of(F.col("url"))) > 0).select(
        F.when(k % 5 == 0, "allow").otherwise("block").alias("list"),
        kind.alias("kind"),
        F.when(kind == "domain", domain).when(kind == "prefix", path).otherwise(host).alias("pattern"),
        (k % 3 != 0).alias("added"),
        (F.lit(EPOCH) + F.pmod(k * 104_729, F.lit(SPAN_HOURS)) * 3600).alias("at"),
        k.alias("change_id"),
    )


def op6(pages: DataFrame) -> DataFrame:
    """``judge`` of all pages: page_id, url, host, fetched_at, verdict, kind, pattern, since, kept."""
    return judge(captures_of(pages), changes_of(pages)).withColumn("kept", F.col("verdict") != "block")


SQL = rf"""
WITH p AS (
  SELECT page_id, url,
         nullif(lower(rtrim(regexp_replace(regexp_replace(regexp_extract(url, '{AUTHORITY}', 1), '^.*@', ''), ':[0-9]*$', ''), '.')), '') AS host,
         [s FOR s IN string_split(regexp_extract(url, '{PATH}', 1), '/') IF s <> ''] AS seg,
         {EPOCH} + page_id * 7919 % {SPAN_HOURS} * 3600 AS fetched_at FROM pages),
h AS (SELECT *, string_split(host, '.') AS lab FROM p),
c AS (
  SELECT CASE WHEN page_id % 5 = 0 THEN 'allow' ELSE 'block' END AS list,
         CASE page_id % 4 WHEN 0 THEN 'domain' WHEN 2 THEN 'prefix' ELSE 'host' END AS kind,
         CASE page_id % 4 WHEN 0 THEN array_to_string(lab[greatest(1, len(lab) - 1):], '.') WHEN 2 THEN host || '/' || seg[1] ELSE host END AS pattern,
         page_id % 3 <> 0 AS added, {EPOCH} + page_id * 104729 % {SPAN_HOURS} * 3600 AS since, page_id
  FROM h WHERE len(seg) > 0),
i AS (SELECT *, lead(since) OVER (PARTITION BY list, kind, pattern ORDER BY since, page_id) AS until FROM c WHERE pattern IS NOT NULL),
k AS (
  SELECT page_id, fetched_at, 'host' AS kind, host AS pattern FROM h
  UNION ALL SELECT page_id, fetched_at, 'domain', array_to_string(lab[n:], '.') FROM (SELECT *, unnest(generate_series(1, greatest(1, len(lab) - 1))) AS n FROM h)
  UNION ALL SELECT page_id, fetched_at, 'prefix', host || '/' || seg[1] FROM h WHERE len(seg) > 0),
m AS (
  SELECT k.page_id, list, k.kind, k.pattern, since,
         row_number() OVER (PARTITION BY k.page_id ORDER BY CASE k.kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC,
                            length(k.pattern) DESC, CASE list WHEN 'allow' THEN 1 ELSE 0 END DESC, since DESC) AS r
  FROM k JOIN i ON k.kind = i.kind AND k.pattern = i.pattern AND added AND fetched_at >= since AND (until IS NULL OR fetched_at < until))
SELECT h.page_id, url, host, fetched_at::BIGINT AS fetched_at, coalesce(list, 'pass') AS verdict, kind, pattern, since::BIGINT AS since,
       coalesce(list, 'pass') <> 'block' AS kept
FROM h LEFT JOIN (SELECT * FROM m WHERE r = 1) d ON h.page_id = d.page_id
"""
