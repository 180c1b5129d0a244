"""URL filtering by dated lists: an as-of join of captures with the list entries active at fetch time.

A list is a log of dated events ``(list_name, scope, value, action, at)``: ``scope`` is ``domain`` (the host or any host
below it) or ``prefix`` (host and leading path segments), ``action`` is ``add`` or ``remove``. Per key the events become
validity intervals ``[valid_from, valid_to)``; a capture is held against the intervals that contain its fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import read_table, stored

#: Entries up to this many rows are broadcast (about 100 MB); longer lists are joined by a shuffle, but for frequent keys.
BROADCAST_ROWS = 500_000
#: A key that more than one in FREQUENT of all keys of captures equals is frequent; so there are FREQUENT of them at most.
FREQUENT = 10_000
LIST_COLUMNS = "list_name string, scope string, value string, action string, at long"
#: The dated lists that the query applies (seconds since 1970).
LISTS = [
    ("spam", "domain", "spam-farm.example.org", "add", 1704844800),
    ("spam", "domain", "spam-farm.example.org", "remove", 1711929600),
    ("spam", "domain", "spam-farm.example.org", "add", 1717200000),
    ("spam", "domain", "cheap-pills.example.com", "add", 1706745600),
    ("legal", "domain", "blog.thertion.example.org", "add", 1709251200),
    ("legal", "domain", "blog.thertion.example.org", "remove", 1727740800),
    ("legal", "domain", "tionsh.example.net", "add", 1714521600),
    ("legal", "domain", "tionsh.example.net", "remove", 1714780800),
    ("adult", "prefix", "m.ththth.example.net/en", "add", 1704067200),
    ("adult", "prefix", "blog.ththly.example.org/en/7", "add", 1719792000),
    ("malware", "domain", "example.com", "add", 1722470400),
    ("malware", "domain", "example.com", "remove", 1722556800),
    ("malware", "domain", "thther.example.org", "add", 1730419200),
]
#: Pages carry no fetch time, so the query gives each one, spread over 2024.
FIRST_FETCH, FETCH_SPAN, FETCH_STEP = 1704067200, 31_622_400, 7919


def host_of(url: Column) -> Column:
    """The lower-case host without port, user and trailing dot; empty where the URL has none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"\.$", "")


def keys_of(url: Column) -> Column:
    """Every key under which a list may name a URL: the host's domain suffixes, and host plus leading path segments."""
    labels = F.split(F.col("_host"), r"\.")
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.lit("domain").alias("scope"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("value")))
    prefixes = F.transform(
        F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.lit("prefix").alias("scope"), F.concat(F.col("_host"), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k), "/")).alias("value")),
    )
    return F.when(F.col("_host") != "", F.concat(domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, scope, value, valid_from, valid_to) of dated entries; an open interval has a null ``valid_to``.

    Of two events of one key at one moment ``remove`` has the last word. Repeated and unknown events change nothing;
    entries with a null key, action or date are dropped.
    """
    known = entries.where(F.col("scope").isin("domain", "prefix") & F.col("value").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    known = known.withColumn("value", F.lower(F.trim("value"))).groupBy("list_name", "scope", "value", "at").agg(F.max("action").alias("action"))
    by_key = Window.partitionBy("list_name", "scope", "value").orderBy("at")
    return known.withColumn("valid_to", F.lead("at").over(by_key)).where("action = 'add'").select("list_name", "scope", "value", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``captures`` with host, blocked (boolean), n_lists (long: lists that name it then), list_name, scope, value, valid_from.

    The last four come from the most specific active entry (longest value, then prefix over domain, then list name).
    A null or hostless URL or a null fetch time is matched by nothing. Verdicts depend on (url, fetch time) alone, so
    repeated captures get the same one. Columns of the captures stay, but those with one of the names above.
    """
    verdict = ["host", "blocked", "n_lists", "list_name", "scope", "value", "valid_from"]
    captures = captures.drop(*[c for c in verdict if c in captures.columns])
    active = intervals(entries)
    asked = captures.select(F.col(url).alias("_url"), F.col(fetched_at).cast("long").alias("_at")).withColumn("_host", host_of(F.col("_url")))
    exploded = asked.select("_url", "_at", F.explode_outer(keys_of(F.col("_url"))).alias("_key")).select("_url", "_at", F.col("_key.scope").alias("_scope"), F.col("_key.value").alias("_value"))
    small = active.limit(broadcast_rows + 1).count() <= broadcast_rows
    during = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    same = (F.col("_scope") == F.col("scope")) & (F.lower("_value") == F.col("value"))
    if small:
        hits = exploded.join(F.broadcast(active), same & during)
    else:
        hits = _long_list(exploded.withColumn("_value", F.lower("_value")), active, during, broadcast_rows)
    rank = F.struct(F.length("value").alias("n"), F.col("scope"), F.col("list_name"), F.col("value"), F.col("valid_from"))
    best = hits.groupBy("_url", "_at").agg(F.max(rank).alias("_best"), F.count_distinct("list_name").alias("_lists"))
    joined = captures.join(best, (F.col(url) == F.col("_url")) & (F.col(fetched_at).cast("long") == F.col("_at")), "left")
    return joined.select(
        *captures.columns,
        host_of(F.col(url)).alias("host"),
        F.col("_best").isNotNull().alias("blocked"),
        F.coalesce("_lists", F.lit(0)).cast("long").alias("n_lists"),
        *[F.col(f"_best.{c}").alias(c) for c in ("list_name", "scope", "value", "valid_from")],
    )


def _long_list(asked: DataFrame, active: DataFrame, during: Column, broadcast_rows: int) -> DataFrame:
    """The keys of captures with the entries active ``during`` their fetch, for lists too long to be broadcast.

    Keys are counted first, combined before they are shuffled. Frequent keys that no list names (``com``) are dropped
    where they are; entries of frequent ones that are listed are broadcast as well, or, if they too are many, dealt
    out with as many salts as the key's count asks for. All others are joined by key, and none of those is hot.
    """
    active = stored(active, "active")
    asked = asked.where("_value IS NOT NULL")
    counts = stored(asked.groupBy("_scope", "_value").agg(F.count("*").alias("_n")), "keys")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    listed = active.select(F.col("scope").alias("_scope"), F.col("value").alias("_value"), F.lit(True).alias("_listed")).distinct()
    often = stored(counts.where(F.col("_n") * FREQUENT > total).join(listed, ["_scope", "_value"], "left"), "frequent")  # FREQUENT rows at most
    tagged = asked.join(F.broadcast(often), ["_scope", "_value"], "left")
    by_key = (F.col("_scope") == F.col("scope")) & (F.col("_value") == F.col("value"))
    rare = tagged.where("_n IS NULL").drop("_n", "_listed").join(active, by_key & during)
    hot = active.join(F.broadcast(often.select(F.col("_scope").alias("_s"), F.col("_value").alias("_v"), "_n")), (F.col("scope") == F.col("_s")) & (F.col("value") == F.col("_v")))
    hot = stored(hot.drop("_s", "_v"), "hot-entries")
    here = tagged.where("_listed")
    if hot.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rare.unionByName(here.drop("_n", "_listed").join(F.broadcast(hot.drop("_n")), by_key & during))
    salts = F.ceil(F.col("_n") * FREQUENT / F.lit(max(total, 1))).cast("int")
    salted = hot.withColumn("_salt", F.explode(F.sequence(F.lit(1), salts))).drop("_n")
    spread = here.withColumn("_own", (F.pmod(F.xxhash64("_url", "_at"), salts) + 1).cast("int")).drop("_n", "_listed")
    return rare.unionByName(spread.join(salted, by_key & during & (F.col("_own") == F.col("_salt"))).drop("_own", "_salt"))


def op5_temporal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = F.lit(FIRST_FETCH).cast("long") + F.pmod(F.col("page_id") * F.lit(FETCH_STEP), F.lit(FETCH_SPAN))
    captures = read_table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("list_name", "scope", "value", "action", "at"), x, strict=True)]) for x in LISTS]
    return filter_urls(captures, spark.range(1).select(F.inline(F.array(*rows))))


_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e})" for a, b, c, d, e in LISTS)
OP5_SQL = rf"""
WITH events(list_name, scope, value, action, day) AS (VALUES {_VALUES}),
one AS (SELECT list_name, scope, value, day, max(action) AS action FROM events GROUP BY ALL),
spans AS (SELECT list_name, scope, value, action, day AS valid_from, lead(day) OVER (PARTITION BY list_name, scope, value ORDER BY day) AS valid_to FROM one),
active AS (SELECT * FROM spans WHERE action = 'add'),
captures AS (SELECT page_id, url, CAST({FIRST_FETCH} + (page_id * {FETCH_STEP}) % {FETCH_SPAN} AS BIGINT) AS fetched_at,
    regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', '') AS host,
    list_filter(string_split(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^?#]*)', 1), '/'), lambda s: s <> '') AS segments FROM pages),
hits AS (SELECT c.page_id, a.list_name, a.scope, a.value, a.valid_from FROM captures c JOIN active a
    ON c.fetched_at >= a.valid_from AND (a.valid_to IS NULL OR c.fetched_at < a.valid_to) AND
    CASE WHEN a.scope = 'domain' THEN c.host = a.value OR c.host LIKE '%.' || a.value
         ELSE starts_with(lower(c.host || '/' || array_to_string(c.segments, '/')) || '/', a.value || '/') END),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(value) DESC, scope DESC, list_name DESC, value DESC, valid_from DESC) AS place FROM hits),
lists AS (SELECT page_id, count(DISTINCT list_name) AS n FROM hits GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_at, c.host, r.page_id IS NOT NULL AS blocked, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lists,
    r.list_name, r.scope, r.value, CAST(r.valid_from AS BIGINT) AS valid_from
FROM captures c LEFT JOIN ranked r ON r.page_id = c.page_id AND r.place = 1 LEFT JOIN lists l ON l.page_id = c.page_id
"""
