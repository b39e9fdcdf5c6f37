"""URL filters by a temporal list join (operator 1), in DataFrame functions only.

A list is dated entries (key, action, since): a key is a host suffix ("example.org" covers its subdomains) or a host
with a leading path ("example.org/ads"); an entry holds until the next entry of its key. The entries become validity
intervals [since, until) by a lead over their key. Each capture gives its candidate keys (host suffixes and path
prefixes, of all lengths that the list has) and is joined, as of its fetch time, to the entry that was active then: an equality join on the key and the
interval's month, so that a host with a third of all captures, or a key with a long history, is spread over months
(and skewed joins split at run time), and no capture meets more than one entry of a key. Of the active entries of a
capture the most specific decides: the longest key, then block before allow. Captures without an active entry pass.

Nulls: a null or unparsable url has no host, no key and passes; a null fetch time matches nothing. Entries with a null
key, action or date are ignored. Of entries of one key and instant, block wins. Repeated entries count once, repeated
captures come out repeated; the verdict depends on url and fetch time alone, so equal ones are decided once. Extra columns of captures are kept, unless they are named
like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: All times up to the first and from the last of these months on share one key of the join.
FIRST_MONTH, LAST_MONTH = 1990 * 12, 2100 * 12 + 1
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"
RESULTS = ("host", "matched_key", "action", "since", "allowed")


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user, port and a trailing dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def keys_of(url: Column, host: Column, labels: list[int] | None = None, segments: list[int] | None = None) -> Column:
    """The keys that may cover a URL: all host suffixes, and the host with leading path segments; of the given numbers of labels and segments alone, if any are given."""
    parts = F.split(host, r"\.")
    steps = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")

    def numbers(given: list[int] | None, most: Column) -> Column:
        if given is None:
            return F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.array(*map(F.lit, given)).cast("array<int>"), lambda k: k <= most)

    suffixes = F.transform(numbers(labels, F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    paths = F.transform(numbers(segments, F.size(steps)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, k), "/")))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.concat(suffixes, paths))


def lengths(spans: DataFrame) -> tuple[list[int], list[int]]:
    """The numbers of labels of the keys without a path, and of segments of those with one."""
    slash = F.instr("key", "/")
    labels = F.when(slash == 0, F.size(F.split("key", r"\.")))
    segments = F.when(slash > 0, F.size(F.split("key", "/")) - 1)
    found = spans.agg(F.collect_set(labels), F.collect_set(segments)).first()
    return sorted(found[0]), sorted(found[1])


def _key(key: Column) -> Column:
    """A key with its host in lower case, as captures have it; paths tell case apart."""
    return F.concat(F.lower(F.substring_index(key, "/", 1)), F.regexp_extract(key, r"^[^/]*((?s:/.*)?)$", 1))


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, since, until: entries (key, action, since) as validity intervals; until is null for the last."""
    clean = entries.where("key IS NOT NULL AND action IS NOT NULL AND since IS NOT NULL").select(_key(F.col("key")).alias("key"), "action", "since")
    at = clean.groupBy("key", "since").agg(F.max("action").alias("action"))  # 'block' > 'allow'
    return at.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since")))


def _month(at: Column) -> Column:
    return F.greatest(F.least(F.year(at) * 12 + F.month(at), F.lit(LAST_MONTH)), F.lit(FIRST_MONTH))


def filtered(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with host, matched_key, action, since and allowed."""
    keep = [c for c in captures.columns if c.lower() not in RESULTS]
    base = captures.select(*(F.col(f"`{c}`") for c in keep), host_of(F.col(url)).alias("host"), F.col(url).alias("__of"), F.col(fetched).alias("__fetched"))
    asks = captures.select(F.col(url).alias("__url"), F.col(fetched).alias("__at")).where("__url IS NOT NULL AND __at IS NOT NULL").distinct()
    spans = intervals(entries)
    labels, segments = lengths(spans)
    # intervals are dealt over the months that the captures have, however long they last
    low, high = captures.select(_month(F.col(fetched)).alias("m")).agg(F.min("m"), F.max("m")).first()
    from_, to = F.greatest(_month(F.col("since")), F.lit(low or FIRST_MONTH)), F.least(F.coalesce(_month(F.col("until")), F.lit(LAST_MONTH)), F.lit(high or FIRST_MONTH))
    spans = spans.where(from_ <= to).withColumn("month", F.explode(F.sequence(from_, to)))
    asked = asks.withColumn("key", F.explode(keys_of(F.col("__url"), host_of(F.col("__url")), labels, segments))).withColumn("month", _month(F.col("__at")))
    hit = (
        asked.join(spans, ["key", "month"])
        .where((F.col("__at") >= F.col("since")) & (F.col("until").isNull() | (F.col("__at") < F.col("until"))))
        .groupBy("__url", "__at")
        .agg(F.max(F.struct(F.length("key").alias("n"), F.col("action"), F.col("key"), F.col("since"))).alias("__hit"))
    )
    out = base.join(hit, (F.col("__of") == F.col("__url")) & (F.col("__fetched") == F.col("__at")), "left")
    return out.select(
        *(F.col(f"`{c}`") for c in keep),
        "host",
        F.col("__hit.key").alias("matched_key"),
        F.col("__hit.action").alias("action"),
        F.col("__hit.since").alias("since"),
        (F.coalesce(F.col("__hit.action"), F.lit("allow")) != "block").alias("allowed"),
    )
