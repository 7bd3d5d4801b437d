"""Operator 8: dated URL lists, joined as they stood when a page was fetched.

List entries are events: on a day a list adds or removes a pattern. A pattern is
a host, which also covers its subdomains, or a host with the beginning of a
path, of any depth; case makes no difference, in hosts and in paths. The events of (list, pattern) become validity intervals [from, to); of
several events on a day, a removal wins. A capture is matched by the entries
that are active on its day.

Captures are reduced to distinct (host, first path segments, day) before the
join, as many segments as the deepest entry has; each explodes to the patterns that could match it (one for every parent
domain and leading path segment: bounded by the url's depth), and those are
joined on the pattern alone, salted by capture so that a host with a third of
all captures is no hot key. Intervals of one pattern are bounded by the days of
the list's history.

Edge cases: a null or odd url has no host and is allowed; a capture without a
day is allowed; events with a null pattern, list or day are ignored; repeated
events and captures change nothing but the captures' own row count; empty
tables give no matches, or no rows; further columns of the captures stay as they
are, but for those named matches, blocked or pattern, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packsieve.llm import scratch

SALTS = 16


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """The path without query and fragment, '' for none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """(list, pattern, from_day, to_day): when entries are active; to_day null while they still are.

    ``events``: list, pattern string, day date, action ('add' or 'remove').
    """
    days = (
        events.where(F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("day").isNotNull())
        .groupBy("list", F.lower("pattern").alias("pattern"), "day").agg(F.bool_and(F.col("action") == "add").alias("active"))
    )
    w = Window.partitionBy("list", "pattern").orderBy("day")
    turns = days.withColumn("before", F.lag("active", 1, False).over(w)).where(F.col("active") != F.col("before"))
    return turns.withColumn("to_day", F.lead("day").over(w)).where("active").select("list", "pattern", F.col("day").alias("from_day"), "to_day")


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def deepest(active: DataFrame) -> int:
    """Path segments of the deepest entry."""
    return active.agg(F.max(F.size(segments(F.col("pattern"))) - 1).alias("n")).first().n or 0


def patterns(h: Column, p: Column) -> Column:
    """Every pattern that covers this host and path: each parent domain, and the host with each number of leading path segments."""
    labels = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(segments(p), lambda _, i: F.concat(h, F.lit("/"), F.array_join(F.slice(segments(p), 1, i + 1), "/")))
    return F.when(h != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def head(p: Column, depth: int) -> Column:
    """The first ``depth`` segments of a path, in lower case: all that a pattern can ask of it."""
    return F.lower(F.array_join(F.slice(segments(p), 1, depth), "/"))


def evaluate(captures: DataFrame, events: DataFrame, salts: int = SALTS) -> DataFrame:
    """The captures (url, day and any other columns) with what was active on their day.

    Adds matches long (active entries), blocked boolean and pattern string: the
    longest that matched, ties to the first in order.
    """
    active = scratch.table(intervals(events), "intervals")
    added = {"_host": host(F.col("url")), "_head": head(path(F.col("url")), deepest(active))}
    rows = captures.select(scratch.whole(captures), F.col("day").alias("_day"), *[c.alias(n) for n, c in added.items()])
    asked = rows.where((F.col("_host") != "") & F.col("_day").isNotNull()).select("_host", "_head", F.col("_day").alias("day")).distinct()
    salt = F.pmod(F.xxhash64("_host", "_head", "day"), F.lit(salts)).cast("int")
    exploded = asked.withColumn("_salt", salt).withColumn("pattern", F.explode(patterns(F.col("_host"), F.col("_head"))))
    active = active.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = exploded.join(active, ["pattern", "_salt"]).where((F.col("day") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("day") < F.col("to_day"))))
    best = F.min(F.struct((-F.length("pattern")).alias("n"), F.col("pattern").alias("pattern")))["pattern"]
    verdict = met.groupBy("_host", "_head", F.col("day").alias("_day")).agg(F.count("*").alias("matches"), best.alias("pattern"))
    # one verdict for each (host, head, day); captures of a host and day, and of one url, are dealt by salt
    verdict = verdict.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    out = rows.join(verdict, ["_host", "_head", "_day", "_salt"], "left")
    added = {"matches": F.coalesce("matches", F.lit(0)).cast("long"), "blocked": F.col("matches").isNotNull(), "pattern": F.col("pattern")}
    # what is added takes the place of a column of that name
    return out.select(*[F.col(f"_doc.`{c}`").alias(c) for c in captures.columns if c.lower() not in added], *[c.alias(n) for n, c in added.items()])
