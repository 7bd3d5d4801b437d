"""Lexical retrieval of fields and examples by shared words.

Fields and queries meet on words, so only pairs that share a word (or a protocol, or
a token that stands for a word) are ever scored, in the task that has the field. Ranking uses
``row_number <= k``, which Spark limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packsieve.functions import text

# Weights of a shared word, of an abbreviated word and of the protocol; registrations that a name may have.
EXACT, ABBREVIATED, PROTOCOL, REGISTRATIONS = 4, 2, 4, 64
# Limits of one request.
LIMITS = {"items": 128, "top_k": 32, "query_bytes": 4096, "query_tokens": 64, "item_id_bytes": 256, "context_bytes": 32 * 1024}
# Examples of a request, and words of the request frame, which say nothing about an example.
FEW_SHOT = 8
FRAME_WORDS = "all filter find for give i keep list me need only packets show that the which".split()
# The shortest acronym, and what a capital letter is.
SHORTEST, CAPITAL = 3, r"\p{IsUppercase}"
#: Words of the queries (as rows) up to which they are sent to every executor, about 40 bytes each.
BROADCAST_WORDS = 1_000_000
#: Pairs of a query and an example that a task counts at most, about 150 bytes each.
TASK_PAIRS = 1_000_000


def request_code(items: Column, top_k: Column, context_bytes: Column) -> Column:
    """The code by which a request's own limits refuse it, or null."""
    return (
        F.when((items < 1) | (items > LIMITS["items"]), "too_many_items").when((top_k < 1) | (top_k > LIMITS["top_k"]), "top_k_out_of_range")
        .when(context_bytes > LIMITS["context_bytes"], "context_too_large")
    )


def resolved(registrations: DataFrame) -> DataFrame:
    """One field per name: at most 64 registrations, all valid, of one type; the smallest (protocol, display) stands for it.

    ``registrations``: name, kind, protocol, display, valid.
    """
    return (
        registrations.groupBy("name")
        .agg(F.count("*").alias("n"), F.bool_and("valid").alias("ok"), F.count_distinct("kind").alias("kinds"), F.min(F.struct("protocol", "display", "kind")).alias("f"))
        .where((F.col("n") <= REGISTRATIONS) & F.col("ok") & (F.col("kinds") == 1)).select("name", "f.kind", "f.protocol", "f.display")
    )


def protocol_words(intent: Column) -> Column:
    """The words of a request that may name a protocol: those with two capitals, or all where the text has no capital."""
    found = F.regexp_extract_all(intent, F.lit(text.WORD), F.lit(0))
    cased = intent.rlike(CAPITAL)
    return F.array_distinct(F.transform(F.filter(found, lambda w: ~cased | (F.regexp_count(w, F.lit(CAPITAL)) >= 2)), F.lower))


def acronyms(protocols: DataFrame) -> DataFrame:
    """(word, protocol): the inverted index from the initials of display names, of three characters or more. ``protocols``: name, display."""
    rows = protocols.select(text.initials(text.unicode_words(F.col("display"))).alias("word"), F.lower("name").alias("protocol"))
    return rows.where(F.length("word") >= SHORTEST).distinct()


def selected_protocols(queries: DataFrame, protocols: DataFrame) -> DataFrame:
    """Per query (item_id, intent) the array ``protocols``: the words that may name one, and the protocols whose acronym such a word is."""
    words = queries.select("item_id", F.explode(protocol_words(F.col("intent"))).alias("word"))
    by_acronym = words.join(acronyms(protocols), "word").groupBy("item_id").agg(F.collect_set("protocol").alias("_more"))
    own = queries.select("item_id", protocol_words(F.col("intent")).alias("_own"))
    return own.join(by_acronym, "item_id", "left").select("item_id", F.array_union("_own", F.coalesce("_more", F.array().cast("array<string>"))).alias("protocols"))


def refused(queries: DataFrame, item: str = "item_id", intent: str = "intent") -> DataFrame:
    """Each query with the code by which its limits refuse it, or null."""
    tokens = F.size(text.unicode_words(F.col(intent)))
    code = (
        F.when(F.octet_length(item) > LIMITS["item_id_bytes"], "item_id_too_long").when(F.octet_length(intent) > LIMITS["query_bytes"], "query_too_long")
        .when(tokens > LIMITS["query_tokens"], "query_too_many_tokens").when(tokens == 0, "query_empty")
    )
    return queries.withColumn("code", code)


def scored(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """(item_id, name, score) of every pair that shares something.

    ``queries``: item_id, words array, protocols array, lexemes array.
    ``fields``: name, kind, protocol, display. Queries of the same words are scored once.
    """
    alike, same = _alike(queries)
    return _scored(alike, fields).withColumnRenamed("item_id", "_first").join(same, "_first").select("item_id", "name", "score")


def best(queries: DataFrame, fields: DataFrame, k: int) -> DataFrame:
    """(item_id, name, score, rank) of each query's k best fields, ties by name; tables as for ``scored``.

    Queries of the same words are ranked once: only the k that stay are told to each of them.
    """
    alike, same = _alike(queries)
    return top_fields(_scored(alike, fields), k).withColumnRenamed("item_id", "_first").join(same, "_first").select("item_id", "name", "score", "rank")


def _alike(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queries whose words no smaller item_id has, and for each item_id which of them (``_first``) stands for it."""
    keys = ["words", "protocols", "lexemes"]
    asked = queries.select("item_id", *[F.array_sort(F.array_distinct(c)).alias(c) for c in keys])
    alike = asked.groupBy(*keys).agg(F.min("item_id").alias("_first"))
    return alike.withColumnRenamed("_first", "item_id"), asked.join(alike, keys).select("item_id", "_first")


def _scored(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """The fields are dealt by name and the queries' words sent to them while there are at most ``BROADCAST_WORDS``, so no word
    is a key of a shuffle: a pair is found, told once and scored in the task that has the field. More queries meet the fields in a join on words.
    """
    f = fields.select(
        "name", F.lower("protocol").alias("protocol"), F.array_distinct(text.unicode_words(F.col("name"))).alias("abbr"), F.array_distinct(text.unicode_words(F.col("display"))).alias("disp")
    )
    marked = lambda kind, words: F.transform(words, lambda w: F.concat(F.lit(kind), w))
    # which short tokens of names stand for which long words of queries
    tokens = f.select(F.explode("abbr").alias("token")).where(F.length("token") >= 3).distinct().withColumn("first", F.substr("token", F.lit(1), F.lit(1)))
    words = queries.select("item_id", F.explode(F.array_distinct("words")).alias("word"))
    long_words = words.select("word").distinct().where((F.length("word") > 3) & (F.length("word") <= 32)).withColumn("first", F.substr("word", F.lit(1), F.lit(1)))
    expansions = long_words.join(tokens, "first").where(text.abbreviates(F.col("token"), F.col("word"))).groupBy("word").agg(F.collect_list("token").alias("tokens"))
    short = words.join(expansions, "word").groupBy("item_id").agg(F.collect_list(F.struct("word", "tokens")).alias("short"))
    q = queries.join(short, "item_id", "left").select("item_id", "words", "protocols", "lexemes", F.coalesce("short", F.array().cast("array<struct<word:string,tokens:array<string>>>")).alias("short"))
    # a query and a field meet on a word, on a token that stands for a word, or on a protocol
    asks = F.concat(marked("w", F.array_distinct("words")), marked("t", F.array_distinct(F.flatten(F.transform("short", lambda e: e["tokens"])))), marked("p", F.array_distinct("protocols")))
    keys = q.select("item_id", F.explode(asks).alias("key"))
    few = keys.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    holds = F.concat(marked("w", F.array_union("abbr", "disp")), marked("t", F.filter("abbr", lambda t: F.length(t) >= 3)), F.array(F.concat(F.lit("p"), F.coalesce("protocol", F.lit("")))))
    met, own = f.repartition("name").select("*", F.explode(holds).alias("key")), [F.first(c).alias(c) for c in ("protocol", "abbr", "disp")]
    if few:  # a field's queries are one array, at most all of them
        postings = F.broadcast(keys.groupBy("key").agg(F.collect_list("item_id").alias("items")))
        asked = met.join(postings, "key").groupBy("name").agg(*own, F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        pairs = asked.select("name", "protocol", "abbr", "disp", F.explode("items").alias("item_id")).join(F.broadcast(q), "item_id")
    else:
        pairs = met.join(keys, "key").groupBy("name", "item_id").agg(*own).join(q, "item_id")
    exact = F.array_intersect("words", F.array_union("abbr", "disp"))
    named = F.coalesce(F.array_contains("protocols", F.col("protocol")), F.lit(False))
    found = pairs.withColumn("_exact", exact).withColumn("_short", F.filter("short", lambda e: F.arrays_overlap(e["tokens"], F.col("abbr"))))
    other = F.size(F.filter("_short", lambda e: ~F.array_contains("_exact", e["word"])))
    raw = EXACT * F.size("_exact") + ABBREVIATED * other + F.when(named, PROTOCOL).otherwise(0)
    covers = F.concat(F.col("_exact"), F.flatten(F.transform("_short", lambda e: e["tokens"])), F.when(named, F.array("protocol")).otherwise(F.array().cast("array<string>")))
    name = F.lower("name")
    return found.select(
        "item_id", "name", text.lexical_score(raw, F.size(F.array_except("abbr", covers)), name.contains(".") & F.array_contains("lexemes", name)).alias("score")
    )


def top(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k of each group with their rank."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_fields(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each item, ties by name; a name stands for one field, whose columns are joined to the few that stay."""
    return top(rows, ["item_id"], [F.desc("score"), F.asc("name")], k)


def within_bytes(ranked: DataFrame, group: Sequence[str], bytes_: Column, most: int) -> DataFrame:
    """The best-first prefix whose serialised list fits: two brackets, a comma between elements."""
    w = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("bytes", F.lit(1) + F.sum(bytes_.cast("long") + 1).over(w)).where(F.col("bytes") <= most)


def recall(ranked: DataFrame, gold: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per k: items with all gold fields found, macro and micro recall. ``gold``: item_id, name, each once."""
    hits = gold.join(ranked.select("item_id", "name", "rank"), ["item_id", "name"], "left")
    per_item = hits.groupBy("item_id").agg(F.count("*").alias("gold"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    wide = per_item.agg(
        F.count("*").alias("items"), F.sum("gold").alias("gold"),
        *[a for k in ks for a in (F.count_if(F.col(f"h{k}") == F.col("gold")).alias(f"all{k}"), F.avg(F.col(f"h{k}") / F.col("gold")).alias(f"macro{k}"), F.sum(f"h{k}").alias(f"micro{k}"))],
    )
    rows = [F.struct(F.lit(k).alias("k"), F.col(f"all{k}").alias("all_found"), F.col(f"macro{k}").alias("macro"), (F.col(f"micro{k}") / F.col("gold")).alias("micro")) for k in ks]
    return wide.select("items", F.inline(F.array(*rows)))


def content_words(c: Column) -> Column:
    """The different words of a text without those of the request frame."""
    return F.array_except(F.coalesce(text.ascii_words(c), F.array().cast("array<string>")), F.array(*map(F.lit, FRAME_WORDS)))


def examples(queries: DataFrame, pool: DataFrame, k: int = FEW_SHOT) -> DataFrame:
    """Per query the k pool rows with most shared words, then fewest others, then smallest id; best last in ``shown``.

    Both tables: id and words (``content_words``). Rows that share words meet on
    them; the pool is dealt by row first, so a common word is no hot key, a pair is
    counted where its row lies and only the best k of each task are shuffled. Where
    fewer than k rows share a word with a query, those of the fewest words follow:
    they are among the 2 k smallest rows of the pool, whatever the query. A pool of
    fewer than k rows is refused.
    """
    smallest = pool.select(F.col("id").alias("example_id"), "words", F.size("words").alias("_n")).orderBy("_n", "example_id").limit(2 * k).collect()
    if len(smallest) < k:
        raise ValueError(f"pool_too_small: the pool cannot supply {k} examples")
    q = queries.select(F.col("id").alias("query_id"), F.explode("words").alias("word"))
    if q.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        q = F.broadcast(q)
    # nearly every pair may share a word: the tasks' number is that of the pairs, which Spark can't tell from the bytes of the pool
    spark = pool.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pool.count() * queries.count() // TASK_PAIRS))
    p = pool.repartition(tasks, "id").select(F.col("id").alias("example_id"), F.explode("words").alias("word"), F.size("words").alias("_n"))
    pairs = q.join(p, "word").groupBy("query_id", "example_id").agg(F.count("*").alias("shared"), (F.first("_n") - F.count("*")).alias("extra"))
    kinds = dict(pool.select(F.col("id").alias("example_id"), "words").dtypes)
    rest = F.array(*[F.struct(F.lit(r.example_id).cast(kinds["example_id"]).alias("example_id"), F.array(*map(F.lit, r.words)).cast("array<string>").alias("_w"), F.lit(r._n).alias("extra")) for r in smallest])
    nothing = (
        queries.select(F.col("id").alias("query_id"), F.col("words").alias("_q"), F.inline(rest)).where(~F.arrays_overlap("_q", "_w"))
        .select("query_id", "example_id", F.lit(0).cast("long").alias("shared"), F.col("extra").cast("long").alias("extra"))
    )
    best = top(pairs.unionByName(nothing), ["query_id"], [F.desc("shared"), F.asc("extra"), F.asc("example_id")], k)
    return best.withColumn("shown", k - F.col("rank") + 1)
