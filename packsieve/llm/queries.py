"""The queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsieve.llm import exact_dedup, html_text, language_id, lexical, mixing, nearest, packing, recurrent, resampling, scratch, seekable, shards, simhash, url_lists


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_pages(spark, sf_dir)).withColumn("n_chars", F.length("text").cast("long"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, read through the manifest after eight arrivals and their compactions."""
    store = shards.Store(spark, scratch.new_path(spark, "store"))
    shards.arrive(_documents(spark, sf_dir), store)
    return store.read().select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find(_documents(spark, sf_dir), {"text_sha256": exact_dedup.text_sha256(F.col("text"))})


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(_documents(spark, sf_dir), similarity=None).select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch day (page_id counts days of 2024) against two lists of their hosts and host sections.

    The tables hold no list, so entries are derived from the pages' hosts and
    paths by md5: which are listed, when they were added, removed, added again.
    """
    pages = _pages(spark, sf_dir)
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 366) as int))").alias("day"))
    h, p = url_lists.host(F.col("url")), url_lists.path(F.col("url"))
    section = F.concat(h, F.lit("/"), F.element_at(F.filter(F.split(p, "/"), lambda s: s != ""), 1))
    names = pages.select(F.explode(F.array(h, F.when(F.length(p) > 1, section))).alias("pattern")).where("pattern <> ''").distinct()
    m = F.md5(F.col("pattern").cast("binary"))
    number = lambda at: F.conv(F.substring(m, at, 4), 16, 10).cast("int")
    added, removed, again = number(1) % 366, number(5) % 366, number(9) % 366
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    name = F.when(number(13) % 2 == 0, "spam").otherwise("adult")
    event = lambda n, action: F.struct(day(n).alias("day"), F.lit(action).alias("action"))
    events = names.where(number(17) % 3 > 0).select(
        name.alias("list"), "pattern", F.explode(F.array(event(added, "add"), event(removed, "remove"), event(again, "add"))).alias("e")
    ).select("list", "pattern", "e.day", "e.action")
    return url_lists.evaluate(captures, events)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_documents(spark, sf_dir))


def op10_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seekable.round_trip(_documents(spark, sf_dir))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op13_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.score(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_html, op3_sharding, op4_exact_dedup, op5_language_id, op6_simhash, op7_nearest, op8_url_lists, op9_mixing, op10_seekable, op11_resampling, op12_lexical, op13_recurrent)}


#: Features of texts, their CRC-32 from a table that the polynomial gives, and the draw, step by step.
_RESAMPLING_SQL = """
    WITH RECURSIVE fold(i, x, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM fold WHERE k < 8),
    crc AS (SELECT list(x ORDER BY i) AS step FROM fold WHERE k = 8),
    texts AS (SELECT 'd' AS side, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        UNION ALL SELECT 'b', row_number() OVER (), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
    said AS (SELECT side, id, coalesce(regexp_extract_all(t, '[0-9a-z\\x{80}-\\x{10FFFF}]+'), []) AS w FROM texts),
    runs AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM said),
    n AS (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL),
    bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
    bucket AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, step[xor(c & 255, b) + 1]::BIGINT)), 4294967295::BIGINT) % 10000 AS bucket FROM bytes, crc),
    sums AS (SELECT b AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
        FROM range(10000) r(b) LEFT JOIN (SELECT * FROM n JOIN bucket USING (f)) x ON x.bucket = b GROUP BY 1),
    gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS g FROM sums),
    weight AS (SELECT id, sum(n) AS n_features, sum(n * g) AS weight FROM n JOIN bucket USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
    scored AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM said LEFT JOIN weight USING (id) WHERE side = 'd'),
    ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
    SELECT s.doc_id, n_features, weight, score, r AS rank FROM scored s LEFT JOIN (SELECT * FROM ranks WHERE r <= 5 * n // 100) k ON s.doc_id = k.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_resampling": _RESAMPLING_SQL,
        "op12_lexical": """
            WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM documents),
            q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
            n AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY 1),
            total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
            p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
            w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY term, docs),
            m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM n, total),
            s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
            r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
            SELECT * FROM r WHERE rank <= 10""",
        "op3_sharding": "SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM documents",
        "op4_exact_dedup": """
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)""",
        "op8_url_lists": """
            WITH c AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS day,
                lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h,
                list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS seg FROM pages),
            names AS (SELECT DISTINCT pattern FROM (SELECT h AS pattern FROM c UNION ALL SELECT h || '/' || seg[1] FROM c WHERE len(seg) >= 1) WHERE pattern IS NOT NULL AND pattern <> ''),
            k AS (SELECT pattern, md5(pattern) AS m FROM names),
            num AS (SELECT pattern, ('0x' || m[1:4])::INT % 366 AS a, ('0x' || m[5:8])::INT % 366 AS r, ('0x' || m[9:12])::INT % 366 AS b,
                CASE WHEN ('0x' || m[13:16])::INT % 2 = 0 THEN 'spam' ELSE 'adult' END AS list FROM k WHERE ('0x' || m[17:20])::INT % 3 > 0),
            ev AS (SELECT list, pattern, a AS d, TRUE AS add_ FROM num UNION ALL SELECT list, pattern, r, FALSE FROM num UNION ALL SELECT list, pattern, b, TRUE FROM num),
            days AS (SELECT list, pattern, d, bool_and(add_) AS active FROM ev GROUP BY ALL),
            iv AS (SELECT list, pattern, d AS lo, coalesce(lead(d) OVER (PARTITION BY list, pattern ORDER BY d), 100000) AS hi, active FROM days),
            caps AS (SELECT *, date_diff('day', DATE '2024-01-01', day) AS n FROM c),
            pat AS (SELECT page_id, url, day, n, h AS own, unnest(list_concat(
                list_transform(range(1, len(string_split(h, '.')) + 1), lambda i: array_to_string(string_split(h, '.')[i:], '.')),
                CASE WHEN len(seg) >= 1 THEN [h || '/' || seg[1]] ELSE [] END, CASE WHEN len(seg) >= 2 THEN [h || '/' || seg[1] || '/' || seg[2]] ELSE [] END)) AS pattern FROM caps WHERE h <> ''),
            met AS (SELECT page_id, url, count(*) AS matches, min_by(iv.pattern, {'n': -length(iv.pattern), 'p': iv.pattern}) AS pattern
                FROM pat JOIN iv ON pat.pattern = iv.pattern AND iv.active AND n >= lo AND n < hi GROUP BY ALL)
            SELECT c.page_id, c.url, c.day, coalesce(matches, 0) AS matches, matches IS NOT NULL AS blocked, met.pattern
            FROM c LEFT JOIN met ON c.page_id = met.page_id AND c.url IS NOT DISTINCT FROM met.url""",
    }
