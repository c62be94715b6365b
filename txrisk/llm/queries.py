"""Queries over the test tables, one per operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from txrisk.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run
    return deco


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_register("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    from txrisk.llm.toxicity import score_toxicity
    return score_toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_register("op2_quality_perplexity")
def op2_quality_perplexity(spark, sf_dir):
    from txrisk.llm.perplexity import judge_quality
    return judge_quality(_docs(spark, sf_dir))


@_register("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    from txrisk.llm.token_counts import count_tokens
    return count_tokens(_docs(spark, sf_dir))


@_register("op4_hilbert_shards")
def op4_hilbert_shards(spark, sf_dir):
    from txrisk.llm.hilbert_shards import shard_rows
    return shard_rows(_docs(spark, sf_dir))


@_register("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir):
    from txrisk.llm.best_fit import pack_documents
    return pack_documents(_docs(spark, sf_dir))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@_register("op6_exact_dedup", OP6_SQL)
def op6_exact_dedup(spark, sf_dir):
    from txrisk.llm.exact_dedup import exact_groups
    return exact_groups(_docs(spark, sf_dir))


# The test tables hold no lists and no fetch times: both are derived from the
# pages.  FIXED VALUES of that derivation, the same in Spark and DuckDB.
OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_seconds((page_id * 7919) % 31622400) AS fetched_at,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'),
                     lambda x: x <> '') AS parts FROM pages),
d AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS domain FROM p),
u AS (SELECT domain, CAST('0x' || substr(md5(domain), 1, 6) AS BIGINT) AS u FROM d),
ev AS (
  SELECT 'hosts' AS list, domain AS pattern, u % 200 AS day, 'add' AS action FROM u WHERE u % 3 = 0
  UNION ALL SELECT 'hosts', domain, u % 200 + 20 + u % 90, 'remove' FROM u WHERE u % 3 = 0
  UNION ALL SELECT 'hosts', domain, 330, 'add' FROM u WHERE u % 6 = 0
  UNION ALL SELECT 'spam', domain, 0, 'add' FROM u WHERE regexp_matches(domain, 'pills|adult|casino')
  UNION ALL SELECT 'paths', domain || '/es', 100, 'add' FROM u),
e AS (SELECT list, pattern, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INTEGER)) AS ts, max(action = 'add') AS on_
      FROM ev GROUP BY ALL),
v AS (SELECT * FROM (SELECT list, pattern, ts AS valid_from, on_,
        lead(ts) OVER (PARTITION BY list, pattern ORDER BY ts) AS valid_to FROM e) WHERE on_),
k AS (SELECT DISTINCT page_id, fetched_at, unnest(list_concat(
        list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
        list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS pattern
      FROM p WHERE host <> ''),
m AS (SELECT k.page_id, v.*, count(*) OVER (PARTITION BY k.page_id) AS n_active, row_number() OVER (
        PARTITION BY k.page_id ORDER BY -length(v.pattern), list, v.pattern, valid_from) AS r
      FROM k JOIN v ON k.pattern = v.pattern AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to))
SELECT p.page_id, p.url, p.fetched_at, m.page_id IS NOT NULL AS blocked, coalesce(m.n_active, 0) AS n_active,
       m.list, m.pattern, m.valid_from, m.valid_to
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.r = 1
"""


@_register("op7_url_lists", OP7_SQL)
def op7_url_lists(spark, sf_dir):
    from pyspark.sql import functions as F
    from txrisk.llm.url_lists import filter_captures, host_of
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    start = F.unix_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(start + (F.col("page_id") * 7919) % 31622400))
    domain = F.array_join(F.slice(F.reverse(F.split(host_of(F.col("url")), r"\.")), 1, 3), ".")
    domain = F.array_join(F.reverse(F.split(domain, r"\.")), ".")
    u = pages.select(domain.alias("domain")).where("domain IS NOT NULL").distinct().withColumn(
        "u", F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("long"))
    rows = lambda where, name, pattern, day, action: u.where(where).select(
        F.lit(name).alias("list"), F.expr(pattern).alias("pattern"),
        F.timestamp_seconds(start + F.expr(day) * 86400).alias("at"), F.lit(action).alias("action"))
    entries = (rows("u % 3 = 0", "hosts", "domain", "u % 200", "add")
               .union(rows("u % 3 = 0", "hosts", "domain", "u % 200 + 20 + u % 90", "remove"))
               .union(rows("u % 6 = 0", "hosts", "domain", "330", "add"))
               .union(rows("domain RLIKE 'pills|adult|casino'", "spam", "domain", "0", "add"))
               .union(rows("true", "paths", "domain || '/es'", "100", "add")))
    return filter_captures(captures, entries)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 1) + 1),
        lambda i: array_to_string(ws[i:i + 2], ' '))) AS sh FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, coalesce(min(r.other), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""


@_register("op8_jaccard_join", OP8_SQL)
def op8_jaccard_join(spark, sf_dir):
    from txrisk.llm.jaccard_join import similar_components
    return similar_components(_docs(spark, sf_dir))


@_register("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir):
    from txrisk.llm.bpe_tree import round_trip
    return round_trip(_docs(spark, sf_dir))


@_register("op10_surrogates")
def op10_surrogates(spark, sf_dir):
    from txrisk.llm.surrogates import replace_entities
    return replace_entities(_docs(spark, sf_dir)).select("doc_id", "text", "n_entities")


@_register("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    from pyspark.sql import functions as F
    from txrisk.llm.periodic_runs import periodic_runs, run_digest, stuttered
    docs = _docs(spark, sf_dir)
    return run_digest(periodic_runs(docs.select("doc_id", stuttered(F.col("doc_id"), F.col("text")).alias("text"))))


@_register("op12_simhash_near_duplicates")
def op12_simhash_near_duplicates(spark, sf_dir):
    from txrisk.llm.simhash_trees import simhash_components
    return simhash_components(_docs(spark, sf_dir))


@_register("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    from txrisk.llm.conversation_repair import damaged, repair_conversations
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), damaged)


@_register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
