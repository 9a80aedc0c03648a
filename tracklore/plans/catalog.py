"""Queries over the driver's tables, each with the DuckDB SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.functions import arrays as A
from tracklore.functions import text as X
from tracklore.operators import calibration, candidates, evaluation, features, labels, losses, metrics, scoring, simulate, splits, state, stats
from tracklore.plans import base as B
from tracklore.session import shared_folder
from tracklore.sources import convert, schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


OS, OR, ES = B.ORDER_STEPS, B.ORDER_RUNS, B.EVENT_STEPS
SD = B.SCORED_DOCS
HASH = "('0x' || substr(sha1({}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def h01(seed: str, *keys: str) -> str:
    return HASH.format("concat_ws(':', '" + seed + "', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")")


# ------------------------------------------------------------------------------------------------ segmentation, prefixes

SEG = """WITH m AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seg FROM conversations),
s AS (SELECT conv_id, seg, max(CASE WHEN role = 'assistant' THEN 'say: ' || text END) AS action, coalesce(string_agg(CASE WHEN role <> 'assistant' THEN 'user: ' || text END, chr(10) ORDER BY turn), '') AS observation
      FROM m WHERE seg > 0 GROUP BY conv_id, seg)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = convert.turn_segments(B.table(spark, sf_dir, "conversations"), "conv_id", "turn").where("seg > 0")
    said = F.max(F.when(F.col("role") == "assistant", F.concat(F.lit("say: "), "text")))
    seen = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "assistant", F.struct("turn", "text")))), lambda x: F.concat(F.lit("user: "), x["text"])), "\n")
    return m.groupBy("conv_id", "seg").agg(said.alias("action"), seen.alias("observation"))


@query("turn_segments", SEG + " SELECT conv_id, CAST(seg AS BIGINT) AS seg, action, observation FROM s")
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@query("prefix_labels", SEG + """, n AS (SELECT conv_id, count(*) AS n FROM s GROUP BY conv_id)
SELECT conv_id, CAST(seg AS INTEGER) AS prefix_len, CAST(n AS INTEGER) AS n_steps, round_even(seg / n, 4) AS prefix_frac,
 CASE WHEN greatest(1, n - seg) <= 5 THEN 0 WHEN greatest(1, n - seg) <= 15 THEN 1 WHEN greatest(1, n - seg) <= 40 THEN 2 ELSE 3 END AS steps_left FROM s JOIN n USING (conv_id)""")
def prefix_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: conversations to steps, every prefix, and how far each is from the end."""
    runs = _segments(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "action", "observation"))).alias("steps"))
    p = labels.expand_prefixes(runs)
    return p.select("conv_id", "prefix_len", "n_steps", "prefix_frac", labels.steps_left_bin(F.col("n_steps") - F.col("prefix_len")).alias("steps_left"))


@query("alternating_convert", """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, CASE WHEN len(r) = 2 AND r[1] = 'system' AND r[2] = 'user' THEN 'empty' WHEN len(r) < 3 OR r[1] <> 'system' OR r[2] <> 'user' THEN 'unexpected message prefix'
 WHEN len(list_filter(range(3, len(r) + 1), lambda i: r[i] <> CASE WHEN i % 2 = 1 THEN 'assistant' ELSE 'user' END)) > 0 THEN 'roles do not alternate' END AS skip_reason, len(r) AS n FROM c)
SELECT conv_id, skip_reason, CAST(CASE WHEN skip_reason IS NULL THEN (n - 1) // 2 END AS INTEGER) AS n_steps FROM k""")
def alternating_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "conversations")
    m = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role")).alias("role"), "text")))
    raw = c.groupBy("conv_id").agg(m.alias("trajectory")).select(
        F.col("conv_id").alias("row_index"), F.lit("").alias("shard"), F.lit("owner__repo-1").alias("instance_id"), F.lit("m").alias("model_name"), F.lit(True).alias("target"), "trajectory", F.lit("").alias("exit_status"), F.lit("").alias("generated_patch")
    )
    out = convert.alternating(raw)
    return out.select(F.element_at(F.split("traj_id", "/"), -1).cast("long").alias("conv_id"), "skip_reason", F.when(F.col("steps").isNotNull(), F.size("steps")).alias("n_steps"))


@query("skip_counts", """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT CASE WHEN len(r) = 2 AND r[1] = 'system' AND r[2] = 'user' THEN 'empty' WHEN len(r) < 3 OR r[1] <> 'system' OR r[2] <> 'user' THEN 'unexpected message prefix'
 WHEN len(list_filter(range(3, len(r) + 1), lambda i: r[i] <> CASE WHEN i % 2 = 1 THEN 'assistant' ELSE 'user' END)) > 0 THEN 'roles do not alternate' END AS skip_reason, count(*) AS n FROM c GROUP BY 1""")
def skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.skip_counts(alternating_convert(spark, sf_dir))


@query("tool_result_lookup", """SELECT user_id, i, action, observation FROM (SELECT e.user_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS i,
 'task_tracker ' || event_type AS action, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS observation FROM events e)""")
def tool_result_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls answered by results through ids, a third of them without one."""
    e = B.table(spark, sf_dir, "events")
    call = F.struct(F.concat(F.lit("c"), "event_id").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("task_tracker").alias("name"), F.to_json(F.struct(F.col("event_type").alias("command"))).alias("arguments")).alias("function"))
    none = F.lit(None).cast("string")
    msg = lambda role, content, calls, cid: F.struct(F.lit(role).alias("role"), content.alias("content"), calls.alias("tool_calls"), none.alias("name"), cid.alias("tool_call_id"))
    no_calls = F.array(call)
    no_calls = F.slice(no_calls, 1, 0)
    ask = msg("assistant", F.lit(""), F.array(call), none)
    reply = msg("tool", F.col("value").cast("string"), no_calls, F.concat(F.lit("c"), "event_id"))
    both = F.when(F.col("event_id") % 3 == 0, F.array(ask)).otherwise(F.array(ask, reply))
    head = F.array(msg("system", F.lit("s"), no_calls, none), msg("user", F.lit("<issue_description> fix it </issue_description>"), no_calls, none))
    d = e.withColumns({"m": both, "h": head})
    raw = d.groupBy("user_id").agg(F.first("h").alias("h"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "m"))), lambda x: x["m"])).alias("m"))
    raw = raw.select(F.col("user_id").cast("string").alias("trajectory_id"), F.lit("owner__repo-1").alias("instance_id"), F.lit("owner/repo").alias("repo"), F.concat("h", "m").alias("trajectory"), F.lit("").alias("model_patch"), F.lit("").alias("exit_status"), F.lit(1).alias("resolved"), F.lit(0.0).alias("gen_tests_correct"), F.lit(0.0).alias("pred_passes_gen_tests"))
    out = convert.tool_calls(raw).select(F.element_at(F.split("traj_id", "/"), -1).cast("long").alias("user_id"), F.posexplode("steps").alias("i", "s"))
    return out.select("user_id", (F.col("i") + 1).cast("long").alias("i"), "s.action", "s.observation")


@query("prefix_lengths", """WITH n AS (SELECT l_orderkey AS run, count(*) AS n FROM lineitem GROUP BY 1)
SELECT DISTINCT run, CAST(least(greatest(1, n - 1), greatest(1, round_even(f * n, 0))) AS INTEGER) AS prefix_len FROM n, (SELECT unnest([0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS f)""")
def prefix_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("run", F.explode(labels.prefix_lengths(F.col("n"), n_random=0)).alias("prefix_len"))


# ------------------------------------------------------------------------------------------------ text functions

@query("step_text", f"""WITH st AS ({OS}), x AS (SELECT *, trim(regexp_replace(action, '\\s+', ' ', 'g')) AS norm, regexp_extract_all(action, '(?:/[\\w.\\-]+)+|[\\w.\\-]+\\.(?:py|md)\\b') AS ps FROM st),
y AS (SELECT *, CASE WHEN split_part(norm, ' ', 1) = 'str_replace_editor' THEN split_part(norm, ' ', 1) || ' ' || split_part(norm, ' ', 2) ELSE split_part(norm, ' ', 1) END AS head, array_to_string(list_sort(list_distinct(ps)), ' ') AS paths FROM x)
SELECT run, i, norm, regexp_replace(trim(head || ' ' || paths), '\\b\\d+\\b', '#', 'g') || CASE WHEN norm LIKE 'edit %' THEN ' L' || CAST(CAST(regexp_extract(norm, '^edit (\\d+)', 1) AS BIGINT) // 10 AS VARCHAR) ELSE '' END AS family,
 CAST(nullif(regexp_extract(observation, '(\\d+) passed', 1), '') AS INTEGER) AS passed, CAST(nullif(regexp_extract(observation, '(\\d+) failed', 1), '') AS INTEGER) AS failed,
 CASE WHEN observation LIKE '%ValueError%' THEN 'ValueError: bad value #' WHEN observation LIKE 'fatal:%' THEN observation END AS err,
 CASE WHEN observation = '' THEN '(no output)' WHEN observation LIKE '%passed%' THEN regexp_extract(observation, '(\\d+ passed)', 1) || ', ' || regexp_extract(observation, '(\\d+ failed)', 1) WHEN observation LIKE 'Traceback%' THEN 'Traceback (most recent call last)' WHEN observation LIKE '12:%' THEN '12: x' ELSE observation END AS summary,
 CAST(floor(len(observation) / 3.5 + 0.999) AS INTEGER) AS tokens FROM y""")
def step_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.order_steps(spark, sf_dir)
    t = X.parse_test_counts("observation")
    return s.select("run", F.col("i").cast("long").alias("i"), X.normalize_action("action").alias("norm"), X.action_family("action").alias("family"), t["passed"].alias("passed"), t["failed"].alias("failed"), X.error_signature("observation").alias("err"), X.summarize_observation("observation").alias("summary"), X.token_count("observation").alias("tokens"))


@query("text_limits", r"""SELECT doc_id, CASE WHEN len(text) <= 864 THEN text ELSE substr(text, 1, 400) || chr(10) || '... [' || CAST(len(substr(text, 401, len(text) - 800)) - len(replace(substr(text, 401, len(text) - 800), chr(10), '')) AS VARCHAR) || ' lines omitted] ...' || chr(10) || right(text, 400) END AS sliced,
 CASE WHEN floor(len(substr(text, 1, 160)) / 3.5 + 0.999) <= 20 THEN substr(text, 1, 160) ELSE regexp_replace(substr(text, 1, 67), '\s+$', '') || '...' END AS capped,
 CASE WHEN len(trim(regexp_replace(text, '\s+', ' ', 'g'))) <= 80 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 77) || '...' END AS line FROM documents""")
def text_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", X.preslice("text", 400).alias("sliced"), X.cap("text", 20).alias("capped"), X.one_line("text").alias("line"))


@query("repo_keys", "SELECT c_custkey, 'owner' || c_nationkey || '/repo' || c_custkey AS k1, 'own_' || c_nationkey || '/r' AS k2, CAST(NULL AS VARCHAR) AS k3, trim(regexp_replace(c_name || '[x]|' || c_mktsegment || ':', '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS slug, c_mktsegment AS base FROM customer")
def repo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "customer")
    n = F.col("c_nationkey").cast("string")
    return c.select("c_custkey", X.repo_key(F.concat(F.lit("https://github.com/Owner"), n, F.lit("/Repo"), "c_custkey", F.lit(".git"))).alias("k1"), X.repo_key(F.concat(F.lit("own_"), n, F.lit("__r-"), "c_custkey")).alias("k2"), X.repo_key(F.lit("no key")).alias("k3"),
                    X.slug(F.concat("c_name", F.lit("[x]|"), "c_mktsegment", F.lit(":"))).alias("slug"), X.basename(F.concat(F.lit("/a/b/"), "c_mktsegment")).alias("base"))


@query("clean_text")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", X.clean_observation("html").alias("clean"), X.collapse_padding("html").alias("collapsed"), X.truncate_middle("html", 100).alias("cut"))


# ------------------------------------------------------------------------------------------------ statistics

@query("task_baselines", f"""WITH r AS ({OR}), s AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS n_runs, CAST(sum(outcome::INT) OVER (PARTITION BY task_id) AS BIGINT) AS n_success FROM r),
p AS (SELECT policy_model, avg(outcome::INT) AS policy_rate FROM r GROUP BY 1), b AS (SELECT s.*, policy_rate, CASE WHEN n_runs - 1 >= 3 THEN (n_success - outcome::INT) / (n_runs - 1) END AS b FROM s JOIN p USING (policy_model))
SELECT run, n_runs, n_success, round(b, 6) AS baseline, round(outcome::INT - b, 6) AS advantage, round(policy_rate, 6) AS policy_rate, CASE WHEN b IS NOT NULL THEN NOT outcome AND b <= 0.5 * policy_rate END AS escalate FROM b""")
def task_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labels.with_policy_rate(labels.with_task_stats(B.sql(spark, sf_dir, OR, "orders")))
    return d.select("run", "n_runs", "n_success", r6("baseline", "baseline"), r6("advantage", "advantage"), r6("policy_rate", "policy_rate"), labels.escalate().alias("escalate"))


@query("profile", f"""WITH n AS (SELECT l_orderkey AS run, count(*) AS n_steps FROM lineitem GROUP BY 1), d AS (SELECT r.*, n_steps, run % 3 = 0 AS has_thought FROM ({OR}) r JOIN n USING (run))
SELECT count(*) AS n, round(avg(outcome::INT), 6) AS success_rate, round(avg(n_steps), 6) AS steps_mean, round(median(n_steps), 6) AS steps_median, max(n_steps) AS steps_max, round(avg(n_steps) FILTER (outcome), 6) AS steps_mean_success,
 round(avg(n_steps) FILTER (NOT outcome), 6) AS steps_mean_failure, count(DISTINCT repo) AS n_repos, round(avg(has_thought::INT), 6) AS thought_share FROM d""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count(F.lit(1)).alias("n_steps"))
    p = stats.profile(B.sql(spark, sf_dir, OR, "orders").join(n, "run").withColumn("has_thought", F.col("run") % 3 == 0))
    return p.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in p.dtypes])


@query("mixed_tasks", f"WITH t AS (SELECT task_id, bool_or(outcome) AS a, bool_and(outcome) AS b FROM ({OR}) GROUP BY 1) SELECT count(*) AS n_tasks, CAST(sum((a AND NOT b)::INT) AS BIGINT) AS n_mixed, round(avg((a AND NOT b)::INT), 6) AS mixed_share FROM t")
def mixed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mixed_tasks(B.sql(spark, sf_dir, OR, "orders")).select("n_tasks", "n_mixed", r6("mixed_share", "mixed_share"))


@query("top_status", "SELECT o_clerk AS status, count(*) AS n FROM (SELECT o_custkey % 40 AS o_clerk FROM orders) GROUP BY 1 ORDER BY n DESC, status LIMIT 12")
def top_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_k(B.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("status")), "status")


@query("frequencies", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequency(B.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("label_histogram", "SELECT question, label, count(*) AS n FROM (SELECT unnest(['quality', 'toxic']) AS question, unnest([CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)]) AS label FROM labels) WHERE label IS NOT NULL GROUP BY ALL")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.label_histogram(B.table(spark, sf_dir, "labels"), ["quality", "toxic"])


@query("token_percentiles", "WITH s AS (SELECT list_sort(list(CAST(floor(n_chars / 3.5 + 0.999) AS BIGINT))) AS v FROM documents) SELECT v[CAST(floor(0.5 * len(v)) AS INT) + 1] AS p50, v[CAST(floor(0.9 * len(v)) AS INT) + 1] AS p90, v[len(v)] AS max FROM s")
def token_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents").select(F.floor(F.col("n_chars") / F.lit(3.5) + 0.999).alias("t"))
    return stats.rank_percentiles(d, "t")


@query("split_stats", f"SELECT lang AS split, count(*) AS records, round(avg(toxic), 6) AS positive_rate, count(quality) AS has_quality, CAST(sum(doc_id % 7) AS BIGINT) AS tokens, count(DISTINCT source) AS trajectories FROM ({SD}) GROUP BY 1")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.scored(spark, sf_dir).select(F.col("lang").alias("split"), (F.col("toxic") == 1).alias("p_success"), "quality", (F.col("doc_id") % 7).alias("state_tokens"), F.col("source").alias("traj_id"))
    return stats.split_stats(d, ["quality"]).withColumn("positive_rate", F.round("positive_rate", 6))


@query("success_by_bucket", f"SELECT CAST(least(3, floor(frac * 4)) AS INTEGER) AS bucket, count(*) AS n, round(avg(toxic), 6) AS success_rate FROM ({SD}) GROUP BY 1")
def success_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.scored(spark, sf_dir).select(F.col("frac").alias("prefix_frac"), F.col("toxic").alias("p_success"))
    return stats.success_by_bucket(d).withColumn("success_rate", F.round("success_rate", 6))


@query("pattern_balance", "SELECT toxic, count(*) AS n, count(*) FILTER (regexp_matches(text, 'License')) AS license, count(*) FILTER (regexp_matches(text, '[0-9]{4}')) AS digits FROM labels JOIN documents USING (doc_id) GROUP BY toxic")
def pattern_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "labels").join(B.table(spark, sf_dir, "documents"), "doc_id")
    return stats.pattern_balance(d, "text", "toxic", {"license": "License", "digits": "[0-9]{4}"})


@query("split_overlap", "WITH s AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS split_a, b.event_type AS split_b, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.split_overlap(B.table(spark, sf_dir, "events"), "user_id", "event_type")


# ------------------------------------------------------------------------------------------------ dedup, splits, sampling

BUCKET = "((76 * ((a + b + c) % 100) + d % 100) % 100)"
CHUNKS = ", ".join(f"('0x' || substr(h, {10 * i + 1}, 10))::BIGINT AS {n}" for i, n in enumerate("abcd"))


@query("hash_split", f"""WITH k AS (SELECT c_custkey, sha1('tracklore-v1:owner' || c_nationkey || '/repo' || c_custkey) AS h FROM customer), b AS (SELECT c_custkey, {CHUNKS} FROM k)
SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'verified_holdout' WHEN {BUCKET} < 80 THEN 'train' WHEN {BUCKET} < 90 THEN 'dev' ELSE 'test' END AS split FROM b""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("owner"), F.col("c_nationkey").cast("string"), F.lit("/repo"), "c_custkey").alias("repo_or_site"), F.col("c_custkey").cast("string").alias("task_id"))
    held = c.where("c_custkey % 50 = 0").select(F.col("repo_or_site").alias("repo"))
    return splits.with_split(c, held).select("c_custkey", "split")


@query("split_table", f"""WITH r AS (SELECT DISTINCT 'own' || n || '/k' || n AS repo FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey + 10 FROM supplier)), k AS (SELECT repo, sha1('tracklore-v1:' || repo) AS h FROM r), b AS (SELECT repo, {CHUNKS} FROM k)
SELECT repo, CASE WHEN {BUCKET} < 80 THEN 'train' WHEN {BUCKET} < 90 THEN 'dev' ELSE 'test' END AS split FROM b""")
def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = lambda n: F.concat(F.lit("own"), n.cast("string"), F.lit("/k"), n.cast("string")).alias("repo_or_site")
    return splits.split_table([B.table(spark, sf_dir, "customer").select(repo(F.col("c_nationkey"))), B.table(spark, sf_dir, "supplier").select(repo(F.col("s_nationkey") + 10))])


@query("content_dedup", "SELECT min(doc_id) AS doc_id, sha1(source || chr(31) || lang || chr(31) || text) AS content FROM documents GROUP BY content")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents").withColumn("content", F.sha1(F.concat_ws("\x1f", "source", "lang", "text")))
    return splits.dedup_first(d.select("doc_id", "content"), F.col("content"), ["doc_id"])


@query("sample_whole_runs", f"""WITH u AS (SELECT l_orderkey AS run, count(*) AS c, {h01('s1', 'l_orderkey')} AS o FROM lineitem GROUP BY l_orderkey), t AS (SELECT *, sum(c) OVER (ORDER BY o, run ROWS UNBOUNDED PRECEDING) - c AS before FROM u)
SELECT run, c FROM t WHERE before < 500""")
def sample_whole_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"))
    return splits.sample_whole(d, 500, "s1", "run").groupBy("run").agg(F.count(F.lit(1)).alias("c"))


@query("mixed_first_sample", f"""WITH r AS (SELECT run, task_id, policy_model, outcome, run * 10 + k AS id FROM ({OR}), (SELECT unnest([1, 2, 3]) AS k)), m AS (SELECT task_id, policy_model, bool_or(outcome) AND NOT bool_and(outcome) AS mixed FROM r GROUP BY ALL),
x AS (SELECT r.*, mixed, row_number() OVER (PARTITION BY run ORDER BY {h01('s2', 'id')}, id) AS k FROM r JOIN m USING (task_id, policy_model)), u AS (SELECT run, count(*) AS c, min(CASE WHEN mixed THEN 0 ELSE 1 END) AS tier, {h01('s2', 'run')} AS o FROM x WHERE k <= 2 GROUP BY run),
t AS (SELECT *, sum(c) OVER (ORDER BY tier, o, run ROWS UNBOUNDED PRECEDING) - c AS before FROM u) SELECT x.id FROM x JOIN t USING (run) WHERE k <= 2 AND before < 1500""")
def mixed_first_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = B.sql(spark, sf_dir, OR, "orders").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("id", F.col("run") * 10 + F.col("k")).withColumn("traj_id", F.col("run"))
    return splits.mixed_first(r.drop("k"), 1500, 2, "s2").select("id")


@query("per_class_sample", f"SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {h01('s3', 'doc_id')}, doc_id) AS k FROM labels) WHERE k <= 20")
def per_class_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.per_class(B.table(spark, sf_dir, "labels").select("doc_id", "toxic"), 20, "s3", "toxic", "doc_id")


@query("sample_n", f"SELECT doc_id FROM documents ORDER BY {h01('s4', 'doc_id')}, doc_id LIMIT 100")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_n(B.table(spark, sf_dir, "documents").select("doc_id"), 100, "s4", F.col("doc_id"))


@query("sample_train_split", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang = 'en' ORDER BY {h01('s5', 'doc_id')}, doc_id) AS k FROM documents) WHERE lang <> 'en' OR k <= 50")
def sample_train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("lang") == "en", "train").otherwise("test").alias("split"))
    return splits.sample_train(d, 50, "s5", "doc_id").select("doc_id", "lang")


@query("policy_dropout", f"SELECT run, CASE WHEN {h01('s6', 'run', 'prefix_len')} < 0.3 THEN 'unknown' ELSE policy_model END AS policy_shown FROM (SELECT *, run % 9 AS prefix_len FROM ({OR}))")
def policy_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.sql(spark, sf_dir, OR, "orders").withColumns({"traj_id": F.col("run"), "prefix_len": F.col("run") % 9})
    return d.select("run", splits.policy_shown("s6").alias("policy_shown"))


@query("key_lists", f"WITH r AS ({OR}), u AS (SELECT DISTINCT task_id FROM r WHERE NOT outcome) SELECT CASE WHEN task_id IN (SELECT task_id FROM u) THEN 'kept' ELSE 'left' END AS side, count(*) AS n, count(DISTINCT task_id) AS tasks FROM r GROUP BY 1")
def key_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of tasks with a failed run, and of tasks without one."""
    r = B.sql(spark, sf_dir, OR, "orders")
    failed = r.where("NOT outcome")
    both = splits.only(r, failed, "task_id").withColumn("side", F.lit("kept")).unionByName(splits.without(r, failed, "task_id").withColumn("side", F.lit("left")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task_id").alias("tasks"))


@query("outcome_pairs")
def outcome_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.sql(spark, sf_dir, OR, "orders").select(F.col("run").cast("string").alias("id"), F.col("task_id"), F.lit("p").alias("policy_model"), "outcome", ((F.col("run") % 100) / 100.0).cast("double").alias("prefix_frac"))
    return splits.pair_outcomes(d, 0.25, "s7")


@query("strict_prefixes", f"""WITH st AS ({OS}), n AS (SELECT run, max(i) AS n FROM st GROUP BY run)
SELECT coalesce(CASE WHEN i >= n THEN 'full prefix' WHEN action = 'submit' THEN 'finish visible' END, 'kept') AS reason, count(*) AS n FROM st JOIN n USING (run) GROUP BY 1""")
def strict_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labels.expand_prefixes(B.order_runs(spark, sf_dir))
    state_text = F.concat(F.lit("<recent>\n$ "), F.element_at("steps", F.col("prefix_len"))["action"])
    d = splits.strict_prefixes(p, X.last_visible_action(state_text))
    return d.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("row_constraints", f"""SELECT CASE WHEN o_orderkey % 11 = 0 THEN ['task is blank'] ELSE [] END || CASE WHEN o_orderkey % 13 = 0 THEN ['unknown domain'] ELSE [] END || CASE WHEN o_orderkey % 17 = 0 THEN ['no outcome'] ELSE [] END AS violations, o_orderkey FROM orders
 WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0""")
def row_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = B.table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 11 == 0, " ").otherwise("t").alias("task"), F.when(k % 13 == 0, "moon").otherwise("swe").alias("domain"), F.when(k % 17 != 0, F.lit(True)).alias("outcome"), F.lit("x").alias("task_id"), F.array(F.lit("step")).alias("steps"))
    return schema.split_valid(d)[1].select("violations", "o_orderkey")


@query("views", f"SELECT run, 'Great, this works! The fix is complete and all tests pass now.' AS last_thought, CAST(count(*) - 1 AS INTEGER) AS silent FROM ({OS}) GROUP BY run")
def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thoughts-removed and the misleading view side by side."""
    d = B.order_runs(spark, sf_dir)
    return schema.with_fake_confidence(schema.without_thoughts(d)).select("run", F.element_at("steps", -1)["thought"].alias("last_thought"), F.size(F.filter("steps", lambda s: s["thought"].isNull())).alias("silent"))


# ------------------------------------------------------------------------------------------------ rule labels

EV = f"""WITH st AS ({ES}), s AS (SELECT run, i, action AS norm, observation AS obs, CASE WHEN observation LIKE 'ValueError%' THEN 'ValueError: code #' END AS err,
 CASE WHEN action LIKE 'edit%' THEN 'edit L' || CAST(CAST(regexp_extract(action, '^edit (\\d+)', 1) AS BIGINT) // 10 AS VARCHAR) WHEN action LIKE 'open%' THEN 'open /a.py src/a.py' WHEN action LIKE 'python%' THEN 'python run.py' ELSE action END AS fam,
 action LIKE 'edit%' AS edit, observation LIKE 'No repl%' AS bad, CAST(nullif(regexp_extract(observation, '(\\d+) passed', 1), '') AS INTEGER) AS passed, CAST(nullif(regexp_extract(observation, '(\\d+) failed', 1), '') AS INTEGER) AS failed FROM st)"""


@query("stuck_rule", EV + """, p AS (SELECT a.run, a.i AS L, b.i AS j, b.norm, b.err, b.fam, b.edit, b.bad FROM s a JOIN s b ON a.run = b.run AND b.i > a.i - 6 AND b.i <= a.i),
acts AS (SELECT run, L, norm, count(*) AS n, min(j) AS f, bool_or(edit) AS edit FROM p GROUP BY ALL), topa AS (SELECT * FROM acts QUALIFY row_number() OVER (PARTITION BY run, L ORDER BY n DESC, f) = 1),
ae AS (SELECT p.run, p.L, p.norm, p.err, count(*) AS n FROM p WHERE err IS NOT NULL GROUP BY ALL), aem AS (SELECT run, L, norm, max(n) AS n FROM ae GROUP BY ALL),
r1 AS (SELECT t.run, t.L, 'same action x' || t.n || ': ' || substr(t.norm, 1, 60) AS r FROM topa t LEFT JOIN aem USING (run, L, norm) WHERE t.n >= 3 AND t.norm NOT LIKE 'open%' AND (t.edit OR coalesce(aem.n, 0) >= 2)),
errs AS (SELECT run, L, err, count(*) AS n, min(j) AS f FROM p WHERE err IS NOT NULL GROUP BY run, L, err QUALIFY row_number() OVER (PARTITION BY run, L ORDER BY count(*) DESC, min(j)) = 1),
r2 AS (SELECT run, L, 'same error x' || n || ': ' || err AS r FROM errs WHERE n >= 3),
cyc AS (SELECT run, L, fam, count(*) AS n, min(j) AS f FROM p WHERE edit AND bad GROUP BY run, L, fam QUALIFY row_number() OVER (PARTITION BY run, L ORDER BY count(*) DESC, min(j)) = 1),
r3 AS (SELECT run, L, 'edit cycle x' || n || ': ' || fam AS r FROM cyc WHERE n >= 3)
SELECT s.run, CAST(s.i AS INTEGER) AS prefix_len, concat_ws('; ', r1.r, r2.r, r3.r) AS reasons FROM s LEFT JOIN r1 ON r1.run = s.run AND r1.L = s.i LEFT JOIN r2 ON r2.run = s.run AND r2.L = s.i LEFT JOIN r3 ON r3.run = s.run AND r3.L = s.i""")
def stuck_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labels.all_prefixes(labels.derive(B.event_runs(spark, sf_dir)), labels.stuck, "reasons", "run")
    return d.withColumn("reasons", F.array_join("reasons", "; "))


@query("progress_rule", EV + """, q AS (SELECT *, lag(norm) OVER w AS pn, lag(err) OVER w AS pe, last_value(passed IGNORE NULLS) OVER b AS pp, last_value(failed IGNORE NULLS) OVER b AS pf, count(*) FILTER (norm LIKE 'open%') OVER b AS opened
 FROM s WINDOW w AS (PARTITION BY run ORDER BY i), b AS (PARTITION BY run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT run, i, CASE WHEN passed IS NOT NULL AND pp IS NOT NULL AND failed = 0 AND pf > 0 THEN '3failures ' || pf || ' -> 0' WHEN passed IS NOT NULL AND pp IS NOT NULL AND failed > pf THEN '0failures ' || pf || ' -> ' || failed
 WHEN passed IS NOT NULL AND pp IS NOT NULL AND (failed < pf OR (passed > pp AND failed = 0)) THEN '2tests improved ' || pp || 'p/' || pf || 'f -> ' || passed || 'p/' || failed || 'f' WHEN passed IS NOT NULL AND pp IS NOT NULL THEN '1tests unchanged'
 WHEN failed = 0 AND passed > 0 THEN '3first passing test run' WHEN passed IS NOT NULL THEN '2first test run, failures present' WHEN pn = norm AND err IS NOT NULL AND err = pe THEN '0repeated action, same error' WHEN pn = norm THEN '1repeated action'
 WHEN edit AND bad THEN '0edit failed' WHEN edit THEN '2edit applied' WHEN norm LIKE 'open%' AND opened > 0 THEN '1re-reading a known location' WHEN norm LIKE 'open%' THEN '2new location explored'
 WHEN err IS NOT NULL AND err = pe THEN '0same error as previous step' WHEN err IS NOT NULL THEN '1command errored' ELSE '1no signal' END AS x FROM q)
SELECT run, CAST(i AS INTEGER) AS prefix_len, CAST(substr(x, 1, 1) AS INTEGER) AS progress, substr(x, 2) AS reason FROM r""")
def progress_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labels.all_progress(labels.derive(B.event_runs(spark, sf_dir)), "x", "run")
    return d.select("run", "prefix_len", F.col("x.value").alias("progress"), F.col("x.reason").alias("reason"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labels.derive(labels.with_policy_rate(labels.with_task_stats(B.order_runs(spark, sf_dir))))
    d = labels.expand_prefixes(d, labels.prefix_lengths(F.size("steps"), seed="r", key=F.col("traj_id")))
    return labels.label_prefixes(d.withColumn("id", F.concat_ws("@", "traj_id", "prefix_len")))


#: Signals of the steps of both kinds of runs, and the rule labels of every prefix, in SQL.
SIG = """WITH st AS ({steps}), x AS (SELECT *, trim(regexp_replace(action, '\\s+', ' ', 'g')) AS norm, regexp_extract_all(action, '(?:/[\\w.\\-]+)+|[\\w.\\-]+\\.(?:py|md)\\b') AS ps FROM st),
y AS (SELECT *, CASE WHEN split_part(norm, ' ', 1) = 'str_replace_editor' THEN split_part(norm, ' ', 1) || ' ' || split_part(norm, ' ', 2) ELSE split_part(norm, ' ', 1) END AS head, array_to_string(list_sort(list_distinct(ps)), ' ') AS paths FROM x),
s AS (SELECT run, i, norm, regexp_replace(trim(head || ' ' || paths), '\\b\\d+\\b', '#', 'g') || CASE WHEN norm LIKE 'edit %' THEN ' L' || CAST(CAST(regexp_extract(norm, '^edit (\\d+)', 1) AS BIGINT) // 10 AS VARCHAR) ELSE '' END AS fam,
 CASE WHEN observation LIKE '%ValueError%' THEN 'ValueError: bad value #' WHEN observation LIKE 'fatal:%' THEN observation END AS err, norm LIKE 'edit %' OR norm LIKE 'str_replace_editor str_replace%' AS edit, observation LIKE 'No repl%' AS bad,
 observation = 'File updated' OR observation LIKE '%has been edited' AS ok, norm LIKE 'open %' OR norm LIKE 'ls%' AS explore, norm LIKE 'open %' OR norm LIKE 'ls%' AS nav, norm = 'submit' AS fin,
 CAST(nullif(regexp_extract(observation, '(\\d+) passed', 1), '') AS INTEGER) AS passed, CAST(nullif(regexp_extract(observation, '(\\d+) failed', 1), '') AS INTEGER) AS failed FROM y)""".replace("{steps}", OS)
RULES = SIG + """, p AS (SELECT a.run, a.i AS L, b.i AS j, b.norm, b.err, b.fam, b.edit, b.bad, b.nav, b.fin FROM s a JOIN s b ON a.run = b.run AND b.i > a.i - 6 AND b.i <= a.i),
acts AS (SELECT run, L, norm, count(*) AS n, min(j) AS f, bool_or(edit) AS edit, bool_or(nav) AS nav, bool_or(fin) AS fin FROM p GROUP BY ALL), topa AS (SELECT * FROM acts QUALIFY row_number() OVER (PARTITION BY run, L ORDER BY n DESC, f) = 1),
aem AS (SELECT run, L, norm, max(n) AS n FROM (SELECT run, L, norm, err, count(*) AS n FROM p WHERE err IS NOT NULL GROUP BY ALL) GROUP BY ALL),
r1 AS (SELECT t.run, t.L, 'same action x' || t.n || ': ' || substr(t.norm, 1, 60) AS r FROM topa t LEFT JOIN aem USING (run, L, norm) WHERE t.n >= 3 AND NOT t.nav AND NOT t.fin AND (t.edit OR coalesce(aem.n, 0) >= 2)),
r2 AS (SELECT run, L, 'same error x' || n || ': ' || substr(err, 1, 60) AS r FROM (SELECT run, L, err, count(*) AS n FROM p WHERE err IS NOT NULL GROUP BY run, L, err QUALIFY row_number() OVER (PARTITION BY run, L ORDER BY count(*) DESC, min(j)) = 1) WHERE n >= 3),
r3 AS (SELECT run, L, 'edit cycle x' || n || ': ' || substr(fam, 1, 60) AS r FROM (SELECT run, L, fam, count(*) AS n FROM p WHERE edit AND (bad OR err IS NOT NULL) GROUP BY run, L, fam QUALIFY row_number() OVER (PARTITION BY run, L ORDER BY count(*) DESC, min(j)) = 1) WHERE n >= 3),
q AS (SELECT *, lag(norm) OVER w AS pn, lag(err) OVER w AS pe, last_value(passed IGNORE NULLS) OVER b AS pp, last_value(failed IGNORE NULLS) OVER b AS pf, min(i) OVER (PARTITION BY run, fam) < i OR min(i) OVER (PARTITION BY run, norm) < i AS known
 FROM s WINDOW w AS (PARTITION BY run ORDER BY i), b AS (PARTITION BY run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT run, i, CASE WHEN fin AND pf = 0 AND pp > 0 THEN '3finish after passing tests' WHEN fin THEN '1finish without a passing test run' WHEN passed IS NOT NULL AND pp IS NOT NULL AND failed = 0 AND pf > 0 THEN '3failures ' || pf || ' -> 0'
 WHEN passed IS NOT NULL AND pp IS NOT NULL AND failed > pf THEN '0failures ' || pf || ' -> ' || failed WHEN passed IS NOT NULL AND pp IS NOT NULL AND (failed < pf OR (passed > pp AND failed = 0)) THEN '2tests improved ' || pp || 'p/' || pf || 'f -> ' || passed || 'p/' || failed || 'f'
 WHEN passed IS NOT NULL AND pp IS NOT NULL THEN '1tests unchanged' WHEN failed = 0 AND passed > 0 THEN '3first passing test run' WHEN passed IS NOT NULL THEN '2first test run, failures present' WHEN pn = norm AND err IS NOT NULL AND err = pe THEN '0repeated action, same error'
 WHEN pn = norm THEN '1repeated action' WHEN edit AND (bad OR (err IS NOT NULL AND NOT ok)) THEN '0edit failed' WHEN edit THEN '2edit applied' WHEN explore AND known THEN '1re-reading a known location' WHEN explore AND err IS NOT NULL THEN '1exploration hit an error'
 WHEN explore THEN '2new location explored' WHEN err IS NOT NULL AND err = pe THEN '0same error as previous step' WHEN err IS NOT NULL THEN '1command errored' ELSE '1no signal' END AS x FROM q),
lab AS (SELECT g.run, g.i, concat_ws('; ', r1.r, r2.r, r3.r) AS reasons, CAST(substr(x, 1, 1) AS INTEGER) AS progress, substr(x, 2) AS why FROM g LEFT JOIN r1 ON r1.run = g.run AND r1.L = g.i LEFT JOIN r2 ON r2.run = g.run AND r2.L = g.i LEFT JOIN r3 ON r3.run = g.run AND r3.L = g.i)"""
RECORDS = RULES + f""", nn AS (SELECT run, max(i) AS n, greatest(1, max(i) - 1) AS hi FROM s GROUP BY run),
len AS (SELECT DISTINCT run, n, L FROM (SELECT run, n, least(hi, greatest(1, round_even(f * n, 0))) AS L FROM nn, (SELECT unnest([0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS f) UNION ALL SELECT run, n, 1 + floor({h01('r', "'run' || run", '0')} * hi) FROM nn)),
rr AS (SELECT * FROM ({OR}) WHERE run IN (SELECT run FROM nn)), ts AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS nr, sum(outcome::INT) OVER (PARTITION BY task_id) AS ns FROM rr), pr AS (SELECT policy_model, avg(outcome::INT) AS rate FROM rr GROUP BY 1),
tb AS (SELECT ts.*, rate, CASE WHEN nr - 1 >= 3 THEN (ns - outcome::INT) / (nr - 1) END AS b FROM ts JOIN pr USING (policy_model)),
rec AS (SELECT 'run' || len.run || '@' || CAST(L AS INTEGER) AS id, task_id, CAST(L AS INTEGER) AS prefix_len, CAST(n AS INTEGER) AS n_steps, round_even(L / n, 4) AS prefix_frac, outcome AS p_success, round(b, 6) AS baseline, round(outcome::INT - b, 6) AS advantage,
 reasons <> '' AS stuck, reasons AS stuck_reasons, progress, why AS progress_reason, CASE WHEN outcome THEN CASE WHEN greatest(1, n - L) <= 5 THEN 0 WHEN greatest(1, n - L) <= 15 THEN 1 WHEN greatest(1, n - L) <= 40 THEN 2 ELSE 3 END END AS steps_left,
 CASE WHEN b IS NOT NULL THEN NOT outcome AND b <= 0.5 * rate END AS escalate FROM len JOIN lab ON lab.run = len.run AND lab.i = len.L JOIN tb ON tb.run = len.run)"""


@query("prefix_records", RECORDS + " SELECT * FROM rec")
def prefix_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled records of sampled prefixes."""
    d = _records(spark, sf_dir).select("id", "task_id", "prefix_len", "n_steps", "prefix_frac", "p_success", r6("baseline", "baseline"), r6("advantage", "advantage"), "stuck", "stuck_reasons", "progress", "progress_reason", "steps_left", "escalate")
    return d.withColumn("stuck_reasons", F.array_join("stuck_reasons", "; "))


@query("relabel_changes", f"""WITH r AS ({OR}), o AS (SELECT *, CASE WHEN outcome THEN run % 4 END AS steps_left, CASE WHEN run % 3 <> 0 THEN NOT outcome END AS escalate FROM r)
SELECT count(*) FILTER (run % 5 = 0) AS p_success, count(*) FILTER (run % 11 = 0) AS stuck, count(*) FILTER (run % 6 = 0) AS progress, count(*) FILTER (run % 9 = 0 AND steps_left IS NOT NULL) AS steps_left,
 count(*) FILTER (run % 8 = 0 AND escalate IS DISTINCT FROM true) AS escalate FROM o WHERE run % 10 <> 3""")
def relabel_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all five questions made anew for nine runs of ten; the others keep theirs."""
    k = F.col("id")
    old = B.sql(spark, sf_dir, OR, "orders").select(F.col("run").alias("id"), F.col("outcome").alias("p_success"), (F.col("run") % 2 == 0).alias("stuck"), (F.col("run") % 4).cast("int").alias("progress"),
        F.when(F.col("outcome"), (F.col("run") % 4).cast("int")).alias("steps_left"), F.when(F.col("run") % 3 != 0, ~F.col("outcome")).alias("escalate"))
    new = lambda c, x, when: F.when(when, x).otherwise(F.col(c)).alias(c)
    fresh = old.where(k % 10 != 3).select(
        "id", new("p_success", ~F.col("p_success"), k % 5 == 0), new("stuck", ~F.col("stuck"), k % 11 == 0), new("progress", (F.col("progress") + 1) % 4, k % 6 == 0),
        new("steps_left", F.lit(None).cast("int"), k % 9 == 0), new("escalate", F.lit(True), k % 8 == 0),
    )
    return labels.relabel(old, fresh)[1]


@query("rules_fired", RECORDS + """, f AS (SELECT split_part(unnest(string_split(stuck_reasons, '; ')), ' x', 1) AS rule FROM rec WHERE stuck), w AS (SELECT progress, array_to_string(list_slice(string_split(progress_reason, ' '), 1, 2), ' ') AS two, count(*) AS n FROM rec GROUP BY ALL)
SELECT rule, count(*) AS n FROM f GROUP BY rule UNION ALL SELECT 'progress ' || progress || ': ' || two, n FROM (SELECT *, row_number() OVER (PARTITION BY progress ORDER BY n DESC, two) AS k FROM w) WHERE k <= 8""")
def rules_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    top = stats.top_progress_rules(r).select(F.concat(F.lit("progress "), "progress", F.lit(": "), "rule").alias("rule"), "n")
    return stats.rules_fired(r).unionByName(top)


# ------------------------------------------------------------------------------------------------ candidates, state, features

@query("family_jaccard", f"""WITH st AS ({OS}), f AS (SELECT run, list(DISTINCT split_part(trim(regexp_replace(action, '\\s+', ' ', 'g')), ' ', 1)) AS fs FROM st GROUP BY run), r AS (SELECT run, task_id FROM ({OR})), d AS (SELECT * FROM f JOIN r USING (run))
SELECT a.run AS run_a, b.run AS run_b, round(len(list_intersect(a.fs, b.fs)) / len(list_distinct(a.fs || b.fs)), 6) AS sim FROM d a JOIN d b ON a.task_id = b.task_id AND a.run <> b.run WHERE a.run % 20 = 0""")
def family_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every twentieth run to all other runs of its task."""
    d = B.order_runs(spark, sf_dir).select("run", "task_id", F.array_distinct(F.transform("steps", lambda s: F.substring_index(X.normalize_action(s["action"]), " ", 1))).alias("fs"))
    a, b = d.where("run % 20 = 0").select(F.col("run").alias("run_a"), "task_id", F.col("fs").alias("fa")), d.select(F.col("run").alias("run_b"), "task_id", F.col("fs").alias("fb"))
    return a.join(b, "task_id").where("run_a <> run_b").select("run_a", "run_b", r6(A.jaccard(F.col("fa"), F.col("fb")), "sim"))


@query("actions_near", f"WITH st AS ({OS}) SELECT a.run, CAST(a.i AS INTEGER) AS prefix_len, CAST(b.i - 1 AS INTEGER) AS step, b.action FROM st a JOIN st b ON a.run = b.run AND abs(b.i - 1 - a.i) <= 2")
def actions_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band join of a prefix and its run's steps, as a slice."""
    d = labels.expand_prefixes(B.order_runs(spark, sf_dir))
    near = candidates.actions_near(F.transform("steps", lambda s: s["action"]), F.col("prefix_len"), 2)
    return d.select("run", "prefix_len", F.explode(near).alias("x")).select("run", "prefix_len", "x.step", "x.action")


@query("candidate_sets")
def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = labels.derive(B.order_runs(spark, sf_dir)).select("traj_id", "task_id", "outcome", F.transform("sig", lambda s: s["norm"]).alias("norm"), F.transform("sig", lambda s: s["fam"]).alias("fam"), F.sequence(F.lit(1), F.size("sig")).alias("lens"))
    return candidates.sets_of_runs(runs)


@query("render_state")
def render_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = state.with_states(B.order_runs(spark, sf_dir), F.sequence(F.lit(1), F.size("steps")), state.StateConfig(budget=220, recent_steps=3))
    return runs.select("traj_id", F.inline("states"))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled prefixes with their states, shown policies and rule labels; steps stay in their run's row."""
    shown = lambda n: splits.policy_shown("s6", length=n)
    d = labels.derive(B.order_runs(spark, sf_dir)).withColumn("lens", labels.prefix_lengths(F.size("steps"), seed="r", key=F.col("traj_id")))
    d = state.with_states(d.drop("task_id", "repo_or_site"), F.col("lens"), policy=shown)
    marks = F.transform("lens", lambda n: F.struct((F.size(labels.stuck(F.col("sig"), n)) > 0).alias("stuck"), labels.progress(F.col("sig"), n)["value"].alias("progress"), shown(n).alias("policy_shown")))
    d = d.withColumn("marks", marks).select("traj_id", "outcome", F.explode(F.arrays_zip("states", "marks")).alias("x"))
    return d.select(F.concat_ws("@", "traj_id", "x.states.prefix_len").alias("id"), F.col("outcome").cast("double").alias("y"), "x.states.*", "x.marks.*")


@query("state_features")
def state_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_features(_rendered(spark, sf_dir)).select("id", "features_by_name.*")


@query("gbt_baseline")
def gbt_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees and a Platt-mapped score on two halves of the documents."""
    d = B.table(spark, sf_dir, "labels").join(B.table(spark, sf_dir, "documents"), "doc_id")
    d = d.select("doc_id", F.col("toxic").cast("double").alias("y"), F.col("n_chars").cast("double").alias("a"), F.size(F.split("text", "\n")).cast("double").alias("b"), F.length(F.regexp_replace("text", "[^a-z]", "")).cast("double").alias("c"))
    from pyspark.ml.feature import VectorAssembler

    d = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(d)
    train, test = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    gbt = features.predict(features.boosted(train, "y"), test, "p_gbt")
    return features.predict(features.platt(train, "a", "y"), gbt, "p_platt").select("doc_id", "y", "p_gbt", "p_platt", F.lit(features.prior(train, "y")).alias("p_prior"))


# ------------------------------------------------------------------------------------------------ metrics

AUC = "(SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) FROM (SELECT toxic AS y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM d))"
BINS = "least(14, len(list_filter(range(0, 16), lambda e: e / 15.0::DOUBLE <= p)) - 1)"


@query("binary_report", f"""WITH d AS ({SD}), e AS (SELECT {BINS} AS b, count(*) AS n, abs(avg(p) - avg(toxic)) AS gap FROM d GROUP BY 1)
SELECT count(*) AS n, round(avg(toxic), 6) AS positive_rate, round(avg(((p >= 0.5)::INT = toxic)::INT), 6) AS accuracy, round(avg((p - toxic) * (p - toxic)), 6) AS brier, round(-avg(CASE WHEN toxic = 1 THEN ln(greatest(1e-7, least(p, 1 - 1e-7))) ELSE ln(1 - greatest(1e-7, least(p, 1 - 1e-7))) END), 6) AS nll,
 round(avg((greatest(p, 1 - p) >= 0.9 AND (p >= 0.5)::INT <> toxic)::INT), 6) AS confident_error, {AUC} AS auroc, (SELECT round(sum(n * gap) / sum(n), 6) FROM e) AS ece15 FROM d""")
def binary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.binary_report(B.scored(spark, sf_dir), "toxic", "p")
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in r.dtypes])


@query("auroc_by_source", f"""WITH d AS ({SD}), r AS (SELECT source, toxic AS y, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2.0 AS r FROM d)
SELECT source, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS auroc FROM r GROUP BY source""")
def auroc_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(B.scored(spark, sf_dir), "toxic", "p", ["source"]).withColumn("auroc", F.round("auroc", 6))


@query("reliability", f"""WITH d AS ({SD}), e AS (SELECT {BINS} AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(toxic), 6) AS accuracy FROM d GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, confidence, accuracy FROM (SELECT unnest(range(0, 15)) AS b) LEFT JOIN e ON bin = b""")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability(B.scored(spark, sf_dir), "toxic", "p").withColumns({"confidence": F.round("confidence", 6), "accuracy": F.round("accuracy", 6)})


@query("recall_at_fpr", f"""WITH d AS (SELECT toxic AS y, p FROM ({SD})), s AS (SELECT list_reverse_sort(list(p)) AS v FROM d WHERE y = 0), t AS (SELECT v[CAST(floor(0.1 * len(v)) AS INT) + 1] AS thr FROM s)
SELECT round(count(*) FILTER (p > thr AND y = 1) / greatest(1, count(*) FILTER (y = 1)), 6) AS recall, round(count(*) FILTER (p > thr AND y = 1) / greatest(1, count(*) FILTER (p > thr)), 6) AS precision, round(avg((p > thr)::INT), 6) AS fired, round(max(thr), 6) AS threshold FROM d, t""")
def recall_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.recall_at_fpr(B.scored(spark, sf_dir), "toxic", "p", 0.1)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


PROBS = "[p * 0.5, (1 - p) * 0.4, (1 - p) * 0.6, p * 0.5]"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return B.scored(spark, sf_dir).select("*", F.array(p * 0.5, (1 - p) * 0.4, (1 - p) * 0.6, p * 0.5).alias("ps"), (F.col("quality") + 2 * F.col("toxic")).alias("level"))


LV = f"WITH d AS (SELECT *, {PROBS}::DOUBLE[] AS ps, quality + 2 * toxic AS level, list_position(ps, list_max(ps)) - 1 AS pred FROM ({SD}))"


@query("ordinal_report", LV + """SELECT count(*) AS n, round(avg((pred = level)::INT), 6) AS accuracy, round(avg(abs(ps[2] + 2 * ps[3] + 3 * ps[4] - level)), 6) AS mae,
 round(avg((pow(ps[1] - (0 >= level)::INT, 2) + pow(ps[1] + ps[2] - (1 >= level)::INT, 2) + pow(ps[1] + ps[2] + ps[3] - (2 >= level)::INT, 2) + pow(ps[1] + ps[2] + ps[3] + ps[4] - 1, 2)) / 3), 6) AS rps, round(avg((abs(pred - level) <= 1)::INT), 6) AS within_one FROM d""")
def ordinal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.ordinal_report(_levels(spark, sf_dir), "level", "ps")
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in r.dtypes])


@query("choice_report", LV + "SELECT lang, count(*) AS n, round(avg((pred = level)::INT), 6) AS top1, round(avg(len(ps)), 6) AS k_mean FROM d GROUP BY lang")
def choice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.choice_report(_levels(spark, sf_dir), "level", "ps", ["lang"])
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in r.dtypes])


@query("prefix_slices", f"""WITH d AS (SELECT *, CAST(least(3, floor(frac * 4)) AS INTEGER) AS bucket FROM ({SD})), r AS (SELECT bucket, p, toxic AS y, rank() OVER (PARTITION BY bucket ORDER BY p) + (count(*) OVER (PARTITION BY bucket, p) - 1) / 2.0 AS r FROM d)
SELECT bucket, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auroc FROM r GROUP BY bucket HAVING count(*) >= 20 AND min(y) < max(y)""")
def prefix_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.prefix_slices(B.scored(spark, sf_dir), "toxic", "p", "frac")
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in r.dtypes])


@query("selective_report", LV + """, g AS (SELECT list_max(ps) AS c, count(*) AS k, sum((pred <> level)::INT) AS e FROM d GROUP BY 1), r AS (SELECT *, sum(k) OVER (ORDER BY c DESC) AS n, sum(e) OVER (ORDER BY c DESC) AS bad, sum(k) OVER () AS total FROM g)
SELECT round(sum(bad / n * k) / max(total), 6) AS aurc, round(1 - arg_min(bad / n, n) FILTER (n >= 0.5 * total), 6) AS accuracy_at_50, round(1 - arg_min(bad / n, n) FILTER (n >= 0.8 * total), 6) AS accuracy_at_80,
 round(coalesce(max(n / total) FILTER (bad / n <= 0.05), 0), 6) AS coverage_at_5, round(coalesce(max(n / total) FILTER (bad / n <= 0.01), 0), 6) AS coverage_at_1 FROM r""")
def selective_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.selective_report(_levels(spark, sf_dir), "level", "ps")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grouped_bootstrap(B.scored(spark, sf_dir), "source", "toxic", "p", n_boot=200)


# ------------------------------------------------------------------------------------------------ calibration, losses

@query("temper", LV + ", e AS (SELECT doc_id, [ln(greatest(x, 1e-9)) / 1.7 FOR x IN ps] AS z, p FROM d), f AS (SELECT doc_id, p, [exp(x - list_max(z)) FOR x IN z] AS e FROM e) SELECT doc_id, round(e[1] / list_sum(e), 6) AS q0, round(e[2] / list_sum(e), 6) AS q1, round(1 / (1 + exp(-ln(p / (1 - p)) / 1.7)), 6) AS b FROM f")
def temper(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = A.temper(F.col("ps"), 1.7)
    return _levels(spark, sf_dir).select("doc_id", r6(q[0], "q0"), r6(q[1], "q1"), r6(A.temper_binary(F.col("p"), 1.7), "b"))


@query("fit_temperatures")
def fit_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.fit_temperatures(_levels(spark, sf_dir), "lang", "ps", "level", least_rows=10)


@query("flag_thresholds", f"""WITH d AS (SELECT doc_id % 2 = 0 AS dev, toxic AS y, p FROM ({SD})), v AS (SELECT list_reverse_sort(list(p)) AS v FROM d WHERE dev AND y = 0), t AS (SELECT budget, v[CAST(floor(budget * len(v)) AS INT) + 1] AS threshold FROM v, (SELECT unnest([0.05, 0.1, 0.25]::DOUBLE[]) AS budget))
SELECT budget, round(threshold, 6) AS threshold, round(count(*) FILTER (dev AND y = 1 AND p > threshold) / greatest(1, count(*) FILTER (dev AND y = 1)), 6) AS dev_recall, round(avg((p > threshold)::INT) FILTER (NOT dev AND y = 0), 6) AS test_fpr,
 round(avg((p > threshold)::INT) FILTER (NOT dev AND y = 1), 6) AS test_recall, round(avg((p > threshold)::INT) FILTER (NOT dev), 6) AS test_fired FROM d, t GROUP BY budget, threshold""")
def flag_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.scored(spark, sf_dir)
    r = calibration.flag_thresholds(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "toxic", "p")
    return r.select("budget", *[F.round(c, 6).alias(c) for c in r.columns if c != "budget"])


@query("losses", LV + """SELECT doc_id, round(-ln(greatest(ps[level + 1], 1e-9)), 6) AS ce,
 round(((CASE WHEN level > 0 THEN -ln(1 - ps[1]) ELSE -ln(ps[1]) END) + (CASE WHEN level > 1 THEN -ln(ps[3] + ps[4]) ELSE -ln(1 - ps[3] - ps[4]) END) + (CASE WHEN level > 2 THEN -ln(ps[4]) ELSE -ln(1 - ps[4]) END)) / 3 + 0.5 * -ln(greatest(ps[level + 1], 1e-9)), 6) AS ordinal FROM d""")
def losses_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", r6(losses.cross_entropy(F.col("ps"), F.col("level")), "ce"), r6(losses.ordinal_loss(F.col("ps"), F.col("level")), "ordinal"))


@query("record_loss", LV + " SELECT source AS id, round(sum(0.5 * -ln(greatest(ps[level + 1], 1e-9))), 5) AS loss FROM d GROUP BY source")
def record_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _levels(spark, sf_dir).select(F.col("source").alias("id"), F.lit("best_next").alias("question"), F.lit("choice").alias("type"), F.col("ps").alias("p"), F.col("level").alias("label"))
    return losses.record_loss(d).withColumn("loss", F.round("loss", 5))


@query("pairwise_loss", f"WITH d AS (SELECT source, max(p) FILTER (toxic = 1) AS w, max(p) FILTER (toxic = 0) AS l FROM ({SD}) GROUP BY 1) SELECT source, round(ln(1 + exp(l - w)), 6) AS loss FROM d WHERE w IS NOT NULL AND l IS NOT NULL")
def pairwise_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.scored(spark, sf_dir).withColumn("won", F.col("toxic") == 1)
    return losses.pairwise_loss(d, "source", "won", "p").withColumn("loss", F.round("loss", 6))


# ------------------------------------------------------------------------------------------------ decisions and simulations

EVENT_SCORES = "SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS step, CASE WHEN event_id % 17 <> 0 THEN value / 1e2 END AS p_success, (event_id % 10) / 1e1 AS stuck, CASE WHEN event_id % 5 <> 0 THEN (event_id % 13) / 13e0 END AS escalate FROM events"
GUARD = f"""WITH s AS ({EVENT_SCORES}), e AS (SELECT *, step < 5 AS gate, coalesce(escalate >= 0.9, false) AS esc, coalesce(p_success < 0.12, false) AS low FROM s), g AS (SELECT *, sum((NOT gate AND NOT esc AND NOT low)::INT) OVER (PARTITION BY run_id ORDER BY step) AS grp FROM e),
k AS (SELECT *, CASE WHEN NOT gate AND NOT esc AND low THEN sum((NOT gate AND NOT esc AND low)::INT) OVER (PARTITION BY run_id, grp ORDER BY step) ELSE 0 END AS streak FROM g)
SELECT run_id, step, CAST(streak AS INTEGER) AS streak, CASE WHEN gate THEN 'continue' WHEN esc THEN 'escalate' WHEN low THEN CASE WHEN streak >= 2 THEN 'abort' ELSE 'continue' END WHEN coalesce(stuck >= 0.8, false) THEN 'escalate' ELSE 'continue' END AS decision FROM k"""
GUARD_CFG = scoring.GuardianConfig(escalate=0.9, stuck=0.8)


@query("guardian_batch", GUARD)
def guardian_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.guardian(B.sql(spark, sf_dir, EVENT_SCORES, "events"), GUARD_CFG).select("run_id", "step", "streak", "decision")


@query("guardian_stream", GUARD)
def guardian_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions from the stateful stream over files, run to the end of what is there."""
    import uuid

    from tracklore.streaming import guardian as G

    root = f"{shared_folder(spark)}/guardian-{uuid.uuid4().hex}"
    steps = B.sql(spark, sf_dir, EVENT_SCORES, "events")
    steps.repartition("run_id").sortWithinPartitions("run_id", "step").write.parquet(f"{root}/in")
    G.use_rocksdb(spark)
    stream = spark.readStream.schema(steps.schema).parquet(f"{root}/in")
    q = G.guard_stream(stream, GUARD_CFG, "append").writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("guardian_reordered", GUARD)
def guardian_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions from steps that come shuffled, over several batches, every tenth of them twice; the log has each once."""
    import uuid

    from tracklore.streaming import guardian as G

    root = f"{shared_folder(spark)}/reordered-{uuid.uuid4().hex}"
    steps = B.sql(spark, sf_dir, EVENT_SCORES, "events")
    again = steps.where(F.pmod(F.xxhash64("run_id", "step"), F.lit(10)) == 0)
    steps.unionByName(again).repartition(4, F.xxhash64("step", "run_id")).write.parquet(f"{root}/in")
    G.use_rocksdb(spark)
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    G.log_decisions(G.ordered_guard_stream(stream, GUARD_CFG, wait=1 << 20, idle_ms=None), f"{root}/log", f"{root}/state", available_now=True).awaitTermination()
    return G.read_log(spark, f"{root}/log")


@query("decide_once", f"WITH s AS ({EVENT_SCORES}) SELECT run_id, step, CASE WHEN step < 5 THEN 'continue' WHEN coalesce(escalate >= 0.7, false) THEN 'escalate' WHEN coalesce(p_success < CASE WHEN run_id % 2 = 0 THEN 0.06 ELSE 0.12 END, false) THEN 'abort' WHEN coalesce(stuck >= 0.5, false) THEN 'escalate' ELSE 'continue' END AS decision FROM s")
def decide_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.sql(spark, sf_dir, EVENT_SCORES, "events").withColumn("policy", F.when(F.col("run_id") % 2 == 0, "known").otherwise("other"))
    return scoring.decide_once(d, "fpr_5", {"*": {"fpr_5": 0.12}, "known": {"fpr_5": 0.06}}).select("run_id", "step", "decision")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count(F.lit(1)).cast("int").alias("n_steps"))
    d = B.sql(spark, sf_dir, OR, "orders").join(n, "run").withColumnRenamed("policy_model", "policy")
    d = d.withColumn("prefix_len", F.explode(F.sequence(F.lit(1), F.col("n_steps"))))
    p = ((F.col("run") * 7 + F.col("prefix_len") * 31) % 97 + 1) / F.lit(99.0)
    return d.select("run", F.concat_ws("@", "run", "prefix_len").alias("id"), "task_id", "policy", "outcome", "n_steps", "prefix_len", (F.col("prefix_len") / F.col("n_steps")).alias("prefix_frac"), p.alias("p"))


PT = f"WITH n AS (SELECT l_orderkey AS run, count(*) AS n_steps FROM lineitem GROUP BY 1), pt AS (SELECT run, task_id, policy_model AS policy, outcome, n_steps, k AS prefix_len, k / n_steps AS prefix_frac, ((run * 7 + k * 31) % 97 + 1) / 99.0::DOUBLE AS p FROM ({OR}) r JOIN n USING (run), range(1, 20) t(k) WHERE k <= n_steps)"
GRID = ", grid AS (SELECT round_even(0.02 + k * 0.01, 10) AS thr FROM range(0, 97) t(k))"
SIM = GRID + ", sim AS (SELECT thr, run, any_value(outcome) AS outcome, any_value(n_steps) AS n_steps, min(prefix_len) FILTER (prefix_frac >= 0.2 AND p < thr) AS a FROM pt, grid GROUP BY thr, run)"
MET = SIM + ", met AS (SELECT thr, count(*) AS runs, count(*) FILTER (outcome AND a IS NOT NULL) / greatest(1, count(*) FILTER (outcome)) AS fpr, count(*) FILTER (NOT outcome AND a IS NOT NULL) / greatest(1, count(*) FILTER (NOT outcome)) AS recall, coalesce(sum(n_steps - a), 0) / sum(n_steps) AS saved FROM sim GROUP BY thr)"


@query("abort_grid", PT + MET + " SELECT thr, runs, round(fpr, 6) AS fpr, round(recall, 6) AS recall, round(saved, 6) AS steps_saved FROM met")
def abort_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = simulate.abort_table(_points(spark, sf_dir), simulate.thresholds())
    return m.select("thr", "runs", r6("fpr", "fpr"), r6("recall", "recall"), r6("steps_saved", "steps_saved"))


@query("abort_thresholds", PT + MET + " SELECT budget::DOUBLE AS budget, coalesce(max(thr) FILTER (fpr <= budget), 0.0) AS threshold FROM met, (SELECT unnest([0.05, 0.1, 0.25]::DOUBLE[]) AS budget) GROUP BY budget")
def abort_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.pick_thresholds(simulate.abort_table(_points(spark, sf_dir), simulate.thresholds()))


@query("policy_operating_points", PT + GRID + """, sim AS (SELECT policy, run % 2 AS half, thr, run, any_value(outcome) AS o, any_value(n_steps) AS n, min(prefix_len) FILTER (prefix_frac >= 0.2 AND p < thr) AS a FROM pt, grid GROUP BY policy, half, thr, run),
met AS (SELECT policy, half, thr, count(*) AS runs, count(*) FILTER (o AND a IS NOT NULL) / greatest(1, count(*) FILTER (o)) AS fpr, count(*) FILTER (NOT o AND a IS NOT NULL) / greatest(1, count(*) FILTER (NOT o)) AS recall, count(*) FILTER (NOT o AND a IS NOT NULL) / greatest(1, count(a)) AS precision,
 count(a) / count(*) AS fired, coalesce(sum(n - a), 0) / greatest(1, sum(n)) AS steps_saved, avg(o::INT) AS resolve_rate, avg((o AND a IS NULL)::INT) AS resolve_rate_with_abort FROM sim GROUP BY ALL),
own AS (SELECT policy, budget, coalesce(max(thr) FILTER (fpr <= budget), 0.0)::DOUBLE AS threshold FROM met, (SELECT unnest([0.05, 0.1, 0.25]::DOUBLE[]) AS budget) WHERE half = 0 GROUP BY policy, budget HAVING max(runs) >= 100)
SELECT own.policy, own.threshold, own.budget, runs, round(fpr, 6) AS fpr, round(recall, 6) AS recall, round(precision, 6) AS precision, round(fired, 6) AS fired, round(steps_saved, 6) AS steps_saved, round(resolve_rate, 6) AS resolve_rate, round(resolve_rate_with_abort, 6) AS resolve_rate_with_abort
FROM own LEFT JOIN met ON met.half = 1 AND met.policy = own.policy AND met.thr::DOUBLE = own.threshold WHERE own.policy IN (SELECT policy FROM met WHERE half = 1 AND runs >= 100)""")
def policy_operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _points(spark, sf_dir)
    r = simulate.policy_operating_points(d.where("run % 2 = 0"), d.where("run % 2 = 1"), simulate.thresholds())
    return r.select(*[F.round(c, 6).alias(c) if t == "double" and c not in ("threshold", "budget") else c for c, t in r.dtypes])


LAST = PT + ", la AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY run ORDER BY prefix_frac DESC, run || '@' || prefix_len) = 1), ra AS (SELECT policy, avg(outcome::INT) AS rate FROM la GROUP BY 1), x AS (SELECT la.*, first_value(policy) OVER (PARTITION BY task_id ORDER BY rate DESC, policy) AS top FROM la JOIN ra USING (policy))"
PICK = LAST + ", pk AS (SELECT task_id, count(*) AS runs, arg_min(outcome::INT, struct_pack(a := -p, b := run)) AS model, arg_min(outcome::INT, struct_pack(a := n_steps, b := run)) AS shortest, avg(outcome::INT) AS random, max(outcome::INT) AS oracle, avg(outcome::INT) FILTER (policy = top) AS best_policy, count(DISTINCT policy) AS policies, min(outcome::INT) AS worst FROM x GROUP BY task_id HAVING count(*) >= 2)"


@query("best_of_group", PICK + " SELECT task_id, runs, CAST(model AS DOUBLE) AS model, CAST(shortest AS DOUBLE) AS shortest, round(random, 6) AS random, CAST(oracle AS DOUBLE) AS oracle, round(best_policy, 6) AS best_policy FROM pk")
def best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = simulate.picks(simulate.latest_scores(_points(spark, sf_dir)))
    return p.select("task_id", "runs", "model", "shortest", r6("random", "random"), "oracle", r6("best_policy", "best_policy"))


@query("pick_slices", PICK + ", sl AS (SELECT *, unnest(list_filter(['all', CASE WHEN oracle > 0 AND worst < 1 THEN 'mixed' END, CASE WHEN policies = 1 THEN 'same_policy' END, CASE WHEN policies > 1 THEN 'multi_policy' END], lambda s: s IS NOT NULL)) AS slice FROM pk) SELECT slice, count(*) AS groups, CAST(sum(runs) AS BIGINT) AS runs, round(avg(model), 6) AS model, round(avg(shortest), 6) AS shortest, round(avg(random), 6) AS random, round(avg(oracle), 6) AS oracle, round(avg(best_policy), 6) AS best_policy, round(avg(model - random), 6) AS lift, round(avg(model - best_policy), 6) AS lift_vs_best_policy FROM sl GROUP BY slice")
def pick_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simulate.pick_slices(simulate.picks(simulate.latest_scores(_points(spark, sf_dir))))
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in r.dtypes])


@query("within_policy", LAST + """, pk AS (SELECT task_id, policy, count(*) AS runs, arg_min(outcome::INT, struct_pack(a := -p, b := run)) AS model, arg_min(outcome::INT, struct_pack(a := n_steps, b := run)) AS shortest, avg(outcome::INT) AS random, max(outcome::INT) AS oracle FROM la GROUP BY task_id, policy HAVING count(*) >= 2)
SELECT policy, count(*) AS groups, CAST(sum(runs) AS BIGINT) AS runs, round(avg(model), 6) AS model, round(avg(shortest), 6) AS shortest, round(avg(random), 6) AS random, round(avg(oracle), 6) AS oracle, round(avg(random), 6) AS best_policy, round(avg(model - random), 6) AS lift, round(avg(model - random), 6) AS lift_vs_best_policy
FROM pk GROUP BY policy HAVING count(*) >= 10""")
def within_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simulate.within_policy(simulate.latest_scores(_points(spark, sf_dir)))
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in r.dtypes])


@query("best_of_n", LAST + """, dr AS (SELECT task_id, d, p, outcome::INT AS won, row_number() OVER (PARTITION BY task_id, d ORDER BY sha1('0:' || task_id || ':' || d || ':' || run)) AS k, count(*) OVER (PARTITION BY task_id, d) AS size FROM la, range(1, 201) t(d)),
g AS (SELECT n, task_id, d, arg_max(won, struct_pack(a := p, b := won)) AS model, max(won) FILTER (k = 1) AS random FROM dr, (SELECT unnest([1, 2, 4, 8]) AS n) WHERE k <= n AND size >= n GROUP BY n, task_id, d)
SELECT n, round(avg(model), 6) AS model, round(avg(random), 6) AS random, count(DISTINCT task_id) AS groups FROM g GROUP BY n""")
def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simulate.best_of_n(simulate.latest_scores(_points(spark, sf_dir)))
    return r.select("n", r6("model", "model"), r6("random", "random"), "groups")


@query("lift_interval")
def lift_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.lift_interval(simulate.picks(simulate.latest_scores(_points(spark, sf_dir))))


@query("answers", LV + " SELECT doc_id, round(p, 6) AS p_true, CASE WHEN p > 1 - p THEN 'true' ELSE 'false' END AS choice, round_even((greatest(p, 1 - p) - 0.5) / 0.5, 4) AS confidence FROM d")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.scored(spark, sf_dir).select("doc_id", F.lit("p_success").alias("question"), F.array(F.lit("false"), F.lit("true")).alias("keys"), F.array(1 - F.col("p"), F.col("p")).alias("calibrated"))
    return scoring.answers(d).select("doc_id", r6("p_true", "p_true"), "choice", "confidence")


@query("plug_in_scorer", "SELECT CAST(doc_id AS VARCHAR) AS id, 'p_success' AS question, round((n_chars % 10) / 10.0, 6) AS p_true FROM documents")
def plug_in_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("string").alias("state"))
    made = scoring.score_states(d, lambda: scoring.FunctionScorer(lambda s, q: {"p_success": [1 - int(s) % 10 / 10, int(s) % 10 / 10]}), ["p_success"])
    return made.select("id", "question", r6(F.element_at("p", 2), "p_true"))


# ------------------------------------------------------------------------------------------------ scored rows and records

#: Scored rows of three questions for each labelled document, every third of another variant.
SCORED_ROWS = f"""SELECT doc_id, source, lang, frac, CASE WHEN doc_id % 3 = 0 THEN 'misleading' WHEN doc_id % 3 = 1 THEN 'clean' END AS variant, p, quality, toxic FROM ({SD})"""


def _scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.sql(spark, sf_dir, SCORED_ROWS, "labels", "documents").withColumn("p", F.col("p").cast("double"))
    cell = lambda q, t, keys, label, p: F.struct(F.lit(q).alias("question"), F.lit(t).alias("type"), F.array(*map(F.lit, keys)).alias("keys"), label.cast("int").alias("label"), F.array(*p).alias("p"))
    p = F.col("p")
    rows = [
        cell("p_success", "noul", ["False", "True"], F.col("toxic"), [1 - p, p]), cell("progress", "score", "0123", F.col("quality") + 2 * F.col("toxic"), [p * 0.5, (1 - p) * 0.4, (1 - p) * 0.6, p * 0.5]),
        cell("best_next", "choice", ["option_1", "option_2", "option_3"], F.col("quality"), [p * 0.5, 1 - p, p * 0.5]),
    ]
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), "variant", F.inline(F.array(*rows)))


def _document_records(spark: SparkSession, sf_dir: str, known: str = "true") -> DataFrame:
    """Records of documents, with labels of their own: some masked, some unknown options. `known` says which have one."""
    d = B.table(spark, sf_dir, "documents").where(known)
    k = F.col("doc_id")
    return d.select(
        k.alias("id"), "source", F.when(F.col("lang") == "de", "tool").otherwise("swe").alias("domain"), ((k % 100) / 100.0).cast("double").alias("prefix_frac"), F.when(k % 5 != 0, k % 2 == 0).alias("p_success"),
        F.when(k % 7 != 0, (k % 4).cast("int")).alias("progress"), F.concat(F.lit("option_"), (k % 4).cast("string")).alias("best_next"),
    )


@query("known_rows", f"""WITH r AS ({SCORED_ROWS}) SELECT question, count(*) AS n, round(avg(prefix_frac), 6) AS frac FROM (SELECT unnest(['p_success', 'progress', 'best_next']) AS question, (doc_id % 100) / 100.0::DOUBLE AS prefix_frac FROM r JOIN documents USING (doc_id)
 WHERE documents.lang <> 'es' AND coalesce(variant, 'clean') = 'clean') GROUP BY question""")
def known_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows with a record, and what their records say."""
    records = _document_records(spark, sf_dir, "lang <> 'es'")
    d = evaluation.with_record(evaluation.known_rows(_scored_rows(spark, sf_dir), records), records, ["prefix_frac"])
    return d.groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prefix_frac"), 6).alias("frac"))


@query("fresh_labels", f"""WITH r AS ({SCORED_ROWS}), j AS (SELECT r.* FROM r JOIN documents USING (doc_id) WHERE documents.lang <> 'es')
SELECT doc_id AS id, 'p_success' AS question, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS label FROM j WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'progress', CAST(doc_id % 4 AS INTEGER) FROM j WHERE doc_id % 7 <> 0
UNION ALL SELECT doc_id, 'best_next', CASE WHEN doc_id % 4 = 0 THEN CAST(quality AS INTEGER) ELSE CAST(doc_id % 4 - 1 AS INTEGER) END FROM j""")
def fresh_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluation.with_fresh_labels(_scored_rows(spark, sf_dir), _document_records(spark, sf_dir, "lang <> 'es'"), ["p_success", "progress", "best_next"])
    return d.select("id", "question", "label")


@query("question_reports", f"""WITH d AS (SELECT *, {PROBS}::DOUBLE[] AS ps, quality + 2 * toxic AS level FROM ({SCORED_ROWS}) WHERE coalesce(variant, 'clean') = 'clean'), r AS (SELECT *, list_position(ps, list_max(ps)) - 1 AS pred, [p * 0.5, 1 - p, p * 0.5]::DOUBLE[] AS cs FROM d),
m AS (SELECT 'p_success' AS question, unnest(['n', 'positive_rate', 'accuracy', 'brier']) AS metric, unnest([count(*), avg(toxic), avg(((p >= 0.5)::INT = toxic)::INT), avg((p - toxic) * (p - toxic))]) AS value FROM r
UNION ALL SELECT 'progress', unnest(['n', 'accuracy', 'mae', 'within_one']), unnest([count(*), avg((pred = level)::INT), avg(abs(ps[2] + 2 * ps[3] + 3 * ps[4] - level)), avg((abs(pred - level) <= 1)::INT)]) FROM r
UNION ALL SELECT 'best_next', unnest(['n', 'top1', 'k_mean', 'nll']), unnest([count(*), avg((list_position(cs, list_max(cs)) - 1 = quality)::INT), 3, -avg(ln(cs[quality + 1]))]) FROM r) SELECT question, metric, round(value, 6) AS value FROM m""")
def question_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluation.reports(evaluation.clean(_scored_rows(spark, sf_dir)))
    return r.where("metric IN ('n', 'positive_rate', 'brier', 'mae', 'within_one', 'top1', 'k_mean') OR (metric = 'accuracy') OR (metric = 'nll' AND question = 'best_next')").withColumn("value", F.round("value", 6))


@query("raw_and_calibrated")
def raw_and_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluation.clean(_scored_rows(spark, sf_dir))
    return evaluation.raw_and_calibrated(d.where("id % 2 = 0"), d.where("id % 2 = 1"), least_rows=10)


@query("question_masks", "SELECT doc_id AS id, CASE WHEN coalesce(lang <> 'de', true) AND doc_id % 7 <> 0 THEN CAST(doc_id % 4 AS INTEGER) END AS progress FROM documents")
def question_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question kept, and masked in one domain."""
    d = evaluation.mask_question(_document_records(spark, sf_dir), "progress", "tool")
    return evaluation.keep_questions(d, ["progress"]).select(*[c for c in ("id", "progress", "p_success", "best_next") if c in evaluation.keep_questions(d, ["progress"]).columns])


@query("tool_text", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'ls ' || event_type END AS command, CASE WHEN event_id % 3 = 0 THEN trim(event_type || chr(10) || 'Error: x') ELSE event_type END || CASE WHEN event_id % 4 <> 0 THEN chr(10) || '[exit ' || (event_id % 4) || ']' ELSE '' END AS seen FROM events""")
def tool_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    given = F.when(k % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("command")))).otherwise(F.concat(F.lit("ls "), "event_type"))
    return B.table(spark, sf_dir, "events").select("event_id", X.tool_command(given).alias("command"), X.tool_observation(F.col("event_type"), k % 4, F.when(k % 3 == 0, "Error: x")).alias("seen"))


@query("turn_runs", SEG + """, f AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user' AND text <> ''), '') AS first FROM conversations GROUP BY conv_id)
SELECT 'turns/m' || '/' || 'shop/' || conv_id AS traj_id, trim('[shop customer-service task] ' || first, ' ' || chr(10) || chr(9)) AS task, conv_id % 2 = 0 AS outcome, CAST(count(*) AS INTEGER) AS n_steps, string_agg(action, '|' ORDER BY seg) AS actions FROM s JOIN f USING (conv_id) GROUP BY conv_id, first""")
def turn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as customer-service runs: task from the first user text, outcome from the score."""
    none = F.lit(None)
    calls = none.cast("array<struct<name:string,arguments:string>>")
    m = F.struct("turn", "role", F.col("text").alias("content"), calls.alias("tool_calls"), F.col("turn").cast("int").alias("turn_idx"))
    d = B.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ms"))
    messages = F.transform("ms", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), calls.alias("tool_calls"), x["turn"].cast("int").alias("turn_idx")))
    raw = d.select(
        F.lit("shop").alias("task_name"), F.lit("/models/m").alias("model_path"), F.lit("u").alias("user_model_path"), messages.alias("messages"), F.struct(F.when(F.col("conv_id") % 2 == 0, 1.0).otherwise(0.0).alias("score"), F.lit(True).alias("db_match")).alias("eval_result"),
        F.struct(F.col("conv_id").cast("string").alias("id"), F.lit(False).alias("is_correct"), F.lit("stop").alias("finish_reason"), F.lit(1.0).alias("duration_seconds")).alias("meta"),
    )
    out = convert.turn_based(raw).where("skip_reason IS NULL")
    return out.select("traj_id", "task", "outcome", F.size("steps").alias("n_steps"), F.array_join(F.transform("steps", lambda x: x["action"]), "|").alias("actions"))


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluation.clean(_scored_rows(spark, sf_dir)).withColumns({"id": F.col("id").cast("string"), "adapter": scoring.route(F.col("question"), {"best_next": "v1", "p_success": "v0"}, ["v1", "v0"])})
    return scoring.calibrated(d, {"v0": {"p_success": 2.0}, "v1": {"best_next": 1.0}})


@query("routed_answers", f"""SELECT CAST(doc_id AS VARCHAR) AS id, 'v0' AS adapter, 'p_success' AS question, round(1 / (1 + pow((1 - p) / p, 0.5)), 6) AS top FROM ({SCORED_ROWS}) WHERE p >= 0.5 AND coalesce(variant, 'clean') = 'clean'
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'v0', 'p_success', round(1 - 1 / (1 + pow((1 - p) / p, 0.5)), 6) FROM ({SCORED_ROWS}) WHERE p < 0.5 AND coalesce(variant, 'clean') = 'clean'
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'v1', 'best_next', round(greatest(1 - p, p * 0.5), 6) FROM ({SCORED_ROWS}) WHERE coalesce(variant, 'clean') = 'clean'""")
def routed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers under the temperature of the adapter that a question goes to."""
    return _answered(spark, sf_dir).where("question <> 'progress'").select("id", "adapter", "question", r6(F.array_max("calibrated"), "top"))


@query("best_candidates", f"SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN p * 0.5 >= 1 - p THEN 'option_1' ELSE 'option_2' END AS choice, round(greatest(1 - p, p * 0.5), 6) AS p FROM ({SCORED_ROWS}) WHERE coalesce(variant, 'clean') = 'clean'")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.best_of(_answered(spark, sf_dir)).select("id", "choice", r6("p", "p"))


@query("answers_as_json", f"""SELECT CAST(doc_id AS VARCHAR) AS id, 3 AS n, CASE WHEN p * 0.5 >= 1 - p THEN 'option_1' ELSE 'option_2' END AS choice, round(p * 0 + (1 - p) * 0.4 + (1 - p) * 1.2 + p * 1.5, 6) AS expected FROM ({SCORED_ROWS}) WHERE coalesce(variant, 'clean') = 'clean'""")
def answers_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers of a record as one object, read back."""
    d = scoring.answers_json(_answered(spark, sf_dir))
    get = lambda path: F.get_json_object("answers", path)
    return d.select("id", F.json_array_length(F.to_json(F.json_object_keys("answers"))).alias("n"), get("$.best_next.choice").alias("choice"), F.round(get("$.progress.expected").cast("double"), 6).alias("expected"))


@query("heuristics", None)
def heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = features.add_features(_rendered(spark, sf_dir))
    return d.select("id", *[c.alias(n) for n, c in features.heuristic_scores().items()])


@query("shuffle_order", f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {h01('s9', 'doc_id')}, doc_id) AS BIGINT) AS place FROM documents")
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a seeded shuffle."""
    return splits.with_place(B.table(spark, sf_dir, "documents").select("doc_id"), "s9", "doc_id")


@query("run_content", f"SELECT min(run) AS run, count(*) AS copies FROM (SELECT run, string_agg(chr(31) || action || chr(30) || observation, '' ORDER BY i) AS body FROM ({OS}) GROUP BY run) GROUP BY body")
def run_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the same steps, whatever their tasks, by content hash."""
    d = B.order_runs(spark, sf_dir).withColumns({"task": F.lit("t"), "policy_model": F.lit("p")}).withColumn("content", splits.content_hash())
    first = splits.dedup_first(d.select("run", "content"), F.col("content"), ["run"])
    return first.join(d.groupBy("content").agg(F.count(F.lit(1)).alias("copies")), "content").select("run", "copies")
