"""Content dedup, hash splits, sampling and success/failure pairs.

Sampling is by hash order: a seed and a key give each row a number in [0, 1), so a sample is the same on any cluster. It
agrees with other libraries' seeded generators in distribution, not row by row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions.arrays import sigma_hash
from tracklore.functions.text import repo_key

SEED = "tracklore-v1"
HOLDOUT = "verified_holdout"


def content_hash(with_steps: bool = True) -> Column:
    """SHA-1 over task, policy, scaffold and, in order, each action and observation."""
    head = [F.col("task"), F.col("policy_model"), F.col("scaffold")]
    body = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("\x1f"), s["action"], F.lit("\x1e"), s["observation"])), "")
    return F.sha1(F.concat_ws("\x1f", *head, *([body] if with_steps else [])))


def dedup_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in the given order. Rows are aggregated before they travel, not sorted: a task sends one whole
    row of each key, so a hot key costs one row per task."""
    names = df.columns
    best = F.min_by(F.struct(*names), F.struct(*order))
    return df.groupBy(key.alias("_key")).agg(best.alias("_row")).select("_row.*")


def bucket_of(key: Column, seed: str = SEED) -> Column:
    """int(sha1(seed:key)) mod 100. The digest's four chunks of ten hex digits count, since 16 ** 10 is 76 mod 100."""
    h = F.sha1(F.concat(F.lit(seed + ":"), key))
    chunk = [F.conv(F.substring(h, 10 * i + 1, 10), 16, 10).cast("long") for i in range(4)]
    return ((76 * ((chunk[0] + chunk[1] + chunk[2]) % 100) + chunk[3] % 100) % 100).cast("int")


def assign_split(repo: Column, seed: str = SEED, dev: int = 10, test: int = 10) -> Column:
    """train, dev or test by the hash of the canonical key; keys that are no repository hash in lower case."""
    key = F.when(F.contains(repo, F.lit("/")), repo_key(repo)).otherwise(F.lower(repo))
    b = bucket_of(key, seed)
    return F.when(b < 100 - dev - test, "train").when(b < 100 - test, "dev").otherwise("test")


def with_split(df: DataFrame, held_repos: DataFrame | None = None, held_ids: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """Adds split; held-out repositories and task ids come before the hash."""
    df = df.withColumn("_repo", repo_key("repo_or_site"))
    held = F.lit(False)
    if held_repos is not None:
        df = df.join(held_repos.select(F.lower("repo").alias("_repo")).distinct().withColumn("_hr", F.lit(True)), "_repo", "left")
        held = held | F.coalesce("_hr", F.lit(False))
    if held_ids is not None:
        df = df.join(held_ids.select("task_id").distinct().withColumn("_hi", F.lit(True)), "task_id", "left")
        held = held | F.coalesce("_hi", F.lit(False))
    return df.withColumn("split", F.when(held, HOLDOUT).otherwise(assign_split(F.col("_repo"), seed))).drop("_repo", "_hr", "_hi")


def split_table(dfs: list[DataFrame], held_repos: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """(repo, split) of every repository in the tables."""
    repos = None
    for d in dfs:
        r = d.select(repo_key("repo_or_site").alias("repo"))
        repos = r if repos is None else repos.unionByName(r)
    repos = repos.where("repo IS NOT NULL").distinct().withColumnRenamed("repo", "repo_or_site").withColumn("task_id", F.lit(None).cast("string"))
    return with_split(repos, held_repos, None, seed).select(F.col("repo_or_site").alias("repo"), "split")


def sample_n(df: DataFrame, n: int, seed: str, key: Column) -> DataFrame:
    """n rows, the first in hash order: a top-n, each task sends n rows at most."""
    return df.orderBy(sigma_hash(seed, key), key).limit(n)


def sample_train(df: DataFrame, n: int, seed: str, key: str = "traj_id") -> DataFrame:
    """n rows of the train split; other splits whole."""
    train = sample_n(df.where("split = 'train'"), n, seed, F.col(key))
    return df.where("split <> 'train' OR split IS NULL").unionByName(train)


def sample_whole(df: DataFrame, n_records: int, seed: str, unit: str = "traj_id", tier: Column | None = None) -> DataFrame:
    """Records of whole units, taken in order of tier and hash until there are at least n_records; the last unit is
    whole. The running total is over one row per unit, summed per hash range first."""
    first = tier if tier is not None else F.lit(0)
    units = df.groupBy(unit).agg(F.count(F.lit(1)).alias("_c"), F.min(first).alias("_tier")).withColumn("_o", sigma_hash(seed, F.col(unit)))
    units = units.withColumn("_r", (F.col("_tier") * 1024 + F.floor(F.col("_o") * 1024)).cast("long"))
    ranges = units.groupBy("_r").agg(F.sum("_c").alias("_s"))
    start = F.coalesce(F.sum("_s").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 1024 rows a tier
    units = units.join(F.broadcast(ranges.select("_r", start.alias("_start"))), "_r").where(F.col("_start") < n_records)
    w = Window.partitionBy("_r").orderBy("_o", unit).rowsBetween(Window.unboundedPreceding, 0)
    taken = units.withColumn("_cum", F.col("_start") + F.sum("_c").over(w)).where(F.col("_cum") - F.col("_c") < n_records)
    return df.join(taken.select(unit), unit, "left_semi")


def mixed_first(df: DataFrame, n_records: int, per_traj: int, seed: str) -> DataFrame:
    """At most per_traj prefixes of each trajectory, trajectories of (task, policy) groups with both outcomes first."""
    both = df.groupBy("task_id", "policy_model").agg((F.bool_or("outcome") & ~F.bool_and("outcome")).alias("_mixed"))
    w = Window.partitionBy("traj_id").orderBy(sigma_hash(seed, F.col("id")), "id")
    df = df.join(both, ["task_id", "policy_model"]).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_traj)
    return sample_whole(df, n_records, seed, "traj_id", F.when(F.col("_mixed"), 0).otherwise(1)).drop("_mixed", "_k")


def per_class(df: DataFrame, k: int, seed: str, cls: str, key: str) -> DataFrame:
    """k rows of each class by hash order."""
    w = Window.partitionBy(cls).orderBy(sigma_hash(seed, F.col(key)), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; a key listed twice counts once."""
    return df.join(keys.select(key), key, "left_semi")


def without(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed, rows without a key among them."""
    return df.join(used.select(key), key, "left_anti")


def shuffled(df: DataFrame, seed: str, key: str) -> DataFrame:
    return df.orderBy(sigma_hash(seed, F.col(key)), key)


def with_place(df: DataFrame, seed: str, key: str, ranges: int = 1024) -> DataFrame:
    """Adds place, from 1, in the order of `shuffled`: rows are numbered within ranges of the hash, after the rows of the ranges
    before, so no task sees all rows. Keys are distinct."""
    df = df.withColumn("_o", sigma_hash(seed, F.col(key))).withColumn("_r", F.floor(F.col("_o") * ranges).cast("int"))
    sizes = df.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as ranges
    df = df.join(F.broadcast(sizes.select("_r", before.alias("_before"))), "_r")
    return df.withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy("_r").orderBy("_o", key))).drop("_o", "_r", "_before")


def policy_shown(seed: str, rate: float = 0.3, unknown: str = "unknown", length: Column | None = None) -> Column:
    """The policy's name, or `unknown` for a share of the prefixes. `length` is the prefix's, by default of its row."""
    return F.when(sigma_hash(seed, F.col("traj_id"), F.col("prefix_len") if length is None else length) < rate, F.lit(unknown)).otherwise(F.col("policy_model"))


def strict_prefixes(df: DataFrame, last_action: Column) -> DataFrame:
    """Adds drop_reason: the prefix is the whole run, or its last visible action ends the run; null for rows to keep."""
    return df.withColumn("drop_reason", F.when(F.col("prefix_len") >= F.col("n_steps"), "full prefix").when(last_action.isin("submit", "finish"), "finish visible"))


def pair_outcomes(df: DataFrame, window: float = 0.1, seed: str = SEED) -> DataFrame:
    """Adds pair_id: each success takes the nearest unused failure of its (task, policy) within the window of run shares.

    Successes choose in hash order; of failures equally near, the first in hash order. The matching is sequential within
    a group, so it runs per group in Python; a group is the runs of one policy on one task, of which five narrow columns
    travel. Free failures are kept by share; those used up are skipped by pointers, so a group costs its size times a
    logarithm. Rows with neither partner nor group have null. df: id, task_id, policy_model, outcome, prefix_frac."""
    cols = df.select("id", "task_id", "policy_model", "outcome", "prefix_frac")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(nearest_pairs(pdf["id"].tolist(), pdf["outcome"].tolist(), pdf["prefix_frac"].tolist(), window, seed), columns=["id", "pair_id"])

    pairs = cols.groupBy("task_id", "policy_model").applyInPandas(match, "id string, pair_id string")
    return df.join(pairs, "id", "left")


def nearest_pairs(ids: list[str], won: list[bool], fracs: list[float], window: float, seed: str) -> list[tuple[str, str]]:
    """(id, pair id) of both sides of each pair of a group."""
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha1(f"{seed}:{ids[i]}".encode()).hexdigest()[:13], ids[i]))
    free: dict[float, deque[tuple[int, str]]] = {}
    for turn, i in enumerate(order):
        if not won[i]:
            free.setdefault(fracs[i], deque()).append((turn, ids[i]))
    shares = sorted(free)
    ups, downs = list(range(len(shares) + 1)), list(range(len(shares) + 1))  # the next share with a free failure; downs from 1

    def follow(link: list[int], k: int) -> int:
        end = k
        while link[end] != end:
            end = link[end]
        while link[k] != end:
            link[k], k = end, link[k]
        return end

    out = []
    for i in order:
        if not won[i]:
            continue
        at = bisect_left(shares, fracs[i])
        up, down = follow(ups, at), follow(downs, at) - 1
        near = [(abs(shares[k] - fracs[i]), free[shares[k]][0][0], k) for k in (up, down) if 0 <= k < len(shares) and abs(shares[k] - fracs[i]) <= window]
        if near:
            k = min(near)[2]
            _, other = free[shares[k]].popleft()
            if not free[shares[k]]:
                ups[k], downs[k + 1] = k + 1, k
            pair = hashlib.sha1(f"{ids[i]}|{other}".encode()).hexdigest()[:16]
            out += [(ids[i], pair), (other, pair)]
    return out


def pair_order(seed: str = SEED) -> list[Column]:
    """Sort key that shuffles records but leaves the two of a pair next to each other."""
    unit = F.coalesce(F.col("pair_id"), F.col("id"))
    return [sigma_hash(seed, unit), unit, sigma_hash(seed, F.col("id"))]
