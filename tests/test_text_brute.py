"""Text functions, states with a real tokenizer and features against plain Python."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tracklore.functions import text as X
from tracklore.operators import features, labels, state
from tracklore.sources import convert, files

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BITS = [
    "=" * 12, "-" * 7, "ab   cd", "  x", "word", "\n", "\n", "\n\n\n", "\r\n", "\x1b[31mred\x1b[0m", "task resolved ok", "RESOLVED", "(Open file: a.py)", "bash-$ ", "======", "Error: bad", "3 passed, 1 failed", "tail   ", "\t", "é ñ", "...", "#" * 9, "line of text here",
]


def py(pattern):
    """The pattern for Python: its flags d and U are Python's own way."""
    return re.compile(re.sub(r"^\(\?([a-zA-Z]+)\)", lambda m: f"(?{f})" if (f := m[1].replace("d", "").replace("U", "")) else "", pattern))


def lines(s):
    out = re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", s)
    return out[:-1] if out[-1] == "" else out


def collapse(s):
    return py(X.INNER_SPACES).sub("  ", py(X.PADDING).sub(lambda m: m[1] * 8, s))


def clean(s):
    s = collapse(s)
    for p in (X.ANSI, X.VERDICT, X.FOOTER, X.RULE):
        s = py(p).sub("", s)
    s = "\n".join(x.rstrip() for x in lines(s))
    return re.sub(r"\n{3,}", "\n\n", s).strip()


def tokens(s):
    return int(len(s) / 3.5 + 0.999)


def presliced(s, keep):
    if len(s) <= 2 * keep + 64:
        return s
    gone = s[keep:-keep]
    return f"{s[:keep]}\n... [{gone.count(chr(10))} lines omitted] ...\n{s[-keep:]}"


def middle_cut(s, most):
    s = presliced(s, most * 6)
    if tokens(s) <= most:
        return s
    own, used, head = lines(s), 0, 0
    while head < len(own) and used + tokens(own[head] + "\n") <= int(most * 0.6):
        used += tokens(own[head] + "\n")
        head += 1
    used = tail = 0
    while tail < len(own) - head and used + tokens(own[-1 - tail] + "\n") <= most - int(most * 0.6):
        used += tokens(own[-1 - tail] + "\n")
        tail += 1
    gone = len(own) - head - tail
    return s if gone <= 0 else "\n".join([*own[:head], f"... [{gone} lines omitted] ...", *own[len(own) - tail :]])


def test_cleaning_and_cutting(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", "x" * 5000, "\n".join(f"line {i} of it" for i in range(300))]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in d.select("i", X.collapse_padding("t").alias("a"), X.clean_observation("t").alias("b"), X.truncate_middle("t", 40).alias("c"), X.join_parts("t", F.lit(" x "), F.lit(None)).alias("j")).collect():
        t = texts[r.i]
        assert (r.a, r.b, r.c) == (collapse(t), clean(t), middle_cut(t, 40)), t
        assert r.j == "\n\n".join(x for x in (t.strip(), "x") if x)


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="tokenizer absent")
def test_states_with_a_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    count = lambda s: len(tok.encode(s, add_special_tokens=False).ids)
    assert state.counter(TOKENIZER)("a few words, and 12 more") == count("a few words, and 12 more")
    rng = random.Random(7)
    runs = [(f"t{i}", "Mend the thing " * rng.randint(1, 30), "m", [("ls -la", " ".join(rng.choice(["résumé", "x", "longword", "12"]) for _ in range(rng.randint(0, 60))), None) for _ in range(rng.randint(1, 12))]) for i in range(30)]
    d = labels.expand_prefixes(spark.createDataFrame(runs, "traj_id string, task string, policy_model string, steps array<struct<action:string,observation:string,thought:string>>"))
    cfg = state.StateConfig(budget=150, recent_steps=3, safety=40, tokenizer=TOKENIZER)
    rows = state.render_states(d, cfg).collect()
    exact = 0
    for r in rows:
        n = count(r.state)
        assert n <= cfg.budget
        if r.state_tokens > cfg.budget - cfg.safety:
            assert r.state_tokens == n
            exact += 1
    assert exact > 20
    for text in ("a" * 300, "some words " * 40, "é" * 90):
        cut = state.cap(text, count, 12)
        assert count(cut) <= 12 and cut.endswith("...") and text.startswith(cut[:-3])
        assert count(text[: len(cut) - 3 + 1] + "...") > 12 or text[: len(cut) - 3 + 1].endswith(" ")


def plain_features(row):
    s = row.state
    between = lambda a, b: s[s.index(a) + len(a) : s.rindex(b)] if a in s and b in s else ""
    recent, hist = between("<recent>", "</recent>"), between("<hist>", "</hist>")
    bodies = re.split(r"(?m)^## step \d+$", recent)[1:]
    seen = [b.split("\n", 2)[2] if b.count("\n") >= 2 else b.split("\n")[-1] for b in bodies]
    acts = [a.strip() for a in re.findall(r"(?m)^\$ (.*)$", recent)]
    error = py(features.ERROR_WORD)
    last = seen[-1] if seen else ""
    passed, failed = re.findall(r"\b(\d+) passed\b", last), re.findall(r"\b(\d+) (?:failed|errors?)\b", last)
    omitted = re.search(r"\.\.\. (\d+) earlier steps omitted", hist)
    return [
        row.prefix_len, row.state_tokens, len(bodies), len(re.findall(r"(?m)^\d+\. \$ ", hist)), int(omitted[1]) if omitted else 0, len(error.findall(recent)), sum(bool(error.search(x)) for x in seen), len(acts) - len(set(acts)), len(set(acts)),
        len(py(features.EDIT_LINE).findall(recent)), len(py(features.TEST_LINE).findall(recent)), int(passed[-1]) if passed else 0, int(failed[-1]) if failed else 0, bool(passed or failed), (acts[-1].split(" ")[0] if acts else "") in ("submit", "finish"), last.strip() == "(no output)",
        row.stuck, row.progress, row.policy_shown != "unknown",
    ]


def test_features_against_plain_counts(spark):
    rng = random.Random(9)
    acts = [("pytest -q", "3 passed, 2 failed in 1s"), ("edit 1:5", "File updated"), ("ls", ""), ("python run.py", "Traceback (most recent call last)\nValueError: bad"), ("submit", "done"), ("open a.py", "12: x\nSyntaxError: no")]
    runs = [(f"t{i}", "k", "Mend it", rng.choice(["m", None]), bool(rng.randint(0, 1)), [(*rng.choice(acts), None) for _ in range(rng.randint(1, 14))]) for i in range(40)]
    d = spark.createDataFrame(runs, "traj_id string, task_id string, task string, policy_model string, outcome boolean, steps array<struct<action:string,observation:string,thought:string>>")
    d = labels.derive(labels.with_policy_rate(labels.with_task_stats(d)))
    d = labels.label_prefixes(labels.expand_prefixes(d)).withColumn("policy_shown", F.coalesce("policy_model", F.lit("unknown")))
    rows = features.add_features(state.render_states(d, state.StateConfig(budget=160, recent_steps=4, safety=10), policy=F.col("policy_shown"))).collect()
    assert len(rows) > 150
    for r in rows:
        assert list(r.features_by_name) == [float(x) for x in plain_features(r)], r.state
    v = features.feature_vector(features.add_features(state.render_states(d, policy=F.col("policy_shown")))).select("features", "features_by_name").first()
    assert v.features.toArray().tolist() == list(v.features_by_name)


def test_hidden_files_and_skip_counts(spark, tmp_path):
    spark.createDataFrame([(1,)], "n int").write.parquet(str(tmp_path / "in" / "a"))
    spark.createDataFrame([(2,)], "n int").write.parquet(str(tmp_path / "in" / ".cache" / "b"))
    assert [r.n for r in files.scan_parquet(spark, str(tmp_path / "in"), ["n"]).collect()] == [1]
    d = spark.createDataFrame([(0,), (1,), (2,), (None,), (1,)], "resolved int")
    d.write.parquet(str(tmp_path / "labels"))
    kept, dropped = convert.labelled(spark.read.parquet(str(tmp_path / "labels")))
    assert sorted(r.resolved for r in kept.collect()) == [0, 1, 1] and dropped.first().asDict() == {"unlabelled": 2}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(resolved" in plan
