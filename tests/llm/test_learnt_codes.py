"""Positive-unlabelled quality, importance resampling and vector codes against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklore.llm import importance, quality, vector_codes, word_bytes

ODD_TEXTS = [None, "", " \n", "Ünïcode wörter ÄB 12x", "a" * 5000 + " b", "x" * 48 + " " + "y" * 49 + " z", "UPPER case, UPPER", "--- ###", "één", "tail word", "no blank at end", "\x00\x7f a", "emoji 😀 ok"]


# ------------------------------------------------------------------------------------------------ importance

def plain_runs(text, most=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_hashes_of_runs(most):
    rng = random.Random(4)
    texts = ODD_TEXTS + ["".join(rng.choice("abCZ 09é\n,") for _ in range(rng.randrange(60))) for _ in range(300)]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array([*texts, "left out"], kind)
        for arr, own in ((whole.slice(0, len(texts)), texts), (whole.slice(3, 50), texts[3:53])):
            words, runs = importance.hashed_runs(arr, most)
            got = [[] for _ in own]
            for row, crc in runs:
                for i, c in zip(row.tolist(), crc.tolist()):
                    got[i].append(c)
            for i, t in enumerate(own):
                w, want = plain_runs(t, most)
                assert words[i] == len(w) and got[i] == [zlib.crc32(x.encode()) for x in want], t
    assert importance.hashed_runs(pa.array([], pa.string()))[0].tolist() == []


def plain_rank(docs, target, percent=25, least=20, buckets=10_000, seed=7):
    counts = []
    for texts in ([t for _, t in docs], target):
        c = [0] * buckets
        for t in texts:
            for r in plain_runs(t)[1]:
                c[zlib.crc32(r.encode()) % buckets] += 1
        counts.append(c)
    s, t = counts
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t)]
    out = []
    for at, (i, text) in enumerate(docs):
        w, runs = plain_runs(text)
        weight = sum(gain[zlib.crc32(r.encode()) % buckets] for r in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = [r for r in out if r[1] >= least]
    may.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, may[: percent * len(may) // 100]


def test_ranks_against_plain_python(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    text = lambda lo: " ".join(rng.choice(vocab[lo : lo + 150]) for _ in range(rng.randrange(10, 60)))
    docs = [(i, text(rng.choice([0, 150]))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs += [(None, text(0)) for _ in range(5)] + [(7, docs[7][1])] * 150  # ids that are null, one repeated for a third of the rows
    target = [text(150) for _ in range(40)] + [None, ""]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, _id int, rank string").repartition(5)
    t = spark.createDataFrame([(x, 2) for x in target], "text string, item int")
    rows = importance.importance_rank(d, t).collect()
    want, drawn = plain_rank(docs, target)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score) for r in rows], key=key) == sorted([(r[0], *r[2:]) for r in want], key=key)
    got = sorted([r for r in rows if r["rank"]], key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in got] == [(r[0], r[4]) for r in drawn]
    out = importance.resample(d, t)
    assert out.columns == [*d.columns, "importance_rank"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in docs if i in {r[0] for r in drawn})
    assert importance.importance_rank(d.where("false"), t).count() == 0
    plain, _ = plain_rank(docs, [])
    bare = importance.importance_rank(d, t.where("false")).collect()
    assert sorted([(r.doc_id, r.weight) for r in bare], key=key) == sorted([(r[0], r[3]) for r in plain], key=key)


# ------------------------------------------------------------------------------------------------ vector codes

def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = [(i, l, v) for i, l, v in rows if v and all(x is not None and math.isfinite(x) and math.isfinite(x * 4096) for x in v)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = len(order[0][2])
    rows, order = ([(i, l, [math.floor(4096 * x) for x in v] + [0] * (-dim % parts)) for i, l, v in own if len(v) == dim] for own in (rows, order))
    w = len(order[0][2]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for _, _, v in order[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: [min((gap(x, e), j) for j, e in enumerate(books[p])) for p, x in enumerate(cut(v))]
    for _ in range(rounds):
        own = [[[] for _ in part] for part in books]
        for _, _, v in rows:
            for p, (_, j) in enumerate(near(v)):
                own[p][j].append(cut(v)[p])
        books = [[[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(os, part)] for os, part in zip(own, books)]
    out = [(i, "".join(f"{j:02x}" for _, j in near(v)), sum(d for d, _ in near(v)), l) for i, l, v in rows]
    total = {}
    for _, _, e, l in out:
        total[l] = total.get(l, 0) + e
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, c, fits(e), fits(total[l])) for i, c, e, l in out], books


def check_codes(spark, rows, kind="long", **how):
    d = spark.createDataFrame([(i, v, l, "x", 0) for i, l, v in rows], f"vec_id {kind}, embedding array<double>, label int, _at string, code int").repartition(3)
    taken = []
    out, books = vector_codes.vector_codes(d, taken=taken, **how)
    want, plain = plain_codes(rows, **how)
    got = out.collect()
    assert books == plain
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for p in plain for e in p for x in e).encode()).hexdigest()}
    return taken


def test_codes_against_plain_lloyd(spark):
    rng = random.Random(8)
    centre = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, rng.choice([None, 1, 2]), [x + rng.gauss(0, 0.1) for x in rng.choice(centre)]) for i in range(600)]
    odd = [(700, 1, None), (701, 1, [1.0, None] * 8), (702, 1, [float("nan")] * 16), (703, 1, [float("inf")] * 16), (704, 2, [0.5] * 3), (705, 2, []), (None, None, [0.25] * 16), (706, None, [1e308] * 16)]
    taken = check_codes(spark, rows + odd + rows[5:6] * 300)
    assert taken[0] == 901 * 8 * 16 and max(taken[1:]) < 0.6 * taken[0] and taken[-1] < 0.25 * taken[0]  # bounds save most distances


def test_codes_with_ties_few_rows_and_odd_lengths(spark):
    rng = random.Random(9)
    grid = [(i, i % 3, [rng.randrange(3) / 4096 * 2 for _ in range(16)]) for i in range(300)]  # many equal distances
    check_codes(spark, grid)
    check_codes(spark, grid, rounds=0)
    check_codes(spark, [(i, 0, v[:11]) for i, _, v in grid[:40]], parts=4, entries=5, rounds=3)
    check_codes(spark, [(i, 0, v) for i, _, v in grid[:3]])
    check_codes(spark, [(None, None, v) for _, _, v in grid[:30]])
    empty = spark.createDataFrame([(1, None, 0)], "vec_id long, embedding array<float>, label int")
    out, books = vector_codes.vector_codes(empty)
    assert out.count() == 0 and books == [] and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_of_huge_components(spark):
    rng = random.Random(10)
    far = [(i, 1, [rng.choice([1.0, 3e5, 1e9, 1e30, 1e200]) * rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    check_codes(spark, far, rounds=3)


def test_decoded_vectors(spark):
    rows = [(i, [i / 8.0] * 8) for i in range(16)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, books = vector_codes.vector_codes(d, label_col=None)
    got = {r.vec_id: r.decoded for r in vector_codes.decoded(out, books).collect()}
    assert got == {i: v for i, v in rows}  # as many entries as vectors
    assert vector_codes.decoded(out.withColumn("code", F.lit(None).cast("string")), books).where("decoded IS NOT NULL").count() == 0


def test_bounds_stay_on_their_side():
    rng = np.random.default_rng(3)
    upper, lower = rng.random((50, 4)) * 1e4, rng.random((50, 4, 9)) * 1e4
    lower[0] = 0
    up, scale, q = vector_codes._packed(upper, lower)
    assert (up.astype(float) >= upper).all() and (q * scale[..., None].astype(float) <= lower).all() and (lower - q * scale[..., None].astype(float)).max() < 1e4 / 200
    for v in (0, 5, -5, 1 << 41, -(1 << 41), (1 << 200) + 12345, -(1 << 200) - 12345):
        assert sum(x["v"] << (vector_codes.LIMB * x["limb"]) for x in vector_codes._limbs(0, v)) == v
        assert all(abs(x["v"]) <= 1 << 40 for x in vector_codes._limbs(0, v))


# ------------------------------------------------------------------------------------------------ quality

def test_shapes_against_plain_python():
    texts = [*ODD_TEXTS, "a a b a b\nA!! B!! C!!\na a b a b\n", "one two three four five one two three four five", "x | y | z$$$"]
    got = quality.shapes(pa.array(texts))
    col = {f: got[:, i] for i, f in enumerate(quality.FEATURES)}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = max(1, len(words))
        solid = max(1, len(re.sub(r"[\x20\x09-\x0D]", "", t).encode()))
        again = lambda xs: (len(xs) - len(set(xs))) / max(1, len(xs))
        runs = lambda k: [tuple(words[j : j + k]) for j in range(len(words) - k + 1)]
        lines = [x for x in t.split("\n") if x]
        want = {
            "upper": len(re.findall("[A-Z]", t)) / solid, "bang": t.count("!") / solid, "odd": len(re.findall(r"[#$%&*+/<=>@\[\\\]^_`{|}~]", t)) / solid, "same": sum(a == b for a, b in zip(words, words[1:])) / n,
            "words_again": again(words), "pairs_again": again(runs(2)), "fives_again": again(runs(5)), "lines_again": again(lines), "marked": sum(bool(re.search(r"[#$%&*+/<=>@\[\\\]^_`{|}~]", w)) for w in words) / n,
            "words": math.log1p(len(words)), "bias": 1.0, "long": sum(len(w.encode()) > 24 for w in words) / n, "root_bang": math.sqrt(t.count("!") / solid),
        }
        for f, x in want.items():
            assert col[f][i] == pytest.approx(x), (f, t[:50])


def sentences(rng, n):
    return " ".join(rng.choice(["the", "river", "was", "cold", "and", "they", "walked", "home.", "Later", "it", "rained,", "so"]) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(n))


def test_quality_from_positives_and_unlabelled(spark):
    rng = random.Random(12)
    rows = []
    for i in range(3000):
        good = rng.random() < 0.7
        text = sentences(rng, rng.randrange(20, 80))
        if not good:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: " ".join([t.split()[0]] * 40)])(text)
        rows.append((i, text, int(good)))
    odd = [(None, None), (-1, ""), (-2, None), (-3, "BUY!! NOW!! " * 50_000), (-1, "")]
    d = spark.createDataFrame([(i, t, 5, "x") for i, t, _ in rows] + [(i, t, 6, "y") for i, t in odd], "doc_id long, text string, score int, _x string")
    known = [i for i, _, y in rows if y and i % 3 == 0 and i % 5]
    trusted = spark.createDataFrame([(i, 1) for i in known + known[:5] + [None]], "doc_id long, quality int")
    out, model = quality.train_and_score(d, trusted, training=F.col("_id") % 5 != 0)
    got = out.collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 3005 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert abs(model.prior - 0.7) < 0.06
    held = [(by[i].predicted, y) for i, _, y in rows if i % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.98 * len(held)
    assert by[-3].predicted == 0 and by[-1].score == by[-2].score == by[None].score
    again = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert all(again[i] == by[i].score for i in by)
    none, model = quality.train_and_score(d, trusted.where("false"))
    assert {r.score for r in none.collect()} == {0.5} and model.prior is None
    assert quality.train_and_score(d.where("false"), trusted)[0].count() == 0


def test_the_risk_against_its_formula(spark):
    """The fitted weights have the least non-negative risk: no step away from them, taken by the formula row by row, lowers it."""
    rng = np.random.default_rng(2)
    n, k = 400, len(quality.FEATURES)
    x = rng.normal(size=(n, k)).astype(np.float32)
    x[:, -1] = 1
    good = x[:, 0] + 0.3 * rng.normal(size=n) > 0
    trusted, block = good & (rng.random(n) < 0.5), rng.integers(0, quality.BLOCKS, n)
    rows = [(bytearray(x[i].tobytes()), bool(trusted[i]), int(block[i])) for i in range(n)]
    cells = spark.createDataFrame(rows, "_x binary, _trusted boolean, _block int")
    zero, one, prior, ridge = np.zeros(k), np.ones(k), 0.5, 1e-1
    w = quality._newton(cells, zero, one, prior, ridge, 40)

    def risk(w):
        z = x.astype(float) @ w
        soft = lambda v: np.logaddexp(0, v)
        total = prior * soft(-z[trusted]).mean()
        for b in range(quality.BLOCKS):
            own = block == b
            total += own.mean() * max(0.0, soft(z[own]).mean() - prior * soft(z[trusted]).mean())
        return total + 0.5 * ridge * (w[:-1] ** 2).sum()

    here = risk(w)
    assert here < risk(zero) - 0.05
    for _ in range(200):
        step = rng.normal(size=k)
        assert risk(w + 0.05 * step / np.linalg.norm(step)) > here - 1e-3


def test_spans_do_not_cross_texts():
    data, edge = word_bytes.buffer(pa.array(["ab", "", None, "cd e", " f"]))
    at, size, row = word_bytes.spans(data, edge, ~quality.BLANK)
    assert [bytes(data[a : a + n]) for a, n in zip(at, size)] == [b"ab", b"cd", b"e", b"f"] and row.tolist() == [0, 3, 3, 4]


# ------------------------------------------------------------------------------------------------ mixing rows of one id

def test_rows_of_one_id_are_dealt_over_the_buckets(spark, monkeypatch):
    from tracklore.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rows = [(None, "a", f"n{i}") for i in range(900)] + [(5, "a", f"f{i}") for i in range(500)] + [(i, "ab"[i % 2], f"t{i}") for i in range(10, 300)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    out = mixing.mix(d, weights={"a": 1.0, "b": 1.0}).collect()
    assert len({(r.slot, r.place) for r in out}) == len(out)
    first = [r for r in out if r.epoch == 0]
    assert sorted(r.text for r in first) == sorted(t for *_, t in rows)
    nulls = sorted((r.slot, r.place) for r in first if r.doc_id is None)
    others = sorted((r.slot, r.place) for r in first if r.source == "a" and r.doc_id is not None)
    assert nulls[0] < others[200] and others[0] < nulls[200] and nulls[-1] > others[-200]  # in between, not one after the other
