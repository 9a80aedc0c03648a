import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tracklore.llm import exact_dedup, line_dedup, line_quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}", 0) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))], SCHEMA)


LONG = " ".join(f"w{i}" for i in range(9000))
ODD = ["a  b", "a\tb", "a b ", "", None, " ", LONG, LONG + "x", LONG, "x" + LONG, "a b"]


def test_exact_dedup_against_brute_force(spark):
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, ODD), block_bytes=1024).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        r = rows[i]
        assert (r.keep_id, r.group_size, r.kept) == (same[0], len(same), same[0] == i)
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_hot_blocks_and_empty_table(spark):
    texts = ["hot " * 500] * 300 + [f"t{i}" for i in range(50)] + ["hot " * 500 + "cold"] * 3
    rows = exact_dedup.exact_dedup(docs(spark, texts), block_bytes=256).collect()
    assert {r.doc_id: r.keep_id for r in rows} == {i: (0 if i < 300 else i if i < 350 else 350) for i in range(353)}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    nulls = exact_dedup.exact_dedup(docs(spark, ["a", "a"], [None, 5])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in nulls} == {(None, 5, False), (5, 5, True)}


def test_line_dedup(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(12))
    shared = "\n".join(line() for _ in range(40))  # its ends stay, up to the first and from the last boundary inside
    texts = [line() + "\n" + shared + "\n" + line() for _ in range(5)] + ["one line", "one line", "", None, "\n\n\n", "\n\n\n", "0a\n0b\n1c"]
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, texts).withColumnRenamed("lang", "h")).collect()}
    assert out[0].text == texts[0] and out[0].n_cut_chunks == 0
    for i in range(1, 5):
        assert out[i].n_cut_chunks > 0 and len(out[i].text) < len(texts[i]) / 2
        assert out[i].text.split("\n")[0] == texts[i].split("\n")[0] and out[i].text.split("\n")[-1] == texts[i].split("\n")[-1]
    for i in range(5, 12):
        assert out[i].text == texts[i]
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_passages_are_cut_whole(spark):
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    lines = lambda n, k: [line(k) for _ in range(n)]
    long, short, one, few = lines(9, 12), lines(2, 20), lines(1, 60), lines(5, 11)
    texts, owns = [], []
    for i in range(6):
        own = lines(4, 7)
        texts.append("\n".join([own[0], *long[: 9 - i % 3], own[1], *one, own[2], *few, "", own[3]]))
        owns.append("\n".join([own[0], own[1], own[2], "", own[3]]))
    texts += ["\n".join([*short]), one[0], "\n".join(long[3:8]), "", None, "\n\n"]
    out = {r.doc_id: r for r in line_dedup.passage_dedup(docs(spark, texts)).collect()}
    assert out[0].text == texts[0] and out[0].n_cut_passages == 0
    assert [out[i].text for i in range(1, 6)] == owns[1:] and all(out[i].n_cut_passages == 3 for i in range(1, 6))
    assert [out[i].text for i in range(6, 12)] == ["\n".join(short), "", "", "", None, "\n\n"]
    assert {r.doc_id for r in line_dedup.stage(spark, docs(spark, texts), "").collect()} == set(range(12)) - {7, 8}


def test_passages_are_compared_byte_by_byte(spark, monkeypatch):
    """With a hash that most lines share, the same passages are cut as with one that tells lines apart."""
    rng = random.Random(12)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    long, one = [line(11) for _ in range(7)], line(60)
    texts = ["\n".join([line(5), *(long if i % 2 else [one]), "", *[line(rng.randint(8, 30)) for _ in range(4)]]) for i in range(8)]
    want = {r.doc_id: (r.text, r.n_cut_passages) for r in line_dedup.passage_dedup(docs(spark, texts)).collect()}
    assert [want[i][1] for i in range(8)] == [0, 0, 1, 1, 1, 1, 1, 1]
    for few in (1, 3):
        monkeypatch.setattr(line_dedup, "line_hash", lambda x: F.pmod(F.xxhash64(x), F.lit(few)))  # noqa: B023
        assert {r.doc_id: (r.text, r.n_cut_passages) for r in line_dedup.passage_dedup(docs(spark, texts)).collect()} == want


def test_repeated_words_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(5)}
        assert line_quality.repeated_words(w) == len(hit)


def test_line_quality_removes_boilerplate(spark):
    board = "subscribe to our letter now and get the best offers of all the week here"
    texts = [f"{board}\nonly {i} few" for i in range(60)] + [f"{board}\n" + " ".join(f"u{i}{k}" for k in range(60)) for i in range(60)] + [None, "", "a b"]
    out = {r.doc_id: r for r in line_quality.line_quality(docs(spark, texts), min_docs=10).collect()}
    assert out[0].kept and out[1].kept  # the first document of each host keeps the line
    assert not any(out[i].kept for i in range(2, 60))
    assert all(out[i].kept for i in range(60, 120))
    assert [out[i].base_failed for i in (120, 121, 122)] == [True] * 3
    assert line_quality.line_quality(docs(spark, [])).count() == 0


def test_boilerplate_lines_leave_the_texts(spark):
    board = "Subscribe to our  letter now"
    texts = [f"{board}\n" + " ".join(f"u{i}{k}" for k in range(40)) + f"\n\n {board.lower()} \nend {i}" for i in range(60)] + [f"{board}\nonly {i}" for i in range(60, 70)]
    d = docs(spark, texts)
    got = {r.doc_id: r.text for r in line_quality.stage(spark, d, "").collect()}
    left = {r.doc_id: r.n_left_words for r in line_quality.line_quality(d).where("kept").collect()}
    assert got[0] == texts[0] and got[1] == texts[1]  # the first documents of the two hosts
    assert [got[i] for i in range(2, 60)] == ["\n".join(t.split("\n")[k] for k in (1, 2, 4)) for t in texts[2:60]]
    assert {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in got.items()} == left and len(got) == 60


def brute_fingerprint(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [4096, 8, 20])
def test_simhash_against_brute_force(spark, block, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        t = list(base)
        t[rng.randrange(120)] = "x"
        texts.append(" ".join(t))
    texts += [" ".join(f"v{rng.randint(0, 900)}" for _ in range(40)) for _ in range(40)] + ["", None, "One", "one", "a b c"] + texts[:3]
    near = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *a: near(*a, block=block))
    if block == 8:
        monkeypatch.setattr(simhash, "BROADCAST_KEYS", 3)
    out = {r.doc_id: r for r in simhash.simhash_groups(docs(spark, texts)).collect()}
    fp = [brute_fingerprint(t, 4) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    for i in range(len(texts)):
        assert (out[i].fingerprint, out[i].component_id) == (f"{fp[i]:016x}", find(i))
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def test_links_of_a_run_against_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, held = int(rng.integers(2, 90)), int(rng.integers(1, 60))
        held = min(held, n)
        centres = rng.integers(0, 2**63, 3).astype(np.uint64)
        flips = np.uint64(1) << rng.integers(0, 64, (n, int(rng.integers(1, 6)))).astype(np.uint64)
        fp = (centres[rng.integers(0, 3, n)] ^ np.bitwise_xor.reduce(flips, axis=1))[:, None]
        node = rng.permutation(n)
        lab = np.arange(n)
        a, b = np.nonzero(np.bitwise_count(fp ^ fp[:held].T) <= 4)
        want = simhash._unite(lab, node[a], node[b])
        u, v = simhash._links(fp, node, held, 4)
        assert (simhash._unite(np.arange(n), u, v) == want).all()


def test_stage_search_for_very_many_rows(spark, monkeypatch):
    rng = random.Random(21)
    texts = []
    for _ in range(40):
        t = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(t))
        for k in rng.sample(range(200), 4):  # a similarity of about 0.82
            t[k] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    few, many = simhash.stage_search(10), simhash.stage_search(1 << 30)
    assert few != many
    kept = {}
    for name, search in (("few", few), ("many", many)):
        monkeypatch.setattr(simhash, "stage_search", lambda rows, s=search: s)
        kept[name] = sorted(r.doc_id for r in simhash.stage(spark, docs(spark, texts), "").collect())
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    near = [i for i in range(0, 80, 2) if 10 * len(sets[i] & sets[i + 1]) >= 8 * len(sets[i] | sets[i + 1])]
    want = sorted(set(range(80)) - {i + 1 for i in near})
    assert len(near) > 20 and kept["few"] == want and kept["many"] == want


@pytest.mark.parametrize("block", [4096, 6])
def test_stage_links_the_same_rows_at_every_size(spark, block, monkeypatch):
    rng = random.Random(33)
    texts = []
    for most in (5, 9, 14, 20):  # similarities from 0.9 to 0.4, where a search finds some pairs only
        for _ in range(12):
            t = [f"w{rng.randrange(10**6)}" for _ in range(200)]
            texts.append(" ".join(t))
            for k in rng.sample(range(200), most):
                t[k] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    for _ in range(40):  # a dense group
        t = texts[0].split()
        for k in rng.sample(range(200), 3):
            t[k] = "x"
        texts.append(" ".join(t))
    texts += ["", None, texts[3]]
    near = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *a: near(*a, block=block))
    sizes = (10, 1 << 18, 1 << 22, (1 << 22) + 1, 1 << 30) if block > 6 else (10, (1 << 22) + 1, 1 << 30)
    got = [{r.doc_id: tuple(r) for r in simhash.simhash_groups(docs(spark, texts), **simhash.stage_search(n)).collect()} for n in sizes]
    assert all(g == got[0] for g in got)

    words = len(got[0][0][1]) // 16
    fp = np.array([simhash.fingerprint(t, 5, words) for t in texts])
    x = fp[:, None] ^ fp[None]
    some = np.zeros(x.shape[:2], bool)
    for lo, hi in ((0, 21), (21, 42), (42, 64)):
        some |= (np.bitwise_count(x & np.uint64((1 << hi) - (1 << lo))) <= 1).any(axis=2)
    within = np.bitwise_count(x).sum(axis=2, dtype=int) <= 64 * words * 7 // 32
    a, b = np.nonzero(within & some)
    want = simhash._unite(np.arange(len(texts)), a, b)
    assert [got[0][i][2] for i in range(len(texts))] == want.tolist()
    assert (within & ~some).any() and len(set(want.tolist())) > 20


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    near = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(5, 290, 40)]
    clean = [" ".join(f"c{rng.randint(0, 9999)}" for _ in range(200)) for _ in range(30)]
    kept = {r.doc_id for r in simhash.stage(spark, docs(spark, [" ".join(base), *near, *clean]), "").collect()}
    assert kept == {0} | set(range(1 + len(near), 1 + len(near) + len(clean)))


@pytest.mark.parametrize("in_order", [256, 0])
def test_stage_drops_only_what_is_similar_to_a_kept_row(spark, monkeypatch, in_order):
    monkeypatch.setattr(simhash, "IN_ORDER", in_order)
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for n in (300, 800):  # chains: each is near the one before it, not the first
        t = [word() for _ in range(n)]
        for _ in range(25):
            texts.append(" ".join(t))
            for k in rng.sample(range(n), n // 100):
                t[k] = word()
    texts += [texts[0], "", None, "a b", "A b"]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    stay = []
    for i, s in enumerate(sets):
        if not any(near(s, sets[j]) for j in stay):
            stay.append(i)
    assert len(stay) > 8
    assert sorted(r.doc_id for r in simhash.stage(spark, docs(spark, texts), "").collect()) == stay


def test_several_words_are_independent():
    f = simhash.fingerprint(" ".join(map(str, range(500))), 5, 3)
    assert len(set(f.tolist())) == 3 and all(16 <= int(np.bitwise_count(x)) <= 48 for x in f)
