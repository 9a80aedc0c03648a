"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most `max_bits` bits, some segment differs in at
most `max_bits // segments` bits, so looking up a small Hamming ball around each segment value in a table keyed by
(segment, value) finds every such pair; complete distances are then verified. Of a ball of radius 1 only the value itself
and the values with one more bit set are looked up: the pair is found from its other side otherwise. Smaller tables need
no balls: of a segment cut into pieces, two values that differ in one bit agree in all pieces but one, so rows meet under the
segment less each of its pieces. Both find the same pairs, with fewer rows to shuffle or fewer to compare.

Texts leave Python as one number each. Equal fingerprints are one node. Lookups and table rows meet in sorted runs, and a
task emits a spanning forest of its verified links, never all pairs. Within a run rows are held against a few leaders
first; rows that those unite are not compared with each other again. Of a run above `block` rows the rows near one leader
are set apart first, and only what is left is dealt in blocks to several tasks, against itself and the others: a dense group
costs its size, not its square. Components come from alternating large-star and small-star rounds over frozen edges.

The pipeline's stage takes components as candidates only: what goes has the wanted Jaccard similarity with a row that stays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm.common import WORD, bounded_batches, frozen, hot_join, hot_keys, salted_join, set_aside, table, union

_WORD = re.compile(WORD.encode())
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = 64


def fingerprint(text: str | None, shingle: int, words: int = 1) -> np.ndarray:
    """`words` unsigned 64-bit words; zero for a text without words. Word 0 is made of the shingles' XXH64 with seed 42,
    the others of a remixed XXH64."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return np.zeros(words, np.uint64)
    out = []
    for w in range(words):
        ones = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = _remix(hashes[at : at + (1 << 16)], w)
            ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])
    return np.array(out, np.uint64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle in order; of all words if they are fewer; none for a text without words."""
    tokens = _WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER))
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(tokens))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=np.uint64)


def _remix(h: np.ndarray, word: int) -> np.ndarray:
    """Independent bits for a further word: the finaliser of SplitMix64 over h plus a multiple of its increment."""
    if not word:
        return h
    h = h + np.uint64((word * 0x9E3779B97F4A7C15) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """rid, id, and w0, w1, ...: the words (signed longs) of each row's fingerprint."""
    bounded_batches(df.sparkSession)
    names = [f"w{i}" for i in range(words)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle, words) for t in b.column(2).to_pylist()], dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(fps[:, i]) for i in range(words))], ["rid", "id", *names])

    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(scan, "rid long, id long, " + ", ".join(f"{n} long" for n in names))


def _unite(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining nodes a[i] and b[i]; a label is the smallest node of its set."""
    while True:
        la, lb = lab[a], lab[b]
        open_ = la != lb
        if not open_.any():
            return lab
        a, b = a[open_], b[open_]
        np.minimum.at(lab, np.maximum(la[open_], lb[open_]), np.minimum(la[open_], lb[open_]))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest of its component in the graph of edges (u[i], v[i])."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    lab = _unite(np.arange(len(nodes)), at[: len(u)], at[len(u) :])
    x = np.flatnonzero(lab != np.arange(len(lab)))
    return nodes[x], nodes[lab[x]]


LEADERS = 4


def _close(x: np.ndarray, masks: list[tuple[int, int]]) -> np.ndarray:
    """Whether a difference of fingerprints, a row of x, has one bit at most in some segment; masks: (word, bits) of each."""
    out = np.zeros(len(x), bool)
    for w, m in masks:
        out |= np.bitwise_count(x[:, w] & np.uint64(m)) <= 1
    return out


def _links(fp: np.ndarray, node: np.ndarray, held: int, max_bits: int, masks: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of a run that differ in at most max_bits bits, as pairs of nodes; with `masks`, of
    those that also differ in one bit at most in some segment. The first `held` rows are table rows; each row is held
    against each of them, but for pairs that leaders have united."""
    nodes, at = np.unique(node, return_inverse=True)
    lab = np.arange(len(nodes))

    def near(rows: np.ndarray, table: np.ndarray) -> None:
        nonlocal lab
        step = max(1, (1 << 20) // max(1, len(table)))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            far = sum(np.bitwise_count(fp[part, None, w] ^ fp[None, table, w]).astype(np.int16) for w in range(fp.shape[1]))
            q, t = np.nonzero(far <= max_bits)
            if masks:
                ok = _close(fp[part[q]] ^ fp[table[t]], masks)
                q, t = q[ok], t[ok]
            lab = _unite(lab, at[part[q]], at[table[t]])

    every, table = np.arange(len(fp)), np.arange(held)
    leaders: list[int] = []
    while len(leaders) < LEADERS:  # each is of a set that no leader before it is of
        apart = table[~np.isin(lab[at[table]], lab[at[leaders]])]
        if not len(apart):
            break
        leaders.append(int(apart[0]))
        near(every, apart[:1])
    own = lab[at]
    big = np.bincount(own).argmax()
    near(every[own != big], table)
    near(every[own == big], table[own[:held] != big])
    x = np.flatnonzero(nodes != nodes[lab])
    return nodes[x], nodes[lab[x]]


def _cuts(segments: int) -> list[int]:
    return [BITS * i // segments for i in range(segments + 1)]


def _segment_keys(word: str, lo: int, hi: int, tag: int) -> tuple[Column, Column]:
    """Key of bits [lo, hi) of a word, and the array of keys with one more bit set; tag tells segments apart."""
    value = F.shiftrightunsigned(word, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    bits = F.array(*[F.lit(1 << j).cast("long") for j in range(hi - lo)])
    clear = F.filter(bits, lambda m: value.bitwiseAND(m) == 0)
    return value.bitwiseOR(F.lit(tag)), F.transform(clear, lambda m: value.bitwiseOR(m).bitwiseOR(F.lit(tag)))


def _piece_keys(word: str, lo: int, hi: int, pieces: int, tag: int) -> list[Column]:
    """Keys of bits [lo, hi) of a word less each of `pieces` pieces of them."""
    cuts = [lo + (hi - lo) * i // pieces for i in range(pieces + 1)]
    rest = [((1 << hi) - (1 << lo)) & ~((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    return [F.shiftrightunsigned(F.col(word).bitwiseAND(F.lit(_signed(m))), lo).bitwiseOR(F.lit(tag | j << 32)) for j, m in enumerate(rest)]


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


#: Above so many hot keys they are joined by a shuffle instead of a broadcast.
BROADCAST_KEYS = 100_000


def near_links(fps: DataFrame, words: int, max_bits: int, segments: int, pieces: int = 0, block: int = 4096) -> DataFrame:
    """Edges (u, v) between the nodes of fingerprints. Their closure is that of the pairs within max_bits bits that differ in
    one bit at most in some segment, `segments` per word: of all pairs within max_bits if max_bits < 2 * segments * words;
    else pairs further apart need a measured recall. fps: distinct w0, w1, ... and the node of each.

    `pieces` says how they meet, and changes no link: by balls (0), with some dozen rows a segment and cells as long as
    segments, or under the segment less each of so many pieces, with that many rows and shorter cells."""
    cuts = _cuts(segments)
    names = [f"w{i}" for i in range(words)]
    masks = [(w, (1 << hi) - (1 << lo)) for w in range(words) for lo, hi in zip(cuts, cuts[1:])] if pieces and max_bits >= 2 * segments * words else None
    table_keys, ball_keys = [], []
    for w in range(words):
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            tag = (w * segments + i) << 40
            if pieces:
                table_keys += _piece_keys(names[w], lo, hi, pieces, tag)
            else:
                key, ball = _segment_keys(names[w], lo, hi, tag)
                table_keys.append(key)
                ball_keys.append(ball)
    cols = [*names, "node"]
    rows = held = fps.select(F.explode(F.array(*table_keys)).alias("key"), F.lit(0).alias("side"), *cols)
    t = held.groupBy("key").agg(F.count(F.lit(1)).alias("t"))
    if pieces:
        hot = frozen(t.where(f"t > {block}").select("key"))
    else:
        rows = held.unionByName(fps.select(F.explode(F.concat(*ball_keys)).alias("key"), F.lit(1).alias("side"), *cols))
        # what a key holds, and what its neighbours with one bit less ask of it
        widths = F.array(*[F.lit(hi - lo) for lo, hi in zip(cuts, cuts[1:])])
        width = F.element_at(widths, (F.shiftright("key", 40) % segments + 1).cast("int"))
        above = F.filter(F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.expr("key").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))), lambda k: k != F.col("key"))
        t = frozen(t)
        q = t.where(F.col("t") > block // 64).select(F.explode(above).alias("key"), F.col("t").alias("q")).groupBy("key").agg(F.sum("q").alias("q"))  # others never ask too much
        hot = frozen(t.join(q, "key", "left").where(f"t > {block} OR q > {4 * block}").select("key"))
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        rows, links = _deal(rows.join(hot, "key"), rows.join(hot, "key", "left_anti"), names, max_bits, masks, block, n_hot)
    else:
        rows, links = rows.withColumn("part", F.lit(0).cast("long")), None

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        n = 0

        def search(key: np.ndarray, side: np.ndarray, fp: np.ndarray, node: np.ndarray) -> None:
            nonlocal us, vs, n
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            stop = np.append(edge[1:], len(fp))
            asks = np.concatenate(([0], np.cumsum(side)))
            q = asks[stop] - asks[edge]
            t = stop - edge - q
            alive = (t > 0) & (t + q > 1)
            small = alive & (t * (t + q) <= 4096)
            count = np.where(small, t * (t + q), 0)
            group = (np.cumsum(count) - count) >> 20  # pairs of all small runs at once, a million at a time
            for g in np.unique(group[small]).tolist():
                own = small & (group == g)
                e, tt, k = edge[own], t[own], count[own]
                run = np.repeat(np.arange(len(e)), k)
                off = np.arange(len(run)) - np.repeat(np.cumsum(k) - k, k)
                a, b = e[run] + off % tt[run], e[run] + off // tt[run]
                open_ = (node[a] != node[b]) & (a < b)  # table rows come first in their run
                a, b = a[open_], b[open_]
                x = fp[a] ^ fp[b]
                ok = np.flatnonzero(np.bitwise_count(x).sum(axis=1, dtype=np.int16) <= max_bits)
                if masks:
                    ok = ok[_close(x[ok], masks)]
                us.append(node[a[ok]])
                vs.append(node[b[ok]])
                n += len(ok)
            for i in np.flatnonzero(alive & ~small):
                u, v = _links(fp[edge[i] : stop[i]], node[edge[i] : stop[i]], int(t[i]), max_bits, masks)
                us.append(u)
                vs.append(v)
                n += len(u)
            if n > 1 << 20:
                u, v = _forest(np.concatenate(us), np.concatenate(vs))
                us, vs, n = [u], [v], 0

        kept: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            if not len(key):
                continue
            side = b.column(2).to_numpy().astype(np.int64)
            fp = np.stack([b.column(3 + i).to_numpy() for i in range(words)], axis=1).view(np.uint64)
            node = b.column(3 + words).to_numpy()
            last = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
            if last:
                search(*(np.concatenate(x) for x in zip(*[*kept, (key[:last], side[:last], fp[:last], node[:last])])))
                kept = []
            kept.append((key[last:], side[last:], fp[last:], node[last:]))
        if kept:
            search(*(np.concatenate(x) for x in zip(*kept)))
        u, v = _forest(np.concatenate(us), np.concatenate(vs))
        for k in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], ["u", "v"])

    dealt = rows.select("key", "part", "side", *cols).repartition("key", "part").sortWithinPartitions("key", "part", "side")
    found = dealt.mapInArrow(runs, "u long, v long")
    return found if links is None else found.unionByName(links)


def _deal(hot: DataFrame, rest: DataFrame, names: list[str], max_bits: int, masks: list[tuple[int, int]] | None, block: int, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """(rows with part, links) of the rows of hot keys, and part 0 for the rest.

    One table row of each hot key leads it. Rows near it are linked to it and go on as its node; they are held against far
    table rows only, far rows against all. Each of these two tables meets its lookups in blocks."""
    leader = hot.where("side = 0").groupBy("key").agg(F.min_by(F.struct(*names, "node"), F.struct(F.xxhash64("node"), "node")).alias("lead"))
    if n_keys <= BROADCAST_KEYS:
        hot = hot.join(F.broadcast(leader), "key")
    else:
        hot = salted_join(hot, leader, ["key"], F.xxhash64("node"))
    far = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"lead.{n}"))) for n in names), F.lit(0))
    near = far <= max_bits
    if masks:
        near = near & reduce(or_, [F.bit_count(F.col(f"w{w}").bitwiseXOR(F.col(f"lead.w{w}")).bitwiseAND(F.lit(_signed(m)))) <= 1 for w, m in masks])
    hot = hot.withColumn("near", near)
    links = hot.where("near AND node <> lead.node").select(F.col("node").alias("u"), F.col("lead.node").alias("v"))
    cols = [*names, F.when(F.col("near"), F.col("lead.node")).otherwise(F.col("node")).alias("node")]
    held = hot.where("side = 0").select("key", F.when(F.col("near"), 2).otherwise(1).alias("sub"), "side", *cols, F.col("node").alias("own"))
    asks = hot.select("key", F.explode(F.when(F.col("near"), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("sub"), F.lit(1).alias("side"), *cols, F.col("node").alias("own"))
    both = held.unionByName(asks)
    sizes = both.groupBy("key", "sub").agg(F.sum(1 - F.col("side")).alias("t"), F.sum("side").alias("q")).where("t > 0 AND q > 0")
    sizes = sizes.select("key", "sub", F.ceil(F.col("t") / block).alias("tp"), F.ceil(F.col("q") / (4 * block)).alias("qp"))
    both = both.join(F.broadcast(sizes), ["key", "sub"]) if n_keys <= BROADCAST_KEYS else salted_join(both, sizes, ["key", "sub"], F.xxhash64("own"))
    h = F.xxhash64("own", F.lit(1))
    parts = F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("qp") - 1), lambda j: F.pmod(h, "tp") * F.col("qp") + j))
    parts = parts.otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("tp") - 1), lambda i: i * F.col("qp") + F.pmod(h, "qp")))
    out = both.withColumn("part", F.explode(parts)).select("key", (F.col("part") * 3 + F.col("sub")).alias("part"), "side", *names, "node")
    return out.unionByName(rest.select("key", F.lit(0).cast("long").alias("part"), "side", *names, "node")), links


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the graph; root is one node of its component (then the node itself among them)."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            return salted_join(near.where("v > u"), low, ["u"], F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = e.groupBy("u").agg(F.min("v").alias("m"))  # u > v on every edge now
        own = low.select("u", F.col("m").alias("v"))
        out = salted_join(e, low, ["u"], F.xxhash64("v")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
        return out.where("u <> v").distinct()

    cur = frozen(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:  # done when every node has one edge down or only edges up
        ends = cur.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(cur.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        ends = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if not ends.agg(F.max(F.greatest(F.col("down") - 1, F.col("down") * F.col("up")))).first()[0]:
            break
        cur = frozen(star(star(cur, True), False))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1, max_bits: int = 4, segments: int = 3, pieces: int = 0) -> DataFrame:
    """One row per input row: `<id_col>`, fingerprint, component_id. `pieces` changes no result (see near_links).

    Null and wordless texts have fingerprint zero and link like any other. component_id is the smallest id of the
    component; rows with a null id take part, and get null only if no row of their component has an id. Repeated rows
    and ties share a component. Very long texts are hashed in parts, in time linear in their length. Extra columns are
    ignored, whatever their names; an empty table gives an empty result.

    With three segments a word, a table cell holds about one row in 2 ** 21; above that many distinct fingerprints the
    comparisons per row grow with their number, some 35 a row for each 2 ** 21, which stays cheaper than the thousand
    lookups a row of longer segments and balls of radius 2 up to some billions of rows.
    """
    names = [f"w{i}" for i in range(words)]
    rows = frozen(fingerprints(df, id_col, text_col, shingle, words))
    least = frozen(rows.groupBy(*names).agg(F.min("id").alias("least"), F.min("rid").alias("node")))
    member = components(near_links(least.select(*names, "node"), words, max_bits, segments, pieces)).withColumnRenamed("node", "_n")
    least = frozen(least.join(member, F.col("node") == F.col("_n"), "left").withColumn("node", F.coalesce("root", "node")).select(*names, "least", "node"))
    root = least.withColumnRenamed("node", "root")
    best = root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = salted_join(root, best, ["root"], F.xxhash64(*names)).select(*names, "component_id")
    out = salted_join(rows, named, names, F.col("rid"))
    digits = F.lower(F.concat(*[F.lpad(F.hex(n), 16, "0") for n in names]))
    return out.select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


#: How many pieces the stage's segments are cut into, and up to how many rows: a cell has 64 rows of random bits then.
PIECES = [(2, 1 << 16), (3, 1 << 20), (4, 1 << 22), (7, 1 << 24)]


def stage_search(rows: int) -> dict[str, int]:
    """The stage's search for candidates, the same links for any number of rows: that only says how they are found, so that
    cells do not fill. A Jaccard similarity of 0.8 on five-word shingles is 0.15 of the bits, well within 7 of 32; eight words
    of three segments give a pair at 0.15 a chance of 0.98 that some segment differs in one bit at most; README has the
    measured recall."""
    pieces = next((p for p, most in PIECES if rows <= most), 0)
    return {"shingle": 5, "words": 8, "max_bits": 112, "segments": 3, "pieces": pieces}


SIMILAR = 0.8


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least `least`; two empty ones have."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


#: Rows of a component that are read in order without another round.
IN_ORDER = 256


def near_copies(df: DataFrame, id_col: str, text_col: str, least: float = SIMILAR, **search: int) -> DataFrame:
    """(id, k) of the rows to drop, k being the xxhash64 of id and text: in each component, by (id, k), a row goes if its
    exact similarity with one that stays is at least `least`. Rows without an id take no part.

    Rows meet the first of their component over a join that deals hot components in parts; those like it go. So do, with the
    first of the others in its place, the rows that are left, as long as some component has many and a round clears a
    tenth of them: a group of copies is cleared by a few firsts, however large. Only what is left then is read in order,
    component by component, against an index of those that stay."""
    shingle = search["shingle"]
    bounded_batches(df.sparkSession)
    own = F.col(id_col).cast("long")
    rows = df.where(own.isNotNull()).select(own.alias("id"), F.xxhash64(own, F.col(text_col).isNull(), F.col(text_col)).alias("k"), F.col(text_col).cast("string").alias("t"))
    group = simhash_groups(rows, "k", "t", **search).select("k", F.col("component_id").alias("c")).distinct()
    group = frozen(rows.select("id", "k").distinct().join(group, "k"))
    some = group.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    group = hot_join(group, some, "c", hot_keys(group, "c"), F.col("k"))
    left = frozen(rows.dropDuplicates(["id", "k"]).join(group, ["id", "k"]).select("c", "id", "k", "t"))

    def against_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, it = None, np.zeros(0, np.uint64)
        for b in batches:
            near = []
            ts = b.column(3).to_pylist()
            for t, u in zip(ts, b.column(4).to_pylist()):
                if u != text:
                    text, it = u, np.unique(shingle_hashes(u, shingle))
                near.append(t == u or similar(np.unique(shingle_hashes(t, shingle)), it, least))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([None if x else t for x, t in zip(near, ts)], pa.string()), pa.array(near, pa.bool_())], ["c", "id", "k", "t", "near"])

    gone, before = [], left.count()
    while True:
        first = left.groupBy("c").agg(F.min(F.struct("id", "k", "t")).alias("first"))  # a task sends one text of each component
        pairs = hot_join(left, first, "c", hot_keys(left, "c"), F.col("k")).where(F.struct("id", "k") != F.struct("first.id", "first.k")).select("c", "id", "k", "t", F.col("first.t").alias("u"))
        judged = frozen(pairs.mapInArrow(against_first, "c long, id long, k long, t string, near boolean"))
        gone.append(judged.where("near").select("id", "k"))
        left = judged.where("NOT near").select("c", "id", "k", "t")
        sizes = left.groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        if (sizes[0] or 0) <= IN_ORDER or sizes[1] > 0.9 * before:
            break
        before = sizes[1]

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stay, index = None, [], {}
        for b in batches:
            gone = []
            for row, (c, t) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                if c != at:
                    at, stay, index = c, [], {}
                s = np.unique(shingle_hashes(t, shingle))
                # similar sets share one of their smallest hashes, so many that the rest is less than `least` of the set
                head = s[: len(s) - math.ceil(least * len(s) - 1e-9) + 1].tolist() or [None]
                if any(similar(s, stay[i], least) for i in {i for h in head for i in index.get(h, ())}):
                    gone.append(row)
                else:
                    for h in head:
                        index.setdefault(h, []).append(len(stay))
                    stay.append(s)
            take = pa.array(gone, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(2).take(take)], ["id", "k"])

    rest = left.repartition("c").sortWithinPartitions("c", "id", "k")
    return union([*gone, rest.mapInArrow(in_order, "id long, k long")])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but for those with a five-word-shingle similarity of 0.8 or more with one that stays, found by SimHash;
    of near-duplicates the smallest id stays. Rows without an id stay, repeated rows stay or go together."""
    docs, back = set_aside(docs, (), ("doc_id", "text"))
    gone = near_copies(docs, "doc_id", "text", **stage_search(docs.count())).select(F.col("id").alias("_id"), F.col("k").alias("_k"))
    own = F.col("doc_id").cast("long")
    keyed = docs.withColumns({"_id": own, "_k": F.xxhash64(own, F.col("text").isNull(), F.col("text"))})
    return back(keyed.join(gone, ["_id", "_k"], "left_anti").select(*docs.columns))
