"""Toxicity by a lexicon trie intersected with Levenshtein automata.

The lexicon is learnt from labelled rows: words, and word beginnings, whose document frequency in toxic texts exceeds
that in clean ones by far. A word is run through the product of the trie and the one-edit Levenshtein automaton
(insertion, deletion, substitution, transposition); product states are made when first met. Hits are told apart by their
context window: whether they stand inside quotation marks, and what the words around them are, which of those speak for
quotation and which for abuse being learnt too. A logistic model turns the sums into a score.

All that is learnt is cross-fitted: a labelled row is seen through a lexicon and context words that the other folds give,
so weights are fitted on rows as new as those to be scored, and the strength of the prior is chosen by the folds' loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm.common import bounded_batches, frozen, table

_WORD = re.compile(r"\w+(?:[@$*!]\w+)*")
_PAIRS = {"“": "”", "«": "»", "„": "“", "‘": "’"}
WINDOW = 5
REMEMBER = 300_000


class Lexicon:
    """Terms as a trie; `match` gives (term number, edits) of the best term within one edit of a word, or None.

    A term that ends in * stands for all words that begin so. Terms under `fuzzy_from` characters and those in `strict`
    match without edits only."""

    def __init__(self, terms: list[str], strict: frozenset[int] = frozenset(), fuzzy_from: int = 5) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]  # term that ends at the node
        self.stem: list[bool] = [False]
        self.fuzzy: list[bool] = [False]  # some term below may be misspelt
        for i, t in enumerate(terms):
            word = t.rstrip("*")
            path = [0]
            for c in word:
                node = self.next[path[-1]].get(c)
                if node is None:
                    node = self.next[path[-1]][c] = len(self.next)
                    self.next.append({})
                    self.end.append(-1)
                    self.stem.append(False)
                    self.fuzzy.append(False)
                path.append(node)
            self.end[path[-1]] = i
            self.stem[path[-1]] = t.endswith("*")
            if len(word) >= fuzzy_from and i not in strict:
                for node in path:
                    self.fuzzy[node] = True
        self.strict = strict
        self.fuzzy_from = fuzzy_from
        self.size = [len(t.rstrip("*")) for t in terms]
        self._reset()
        self.known: dict[str, tuple[int, int] | None] = {}

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.done: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, raw: set[tuple[int, int, str]]) -> int:
        """Number of a product state: (node, edits, character still owed by a transposition); -1 if empty."""
        full = set(raw)
        for n, e, owed in raw:
            if e == 0 and not owed:  # a term's character left out
                full |= {(m, 1, "") for m in self.next[n].values() if self.fuzzy[m]}
        full = frozenset(x for x in full if x[2] or not ((x[0], x[1] - 1, "") in full))
        if not full:
            return -1
        got = self.ids.get(full)
        if got is None:
            got = self.ids[full] = len(self.sets)
            self.sets.append(full)
            self.moves.append({})
            ends = [(e, -self.size[self.end[n]], self.end[n]) for n, e, owed in full if not owed and self.end[n] >= 0 and (e == 0 or self._may(self.end[n]))]
            self.done.append((min(ends)[2], min(ends)[0]) if ends else None)
        return got

    def _may(self, term: int) -> bool:
        return self.size[term] >= self.fuzzy_from and term not in self.strict

    def _step(self, state: int, c: str) -> int:
        raw = set()
        for n, e, owed in self.sets[state]:
            if owed:
                if owed == c:
                    raw.add((n, e, ""))
                continue
            if self.stem[n] and self.end[n] >= 0 and (e == 0 or self._may(self.end[n])):
                raw.add((n, e, ""))  # anything may follow a stem
            m = self.next[n].get(c)
            if m is not None:
                raw.add((m, e, ""))
            if e == 0 and self.fuzzy[n]:
                raw.add((n, 1, ""))  # an extra character
                for d, m in self.next[n].items():
                    if d != c and self.fuzzy[m]:
                        raw.add((m, 1, ""))  # another character
                        two = self.next[m].get(c)
                        if two is not None and self.fuzzy[two]:
                            raw.add((two, 1, d))  # two characters exchanged
        return self._state(raw)

    def match(self, word: str) -> tuple[int, int] | None:
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self._step(state, c)
                self.moves[state][c] = to
            if to < 0:
                return None
            state = to
        return self.done[state]

    def look_up(self, word: str) -> tuple[int, int] | None:
        """`match` with a table of bounded size."""
        if word in self.known:
            return self.known[word]
        if len(self.known) >= REMEMBER:
            self.known.clear()
        if len(self.sets) >= REMEMBER:
            self._reset()
        got = self.known[word] = self.match(word)
        return got

    def hits(self, text: str) -> list[tuple[int, int, bool, list[str]]]:
        """(term, edits, quoted, the words around it) of each word of the text that matches."""
        low = text.lower()
        if not any(self.look_up(w) for w in set(_WORD.findall(low))):
            return []
        words = list(_WORD.finditer(low))
        out = []
        for i, m in enumerate(words):
            got = self.look_up(m[0])
            if got:
                near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                out.append((*got, _quoted(low, near[0].start(), m.start(), m.end(), near[-1].end()), [w[0] for w in near if w is not m]))
        return out


def _quoted(text: str, lo: int, a: int, b: int, hi: int) -> bool:
    before, after = text[lo:a], text[b:hi]
    if before.count('"') % 2 and '"' in after:
        return True
    return any(before.rfind(o) > before.rfind(c) and c in after for o, c in _PAIRS.items())


#: bias, abusive hits, what misspelt ones among them add to or take from that, quoted hits, mean context of the hits
PRIOR_MEAN = np.array([-3.0, 2.0, 0.0, 0.3, 0.0])
FOLDS = 5


@dataclass(frozen=True)
class Model:
    """Terms with weights, terms that match without edits only, log-odds of context words (above 0: abuse), and beta."""

    terms: list[str]
    weights: list[float]
    strict: frozenset[int] = frozenset()
    context: dict[str, float] = field(default_factory=dict)
    beta: list[float] = field(default_factory=PRIOR_MEAN.tolist)

    def features(self, hits: list[tuple[int, int, bool, list[str]]]) -> list[float]:
        x = [0.0, 0.0, 0.0]
        around = total = 0.0
        for term, edits, quoted, near in hits:
            w = self.weights[term]
            if quoted:
                x[2] += w
            else:
                x[0] += w
                x[1] += w * bool(edits)
            total += w
            around += w * np.tanh(sum(self.context.get(n, 0.0) for n in set(near))) if self.context else 0.0
        return [1.0, *np.log1p(x), around / total if total else 0.0]

    def score(self, hits: list[tuple[int, int, bool, list[str]]]) -> float:
        z = float(np.dot(self.beta, self.features(hits)))
        return 1 / (1 + np.exp(-z))


def _fit_logistic(x: np.ndarray, y: np.ndarray, spread: float) -> np.ndarray:
    """Most likely weights under a normal prior around PRIOR_MEAN with the variance `spread`, nine for the bias, by Newton steps."""
    beta = PRIOR_MEAN.copy()
    var = np.array([9.0, *[spread] * (len(beta) - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (y - p) - (beta - PRIOR_MEAN) / var
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(1 / var)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


SPREADS = (0.01, 0.1, 1.0, 10.0)
SURE = (2.0, 1.0, 0.0)


def _choose(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[float, list[float]]:
    """The least loss on folds left out over the spreads, and the weights on all rows with its spread; of equals the smallest."""
    def loss(spread: float) -> float:
        total = 0.0
        for f in np.unique(fold):
            own = fold == f
            z = x[own] @ _fit_logistic(x[~own], y[~own], spread)
            total += float(np.logaddexp(0, np.where(y[own] == 1, -z, z)).sum())
        return total

    least, spread = min((round(loss(s), 6), s) for s in SPREADS)
    return least, _fit_logistic(x, y, spread).tolist()


def _gains(pos: np.ndarray, neg: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of document frequency, toxic over clean, and what they are at least, by two standard errors; the last axis
    are the views: each fold left out, and all rows."""
    gain = np.log((pos + 0.5) / size[1]) - np.log((neg + 0.5) / size[0])
    return gain, gain - 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def _views(counts: np.ndarray) -> np.ndarray:
    """Counts per fold (the last axis) to counts without each fold, and of all."""
    total = counts.sum(axis=-1, keepdims=True)
    return np.concatenate((total - counts, total), axis=-1)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = 4000, least_docs: int = 4, odds: float = 3.0,
) -> Model:
    """Fits on at most `per_class` labelled rows of each class, the first in order of a hash of their id, and whole texts.
    Labels other than 0 and 1 and rows without text are left out; without rows of both classes the lexicon is empty and
    every score is the prior's. Other columns are ignored, whatever their names. A term has at least `least_docs` toxic rows,
    log-odds of `odds`, and, two standard errors below that, of one of SURE, whichever has the least loss on folds left out; the driver holds the terms, and five numbers for each labelled row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    picked = [marks.where((F.col("y") == c) & F.col("i").isNotNull()).distinct().orderBy(F.xxhash64("i"), "i").limit(per_class) for c in (0, 1)]
    ids = frozen(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    rows = frozen(texts.join(F.broadcast(ids), "i").select("y", F.pmod(F.xxhash64("i", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"), "t"))
    size = np.zeros((2, FOLDS))
    for r in rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r.y, r.fold] = r.n
    if not size.sum(axis=1).all():
        return Model([], [])
    size = _views(size)

    def counted(found: DataFrame) -> DataFrame:
        """w, pos, neg: rows per fold that hold w."""
        per = lambda c: F.array(*[F.sum((c & (F.col("fold") == f)).cast("long")) for f in range(FOLDS)])
        return found.groupBy("w").agg(per(F.col("y") == 1).alias("pos"), per(F.col("y") == 0).alias("neg"))

    def collected(t: DataFrame, least: int, ratio: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What may be a term in some view: enough toxic rows in all, and `ratio` times as many as clean ones in a view."""
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        most = F.array_max(F.zip_with("pos", "neg", lambda p, n: (total(F.col("pos")) - p + 1) / (total(F.col("neg")) - n + 0.5)))
        got = t.where((total(F.col("pos")) >= least) & (F.greatest(most, (total(F.col("pos")) + 1) / (total(F.col("neg")) + 0.5)) >= ratio)).orderBy("w").toPandas()
        array = lambda c: np.array(got[c].tolist(), dtype=float).reshape(-1, FOLDS)
        return got["w"].tolist(), _views(array("pos")), _views(array("neg"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, fold, text in zip(*(c.to_pylist() for c in b.columns)):
                own = list(set(_WORD.findall(text.lower())))
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(own), pa.int32()), pa.array([fold] * len(own), pa.int32()), pa.array(own, pa.string())], ["y", "fold", "w"])

    seen = frozen(counted(rows.mapInArrow(words, "y int, fold int, w string")))
    fair = float(np.exp(odds) * (size[1] / size[0]).min() / 4)
    names, pos, neg = collected(seen, least_docs, fair)
    sums = lambda c: F.array(*[F.sum(F.element_at(c, f + 1)) for f in range(FOLDS)])
    begun = seen.select("pos", "neg", F.explode(F.transform(F.sequence(F.lit(4), F.lit(8)), lambda n: F.when(F.length("w") > n, F.substring("w", F.lit(1), n)))).alias("w")).where("w IS NOT NULL")
    stems, s_pos, s_neg = collected(begun.groupBy("w").agg(sums("pos").alias("pos"), sums("neg").alias("neg"), F.count(F.lit(1)).alias("forms")).where("forms >= 5"), 20, 50.0)

    def lexicon(least: float, view: int) -> tuple[list[str], list[float]]:
        (gain, sure), (s_gain, _) = ([x[:, view] for x in _gains(p, n, size)] for p, n in ((pos, neg), (s_pos, s_neg)))
        begin: dict[str, float] = {}
        for i in sorted(range(len(stems)), key=lambda i: (len(stems[i]), stems[i])):
            if s_pos[i, view] >= 20 and s_neg[i, view] * 50 <= s_pos[i, view] and s_gain[i] >= odds and not any(stems[i][:n] in begin for n in range(4, 9)):
                begin[stems[i]] = float(s_gain[i])
        terms = [(x + "*", g) for x, g in sorted(begin.items())]
        terms += [(w, float(g)) for w, g, n, low in zip(names, gain, pos[:, view], sure) if n >= least_docs and g >= odds and low >= least and not any(w[:k] in begin for k in range(4, 9))]
        return [t for t, _ in terms], [g for _, g in terms]

    views = [[lexicon(least, v) for v in range(FOLDS + 1)] for least in SURE]

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What stands around the hits of a row (as k=w), and the terms that it has misspelt (as k!term); k counts SURE."""
        lex = [[Lexicon(t) for t, _ in own] for own in views]
        for b in batches:
            for y, fold, text in zip(*(c.to_pylist() for c in b.columns)):
                own = []
                for k in range(len(SURE)):
                    found = lex[k][fold].hits(text)
                    own += {f"{k}={w}" for *_, near in found for w in near} | {f"{k}!{views[k][fold][0][t]}" for t, e, *_ in found if e}
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(own), pa.int32()), pa.array([fold] * len(own), pa.int32()), pa.array(own, pa.string())], ["y", "fold", "w"])

    around = frozen(counted(rows.mapInArrow(surroundings, "y int, fold int, w string")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    of = lambda mark: F.substring("w", 2, 1) == mark
    # their misspellings are ordinary words
    odd = {r.w for r in around.where(of("!") & (total(F.col("neg")) > 1 + 0.0005 * size[0, -1])).select("w").collect()}
    near = around.where(of("=") & (total(F.col("pos")) + total(F.col("neg")) >= 2 * least_docs)).orderBy("w").toPandas()
    hit_rows = _views(np.array([near["pos"].tolist(), near["neg"].tolist()], dtype=float).reshape(2, -1, FOLDS))
    known = set(names)

    def model(k: int, view: int) -> Model:
        terms, weights = views[k][view]
        own = np.array([w.startswith(f"{k}=") for w in near["w"]], dtype=bool)
        # counts are drawn towards the share of toxic rows among all that have hits
        p, n = hit_rows[0, own, view], hit_rows[1, own, view]
        all_p, all_n = max(1.0, p.sum()), max(1.0, n.sum())
        lean = np.log((p + 2 * all_p / (all_p + all_n)) / (n + 2 * all_n / (all_p + all_n))) - np.log(all_p / all_n)
        context = {w[2:]: float(v) for w, v, rows in zip(near["w"][own], lean, p + n) if rows >= 2 * least_docs and abs(v) > 0.5 and w[2:] not in known}
        return Model(terms, weights, frozenset(i for i, t in enumerate(terms) if f"{k}!{t}" in odd), context)

    models = [[model(k, v) for v in range(FOLDS + 1)] for k in range(len(SURE))]

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = [[Lexicon(m.terms, m.strict) for m in own] for own in models]
        for b in batches:
            x = [[models[k][fold].features(lex[k][fold].hits(text)) for k in range(len(SURE))] for fold, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.list_(pa.float64())))], ["y", "fold", "x"])

    fitted = sorted(rows.mapInArrow(figures, "y int, fold int, x array<array<double>>").collect())
    x, y, fold = np.array([r.x for r in fitted]), np.array([r.y for r in fitted], dtype=float), np.array([r.fold for r in fitted])
    chosen = [_choose(x[:, k], y, fold) for k in range(len(SURE))]
    best = min(range(len(SURE)), key=lambda k: chosen[k][0])
    whole = models[best][-1]
    return Model(whole.terms, whole.weights, whole.strict, whole.context, chosen[best][1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`<id_col>`, score, predicted, n_hits, n_quoted of every row. Null text counts as empty; a text without hits has
    the score of the model's bias. Repeated rows score alike, of terms equally near a word the longest, then the first, is
    its hit. Very long texts are read whole, in time linear in their words. An empty table gives an empty result; extra
    columns are ignored, whatever their names."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        lex = Lexicon(m.terms, m.strict)
        for b in batches:
            hits = [lex.hits(t) if t else [] for t in b.column(1).to_pylist()]
            p = np.array([m.score(h) for h in hits], dtype=float)
            cols = [b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(h) for h in hits], pa.int32()), pa.array([sum(x[2] for x in h) for h in hits], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "score", "predicted", "n_hits", "n_quoted"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string").alias("_t")).mapInArrow(scan, f"`{id_col}` {kind}, score double, predicted int, n_hits int, n_quoted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    return score(docs, train(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_hits", "n_quoted")
