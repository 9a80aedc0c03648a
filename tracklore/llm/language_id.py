"""Language identification by fusing evidence as a naive Bayes posterior.

Evidence of a row: the text's likelihood under byte trigram models, the language its markup declares, and a prior that
depends on where it comes from. Priors are smoothed along the hierarchy all > address suffix > host: the posteriors of
text and declaration are summed per level by grouped aggregation, and each level adds `weight` pseudo-rows drawn from
the level above. A row's own posterior is left out of its prior.

The trigram models are fitted on at most `per_language` rows of each language; their number has no bound, and the model
takes 256 KiB a language. Texts pass Python once and leave it as a few numbers, which are frozen; hosts that a large
share of the rows have are joined in parts, so a hot host spreads over tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklore.llm.common import bounded_batches, frozen, hot_join, hot_keys, table

BUCKETS = 1 << 16
_TAG_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_HIDDEN_END = {x: re.compile(f"</{x}", re.I) for x in ("script", "style")}
_LANG = re.compile(r"\blang=[\"']?([A-Za-z]{2,3})(?![A-Za-z])", re.I)
_CONTENT = re.compile(r"\bcontent=[\"']?([A-Za-z]{2,3})(?![A-Za-z])", re.I)
_AROUND_EQUALS = re.compile(r"(?<=\s)\s+|\s(?==)|(?<==)\s")


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts in a row, and where each text's begin. A text is lower-cased and framed by spaces."""
    parts = [f" {t.lower()} ".encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    lens = np.array([len(p) for p in parts])
    h = (raw[:-2] * 0x9E3779 + raw[1:-1] * 0x85EBC7 + raw[2:] * 0xC2B2AF) if len(raw) > 2 else np.empty(0, np.uint32)
    h = ((h ^ (h >> 13)) * np.uint32(0x27D4EB2D)) >> np.uint32(16)
    return h, np.cumsum(lens) - lens


def visible(page: str) -> tuple[str, str | None]:
    """Text of an HTML page without markup, and the language that its first html tag declares, else its first
    content-language. One pass from left to right: a comment, script, style or tag that is not closed ends the text, a < that
    begins none of them is text, and a tag ends at the next >."""
    out: list[str] = []
    declared = meta = None
    at = 0
    while (i := page.find("<", at)) >= 0:
        out.append(page[at:i])
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3
        else:
            name = _TAG_NAME.match(page, i + 1)
            if not name and page[i + 1 : i + 2] not in ("!", "?"):
                out.append("<")
                at = i + 1
                continue
            end = page.find(">", i + 1)
            at = end + 1
            kind = name[1].lower() if name else ""
            if end >= 0 and page[i + 1] != "/":
                if kind == "html" and declared is None:
                    declared = _attribute(_LANG, page[i:end])
                elif kind == "meta" and meta is None and "content-language" in page[i:end].lower():
                    meta = _attribute(_CONTENT, page[i:end])
                elif kind in _HIDDEN_END:
                    close = _HIDDEN_END[kind].search(page, end)
                    at = close.start() if close else len(page)
        out.append(" ")
        if end < 0:
            at = len(page)
    out.append(page[at:])
    return html.unescape("".join(out)), declared or meta


def _attribute(pattern: re.Pattern[str], tag: str) -> str | None:
    found = pattern.search(_AROUND_EQUALS.sub("", tag))
    return found and found[1].lower()


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 400) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities of the buckets, from the first `per_language` rows of each in order of a hash of the
    id. Rows without id, text or language are left out.

    The sample is taken in one pass: the hash's least share that holds the wanted rows with near certainty is kept of each
    language, and of that the first rows. Should it hold fewer, the sample is that much smaller. The driver holds one row a
    language, as the model does, and broadcasts them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("i IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    enough = per_language + 8 * per_language**0.5 + 32
    shares = spark.createDataFrame([(k, x, min(1.0, enough / sizes[x])) for k, x in enumerate(langs)], "k int, l string, share double")
    u = F.xxhash64("i") / F.lit(2.0**64) + 0.5
    few = rows.join(F.broadcast(shares), "l").where(u <= F.col("share"))
    first = Window.partitionBy("k").orderBy(F.xxhash64("i"), "i", "t")
    sample = few.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language).select("k", "t")
    n = len(langs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            own = b.column(0).to_numpy()
            texts = b.column(1).to_pylist()
            for k in np.unique(own).tolist():
                h, _ = buckets([texts[i] for i in np.flatnonzero(own == k)])
                total[k] = total.get(k, 0) + np.bincount(h, minlength=BUCKETS)
        for k, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["k", "at", "n"])

    counts = np.full((BUCKETS, n), 0.05)
    got = sample.mapInArrow(count, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toPandas()
    counts[got["at"], got["k"]] += got["n"]
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def evidence(df: DataFrame, key: Column, content: Column, host: Column, suffix: Column, markup: bool, langs: list[str], model: np.ndarray, trust: float, damp: float) -> DataFrame:
    """key, host, suffix, declared, text_p (posterior of the text alone) and both_p (of text and declaration)."""
    bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ll = held.value
        for b in batches:
            pages = [x or "" for x in b.column(1).to_pylist()]
            texts, said = zip(*map(visible, pages)) if markup and pages else (pages, [None] * len(pages))
            h, at = buckets(list(texts))
            score = np.zeros((len(texts), len(langs)))
            ends = np.append(at[1:], len(h) + 2)
            for i, (a, z) in enumerate(zip(at, ends)):
                n = max(0, z - a - 2)
                if n and texts[i].strip():
                    seen = np.bincount(h[a : a + n], minlength=BUCKETS) if n > BUCKETS else None
                    total = seen @ ll if seen is not None else ll[h[a : a + n]].sum(axis=0, dtype=np.float64)
                    score[i] = total / n * min(n, damp)  # trigrams overlap: evidence grows to that of `damp` of them
            text_p = _posterior(score)
            for i, x in enumerate(said):
                if x in langs:
                    score[i] += np.where(np.array(langs) == x, np.log(trust), np.log((1 - trust) / max(1, len(langs) - 1)))
            as_list = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), len(langs)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(said, pa.string()), as_list(text_p), as_list(_posterior(score))], ["key", "host", "suffix", "declared", "text_p", "both_p"])

    rows = df.select(key.cast("long").alias("key"), content.cast("string").alias("t"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(suffix, F.lit("")).alias("suffix"))
    return rows.mapInArrow(scan, "key long, host string, suffix string, declared string, text_p array<double>, both_p array<double>")


def _posterior(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True, initial=-np.inf)) if score.size else score
    return p / p.sum(axis=1, keepdims=True)


def fuse(rows: DataFrame, langs: list[str], weight: float) -> DataFrame:
    """Adds lang and prob: text and declaration under the row's own prior."""
    k = len(langs)
    parts = [F.element_at("both_p", i + 1) for i in range(k)]
    level = frozen(rows.groupBy("suffix", "host").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(p) for p in parts]).alias("s")))
    by_suffix = level.groupBy("suffix").agg(F.sum("n").alias("n2"), F.array(*[F.sum(F.element_at("s", i + 1)) for i in range(k)]).alias("s2"))
    whole = level.agg(F.sum("n"), *[F.sum(F.element_at("s", i + 1)) for i in range(k)]).first()
    level = level.join(by_suffix, "suffix").withColumns({"n1": F.lit(whole[0]).cast("long"), "s1": F.array(*[F.lit(x).cast("double") for x in whole[1:]])})
    place = F.xxhash64("suffix", "host")
    rows = rows.withColumn("place", place)
    level = level.withColumn("place", place).withColumnsRenamed({"suffix": "its_suffix", "host": "its_host"})
    same = (F.col("suffix") == F.col("its_suffix")) & (F.col("host") == F.col("its_host"))
    out = hot_join(rows, level, "place", hot_keys(rows, "place"), F.xxhash64("key"), same)
    w = F.lit(float(weight))
    out = out.withColumn("p1", F.expr(f"transform(s1, (x, i) -> (x - both_p[i] + 1.0D / {k}) / (n1 - 1 + 1))"))
    out = out.withColumn("p2", F.zip_with(F.zip_with("s2", "both_p", lambda x, b: x - b), "p1", lambda x, p: (x + w * p) / (F.col("n2") - 1 + w)))
    out = out.withColumn("p3", F.zip_with(F.zip_with("s", "both_p", lambda x, b: x - b), "p2", lambda x, p: (x + w * p) / (F.col("n") - 1 + w)))
    out = out.withColumn("raw", F.zip_with("both_p", "p3", lambda b, p: b * F.greatest(p, F.lit(1e-9))))
    out = out.withColumn("total", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)).withColumn("top", F.array_max("raw"))
    names = F.array(*[F.lit(x) for x in langs])
    return out.withColumn("lang", F.element_at(names, F.array_position("raw", F.col("top")).cast("int"))).withColumn("prob", F.col("top") / F.col("total"))


def identify(
    parts: list[tuple[str, DataFrame, Column, Column, Column, Column, bool]], langs: list[str], model: np.ndarray,
    weight: float = 5.0, trust: float = 0.9, damp: float = 50.0,
) -> DataFrame:
    """kind, key, lang, prob, text_lang, declared, host of every row of the parts; a part is (kind, rows, key, content,
    host, address suffix, whether the content is markup). Priors are those of the part's own rows.

    Null or empty content is evidence for no language: the row gets its prior's best. A null host or suffix is a host
    or suffix named ''. Declared languages that no model has are ignored. Ties go to the first language in order.
    Repeated rows count each. Very long texts and unclosed markup take time linear in their length. An empty table gives
    no rows; further columns are ignored, whatever their names. Without a model every language is null."""
    out = []
    for kind, df, key, content, host, suffix, markup in parts:
        if not langs:
            blank = F.lit(None).cast("string")
            out.append(df.select(F.lit(kind).alias("kind"), key.cast("long").alias("key"), blank.alias("lang"), F.lit(None).cast("double").alias("prob"), blank.alias("text_lang"), blank.alias("declared"), F.coalesce(host, F.lit("")).alias("host")))
            continue
        rows = frozen(evidence(df, key, content, host, suffix, markup, langs, model, trust, damp))
        names = F.array(*[F.lit(x) for x in langs])
        best = F.element_at(names, F.array_position("text_p", F.array_max("text_p")).cast("int"))
        out.append(fuse(rows, langs, weight).select(F.lit(kind).alias("kind"), "key", "lang", "prob", best.alias("text_lang"), "declared", "host"))
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by markup, address and text; documents by text and source. Models are fitted on documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    langs, model = fit(docs, "doc_id", "text", "lang")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    suffix = F.element_at(F.split(host, r"\."), -1)
    none = F.lit("")
    parts = [
        ("page", pages, F.col("page_id"), F.col("html"), host, suffix, True),
        ("document", docs, F.col("doc_id"), F.col("text"), F.col("source"), none, False),
    ]
    out = identify(parts, langs, model)
    return out.select("kind", F.when(F.col("kind") == "page", F.col("key")).alias("page_id"), F.when(F.col("kind") == "document", F.col("key")).alias("doc_id"), "lang", "prob", "text_lang", "declared", "host", F.lit(True).alias("kept"))
