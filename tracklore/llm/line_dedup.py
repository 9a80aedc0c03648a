"""Line dedup by content-defined line chunks; DataFrame functions only.

A rolling hash over the hashes of two successive lines ends a chunk where it is 0 modulo `every`, so boundaries depend
on content, not position, and a shared passage is cut alike wherever it stands. Chunks of at least two lines with a word
whose 64-bit hash occurs twice or more are compared byte by byte (grouped by their text); all but the first copy, by
(id, place), are removed.

Only hashes travel for chunks that occur once. Texts move twice, to meet the candidate list and the removal list of
their document; only texts with candidates are cut again, and only candidate chunks are compared. Hashes and chunks are
counted after partial aggregation; the few that a large share of the places have are joined in parts.

The pipeline's stage goes further than the query, whose rule its SQL fixes: see `passage_dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.functions.text import let
from tracklore.llm.common import frozen, hot_join, hot_keys, set_aside, table

EVERY = 3
#: The pipeline cuts every repeated run of lines with over 50 words.
PASSAGE_WORDS = 51
PLACE = 1 << 31
#: Two lines with a word: the first character of a word, the rest of its line, and another after that; in linear time.
TWO_LINES = r"\A[\x20\x09-\x0D]*+[^\x20\x09-\x0D][^\n]*+\n[\x20\x09-\x0D]*+[^\x20\x09-\x0D]"


def _chunked(df: DataFrame, text_col: str, every: int) -> DataFrame:
    """Adds _chunks: the chunks of the text in order, joined by newlines they are the text.

    No lambda refers to an array outside it, since such an array would be computed anew for each element. Each line gets
    a flag in front, 1 if it begins a chunk; the flagged text is cut before the newlines that a 1 follows."""
    df = df.withColumn("_lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    df = df.withColumn("_h", F.transform("_lines", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")))
    prior = F.concat(F.array(F.lit(None).cast("long")), F.slice("_h", F.lit(1), F.size("_h") - 1))
    ends = F.zip_with(prior, "_h", lambda a, b: F.coalesce((a * 31 + b) % every == 0, F.lit(False)))
    df = df.withColumn("_ends", ends)
    starts = F.concat(F.array(F.lit(True)), F.slice("_ends", F.lit(1), F.size("_ends") - 1))
    flagged = F.array_join(F.zip_with("_lines", starts, lambda x, s: F.concat(F.when(s, "1").otherwise("0"), x)), "\n")
    chunks = F.transform(F.split(flagged, "\n(?=1)", -1), lambda c: F.substring(F.replace(c, F.lit("\n0"), F.lit("\n")), F.lit(2), F.length(c)))
    return df.withColumn("_chunks", chunks).drop("_lines", "_h", "_ends")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """`df` with repeated chunks cut out of `<text_col>`, plus n_cut_chunks (int).

    Null text stays null; empty text has no chunk to cut. A text all of whose chunks are cut becomes empty. Rows with a
    null id are neither cut nor counted. Rows with the same id and the same text count as one occurrence and are cut
    alike. An empty table gives an empty result. Very long texts are cut in time linear in their lines, and held in memory by
    one task. Other columns pass through, whatever their names, but an input column n_cut_chunks gives way to the result.
    """
    df, back = set_aside(df.drop("n_cut_chunks"), (), (id_col, text_col))
    key = F.when(F.col(id_col).isNotNull() & F.col(text_col).isNotNull(), F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("x")))
    rows = df.select(key.alias("_key"), F.col(text_col).alias("_t")).where("_key IS NOT NULL")
    hashes = F.transform("_chunks", lambda c: F.when(c.rlike(TWO_LINES), F.xxhash64(c)))
    places = frozen(_chunked(rows, "_t", every).select("_key", hashes.alias("hs"))).select("_key", F.posexplode("hs").alias("k", "h")).where("h IS NOT NULL")
    hot = hot_keys(places, "h")
    twice = places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    listed = hot_join(places, twice, "h", hot, F.xxhash64("_key")).groupBy("_key").agg(F.collect_set("k").alias("_ks"))  # some of a text's own chunks

    # only texts with a candidate are cut into chunks again, and only candidates leave them
    wanted = let("_chunks", lambda c: F.transform("_ks", lambda k: F.struct(k.alias("k"), F.element_at(c, k + 1).alias("c"))))
    chosen = _chunked(rows.join(listed, "_key"), "_t", every).select("_key", F.inline_outer(wanted)).withColumn("h", F.xxhash64("c"))
    at = F.struct("_key", "k")
    first = chosen.groupBy("h", "c").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("h", F.col("c").alias("same"), "first")
    copies = hot_join(chosen, first, "h", hot, F.xxhash64("_key"), F.col("c") == F.col("same")).where(at != F.col("first"))
    cut = frozen(copies.groupBy("_key").agg(F.collect_set("k").alias("_cut")))

    out = df.withColumn("_key", key).join(cut, "_key", "left")
    out = _chunked(out.withColumn("_todo", F.when(F.col("_cut").isNotNull(), F.col(text_col))), "_todo", every)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_chunks") - 1), F.col("_cut"))
    left = let("_chunks", lambda c: F.transform(stay, lambda i: F.element_at(c, i + 1)))
    text = F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return back(out.select(*[text.alias(c) if c == text_col else c for c in df.columns], F.when(F.col("_cut").isNull(), 0).otherwise(F.size("_cut")).alias("n_cut_chunks")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def _units(every: int, words: int) -> Column:
    """Codes of the units of _l, the lines with a word: content-defined chunks of two lines or more, and for each line the
    least windows that begin or end with it and have `words` words. A code is the place of the first line and the number
    of lines. Lambdas refer to no array but the stored _l."""
    n = F.size("_l")
    places = F.sequence(F.lit(1), n)
    code = lambda lo, k: lo.cast("long") * PLACE + k

    def window(lines: Column) -> Column:
        start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
        more = lambda a, x: F.when(a["w"] >= words, a).otherwise(F.struct((a["w"] + x["w"]).alias("w"), (a["n"] + 1).alias("n")))
        return F.aggregate(lines, start, more, lambda a: F.when(a["w"] >= words, a["n"]))

    def low(i: Column) -> Column:
        return F.element_at("_l", i)["low"]

    ahead = F.transform(places, lambda i: code(i, window(F.slice("_l", i, F.lit(words)))))
    behind = F.transform(places, lambda i: F.transform(F.array(window(F.reverse(F.slice("_l", F.greatest(F.lit(1), i - words + 1), F.least(i, F.lit(words)))))), lambda k: code(i - k + 1, k))[0])
    ends = F.filter(places, lambda i: F.when(i == F.size("_l"), True).when(i == 1, False).otherwise((low(i - 1) * 31 + low(i)) % every == 0))
    chunks = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1)), ends, lambda a, b: F.when(b - a >= 2, code(a + 1, b - a)))
    return F.filter(F.array_union(F.array_union(ahead, behind), chunks), lambda u: u.isNotNull())


def line_hash(line: Column) -> Column:
    """What lines are compared by until their bytes are."""
    return F.xxhash64(line)


def _merged(units: Column) -> Column:
    """Sorted units as runs of lines: those that overlap or touch are one."""

    def merge(a: Column, u: Column) -> Column:
        last = F.element_at(a, -1)
        longer = F.shiftright(last, 31) * PLACE + F.greatest(last % PLACE, u % PLACE)
        joins = (F.size(a) > 0) & (F.shiftright(u, 31) <= F.try_element_at(a, F.lit(-1)) % PLACE + 1)
        return F.when(joins, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(longer))).otherwise(F.concat(a, F.array(u)))

    return F.aggregate(units, F.array().cast("array<bigint>"), merge)


def _places(runs: str) -> Column:
    """The places of the lines of runs."""
    return F.flatten(F.transform(runs, lambda u: F.sequence(F.shiftright(u, 31).cast("int"), (u % PLACE).cast("int"))))


def _part(lines: str, u: Column) -> Column:
    """The unit's part of an array that has null for lines without a word."""
    lo, hi = F.shiftright(u, 31).cast("int"), (u % PLACE).cast("int")
    return F.filter(F.slice(lines, lo + 1, hi - lo + 1), lambda x: x.isNotNull())


def passage_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, words: int = PASSAGE_WORDS) -> DataFrame:
    """`df` with repeated passages cut out of `<text_col>`, plus n_cut_passages (int), the runs of lines cut.

    Lines without a word are left out of the comparison and go with the lines around them. Besides chunks of two lines or
    more, every run of whole lines with `words` words or more that stood before, by (id, place), is cut from its first to
    its last line, wherever chunk boundaries fall: the least windows of `words` words that begin or end with each line
    cover it. A line goes only if an equal one stood before, so the first copy of each stays.

    Units are compared by the hashes of all their lines, and the bytes of all lines of units that seem to repeat are compared
    too: grouped by hash and text, each once. Where two texts have one hash, units with that hash are compared by their
    texts instead. Nulls, repeated rows and other columns as in line_dedup.
    """
    df, back = set_aside(df.drop("n_cut_passages"), (), (id_col, text_col))
    key = F.when(F.col(id_col).isNotNull() & F.col(text_col).isNotNull(), F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("x")))
    low = lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << 28) - 1))
    line = lambda x, i: F.struct(i.alias("i"), line_hash(x).alias("h"), low(x).alias("low"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]++")).alias("w"))
    rows = df.select(key.alias("_key"), F.split(text_col, "\n", -1).alias("_s")).where("_key IS NOT NULL")
    docs = frozen(rows.select("_key", F.filter(F.transform("_s", line), lambda x: x["w"] > 0).alias("_l"))).where(F.size("_l") > 0)

    def unit(u: Column) -> Column:
        lo, n = F.shiftright(u, 31).cast("int"), (u % PLACE).cast("int")
        at = lambda i: F.element_at("_l", i)["i"].cast("long")
        return F.struct((at(lo) * PLACE + at(lo + n - 1)).alias("u"), F.xxhash64(F.transform(F.slice("_l", lo, n), lambda x: x["h"])).alias("a"))

    places = frozen(docs.select("_key", F.transform(_units(every, words), unit).alias("us"))).select("_key", F.explode("us").alias("_u")).select("_key", "_u.*")
    hot = hot_keys(places, "a")
    twice = places.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    listed = hot_join(places, twice, "a", hot, F.xxhash64("_key")).groupBy("_key").agg(F.sort_array(F.collect_set("u")).alias("us"))

    # texts with such units, their lines' hashes, and the hashes that are not those of one line only
    hashes = F.transform("_s", lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), line_hash(x)))
    held = frozen(rows.join(listed, "_key").select("_key", "us", "_s", hashes.alias("_h"), _merged(F.col("us")).alias("_runs")))
    lines = held.select(F.explode(F.transform(_places("_runs"), lambda i: F.struct(F.get("_h", i).alias("h"), F.get("_s", i).alias("c")))).alias("l")).select("l.*").where("h IS NOT NULL")
    shared = frozen(lines.groupBy("h", "c").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    chosen = held.select("_key", "_s", F.explode(F.transform("us", lambda u: F.struct(u.alias("u"), _part("_h", u).alias("hs")))).alias("_u")).select("_key", "_s", "_u.*")
    if shared.isEmpty():
        chosen = chosen.withColumn("t", F.lit(None).cast("string"))
    else:
        doubtful = chosen.select("_key", "u", F.explode("hs").alias("h")).join(shared, "h", "left_semi").select("_key", "u").distinct().withColumn("doubt", F.lit(True))
        filled = F.filter(F.slice("_s", F.shiftright("u", 31).cast("int") + 1, (F.col("u") % PLACE - F.shiftright("u", 31) + 1).cast("int")), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        chosen = chosen.join(doubtful, ["_key", "u"], "left").withColumn("t", F.when(F.col("doubt"), F.array_join(filled, "\n")))
    chosen = chosen.select("_key", "u", F.xxhash64("hs").alias("a"), "hs", "t")
    at = F.struct("_key", "u")
    first = chosen.groupBy("a", "hs", "t").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("a", F.col("hs").alias("same"), F.col("t").alias("_same"), "first")
    later = hot_join(chosen, first, "a", hot, F.xxhash64("_key"), (F.col("hs") == F.col("same")) & F.col("t").eqNullSafe(F.col("_same"))).where(at != F.col("first"))

    units = later.groupBy("_key").agg(F.sort_array(F.collect_set("u")).alias("us"))
    cut = frozen(units.select("_key", _merged(F.col("us")).alias("_cut")))
    out = df.withColumn("_key", key).join(cut, "_key", "left")
    todo = F.split(F.when(F.col("_cut").isNotNull(), F.col(text_col)), "\n", -1)
    left = let(todo, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), _places("_cut")), lambda i: F.element_at(x, i + 1)))
    text = F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return back(out.select(*[text.alias(c) if c == text_col else c for c in df.columns], F.when(F.col("_cut").isNull(), 0).otherwise(F.size("_cut")).alias("n_cut_passages")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a document that was wholly a repetition of earlier ones goes."""
    docs, back = set_aside(docs, ("n_cut_passages",))
    out = passage_dedup(docs)
    return back(out.where((F.col("n_cut_passages") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l),
e AS (SELECT *, (lag(h) OVER w * 31 + h) % 3 = 0 AS ends FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS c, count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS filled FROM k GROUP BY doc_id, k),
r AS (SELECT *, row_number() OVER (PARTITION BY c, filled >= 2 ORDER BY doc_id, k) AS nth FROM c),
t AS (SELECT doc_id, coalesce(string_agg(c, chr(10) ORDER BY k) FILTER (filled < 2 OR nth = 1), '') AS text,
             CAST(count(*) FILTER (filled >= 2 AND nth > 1) AS INTEGER) AS n_cut_chunks FROM r GROUP BY doc_id)
SELECT d.doc_id, t.text, d.lang, d.source, d.n_chars, coalesce(t.n_cut_chunks, 0) AS n_cut_chunks FROM documents d LEFT JOIN t USING (doc_id)
"""
