"""Product codes of vectors: a small codebook for each part of a vector, fitted by Lloyd rounds with Elkan's bounds.

Components are integers (floor(4096 * x)), so distances, means and ties are exact whatever the
order of rows and tasks. A round keeps for each part of each vector its entry, an upper bound of the distance to it, and a
lower bound of the distance to every entry. Entries move between rounds, and the bounds move with them; an entry whose
lower bound, or half its distance to the present entry, is strictly above the upper bound needs no distance. Whatever is
left, ties too, is decided by exact integer distances.

Bounds are rounded outwards: the upper ones to 32 bits, the lower ones to 8 bits of the largest. They are written with the
vectors to the shared folder, one folder a round, the folder before deleted; each task adds one row with its sums per
entry, so a round is one pass and a read of those rows. What the driver holds is the codebooks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklore.llm.common import bounded_batches, drop_folder, frozen, hot_join, hot_keys, shared_folder, table

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Relative slack of bounds, far above the rounding of the few operations that make them.
SLACK = 1e-9
EXACT = float(1 << 53)
LIMB = 32

Books = list[list[list[int]]]  # part, entry, position


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str | None, parts: int) -> tuple[DataFrame, int, list[list[float]]]:
    """(_id, _label, _v), the width of a part, and the vectors of the smallest ids: rows whose vector has finite components only and
    is as long as that of the first such id. _v holds the scaled integers as doubles, which are exact, and zeros to a multiple of `parts`."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    vec = F.col(vec_col).cast("array<double>")
    scaled = F.transform(vec, lambda x: x * 4096)
    rows = df.select(F.col(id_col).alias("_id"), label.alias("_label"), scaled.alias("_v"))
    rows = rows.where((F.size("_v") > 0) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    order = [F.asc_nulls_last("_id"), F.asc("_v")]
    first = rows.orderBy(*order).limit(1).select(F.size("_v")).collect()
    if not first:
        return rows, 0, []
    dim = first[0][0]
    rows = rows.where(F.size("_v") == dim)
    width = -(-dim // parts)
    if width * parts > dim:
        rows = rows.withColumn("_v", F.concat("_v", F.array_repeat(F.lit(0.0), width * parts - dim)))
    smallest = rows.orderBy(*order).limit(ENTRIES_MOST)
    return rows, width, [r[0] for r in smallest.select("_v").collect()]


ENTRIES_MOST = 256  # two hex digits


def _gap(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis, exact in either form that `_forms` gives."""
    d = x - c
    return (d * d).sum(axis=-1)


def _forms(v: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray, bool]:
    """Vectors and codebooks as doubles where all sums of squares are below 2 ** 53, else as integers of any size."""
    top = max(abs(x) for part in books for e in part for x in e)
    most = max(float(np.abs(v).max(initial=0.0)), float(top) if top < 1 << 1000 else EXACT)
    if v.shape[-1] * (2 * most) ** 2 < EXACT if most < 1e100 else False:
        return v, np.array(books, dtype=float), True
    whole = np.empty(v.shape, dtype=object)
    whole.reshape(-1)[:] = [int(x) for x in v.reshape(-1).tolist()]
    return whole, np.array(books, dtype=object).reshape(len(books), len(books[0]), v.shape[-1]), False


def nearest(v: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None, int]:
    """Entries, their squared distances, upper and lower bounds, by all distances; bounds are None if not in doubles."""
    x, c, plain = _forms(v, books)
    d = np.stack([_gap(x, c[:, j]) for j in range(c.shape[1])], axis=-1)
    at = d.argmin(axis=-1) if plain else np.array([[min(range(c.shape[1]), key=lambda j: (p[j], j)) for p in row] for row in d], dtype=np.int64).reshape(d.shape[:2])
    best = np.take_along_axis(d, at[..., None], axis=-1)[..., 0]
    if not plain:
        return at, best, None, None, d.size
    return at, best, np.sqrt(best) * (1 + SLACK), np.sqrt(d) * (1 - SLACK), d.size


def renewed(v: np.ndarray, books: Books, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, errors: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None, int]:
    """As `nearest`, from the entries and bounds of the round before and how far each entry has moved since. Squared distances are
    given for all rows if `errors`, else only where they were taken."""
    x, c, plain = _forms(v, books)
    if not plain or not np.isfinite(upper).all():
        return nearest(v, books)
    part = np.arange(c.shape[0])
    at, upper, lower = at.copy(), (upper + moved[part, at]) * (1 + SLACK), np.maximum(0.0, lower - moved) * (1 - SLACK)
    half = np.sqrt(((c[:, :, None] - c[:, None]) ** 2).sum(axis=-1)) * (0.5 * (1 - SLACK))
    floor = np.maximum(lower, half[part, at])  # of the distance to each entry, as far as it may be the nearest
    np.put_along_axis(floor, at[..., None], np.inf, axis=-1)
    open_ = (floor <= upper[..., None]).any(axis=-1)  # strictly above: neither nearer nor as near
    best = np.full(at.shape, np.nan)
    row, p = np.nonzero(open_ | errors)
    own = at[row, p]
    d = _gap(x[row, p], c[p, own])
    best[row, p], upper[row, p], lower[row, p, own] = d, np.sqrt(d) * (1 + SLACK), np.sqrt(d) * (1 - SLACK)
    done = d.size
    near = floor <= upper[..., None]  # half distances hold for the entry that they are of, so before any other is taken
    for j in range(c.shape[1]):
        row, p = np.nonzero(open_ & near[..., j] & (lower[..., j] <= upper))
        d = _gap(x[row, p], c[p, j])
        done += d.size
        lower[row, p, j] = np.sqrt(d) * (1 - SLACK)
        win = (d < best[row, p]) | ((d == best[row, p]) & (j < at[row, p]))
        row, p, d = row[win], p[win], d[win]
        at[row, p], best[row, p], upper[row, p] = j, d, np.sqrt(d) * (1 + SLACK)
    return at, best, upper, lower, done


def _packed(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper bounds in 32 bits, rounded up; lower ones as a scale in 32 bits and 8 bits each, rounded down."""
    up = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
    scale = np.nextafter((lower.max(axis=-1) / 255).astype(np.float32), np.float32(np.inf))
    q = np.floor(lower / scale[..., None].astype(float)).clip(0, 255)
    q -= q * scale[..., None].astype(float) > lower
    return up, scale, q.clip(0, 255).astype(np.uint8)


def _rows(a: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(a[0].nbytes), len(a), [None, pa.py_buffer(np.ascontiguousarray(a).tobytes())]).cast(pa.binary()) if len(a) else pa.array([], pa.binary())


def _column(b: pa.RecordBatch, name: str, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(name).to_pylist()), dtype=kind).reshape(b.num_rows, *shape)


def _limbs(cell: int, value: int) -> list[dict]:
    """A sum of any size as numbers that add up in 64 bits over as many tasks as there may be."""
    out, k = [], 0
    while value not in (0, -1):
        if -(1 << 40) < value < 1 << 40:
            return [*out, {"cell": cell, "limb": k, "v": value}]
        out.append({"cell": cell, "limb": k, "v": value & ((1 << LIMB) - 1)})
        value, k = value >> LIMB, k + 1
    return [*out, {"cell": cell, "limb": k, "v": value}] if value else out


def _vectors(b: pa.RecordBatch, width: int, parts: int) -> np.ndarray:
    return np.floor(b.column("_v").flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, parts, width)


SUMS = "array<struct<cell:int,limb:int,v:bigint>>"


def _round(rows: DataFrame, books: Books, moved: list[list[float]] | None, path: str) -> None:
    """Writes every row with its entries and bounds, and one row for each task with sums and counts per entry."""
    parts, entries, width = len(books), len(books[0]), len(books[0][0])
    kinds = {c: rows.schema[c].dataType for c in ("_id", "_label")}
    names = ["_id", "_label", "_v", "_at", "_upper", "_scale", "_lower", "_sums"]
    schema = T.StructType([*[T.StructField(c, k) for c, k in kinds.items()], T.StructField("_v", T.ArrayType(T.DoubleType()))] + [T.StructField(c, T.BinaryType()) for c in names[3:7]])
    schema = schema.add("_sums", T._parse_datatype_string(SUMS))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.array(moved) if moved else None
        sums: dict[int, int] = {}
        done, kind = 0, None
        for b in batches:
            kind = {c: b.schema.field(c).type for c in names[:3]}
            if not b.num_rows:
                continue
            v = _vectors(b, width, parts)
            if shift is None:
                at, _, upper, lower, n = nearest(v, books)
            else:
                lower = _column(b, "_lower", np.uint8, (parts, entries)) * _column(b, "_scale", np.float32, (parts,))[..., None].astype(float)
                at, _, upper, lower, n = renewed(v, books, _column(b, "_at", np.uint8, (parts,)).astype(np.int64), _column(b, "_upper", np.float32, (parts,)).astype(float), lower, shift)
            done += n
            if upper is None:
                upper, lower = np.full(at.shape, np.inf), np.zeros((*at.shape, entries))
            plain = v.shape[0] * float(np.abs(v).max()) < EXACT
            for p in range(parts):
                for j in np.unique(at[:, p]).tolist():
                    own = v[at[:, p] == j, p]
                    cell = (p * entries + j) * (width + 1)
                    total = [int(x) for x in own.sum(axis=0).tolist()] if plain else [sum(map(int, col)) for col in own.T.tolist()]
                    for k, x in enumerate([*total, len(own)]):
                        sums[cell + k] = sums.get(cell + k, 0) + x
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, parts * width, dtype=np.int32)), pa.array(v.reshape(-1)))
            up, scale, low = _packed(upper, lower)
            none = pa.nulls(b.num_rows, pa.list_(pa.struct([("cell", pa.int32()), ("limb", pa.int32()), ("v", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), values, _rows(at.astype(np.uint8)), _rows(up), _rows(scale), _rows(low), none], names)
        if kind:
            sums[-1] = done
            own = pa.array([[x for cell, value in sums.items() for x in _limbs(cell, value)]], pa.list_(pa.struct([("cell", pa.int32()), ("limb", pa.int32()), ("v", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind["_id"]), pa.nulls(1, kind["_label"]), pa.nulls(1, pa.list_(pa.float64())), *[pa.nulls(1, pa.binary()) for _ in range(4)], own], names)

    rows.mapInArrow(step, schema).write.parquet(path)


def _moved(books: Books, state: DataFrame) -> tuple[Books, list[list[float]], int]:
    """The means of each entry's parts, floored, how far each entry has moved, rounded up, and the distances that were taken."""
    width, entries = len(books[0][0]), len(books[0])
    total: dict[int, int] = {}
    cells = state.where("_sums IS NOT NULL").select(F.inline("_sums")).groupBy("cell", "limb").agg(F.sum("v").alias("v"))
    for r in cells.collect():
        total[r.cell] = total.get(r.cell, 0) + (r.v << (LIMB * r.limb))
    new, far = [], []
    for p, part in enumerate(books):
        new.append([])
        far.append([])
        for j, entry in enumerate(part):
            cell = (p * entries + j) * (width + 1)
            n = total.get(cell + width, 0)
            mean = [total.get(cell + k, 0) // n for k in range(width)] if n else entry
            square = sum((a - b) ** 2 for a, b in zip(mean, entry))
            new[-1].append(mean)
            far[-1].append(float(square) ** 0.5 * (1 + SLACK) if square < 1 << 1000 else float("inf"))
    return new, far, total.get(-1, 0)


def vector_codes(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, taken: list[int] | None = None,
) -> tuple[DataFrame, Books]:
    """(`<id_col>`, code, error, label_error, codebooks_sha256 of each kept row; the codebooks).

    Rows whose vector is null, empty, or holds null or non-finite components (also once they are scaled) are dropped, and so are vectors of
    another length than that of the smallest id; a length that is no multiple of `parts` is filled up with zeros. Codebooks begin
    with the smallest ids' vectors, null ids last, rows of one id by their components; with fewer than `entries` rows there are
    as many entries as rows. Repeated rows count as often as they are there. Components may be of any size: beyond 53 bits the
    same steps run in integers without bounds; an error or sum of errors that does not fit a long is null. Null
    labels are one label, without a label column all rows share it. An empty table gives an empty result and no codebooks.
    Extra columns are ignored, whatever their names. `taken` gets the number of distances taken in each round."""
    spark = df.sparkSession
    bounded_batches(spark, 4)
    rows, width, smallest = kept_vectors(df, id_col, vec_col, label_col, parts)
    books: Books = [[[int(x // 1) for x in v[p * width : (p + 1) * width]] for v in smallest[: min(entries, ENTRIES_MOST)]] for p in range(parts)]
    id_kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", id_kind), T.StructField("_label", rows.schema["_label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not smallest:
        out = spark.createDataFrame([], schema)
        return out.select(F.col("_id").alias(id_col), "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256")), []
    folder = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"
    moved, before = None, None
    for k in range(rounds):
        path = f"{folder}/{k}"
        _round(rows, books, moved, path)
        state = spark.read.parquet(path)
        books, moved, n = _moved(books, state)
        if taken is not None:
            taken.append(n)
        if before:
            drop_folder(spark, before)
        rows, before = state.where("_sums IS NULL").drop("_sums"), path

    entries = len(books[0])
    shift = np.array(moved) if moved else None

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([list(f"{j:02x}".encode()) for j in range(entries)], dtype=np.uint8)
        for b in batches:
            if not b.num_rows:
                continue
            v = _vectors(b, width, parts)
            if shift is None:
                at, best, *_ = nearest(v, books)
            else:
                lower = _column(b, "_lower", np.uint8, (parts, entries)) * _column(b, "_scale", np.float32, (parts,))[..., None].astype(float)
                at, best, *_ = renewed(v, books, _column(b, "_at", np.uint8, (parts,)).astype(np.int64), _column(b, "_upper", np.float32, (parts,)).astype(float), lower, shift, errors=True)
            errors = [x if x < 1 << 63 else None for x in (sum(map(int, r)) for r in best.tolist())]
            codes = digits[at].reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), pa.array([c.tobytes().decode() for c in codes]), pa.array(errors, pa.int64())], ["_id", "_label", "code", "error"])

    coded = frozen(rows.mapInArrow(code, schema).withColumns({"_key": F.xxhash64("_label"), "_at": F.monotonically_increasing_id()}))
    drop_folder(spark, folder)
    sums = coded.groupBy("_key", F.col("_label").alias("_same")).agg(F.when(F.count_if(F.col("error").isNull()) == 0, F.try_sum("error")).alias("label_error"))
    coded = hot_join(coded, sums, "_key", hot_keys(coded, "_key"), F.col("_at"), F.col("_label").eqNullSafe(F.col("_same")))
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    return coded.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books


def decoded(codes: DataFrame, books: Books, code_col: str = "code") -> DataFrame:
    """Adds `decoded`, the vector that a code stands for (the entries' components over 4096), null for a null code. Repeated
    rows and other columns stay as they are; an empty table gives an empty result."""
    parts = range(len(books))
    book = lambda p: F.array(*[F.array(*[F.lit(x / 4096) for x in e]) for e in books[p]])
    return codes.withColumn("decoded", F.when(F.col(code_col).isNotNull(), F.concat(*[F.element_at(book(p), F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") + 1) for p in parts])))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))[0]


def _sql() -> str:
    """The rounds as one statement after another, by all distances."""
    steps = [r"""v AS MATERIALIZED (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(e) // 8) AS part, (i - 1) % (len(e) // 8) AS pos, floor(4096 * e[i]::DOUBLE)::BIGINT AS x FROM v, unnest(range(1, len(e) + 1)) u(i)),
b0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 16) USING (vec_id))"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS (SELECT vec_id, part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN b{k} USING (part, pos) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (SELECT part, entry, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS c FROM x JOIN a{k} USING (vec_id, part) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m{k}.c, b{k}.c)::BIGINT AS c FROM b{k} LEFT JOIN m{k} USING (part, entry, pos))""")
    return f"""WITH {", ".join(steps)},
o AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256 FROM o JOIN v USING (vec_id)"""


OP13_SQL = _sql()
