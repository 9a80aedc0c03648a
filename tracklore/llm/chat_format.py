"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. Successive turn prefixes are rendered and consecutive outputs
compared: if an output starts with the one before it, what it adds is the new turn's span; if not, the template rewrites
history, which is reported instead of guessed at. The loss mask covers the assistant texts inside their spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracklore.llm.common import bounded_batches, table

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

_TEXT = re.compile(r"[\\#<]")
_ROLE = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_OPEN = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
END = "</turn>\n"


#: Turns whose rendered form is remembered between prefixes, and the longest text for which it is.
REMEMBER, REMEMBER_CHARS = 1 << 14, 2_000


def _piece(turn: Turn) -> str:
    return f"### {_ROLE.sub(r'\\\g<0>', turn[0])}: {_TEXT.sub(r'\\\g<0>', turn[1])}{END}"


_known_piece = lru_cache(maxsize=REMEMBER)(_piece)


def marked(turns: list[Turn]) -> str:
    """`### role: text</turn>` and a newline per turn. A backslash goes before each backslash, # and < of a text, so a
    control string never stands in one, and before each colon of a role as well."""
    return "".join([_known_piece(t) if len(t[1]) <= REMEMBER_CHARS else _piece(t) for t in turns])


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def spans(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int]] | None]:
    """The whole output and each turn's (start, end) in it; None for a template that rewrites history."""
    out, found = template([]) if not turns else "", []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(out):
            return template(turns), None
        found.append((len(out), len(now)))
        out = now
    return out, found


def read_back(out: str, found: list[tuple[int, int]]) -> tuple[list[Turn], list[tuple[int, int]]]:
    """Turns parsed from the spans of an output of `marked`, and the loss mask: spans of assistant texts."""
    turns, mask = [], []
    for a, b in found:
        head = _OPEN.match(out, a, b)
        start, stop = head.end(), b - len(END)
        turns.append((unescape(head[1]), unescape(out[start:stop])))
        if turns[-1][0] == "assistant":
            mask.append((start, stop))
    return turns, mask


def format_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    template: Template = marked,
) -> DataFrame:
    """One row per conversation: `<conv_col>`, roles, texts, formatted, turn_starts, turn_ends (null for a template that
    rewrites history), rewrites_history.

    Rows of a conversation are put in order of turn, role and text, nulls first. Null roles and texts count as empty; each
    row with a null conversation id is a conversation of its own. Ids may be of any type. Repeated rows are repeated
    turns, equal turn numbers stand in order of role and text. An empty table gives no rows; extra columns are ignored,
    whatever their names. A conversation is held in one task's memory, as its output is; very long texts count as any
    others. Rendering every prefix takes time in the square of the number of turns, times the length of a turn, for
    copying and comparing strings.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("k"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lone = F.when(F.col("c").isNull(), F.xxhash64("k", "r", "t"))  # spreads rows without an id
    rows = rows.repartition("c", lone).sortWithinPartitions("c", "k", "r", "t").select("c", "r", "t")
    kind = df.schema[conv_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(kind), *_KINDS]

        def stream():
            n = 0
            for b in batches:
                for conv, r, t in zip(*(x.to_pylist() for x in b.columns)):
                    n += conv is None
                    yield (conv, n if conv is None else 0), r, t

        pile: list[tuple] = []
        for (conv, _), own in groupby(stream(), key=itemgetter(0)):
            turns = [(r, t) for _, r, t in own]
            out, found = spans(turns, template)
            pile.append((conv, [r for r, _ in turns], [t for _, t in turns], out, found and [a for a, _ in found], found and [b for _, b in found], found is None))
            if len(pile) >= 200:
                yield _batch(pile, kinds)
                pile = []
        if pile:
            yield _batch(pile, kinds)

    return rows.mapInArrow(scan, f"`{conv_col}` {kind.simpleString()}, roles array<string>, texts array<string>, formatted string, turn_starts array<int>, turn_ends array<int>, rewrites_history boolean")


_KINDS = [pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()]


def _batch(pile: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*pile), kinds)], ["conv", "roles", "texts", "formatted", "turn_starts", "turn_ends", "rewrites_history"])


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What reading the output back gives, as counts and hashes. Of a conversation whose template rewrites history only
    formatted_chars is known; the others are null."""
    kind = formatted.schema[conv_col].dataType
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, a, z in zip(*(x.to_pylist() for x in b.columns[1:])):
                if a is None:
                    out.append((None, None, None, None, len(text)))
                    continue
                turns, mask = read_back(text, list(zip(a, z)))
                loss = "".join(unescape(text[i:j]) for i, j in mask)
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), loss)]
                out.append((len(turns), sha[0], len(loss), sha[1], len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 5, kinds))], names)

    schema = f"`{conv_col}` {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(conv_col, "formatted", "turn_starts", "turn_ends").mapInArrow(scan, schema)


PROBE = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(format_conversations(rows))


OP10_SQL = r"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(14 + 2 * len(role) - len(regexp_replace(role, '[\\#<:]', '', 'g')) + 2 * len(text) - len(regexp_replace(text, '[\\#<]', '', 'g'))) AS formatted
      FROM c GROUP BY conv_id, lone)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted AS BIGINT) AS formatted_chars FROM g
"""
