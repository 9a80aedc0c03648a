"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary reports, at each position, all pieces that end there (its output links);
each relaxes the best score of the position, so one pass over the text is the Viterbi search for the segmentation with
the highest sum of piece scores. Characters that no piece covers cost `lowest score - 10` and become byte pieces.

No piece holds a word start mark after another character, so the search splits exactly before each mark that follows
another character; results of short segments are remembered in a table of bounded size.

The mark stands for a space. Where a text holds the mark's own character, that goes out as its bytes, so decoding gives
every text back as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm.common import bounded_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # piece types of the model format
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
REMEMBER, REMEMBER_CHARS = 400_000, 48


def read_pieces(blob: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) from a serialised model: field 1 of the message, with fields 1, 2 and 3."""
    def fields(b: bytes):
        at = 0

        def varint() -> int:
            nonlocal at
            v = shift = 0
            while True:
                x = b[at]
                at += 1
                v |= (x & 127) << shift
                shift += 7
                if x < 128:
                    return v

        while at < len(b):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            else:
                n = {1: 8, 5: 4}.get(tag & 7) or varint()
                yield tag >> 3, b[at : at + n]
                at += n

    out = []
    for number, value in fields(blob):
        if number == 1:
            f = dict(fields(value))
            out.append((f.get(1, b"").decode(), float(np.frombuffer(f.get(2, b"\0" * 4), "<f4")[0]), f.get(3, NORMAL)))
    return out


class _Known(dict):
    """Ids of short segments, made when first asked for; emptied when full."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, s: str) -> list[int]:
        ids = self.make(s)
        if len(s) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                self.clear()
            self[s] = ids
        return ids


class Pieces:
    """A vocabulary with its automaton."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.text = [p for p, _, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        self.byte = [0] * 256
        #: What a piece adds to a decoded text; bytes of 128 and more are lone surrogates until the text is whole.
        self.plain = [p.replace(MARK, " ") if k == NORMAL else "" for p, _, k in pieces]
        self.auto = ahocorasick.Automaton()
        scores = []
        self.splits = True
        for i, (p, s, k) in enumerate(pieces):
            if k == BYTE:
                b = int(p[3:5], 16)
                self.byte[b] = i
                self.plain[i] = chr(b) if b < 128 else chr(0xDC00 + b)
            elif k == NORMAL:
                scores.append(s)
                self.auto.add_word(p, (len(p), s, i))
                self.splits &= MARK not in p.lstrip(MARK)
        self.auto.make_automaton()
        self.no_piece = min(scores, default=0.0) - 10.0
        self.known = _Known(self.segment)

    def segment(self, s: str) -> list[int]:
        """Ids of the best segmentation. Of equal scores at a position, the piece that starts first there."""
        n = len(s)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 0
        lone = self.no_piece

        def skip(to: int) -> None:  # positions up to `to` are settled; each may also be reached by an uncovered character
            nonlocal at
            while at < to:
                at += 1
                if best[at - 1] + lone > best[at]:
                    best[at], back[at] = best[at - 1] + lone, (at - 1, -1)

        for end, (size, score, i) in self.auto.iter(s):
            end += 1
            if end > at + 1:
                skip(end - 1)
            v = best[end - size] + score
            if v > best[end]:
                best[end], back[end] = v, (end - size, i)
        skip(n)
        out: list[int] = []
        while n:
            start, i = back[n]
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte[b] for b in reversed(s[start:n].encode("utf-8", "surrogatepass"))]
            n = start
        out.reverse()
        return out

    def _encode_marked(self, marked: str) -> list[int]:
        if not self.splits:
            return self.segment(marked)
        return list(chain.from_iterable(map(self.known.__getitem__, _SEGMENT.findall(marked))))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; a word start mark is put before it and stands for each space, as the model's settings say."""
        if not text:
            return []
        if MARK not in text:
            return self._encode_marked(MARK + text.replace(" ", MARK))
        own = [self.byte[b] for b in MARK.encode()]
        first, *rest = (part.replace(" ", MARK) for part in text.split(MARK))
        out = self._encode_marked(MARK + first)
        for part in rest:
            out += own + self._encode_marked(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: of those of `encode`, the text that was encoded. Bytes that are no UTF-8 become U+FFFD."""
        out = "".join(map(self.plain.__getitem__, ids))[1:]
        return out if out.isascii() else out.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(blob: bytes) -> Pieces:
    return Pieces(read_pieces(blob))


def _shipped(df: DataFrame, model: str):
    """The model's file, read by the driver and sent to the executors."""
    with open(model, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_column(df: DataFrame, text_col: str = "text", model: str = MODEL, check: bool = True) -> DataFrame:
    """`df` plus token_ids array<int>, n_tokens int and, with `check`, round_trip boolean (decoding gives the text back).

    Null text gives null ids, null count and null round_trip; empty text gives no ids. Very long texts are one search,
    in time linear in their length; a task holds a batch of them. Of segmentations with equal scores the one whose last
    piece starts first is taken, from the end on. Repeated rows give repeated results, an empty table an empty one. The
    driver reads the model file and sends it. Other columns pass through, but input columns named like a result give way
    to it.
    """
    bounded_batches(df.sparkSession, 4)
    df = df.drop("token_ids", "n_tokens", *["round_trip"] * check)
    names = df.columns
    held = _shipped(df, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(held.value)
        for b in batches:
            texts = b.column(names.index(text_col)).to_pylist()
            ids = [None if t is None else pieces.encode(t) for t in texts]
            lens = [None if x is None else len(x) for x in ids]
            flat = np.fromiter(chain.from_iterable(x for x in ids if x is not None), np.int32)
            offs = pa.array(np.concatenate(([0], np.cumsum([n or 0 for n in lens]))), pa.int32())
            arr = pa.ListArray.from_arrays(offs, pa.array(flat), mask=pa.array([x is None for x in ids]))
            cols = [*b.columns, arr, pa.array(lens, pa.int32())]
            if check:
                cols.append(pa.array([None if t is None else pieces.decode(x) == t for t, x in zip(texts, ids)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, [*names, "token_ids", "n_tokens", *["round_trip"] * check])

    extra = "token_ids array<int>, n_tokens int" + ", round_trip boolean" * check
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + extra
    return df.mapInArrow(scan, schema)


def decode_column(df: DataFrame, ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """`df` plus decoded string; null ids give null. An input column decoded gives way to the result."""
    df = df.drop("decoded")
    names = df.columns
    held = _shipped(df, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(held.value)
        for b in batches:
            ids = b.column(names.index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else pieces.decode(x) for x in ids], pa.string())], [*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", decoded string"
    return df.mapInArrow(scan, schema)


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return encode_column(docs, check=False)
