"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding at *safe boundaries*: right before an ASCII
white-space character that follows a character which is white space under no
definition.  No alternative of the splitting pattern matches across such a
place, and none looks further, so each match stays whole and the ids are those
of the uncut text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import map_batches

#: Longer texts are cut at the next safe boundary.
SPLIT_CHARS = 1 << 15
_SAFE = re.compile(f"(?<=[!-~{chr(0xC0)}-{chr(0x24F)}])(?=[ \\t\\n\\r])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int = SPLIT_CHARS) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "token_ids", split_chars: int = SPLIT_CHARS) -> DataFrame:
    """Add ``out`` (array<int>), the ids of the whole text without special tokens.

    Null and empty texts get an empty array; strings that look like special
    tokens are ordinary text; all other columns and repeated rows pass through;
    an existing column ``out`` is replaced.
    """
    df = df.drop(out) if out != text else df
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        texts = batch.column(text).to_pylist()
        start, ids, held = 0, [], 0
        for i, t in enumerate(texts):
            got = [enc.encode_to_numpy(p, disallowed_special=()).astype(np.int32) for p in safe_pieces(t or "", split_chars)]
            ids.append(got[0] if len(got) == 1 else np.concatenate(got))
            held += len(ids[-1])
            if held > 500_000 or i + 1 == len(texts):
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                kind = pa.list_(pa.field("element", pa.int32(), False))
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), type=kind)
                part = batch.slice(start, len(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*batch.schema.names, out])
                start, ids, held = i + 1, [], 0

    return map_batches(df, run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the raw bytes of the ids, which need not be valid UTF-8 by themselves. Null ids give null."""
    df = df.drop(out) if out != ids else df
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType(), True)])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            got = [None if x is None else enc.decode_bytes(x) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*batch.schema.names, out])

    return map_batches(df, run, schema)
