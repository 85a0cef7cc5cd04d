"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import spread

#: File of ranks in the format of tiktoken; read on the driver and sent to the tasks (about a megabyte).
RANKS = os.environ.get("CAIRNFLOW_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
MOST_BYTES = 16 << 20

#: Fixed value: the public pattern by which that vocabulary splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def with_tokens(df: DataFrame, text: str, name: str = "n_tokens", ranks: str = RANKS) -> DataFrame:
    """``df`` with ``text`` replaced by its number of tokens. Null and empty texts have 0. Whole texts, one pass, no shuffle."""
    if os.path.getsize(ranks) > MOST_BYTES:
        raise ValueError(f"{ranks} is larger than {MOST_BYTES} bytes")
    with open(ranks, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in df.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(sent.value).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if (t := x.as_py()) else 0 for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64())], names=[*kept, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    return spread(df.select(*kept, text)).mapInArrow(count, f"{fields}, `{name}` bigint")
