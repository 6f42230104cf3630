"""Sizes of texts in tokens of a public byte-level tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: default vocabulary file; every function takes another path
VOCABULARY = os.environ.get("LOOMSHEET_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: fixed value: the split pattern the vocabulary was made with
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: longer texts are encoded in parts cut after a line break before a non-blank, where no token can span
PART = 200_000


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _parts(text: str) -> Iterator[str]:
    begin = 0
    while len(text) - begin > PART:
        at = text.find("\n", begin + PART)
        while at >= 0 and at + 1 < len(text) and text[at + 1].isspace():
            at = text.find("\n", at + 1)
        if at < 0 or at + 1 >= len(text):
            break
        yield text[begin : at + 1]
        begin = at + 1
    yield text[begin:]


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; 0 for null and empty ones."""
    if not text:
        return 0
    encode = encoding(path).encode_ordinary
    clean = text.encode("utf-8", "replace").decode("utf-8")
    return sum(len(encode(p)) for p in _parts(clean))


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """The other columns of ``df`` with the number of tokens in place of the text, which isn't carried on."""
    names = [n for n in df.columns if n not in (text, out)]
    schema = T.StructType([*(df.schema[n] for n in names), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count(t, path) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*names, out])

    return df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`")).mapInArrow(run, schema)
