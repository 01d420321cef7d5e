"""Public tokenizers inside Arrow workers. Their files are read where they lie; nothing is trained here."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

FOLDER = os.environ.get("SIFTARA_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = f"{FOLDER}/byte_bpe_50k.tiktoken"
#: For texts in several languages: on those, and on odd widths, the English vocabulary needs up to a fifth more tokens.
MANY_LANGUAGES = f"{FOLDER}/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how this byte-level vocabulary cuts a text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def fingerprint(path: str = TOKENIZER) -> str:
    """Digest of the tokenizer file and of the word pattern; a count holds only under the same one."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + WORDS.encode()).hexdigest()


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def count_one(text: str | None, path: str = TOKENIZER) -> int:
    return len(_encoding(path).encode_ordinary(text)) if text else 0


def count_tokens(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """``key`` and ``tokens`` of each row; a null or empty text has 0 tokens. Every text is encoded whole."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for batch in batches:
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["key", "tokens"])

    kind = dict(df.dtypes)[key]
    return df.select(f"`{key}`", f"`{text}`").mapInArrow(encode, f"key {kind}, tokens long").withColumnRenamed("key", key)
