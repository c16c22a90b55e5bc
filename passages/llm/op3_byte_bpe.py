"""Operator 3, byte-level BPE encoding and decoding with vectorised pre-tokenisation.

encode_texts() finds token boundaries of many texts at once (see pretok) and merges each distinct
pre-token once per worker (see bpe); the slices' ids and byte offsets come from the cache. decode() turns
ids into bytes by the vocabulary, and byte offsets of the ids come with it.

Defined results: a null text is the empty text, with no ids; texts are encoded whole, whatever their
length; repeated rows give repeated rows; other columns are ignored. Lone surrogates can't occur in Parquet
strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.bpe import encoder, token_bytes
from passages.llm.common import table

NAME = "op3_byte_bpe"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def decode(ids: list[int], path: str) -> bytes:
    return b"".join(map(token_bytes(path).__getitem__, ids))


def offsets(ids: list[int], path: str) -> list[int]:
    """Byte offset at which each id starts."""
    sizes = [len(x) for x in map(token_bytes(path).__getitem__, ids)]
    return list(accumulate(sizes, initial=0))[:-1]


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        written = [b"%d" % i for i in range(len(token_bytes(path)))]
        for texts in batches:
            rows = []
            for ids in (x.tolist() for x in own.encode([t or "" for t in texts])):
                listed = b",".join(map(written.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(F.col(f"`{text}`")).alias("_d")).select("doc_id", "_d.*")


def encode_column(path: str):
    """A pandas UDF text -> array of ids."""

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x.astype("int32") for x in encoder(path).encode([t or "" for t in texts])])

    return encoded


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


#: SQL can't express the merges: tests compare with the tiktoken library.
ORACLE_SQL = None
