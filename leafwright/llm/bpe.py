"""BPE encoding and decoding by forced-boundary splitting.

A null or empty text has no tokens and decodes to the empty string.  Rows are
independent, so repeated rows and ties give repeated results; columns other
than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.fragments import shared_codec, joined
from leafwright.llm.textscan import blocks, tidy


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tokenizer)
        for batch in batches:
            for b in blocks(batch.column(1)):
                ids, starts = codec.encode(b)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.start, len(b)), lists], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text): the text of each list of ids; bytes that are no UTF-8
    are replaced as the library's decoder does."""
    schema = f"{id_col} {tokens.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared_codec(tokenizer).token_bytes()
        for batch in batches:
            lists = batch.column(1)
            lengths = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            data, at = joined(table, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), starts)
            texts = [bytes(data[a:z]).decode("utf-8", "replace") for a, z in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(F.col(id_col), F.col("ids")).mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and
    decoded again in one pass over the texts."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tokenizer)
        pieces = codec.token_bytes()
        decimal = pa.array([b"%d," % i for i in range(len(pieces))], pa.large_binary())
        sha = hashlib.sha256
        for batch in batches:
            for b in blocks(batch.column(1)):
                ids, starts = codec.encode(b)
                shown, at = joined(decimal, ids, starts)
                listed = [sha(shown[a : max(a, z - 1)]).hexdigest() for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)]
                raw, at = joined(pieces, ids, starts)
                back = [sha(_utf8(raw[a:z])).hexdigest() for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.start, len(b)), pa.array(np.diff(starts)), pa.array(listed, pa.string()), pa.array(back, pa.string())],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def _utf8(raw: memoryview) -> bytes:
    data = bytes(raw)
    try:
        data.decode("utf-8")
        return data
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()
