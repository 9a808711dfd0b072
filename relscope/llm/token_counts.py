"""Token counts: pieces counted once per distinct pre-token, summed without ids.

Each document's pre-token frequencies are joined to the number of tokens of each distinct
pre-token (:mod:`.blocks`); no token ids exist at any time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import blocks, pretoken, runtime, vocab

#: Characters of a block, and the length from which a text is cut for pre-tokenising.
BLOCK_CHARS, PART_CHARS = 3_000_000, 500_000

RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _extract(path: str):
    table = pretoken.table_data("tokenizers")

    def run(rows: Iterator[tuple]) -> Iterator[blocks.Counts]:
        pretoken.use("tokenizers", table)
        special = vocab.special_pattern(path)

        def block(ids: list, extra: list, owners: list, parts: list) -> blocks.Counts:
            owner, found = [], []
            for at in range(0, len(parts), 4096):
                pieces, counts = pretoken.split_batch(parts[at : at + 4096], "tokenizers")
                owner.append(np.repeat(np.array(owners[at : at + 4096], np.int64), counts))
                found += pieces
            code, keys = pd.factorize(np.array(found, object)) if found else (np.zeros(0, np.int64), np.zeros(0, object))
            return blocks.Counts(ids, extra, *blocks.sparse(np.concatenate(owner) if owner else np.zeros(0, np.int64), code, len(keys)), keys)

        ids, extra, owners, parts, size = [], [], [], [], 0
        for doc_id, text in rows:
            plain = special.split(text)
            for stretch in plain:
                for part in pretoken.cuts(stretch, PART_CHARS):
                    owners.append(len(ids))
                    parts.append(part)
            ids.append(doc_id)
            extra.append((len(text.encode()), len(plain) - 1))
            size += len(text) + 1
            if size >= BLOCK_CHARS:
                yield block(ids, extra, owners, parts)
                ids, extra, owners, parts, size = [], [], [], [], 0
        if ids:
            yield block(ids, extra, owners, parts)

    return run


def _answer(path: str):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        count = vocab.PieceCounts(path)
        for block, shard, data in rows:
            keys, at = runtime.unpack(data)
            yield block, shard, runtime.pack((at, np.array([count[k] for k in blocks.keys_of(keys)], np.uint32)))
            count.trim()

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text, by a byte-level ``.json`` vocabulary.

    One row per input row.  A null text counts as empty: 0 bytes, 0 tokens.  A null doc_id
    stays null; repeated rows give repeated results; an empty table gives none.  Special
    strings inside texts count one token each, as the library takes them by default.
    Columns besides doc_id and text are not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = runtime.tune(docs.sparkSession)
    shards = runtime.shards(spark)
    packed = runtime.stored(blocks.packed(runtime.with_text(docs), _extract(path), shards))
    answers = blocks.answered(packed, None, _answer(path), shards)
    finish = lambda doc_id, extra, total, n: (doc_id, extra[0], extra[1] + round(total))
    return blocks.summed(packed, answers, shards, finish, RESULT, "doc_id long, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(runtime.read(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", counts.n_tokens > 1024)
