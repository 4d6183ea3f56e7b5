"""Token counts: batch encoding in Arrow functions that return lengths only.

The tokenizer never looks across ASCII white space (its normaliser turns it into
one blank, its pre-tokenizer drops it), so every text, long ones above all, is
split there into pieces.  Of each slice of texts of bounded bytes the distinct
pieces that are not known yet are encoded in batches balanced by bytes; a
text's count is the sum over its pieces.  Known lengths stay in a memo of
bounded size for each task.  No ids ever leave the worker.

Defined results: a null text counts as empty: 0 bytes, 0 tokens.  Special
strings inside texts are matched as the tokenizer's file says.  Rows are
independent, so repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import ship
from lakeseek.llm.kernels import slices

#: Token limit of the over_limit flag, bytes of pieces in one encoded batch, and lengths kept for each task.
LIMIT, BATCH_BYTES, MEMO_ENTRIES = 2048, 1 << 18, 250_000


def _balanced(pieces: list[bytes], limit: int) -> Iterator[list[bytes]]:
    for a, b in slices(_lengths(pieces), limit):
        yield pieces[a:b]


def _lengths(pieces: list[bytes]):
    import numpy as np

    return np.fromiter(map(len, pieces), np.int64, len(pieces))


def _counter(vocabulary, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        memo: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("").cast(pa.large_binary())
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            counts: list[int] = []
            for a, b in slices(sizes):
                split = [t.split() for t in texts.slice(a, b - a).to_pylist()]
                distinct = set().union(*split)
                if len(memo) + len(distinct) > MEMO_ENTRIES:
                    new, memo = list(distinct), {}
                else:
                    new = [w for w in distinct if w not in memo]
                for group in _balanced(new, BATCH_BYTES):
                    found = tokenizer.encode_batch_fast([w.decode() for w in group], add_special_tokens=False)
                    memo.update(zip(group, map(len, found), strict=True))
                counts += [sum(map(memo.__getitem__, words)) for words in split]
                if len(memo) > MEMO_ENTRIES:
                    memo = {}
            tokens = pa.array(counts, pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), tokens, pc.greater(tokens, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs(doc_id, text); vocabulary_path: a tokenizers JSON file that the driver can read, sent once to each executor."""
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary_path, encoding="utf-8") as source:
        vocabulary = spark.sparkContext.broadcast(source.read())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counter(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
