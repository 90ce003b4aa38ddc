"""Token counts by a map-side two-tier lookup.

The first tier is a broadcast hash table from frequent pre-tokens to their number of tokens: the pieces of the vocabulary that are
pre-tokens by themselves, which are the ones that were frequent when it was made. Its size is bounded by the vocabulary's, and no pass over the data is needed to
fill it. A worker encodes a miss with the library and keeps it in a bounded cache, the second tier, as long as the worker lives. No pre-token is
shuffled. Both tables are caches; no count depends on them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import texts_of
from heatloom.llm.pretokens import Bounded, PreTokenizer, pretokenizer


def frequent_lengths(vocabulary: str) -> dict[str, int]:
    """Tokens of each piece of the vocabulary that the pre-tokenizer leaves whole; at most as many entries as the vocabulary has."""
    split = pretokenizer(vocabulary)
    texts = filter(None, map(split.surface, split.library.get_vocab(with_added_tokens=False)))
    return {t: len(split.ids(t)) for t in texts if len(t) <= 64 and split.pieces(t) == [t]}


class TokenCounter:
    def __init__(self, split: PreTokenizer, frequent: dict[str, int], cached: int):
        self.split = split
        self.look = Bounded(lambda piece: len(split.ids(piece)), frequent, cached).__getitem__

    def count(self, text: str) -> int:
        split = self.split
        if not split.plain(text):
            return len(split.whole(text))
        parts = split.parts(text)
        return len(parts) // 2 + sum(sum(map(self.look, split.pieces(p))) for p in parts[::2])


_WORKER: dict[tuple, TokenCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, cached: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text).

    Counts are those of the library without added special tokens, truncation or padding. A null or empty text has 0 bytes
    and 0 tokens; rows with a null or repeated doc_id are counted like others; other columns are ignored, so their names
    cannot clash; an empty table gives an empty one. Long texts are counted whole. Pre-tokens over 64 characters
    are encoded but not cached.
    """
    lengths = docs.sparkSession.sparkContext.broadcast(frequent_lengths(vocabulary))

    def count(batches):
        key = (vocabulary, cached)
        if key not in _WORKER:
            _WORKER[key] = TokenCounter(pretokenizer(vocabulary), lengths.value, cached)
        counter = _WORKER[key]
        for batch in batches:
            texts = texts_of(batch)
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
