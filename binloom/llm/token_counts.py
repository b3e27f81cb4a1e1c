"""Token counts: pieces are counted once for each distinct pre-token, joined to the documents' pre-token frequencies and summed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices
from .pretokens import encoded, vocabulary

#: Distinct pre-tokens whose piece counts a worker remembers, and text bytes handled at a time.
REMEMBERED, CHUNK = 1_000_000, 4 << 20
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_counts: dict[str, dict[str, int]] = {}


def add_piece_counts(words: set[str], path: str, known: dict[str, int]) -> None:
    """Adds to `known` the piece counts of the words that it lacks, asking the tokenizer once for each."""
    new = list(words - known.keys())
    known.update(zip(new, (len(ids) // 4 for ids in encoded(new, path))))


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Each document becomes its distinct pre-tokens with their frequencies.  They are joined to a table of
    piece counts, one for each distinct pre-token, and the products are summed; no document's ids are built.
    The join is made inside each task, in a bounded table that the worker's tasks share: a document
    has two thirds as many distinct pre-tokens as pre-tokens, so a shuffled join would write more than the texts.

    Null and empty texts have 0 bytes and tokens; a null doc_id stays null; repeated rows give a row
    each; other columns are not read, whatever their names.  A text of any length is handled whole.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = vocabulary(path).split, _counts.setdefault(path, {})
        for batch in batches:
            texts = batch.column("text").to_pylist()
            totals = np.zeros(len(texts), np.int64)
            for lo, hi in slices(batch.column("n_bytes").to_pylist(), CHUNK):
                frequencies = [Counter(split(t)) for t in texts[lo:hi]]
                if len(known) > REMEMBERED:
                    known.clear()
                add_piece_counts(set(chain.from_iterable(frequencies)), path, known)
                for i, found in enumerate(frequencies, lo):
                    pieces = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
                    totals[i] = pieces @ np.fromiter(found.values(), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals), pa.array(totals > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return plain.mapInArrow(run, SCHEMA)
