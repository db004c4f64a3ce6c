"""Operator 7, token counts: pieces are counted once per distinct pre-token."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "piece_bpe_32k.model"
#: A task remembers the counts of so many pre-tokens, each of at most MEMO_CHARS characters, then starts anew.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 64


def vocabulary_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Counts(dict):
    """Pre-token -> number of pieces, filled on demand."""

    def __init__(self, processor):
        self.encode = processor.encode
        self.lead = len(self.encode("\n"))

    def __missing__(self, piece: str) -> int:
        # After a line feed the library adds no space of its own, so any chunk can be counted as it stands inside a text.
        n = len(self.encode("\n" + piece)) - self.lead
        if len(piece) <= MEMO_CHARS:
            self[piece] = n
        return n


def splits_at_spaces(processor) -> bool:
    """True if no piece has a space after another character nor a line feed: then no merge crosses those places."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    A text, with the space that the library puts in front and its word mark read as a space, is cut before every run of spaces that follows another
    character and around line feeds. No piece of the vocabulary crosses those places (checked when a task starts; if
    one does, whole texts are encoded), so a text's count is the sum over its distinct pre-tokens of frequency times
    pieces. Frequencies and piece counts meet inside the task, against a bounded memo: a global join would shuffle a
    row for each document and pre-token, more than the corpus itself. Ids exist for single pre-tokens only.

    Null text counts as empty (0 tokens). Repeated rows are counted each. Further columns are ignored; an empty table
    gives no rows.
    """
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=where)
        counts, cut = _Counts(processor), re.compile(r" *[^ \n]+| +|\n").findall
        plain = not splits_at_spaces(processor)
        for batch in batches:
            n_tokens = []
            for t in batch.column(2):
                t = t.as_py()
                if plain or not t:
                    n_tokens.append(len(processor.encode(t)) if t else 0)
                    continue
                n_tokens.append(sum(map(int.__mul__, map(counts.__getitem__, freq := Counter(cut(" " + t.replace("▁", " ")))), freq.values())))
                if len(counts) > MEMO_ENTRIES:
                    counts.clear()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
