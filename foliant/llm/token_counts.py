"""Token counts of whole texts under a fixed public tokenizer.

Arrow batches are cut into pieces of equal bytes, long texts at white space.
White space is a safe boundary: the tokenizers accepted here (read from
tokenizer.json) drop it before merging, and no token, special string or
Unicode composition spans it. So a text's count is the sum over its
white-space separated chunks. Only lengths leave the batch function; chunks
that repeat are encoded once, in a memo of bounded size. A chunk is never cut,
whatever its length (a cut inside it could change the count), and under
tokenizers that fail this test a text is encoded whole. The tokenizer's file
is sent to the executors with the job: its path need exist on the driver only.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated
rows are counted row by row; an empty table gives an empty table; no result
depends on an order, so there are no ties; extra columns are ignored unless
named in ``keep`` (``carried`` names those that clash).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import carried, slices, string_buffer, word_bounds

PIECE_BYTES = 1 << 22
MEMO_CHUNKS = 400_000
MEMO_BYTES = 64  # longer chunks are seldom seen again


def drops_spaces(text: str) -> bool:
    """Whether white space is a safe boundary of the tokenizer that this tokenizer.json describes."""
    spec = json.loads(text)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    first = steps[0] if steps else {}
    removed = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "\\s" in str(first.get("pattern"))
    return removed and not any(set(t["content"]) & set(" \t\n\r\x0b\x0c") or t.get("normalized") for t in spec.get("added_tokens", []))


class Counter:
    """Counts tokens of texts by the text of a tokenizer.json; one per Python worker."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunked = drops_spaces(text)
        self.memo: dict[bytes, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [len(e) for e in encode(texts, add_special_tokens=False)]

    def count(self, column: pa.Array) -> np.ndarray:
        if not self.chunked:
            return np.array(self.lengths([t or "" for t in column.to_pylist()]), dtype=np.int64)
        data, offsets = string_buffer(column)
        _, _, before = word_bounds(data, offsets)
        chunks = []  # in order; every text ends at a boundary
        raw = data.tobytes()
        for at, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            chunks += raw[at:to].split()
        memo = self.memo
        new = [c for c in set(chunks) if c not in memo]
        if len(memo) + len(new) > MEMO_CHUNKS:
            memo.clear()
            new = list(set(chunks))
        own: dict[bytes, int] = {}
        size, piece = 0, []
        for c in [*new, None]:
            if piece and (c is None or size + len(c) > PIECE_BYTES // 4):
                own.update(zip(piece, self.lengths([x.decode("utf-8") for x in piece]), strict=True))
                size, piece = 0, []
            if c is not None:
                piece.append(c)
                size += len(c)
        memo.update(own)
        each = np.fromiter((memo[c] for c in chunks), dtype=np.int64, count=len(chunks))
        sums = np.zeros(len(each) + 1, dtype=np.int64)
        np.cumsum(each, out=sums[1:])
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        else:
            for c in own:
                if len(c) > MEMO_BYTES:
                    memo.pop(c, None)
        return sums[before[1:]] - sums[before[:-1]]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048) -> DataFrame:
    """keep columns with n_bytes, n_tokens and over_limit (n_tokens > limit), one row for each row of docs.

    tokenizer: path of a tokenizer.json on the driver.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: a few MB
    n = len(keep)
    kept = docs.select(*[docs[c].alias(f"k_{i}") for i, c in enumerate(keep)], docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            for piece in slices(batch, "_text", PIECE_BYTES):
                counter = counter or Counter(spec.value)
                column = piece.column(n)
                _, offsets = string_buffer(column)
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(n)), pa.array(np.diff(offsets)), pa.array(counter.count(column))], [*(f"k_{i}" for i in range(n)), "n_bytes", "n_tokens"])

    schema = "".join(f"k_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = kept.mapInArrow(run, f"{schema}n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
    results = ["n_bytes", "n_tokens", "over_limit"]
    return out.select(*[F.col(f"k_{i}").alias(name) for i, (_, name) in enumerate(carried(keep, results))], *results)
