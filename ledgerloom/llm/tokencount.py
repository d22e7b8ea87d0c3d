"""Token counts: texts are encoded in Arrow functions that return lengths only.

Batches are cut by bytes, not rows, and a text longer than PART_CHARS is split at a place where encoding the parts
gives the same tokens as encoding the whole. For the piece model that is a single space between two other characters:
no piece holds the space mark after another character, so no merge crosses that place, and the mark that the model puts
before a text stands for the space that the split takes away. Where no such space is near, as in Chinese or Japanese
text, it is a place between two characters that no piece of the vocabulary has side by side, if none has the second
after the space mark either: then the mark before the second part is a token of its own, which isn't counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches

MODEL = "piece_bpe_32k.model"
PART_CHARS, BATCH_BYTES = 50_000, 1_000_000
_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


def neighbours(model) -> frozenset[str]:
    """All pairs of characters that stand side by side in a piece of the vocabulary: merges join no others."""
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return frozenset(p[k : k + 2] for p in pieces for k in range(len(p) - 1))


def split_safely(text: str, part_chars: int = PART_CHARS, joined: frozenset[str] | None = None) -> list[tuple[str, int]]:
    """(part, tokens to take off its count): parts of about part_chars characters whose counts sum to text's.

    joined: neighbours() of the model, without which only spaces are safe. What has no safe place stays whole.
    """
    parts, start, extra = [], 0, 0

    def apart(i: int) -> bool:
        a, b = text[i - 1], text[i]
        return a not in " ▁" and b not in " ▁" and a + b not in joined and "▁" + b not in joined

    while len(text) - start > part_chars:
        near = start + part_chars
        at = _SAFE.search(text, near, near + part_chars)
        if at is None and joined is not None:
            place = next((i for i in range(near, len(text)) if apart(i)), None)
            space = _SAFE.search(text, near + part_chars - 1, place if place is not None else len(text))
            if space is None and place is not None:
                parts.append((text[start:place], extra))
                start, extra = place, 1
                continue
            at = space
        elif at is None:
            at = _SAFE.search(text, near)
        if at is None:
            break
        parts.append((text[start : at.start()], extra))
        start, extra = at.end(), 0
    return [*parts, (text[start:], extra)]


def lengths(texts: list[str], model, batch_bytes: int = BATCH_BYTES, part_chars: int = PART_CHARS, joined: frozenset[str] | None = None) -> list[int]:
    """Number of tokens of each text, encoded in batches of about batch_bytes of UTF-8."""
    out, batch, owners, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        for (i, extra), ids in zip(owners, model.encode(batch, num_threads=1), strict=True):
            out[i] += len(ids) - extra
        batch.clear(), owners.clear()

    for i, text in enumerate(texts):
        for part, extra in split_safely(text, part_chars, joined):
            batch.append(part), owners.append((i, extra))
            held += len(part.encode("utf-8", "surrogatepass"))
            if held >= batch_bytes:
                flush()
                held = 0
    flush()
    return out


def token_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model_file: str | None = None, limit: int = 4096) -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Nothing is truncated. Rows are independent, so repeated ones give
    repeated results; other columns of df are not used. model_file is a place that each executor can read.
    """
    small_batches(df.sparkSession)
    path = model_file or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        joined = None
        for b in batches:
            texts = b.column(1).to_pylist()
            if joined is None and any(len(t) > PART_CHARS for t in texts):
                joined = neighbours(model)
            n = lengths(texts, model, joined=joined)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
