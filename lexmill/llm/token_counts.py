"""Token counts: exact lengths under a public tokenizer, from Arrow batches.

Only lengths leave the workers; ids never do.  A text is cut at every run of the six ASCII blanks.
For tokenizers whose pre-tokenizer drops white space that is a safe boundary: no pre-token, merge,
special string or normalisation crosses it, so the counts of the pieces add up to the count of the
text.  Pieces repeat, so each distinct one is encoded once per worker while the memo holds it; the
new ones are encoded together, in batches of about equal bytes.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result;
repeated rows are counted each; a text without a blank is encoded whole; other columns are dropped,
so their names can't clash.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces that a worker remembers; past this the memo starts anew (speed only, never counts).
MEMO_PIECES = 400_000
#: Bytes of one call of the tokenizer library.
BATCH_BYTES = 1 << 20

_memos: dict[str, tuple[object, dict[bytes, int]]] = {}


def _tokenizer(path: str) -> tuple[object, dict[bytes, int]]:
    if path not in _memos:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        _memos[path] = (model, {})
    return _memos[path]


def balanced(pieces: Iterable[bytes], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Groups of pieces of at most ``limit`` bytes; a larger piece stands alone."""
    group: list[bytes] = []
    held = 0
    for piece in pieces:
        if group and held + len(piece) > limit:
            yield group
            group, held = [], 0
        group.append(piece)
        held += len(piece)
    if group:
        yield group


def pieces_of(text: bytes) -> list[bytes]:
    """The pieces of a text; A-Z are lowered where that can't make or break a special string."""
    return text.split() if b"<|" in text else text.lower().split()


def lengths(texts: Iterable[bytes], path: str) -> Iterator[int]:
    """Token counts of a few texts that are held together anyway."""
    model, memo = _tokenizer(path)
    cut = [pieces_of(t) for t in texts]
    fresh = set().union(*cut).difference(memo) if cut else set()
    if len(memo) + len(fresh) > MEMO_PIECES:
        memo.clear()
        fresh = set().union(*cut)
    for group in balanced(fresh):
        encoded = model.encode_batch_fast([p.decode("utf-8") for p in group], add_special_tokens=False)
        memo.update(zip(group, map(len, encoded)))
    for pieces in cut:
        yield sum(map(memo.__getitem__, pieces))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, lowercases: bool = True
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``lowercases``: the tokenizer lower-cases and drops white space (word_bpe_49k.json does); only
    such tokenizers may be cut at each blank.
    """
    if not lowercases:
        raise ValueError("cutting at blanks is exact only for tokenizers that drop white space")
    schema = docs.select(F.col(id_col)).schema.simpleString()[len("struct<") : -1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            counts: list[int] = []
            held: list[bytes] = []
            size = 0
            for value in texts:
                raw = value.as_buffer()
                text = b"" if raw is None else raw.to_pybytes()
                held.append(text)
                size += len(text)
                if size >= 4 * BATCH_BYTES:
                    counts.extend(lengths(held, tokenizer_path))
                    held, size = [], 0
            counts.extend(lengths(held, tokenizer_path))
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(work, f"id {schema.split(':', 1)[1]}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
