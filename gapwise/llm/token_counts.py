"""Token counts: texts are encoded in batches, in Arrow functions that give back nothing but lengths.

Long texts are cut at safe boundaries, where no token can cross: before a blank that stands between two other ASCII characters.
The pieces of all texts are put into batches of about equal size in bytes, whatever the texts' own sizes, and each batch is
encoded at once; a text's count is the sum over its pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend
from .tokens import encoder

#: Tokens over which a text is over the limit; bytes of a batch that is encoded at once; characters of a piece of a long text.
LIMIT, BATCH_BYTES, PIECE_CHARS = 1024, 1 << 20, 1 << 16

_SAFE = re.compile(r"(?<=[!-~]) (?=[!-~])")


def cut(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """text in pieces of `chars` characters or more, each but the last up to the next safe boundary."""
    at = 0
    while len(text) - at > chars and (found := _SAFE.search(text, at + chars)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def batched(texts: Iterator[str | None], splits: bool, size: int = BATCH_BYTES, chars: int = PIECE_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of (numbers of texts, pieces) of about `size` bytes; a null text has no piece, one that can't be cut is one piece."""
    numbers, held, n = [], [], 0
    for i, text in enumerate(texts):
        for piece in (cut(text, chars) if splits else [text]) if text else []:
            own = len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
            if held and n + own > size:
                yield numbers, held
                numbers, held, n = [], [], 0
            numbers.append(i)
            held.append(piece)
            n += own
    if held:
        yield numbers, held


class _Pieces:
    """Lengths by sentencepiece, whose pieces' edges are not known: texts are never cut."""

    splits = False

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


_MODELS: dict[str, _Pieces] = {}


def counter(path: str):
    """This worker's tokenizer of a .json file (tokenizers) or a .model file (sentencepiece); it has splits and lengths."""
    if path.endswith(".json"):
        return encoder(path)
    if not path.endswith(".model"):
        raise ValueError(f"neither .json nor .model: {path}")
    if path not in _MODELS:
        _MODELS[path] = _Pieces(path)
    return _MODELS[path]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs without its text, with n_bytes (UTF-8), n_tokens (as the library gives them) and over_limit (n_tokens > limit).

    Strings of special tokens inside a text count as the library takes them by default. Null text: as empty, 0 tokens. Rows
    and other columns stay as they are, null ids and repeated rows among them; columns called n_bytes, n_tokens or over_limit
    are replaced. An empty table gives an empty result. A text without any safe boundary is one piece, however long.
    """
    rows = docs.drop("n_bytes", "n_tokens", "over_limit").withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    others = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        library = counter(tokenizer)
        for b in batches:
            if not b.num_rows:
                continue
            n = np.zeros(b.num_rows, np.int64)
            for numbers, held in batched((t.as_py() for t in b.column(b.num_columns - 1)), library.splits):
                np.add.at(n, numbers, library.lengths(held))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], names=[*others, "n_tokens"])

    counted = rows.select(*others, text).mapInArrow(run, extend(rows.select(*others), n_tokens="long"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
