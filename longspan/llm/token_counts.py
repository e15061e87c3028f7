"""Token counts by a public tokenizer: lengths only, whole texts.

The tokenizer drops white space and never joins across it, so the ASCII white-space
characters are safe boundaries: the tokens of a text are those of its words, one
after another.  An Arrow batch is cut into blocks of about equal bytes; short texts
share a block, a long text is cut at the next white space after each full block.
The words of a block that the worker has not met are encoded by the library in
batches of about equal bytes, and only their lengths are kept, in a table of bounded
size.  A special string has no white space, so it stays within a word and is treated
as the library treats it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_bounded_batches

#: Bytes of texts that are counted together, and of new words in one call of the library.
BLOCK_BYTES, CALL_BYTES = 1 << 20, 1 << 16
#: Words whose lengths a worker keeps, and the most bytes of one of them.
KEPT_WORDS, KEPT_BYTES = 800_000, 48
#: Tokens above which a text is marked.
LIMIT = 2048

#: The first safe boundary at or after a place.
BOUNDARY = re.compile(rb"[\x20\x09-\x0D]")
#: Punctuation that often stands behind a word.
ENDS = b".,;:!?"


def pieces(row: int, raw: memoryview) -> Iterator[tuple[int, bytes]]:
    """(row, bytes) of at least BLOCK_BYTES each but the last, cut at white space only."""
    at = 0
    while len(raw) - at > BLOCK_BYTES:
        found = BOUNDARY.search(raw, at + BLOCK_BYTES)
        end = found.start() if found else len(raw)
        yield row, bytes(raw[at:end])
        at = end
    yield row, bytes(raw[at:])


def blocks(texts: list[memoryview]) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of pieces with about BLOCK_BYTES bytes together."""
    block, size = [], 0
    for row, raw in enumerate(texts):
        for piece in pieces(row, raw):
            if block and size + len(piece[1]) > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append(piece)
            size += len(piece[1])
    if block:
        yield block


class Lengths(dict):
    """Number of tokens by word (bytes)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, words: list[bytes]) -> None:
        """Has the library encode the words, by calls of about CALL_BYTES bytes, and keeps their lengths."""
        lo = size = 0
        for hi, word in enumerate(words, 1):
            size += len(word)
            if size >= CALL_BYTES or hi == len(words):
                texts = [str(w, "utf-8") for w in words[lo:hi]]
                self.update(zip(words[lo:hi], map(len, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))))
                lo, size = hi, 0

    def learn(self, words: set[bytes]) -> None:
        """Lengths of words that are not known.

        Punctuation after an ASCII letter is a token run of its own and the tokenizer
        lower-cases, so a word of ASCII letters with punctuation behind it has the
        length of its lower-cased letters and that of the punctuation.
        """
        parts = {}
        for word in words:
            letters = word.rstrip(ENDS)
            if letters.isalpha():  # of bytes: ASCII letters only
                parts[word] = letters.lower(), word[len(letters) :]
        needed = set().union(*parts.values()) | words.difference(parts)
        self.encode([w for w in needed if w not in self])
        self.update({word: self[letters] + self[end] for word, (letters, end) in parts.items()})

    def count(self, block: list[tuple[int, bytes]], total: list[int]) -> None:
        """Adds each piece's number of tokens to its row's ``total``."""
        if len(self) > KEPT_WORDS:
            self.clear()
        split = [(row, piece.split()) for row, piece in block]
        new = set().union(*(words for _, words in split)).difference(self)
        self.learn(new)
        for row, words in split:
            total[row] += sum(map(self.__getitem__, words))
        for word in new:
            if len(word) > KEPT_BYTES:
                del self[word]


@functools.lru_cache(maxsize=2)
def lengths(path: str) -> Lengths:
    return Lengths(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def text_views(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each text, without a copy; null counts as empty."""
    column = column.cast(pa.large_binary())
    return [memoryview(x.as_buffer()) if x.is_valid else memoryview(b"") for x in column]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row and whole text.

    ``path`` names a tokenizer file that drops white space, which every executor can
    open.  A null text counts as empty: no bytes, no tokens.  A text without any
    white space is one piece, however long.  Repeated rows get equal results, an
    empty table gives an empty result, further columns are ignored.
    """
    path = path or default_path()
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        table = lengths(path)
        for batch in batches:
            texts = text_views(batch.column("text"))
            total = [0] * len(texts)
            for block in blocks(texts):
                table.count(block, total)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(total, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = in_bounded_batches(rows).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
