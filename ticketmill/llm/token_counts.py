"""Token counts of whole texts: batches balanced by bytes, long texts split where no token can cross."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ticketmill.llm.common import prepare

# Bytes of text that one call of a tokenizer gets, and characters from which a
# text is split.
BATCH_BYTES = 500_000
LONG_TEXT = 100_000
SPACE = "▁"
# White space after something else; U+001C to U+001F are none for the libraries' patterns.
AFTER_WORD = re.compile(r"(?<=[\S\x1c-\x1f])[^\S\x1c-\x1f]")


class PieceCounter:
    """Lengths by a sentencepiece model, without begin and end.

    A merge makes a piece of the vocabulary, so no token crosses a place whose
    two characters stand side by side in no piece. A part that starts with a
    space gives it to the space the library puts in front of a text; any other
    part must start with a character that follows a space in no piece, and the
    token of that added space is taken off again.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)
                  if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.single = {p for p in pieces if len(p) == 1}
        self.bytes = any(map(self.model.is_byte, range(size)))
        # Only a model that leaves texts as they are can be cut: others may change a part's ends.
        probe = " a  b\nﬁ½ \t́ "
        self.plain = self.model.normalize(probe) == SPACE + probe.replace(" ", SPACE)

    def cut(self, text: str, at: int) -> int:
        """The first place from ``at`` on where a part may start, else the end of the text."""
        if not self.plain:
            return len(text)
        for i in range(at, len(text)):
            before, c = text[i - 1].replace(" ", SPACE), text[i].replace(" ", SPACE)
            if before + c in self.pairs or c != SPACE and SPACE + c in self.pairs:
                continue
            if self.bytes or before in self.single and c in self.single:
                return i
        return len(text)

    def lengths(self, parts: list[tuple[str, bool]]) -> list[int]:
        """Tokens of each part; the flag says that the part goes on with a text."""
        rests = [more and not part.startswith((" ", SPACE)) for part, more in parts]
        texts = [part[1:] if more and not rest else part for (part, more), rest in zip(parts, rests)]
        found = self.model.encode(texts, out_type=int, num_threads=1)
        # a part that was only its leading space still has that one token
        return [max(len(ids), 1) - rest if more else len(ids) for ids, (_, more), rest in zip(found, parts, rests)]


class JsonCounter:
    """Lengths by a tokenizer file, special tokens inside texts as the library's default has them.

    Byte-level files without a normalizer are cut where white space follows
    something else: no match of their pattern crosses such a place. Other files
    get whole texts.
    """

    def __init__(self, model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(model)
        self.model = Tokenizer.from_str(model.decode())
        self.model.no_truncation()
        self.model.no_padding()
        split = spec.get("pre_tokenizer") or {}
        self.plain = (spec.get("normalizer") is None and split.get("type") == "ByteLevel"
                      and bool(split.get("use_regex")) and not split.get("add_prefix_space")
                      and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"]
                                  for t in spec.get("added_tokens", [])))

    def cut(self, text: str, at: int) -> int:
        found = AFTER_WORD.search(text, at) if self.plain else None
        return found.start() if found else len(text)

    def lengths(self, parts: list[tuple[str, bool]]) -> list[int]:
        found = self.model.encode_batch_fast([part for part, _ in parts], add_special_tokens=False)
        return [len(e.ids) for e in found]


def counter(model: bytes) -> PieceCounter | JsonCounter:
    return JsonCounter(model) if model.lstrip()[:1] == b"{" else PieceCounter(model)


def parts_of(text: str, cutter: PieceCounter | JsonCounter) -> Iterator[tuple[str, bool]]:
    """The text in parts of about ``LONG_TEXT`` characters, cut at safe places."""
    start = 0
    while len(text) - start > LONG_TEXT:
        end = cutter.cut(text, start + LONG_TEXT)
        yield text[start:end], start > 0
        start = end
    if start < len(text) or not start:
        yield text[start:], start > 0


def balanced(texts: pa.Array, cutter: PieceCounter | JsonCounter) -> Iterator[tuple[list[int], list[tuple[str, bool]]]]:
    """Row numbers and parts of texts, in batches of about ``BATCH_BYTES`` bytes."""
    rows: list[int] = []
    batch: list[tuple[str, bool]] = []
    size = 0
    for row, text in enumerate(texts):
        for part in parts_of(text.as_py() or "", cutter):
            rows.append(row)
            batch.append(part)
            size += len(part[0].encode())
            if size >= BATCH_BYTES:
                yield rows, batch
                rows, batch, size = [], [], 0
    if batch:
        yield rows, batch


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer`` is a sentencepiece model or a tokenizer file; the driver reads
    it (a vocabulary, a few MB) and broadcasts it. A task encodes its rows batch
    by batch and returns lengths only. Rows need no other row: no shuffle, and a
    lost task is run again.

    Null text counts as empty: no bytes, no tokens. A text of any length is
    counted whole; a text with no safe place stays one part. Repeated rows give
    repeated rows, a null id stays null, an empty table gives an empty table,
    other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    with open(tokenizer, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    key = docs.schema[id_column].dataType
    id_type = to_arrow_type(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n = np.zeros(batch.num_rows, np.int64)
            for rows, parts in balanced(texts, model):
                np.add.at(n, rows, model.lengths(parts))
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids.cast(id_type), sizes, pa.array(n)], ["id", "n_bytes", "n_tokens"])

    picked = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    counted = picked.mapInArrow(run, f"id {key.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
    )
