"""Alignment of two tokenizers over a corpus: each distinct text once, pair counts by multiplicity."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.llm.common import materialise, prepare, rows_of

# Words a task remembers, the longest that are encoded together with others, and
# characters of such words in one call.
CACHE_WORDS = 300_000
CACHE_CHARS = 60
TOGETHER = 200_000
# A text with more than one of so many rows is a hot one; there are fewer of them than that.
HOT_SHARE = 512

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
ALIGNED = ("text_key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "groups_sha256 string, pairs array<bigint>, times array<bigint>")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
# White space as the tokenizers' patterns have it, without the separators U+001C to U+001F.
WHITE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
# The white space in front of which a word may start.
STARTS = " \n\t"


def byte_level_table() -> dict[str, int]:
    """Bytes by the characters that stand for them: printable ones for themselves, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


# Counts, digest, pairs and times of a text without tokens.
NOTHING = (0, 0, 0, 0, "", [], [])


class Aligner:
    """Encodes by both tokenizers and cuts where tokens of both end.

    No token of either crosses a place where a space, line end or tab follows
    something that is not white space, so a text is the sequence of its words
    with the white space before them, and words never seen before are encoded
    together. A model for which that cannot be told from its vocabulary gets
    whole texts.
    """

    def __init__(self, byte_level: bytes, pieces: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        spec = json.loads(byte_level)
        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        table = byte_level_table()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        added = {t["content"] for t in spec.get("added_tokens", [])}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.a_bytes[k] = entry.encode() if entry in added else bytes(table[c] for c in entry)

        self.b = SentencePieceProcessor(model_proto=pieces)
        listed = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(BYTE_PIECE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(listed)
        ]
        self.numbers = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)

        split = spec.get("pre_tokenizer") or {}
        probe = " a  b\nﬁ½ \t́ "
        self.by_words = (
            spec.get("normalizer") is None and split.get("type") == "ByteLevel" and bool(split.get("use_regex"))
            and not split.get("add_prefix_space") and self.b.normalize(probe) == "▁" + probe.replace(" ", "▁")
            and not any(re.search(f"{OTHER}[{STARTS}]", p.replace("▁", " ")) for p in listed)
            and any(map(self.b.is_byte, range(len(listed))))
        )
        self.word = re.compile(f"{WHITE}*{OTHER}+(?:(?![{STARTS}]){WHITE}+{OTHER}*)*|{WHITE}+")
        self.known: dict[str, tuple] = {}

    def words(self, text: str) -> Iterable[str]:
        """White space and what follows it, up to the next white space; long texts as a stream."""
        if not self.by_words:
            return [text]
        if len(text) < 1_000_000:
            return self.word.findall(text)
        return (m.group() for m in self.word.finditer(text))

    def pair_bound(self) -> int:
        """How many different pairs can ever be linked: of two tokens that end together, one ends with the other."""
        return int(2 * self.a_sizes.sum() + 2 * self.b_sizes.sum())

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both for a text that starts with a space, which the second tokenizer puts there itself."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return a, self.b.encode(text[1:], out_type=int, num_threads=1)

    def _groups(self, a: list[int], b: list[int], whole: bytes, ends: np.ndarray) -> list[tuple] | None:
        """Of each piece of ``whole`` up to one of ``ends``: tokens (A times 2^32 plus B), groups, packed pair codes.

        None where the tokens' bytes differ from ``whole`` or cross an end. Every
        token has a byte, so an end is the end of one token of each.
        """
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        common, to_a, to_b = np.intersect1d(
            np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b]), assume_unique=True, return_indices=True
        )
        stop = np.searchsorted(common, ends)
        if stop[-1] >= len(common) or (common[stop] != ends).any():
            return None
        codes = (ids_a[to_a] << 32 | ids_b[to_b]).tobytes()
        of_a, of_b = ([self.numbers[k] for k in ids] for ids in (a, b))
        to_a, to_b = to_a + 1, to_b + 1
        last_a, last_b = to_a.tolist(), to_b.tolist()
        groups = [
            (of_a[i] if j - i == 1 else ",".join(of_a[i:j])) + "|" + (of_b[k] if m - k == 1 else ",".join(of_b[k:m]))
            for i, j, k, m in zip([0, *last_a], last_a, [0, *last_b], last_b)
        ]
        counts = (np.diff(to_a[stop], prepend=0) << 32 | np.diff(to_b[stop], prepend=0)).tolist()
        upto = (stop + 1).tolist()
        return [(n, ";".join(groups[i:j]), codes[8 * i : 8 * j]) for n, i, j in zip(counts, [0, *upto], upto)]

    def learn(self, words: Iterable[str]) -> None:
        """Encode new words in one string per ``TOGETHER`` characters and share the tokens out again."""
        held: list[str] = []
        size = 0
        for word in words:
            if word[-1].isspace() or "▁" in word or len(word) > CACHE_CHARS:
                self._alone(word)
                continue
            held.append(word)
            size += len(word)
            if size >= TOGETHER:
                self._together(held)
                held, size = [], 0
        if held:
            self._together(held)

    def _alone(self, word: str) -> None:
        raw = word.encode()
        if self.by_words:
            # inside a text no space is put before a word: give it a neighbour and take that off again
            a, b = self.encode(" a" + word)
            skip_a, skip_b = map(len, self.encode(" a"))
            a, b = a[skip_a:], b[skip_b:]
        else:
            a, b = self.encode(word)
        self.known[word] = (self._groups(a, b, raw, np.array([len(raw)])) or [None])[0]

    def _together(self, words: list[str]) -> None:
        words = [" a", *words]  # so that the string starts with a space
        raw = [w.encode() for w in words]
        found = self._groups(*self.encode("".join(words)), b"".join(raw), np.cumsum([len(r) for r in raw]))
        if found is not None:
            self.known.update(zip(words, found))
            return
        for word in words:
            self._alone(word)

    def measure(self, texts: list[str]) -> list[tuple | None]:
        """Counts, digest, pair codes and their numbers of each text; None where it has no tokens.

        The new words of all texts are learned together; a very long text comes
        in parts after the others.
        """
        listed = [self.words(" " + text) for text in texts]
        self._know(set().union(*[w for w in listed if isinstance(w, list)]))
        done = {k: self._measure([w], False) for k, w in enumerate(listed) if isinstance(w, list)}
        done |= {k: self._measure(_parts(w), True) for k, w in enumerate(listed) if k not in done}
        return [done[k] for k in range(len(texts))]

    def _know(self, words: set[str]) -> None:
        new = words - self.known.keys()
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = words
        self.learn(new)

    def _measure(self, parts: Iterable[list[str]], learn: bool) -> tuple | None:
        n, n_links = 0, 0
        hashed, joint = hashlib.sha256(), b""
        codes, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in parts:
            if learn:
                self._know(set(part))
            found = list(map(self.known.__getitem__, part))
            if None in found:
                return None
            counts, groups, linked = zip(*found)
            n += sum(counts)
            hashed.update(joint + ";".join(groups).encode())
            joint = b";"
            flat = np.frombuffer(b"".join(linked), np.int64)
            n_links += len(flat)
            codes, times = _merge(codes, times, flat)
        # each common end closes one group and links its last two tokens
        return n >> 32, n & 0xFFFFFFFF, n_links, n_links, hashed.hexdigest(), codes, times


def _parts(words: Iterable[str]) -> Iterator[list[str]]:
    held: list[str] = []
    for word in words:
        held.append(word)
        if len(held) >= 100_000:
            yield held
            held = []
    if held:
        yield held


def _merge(codes: np.ndarray, times: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new, n = np.unique(more, return_counts=True)
    if not len(codes):
        return new, n
    both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([times, n]), len(both)).astype(np.int64)


def distinct_texts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``text_key``, ``text`` and ``copies`` of the different non-empty texts.

    Copies are counted inside the tasks before the shuffle by the full text.
    """
    texts = docs.select(docs[text_column].alias("text")).where("text <> ''")
    return texts.groupBy("text").agg(F.count("*").alias("copies")).withColumn("text_key", _key("text"))


def _key(text: str):
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def align_texts(texts: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Of each distinct text: counts, digest, its linked id pairs and how often it has each."""
    spark = prepare(texts.sparkSession)
    shared = spark.sparkContext.broadcast((_read(byte_level), _read(pieces)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        for block in rows_of(batches, "text_key", "copies", "text"):
            measured = aligner.measure([text for _, _, text in block])
            rows = [(key, copies, *(found or NOTHING)) for (key, copies, _), found in zip(block, measured)]
            columns = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.binary(), *[pa.int64()] * 5, pa.string(), *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds)],
                [field.split()[0] for field in ALIGNED.split(", ")],
            )

    return texts.select("text_key", "copies", "text").mapInArrow(run, ALIGNED)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair`` (first id times 2^32 plus second id), its links in the corpus and whether its second id has no better."""
    listed = aligned.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counted = listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.times") * F.col("copies")).alias("links"))
    counted = materialise(counted.withColumn("b", F.col("pair").bitwiseAND(F.lit(2**32 - 1))))
    best = counted.groupBy("b").agg(F.max("links").alias("most"))
    return counted.join(best, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align_documents(
    docs: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A is a byte-level tokenizer file, B a sentencepiece model. Places where a
    token of both ends cut a text into groups; the two tokens that end there are
    linked. ``count_sum`` adds up, over the links of a text, how many links of
    the corpus have the same id pair; ``n_best`` counts the links whose number
    is the highest of their B id, ties included.

    Texts are shuffled once, by the full text and after copies are counted in
    the tasks; each different text is encoded and aligned once. Its pairs are
    counted with the number of its copies. The table of pairs goes to every
    task: linked tokens end with the same bytes, so there are at most as many
    pairs as suffixes of tokens (``Aligner.pair_bound``, 1.3 million here, 16
    bytes each), whatever the corpus. Measures return to the rows by the hash
    of the text; texts with more than one of 512 rows, fewer than 512, are
    dealt out by the hash of the id.

    Null and empty texts, and texts whose tokens do not give back the bytes
    (such as texts with the character U+2581), have zeros and the digest ''.
    Repeated rows give repeated rows and count twice, a null id stays null, an
    empty table gives an empty table, other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    keyed = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    keyed = keyed.withColumn("text_key", F.when(F.col("text") != "", _key("text")))
    aligned = materialise(align_texts(distinct_texts(docs, text_column), byte_level, pieces))
    measures = materialise(score(aligned, pair_counts(aligned)))

    rows = aligned.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    tile = rows // HOT_SHARE + 1
    hot = measures.where(F.col("copies") > tile).select("text_key", F.ceil(F.col("copies") / tile).alias("tiles"))
    hot = F.broadcast(hot)
    salted = keyed.select("id", "text_key").join(hot, "text_key", "left").select(
        "id", "text_key",
        # rows without a text meet nothing and may go anywhere
        F.when(F.col("text_key").isNull(), F.pmod(F.xxhash64("id"), F.lit(HOT_SHARE)))
        .otherwise(F.coalesce(F.pmod(F.xxhash64("id"), "tiles"), F.lit(0))).alias("salt"),
    )
    dealt = measures.join(hot, "text_key", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("tiles"), F.lit(1)) - 1)),
    )
    found = salted.join(dealt, ["text_key", "salt"], "left")
    return found.select(
        F.col("id").alias(id_column), *(F.coalesce(F.col(m), F.lit(0).cast("bigint")).alias(m) for m in MEASURES),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )


def score(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` from the corpus-wide pair counts instead of its pairs."""
    spark = aligned.sparkSession
    listed = [c.to_numpy() for c in counts.select("pair", "links", "best").toArrow().columns]
    order = np.argsort(listed[0])
    shared = spark.sparkContext.broadcast(tuple(c[order] for c in listed))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, links, best = shared.value
        for batch in batches:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            codes, times = (column[n].flatten().to_numpy(zero_copy_only=False) for n in ("pairs", "times"))
            at = np.searchsorted(pairs, codes)
            row = np.repeat(np.arange(batch.num_rows), np.diff(column["pairs"].offsets.to_numpy()))
            total = np.zeros(batch.num_rows, np.int64)
            highest = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, links[at] * times)
            np.add.at(highest, row, best[at] * times)
            kept = ["text_key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(column[n] for n in kept), pa.array(highest), pa.array(total)], [*kept, "n_best", "count_sum"],
            )

    schema = ("text_key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
              "groups_sha256 string, n_best bigint, count_sum bigint")
    return aligned.mapInArrow(run, schema)
