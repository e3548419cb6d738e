"""Byte-level BPE encoding and decoding by corpus-level merge replay."""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ticketmill.llm.common import prepare, rows_of

# Words whose ids a task remembers, and the length of a text from which its
# words are streamed twice instead of listed.
CACHE_WORDS = 400_000
LONG_TEXT = 2_000_000
# Positions of a pair from which they are merged at once.
TOGETHER = 32

ENCODED = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """Every way to cut a token in two tokens: the pair as one number, and the rank of the whole."""
    return {
        ranks[text[:i]] << 32 | ranks[text[i:]]: rank
        for text, rank in ranks.items() for i in range(1, len(text)) if text[:i] in ranks and text[i:] in ranks
    }


class Vocabulary(dict):
    """Ranks by token, tokens by rank, and which two tokens make which."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, int] | None = None):
        super().__init__(ranks)
        self.token = {rank: text for text, rank in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.pairs = pair_table(ranks) if pairs is None else pairs
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.ranks = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's whole, -1 where there is none or a side is missing."""
        if not len(self.keys):
            return np.full(len(left), -1)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.ranks[at], -1)


def replay(words: Iterable[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each word, all words merged together.

    The bytes of all words lie in one linked array. ``index`` is the inverted
    index: for the rank of a token pair, the positions where the pair stands.
    Ranks are applied in order; a merge looks only at its two neighbours and
    enters the pairs it creates. A merge can create a pair of a lower rank than
    the one being applied; that pair then goes first, and the remaining
    positions of the current rank wait for their turn. The order within a word
    is therefore lowest rank first, leftmost first. A rank with many positions
    is applied to all of them at once where none of its merges creates a lower
    one.
    """
    words = list(words)
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]) if words else np.empty(0, np.int64)
    starts = ends - np.array([len(w) for w in words], np.int64)
    n = len(flat)
    # one cell more than bytes: the neighbour of a last and of a first token, number -1
    piece, after, before = (array("q", bytes(8 * (n + 1))) for _ in range(3))
    cells, nexts, lasts = (np.frombuffer(x, np.int64) for x in (piece, after, before))
    cells[:n], cells[n] = vocabulary.single[flat], -1
    if (cells[:n] < 0).any():
        raise ValueError("the rank file lacks a byte")
    nexts[:n], lasts[:n] = np.arange(1, n + 1), np.arange(-1, n - 1)
    nexts[ends[ends > starts] - 1] = -1
    lasts[starts[ends > starts]] = -1

    pairs = vocabulary.pairs
    index: dict[int, list[int]] = {}
    queue: list[int] = []

    def enter(ranks: np.ndarray, spots: np.ndarray) -> None:
        """Positions into the index, by the rank of the pair that stands there."""
        known = ranks >= 0
        ranks, spots = ranks[known], spots[known]
        order = np.argsort(ranks, kind="stable")
        ranks, spots = ranks[order], spots[order].tolist()
        cut = np.flatnonzero(np.diff(ranks, prepend=-1)) if len(ranks) else ranks
        for rank, at, end in zip(ranks[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(spots)]):
            _enter(index, queue, rank, spots[at:end])

    at = np.flatnonzero(nexts[:n] >= 0)
    enter(vocabulary.merged(cells[at], cells[at + 1]), at)
    while queue:
        rank = heappop(queue)
        spots = index.pop(rank, None)
        if spots is None:
            continue
        if len(spots) >= TOGETHER:
            left = np.unique(np.array(spots, np.int64))
            left = left[vocabulary.merged(cells[left], cells[nexts[left]]) == rank]
            right = nexts[left]
            # of positions that share a token the first counts, then the third, ...
            chained = np.concatenate([[False], right[:-1] == left[1:]])
            number = np.arange(len(left))
            first = (number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0
            left, right = left[first], right[first]
            ahead, beyond = lasts[left], nexts[right]
            whole = np.full(len(left), rank)
            taken = np.concatenate([[False], right[:-1] == ahead[1:]]) & (ahead >= 0)
            made = vocabulary.merged(np.where(taken, rank, cells[ahead]), whole), vocabulary.merged(whole, cells[beyond])
            if not any(((m >= 0) & (m < rank)).any() for m in made):
                cells[left], cells[right] = rank, -1
                nexts[left] = beyond
                some = beyond >= 0
                lasts[beyond[some]] = left[some]
                ahead = lasts[left]  # a token merged just now may stand there
                ahead = ahead[ahead >= 0]
                at = np.unique(np.concatenate([left, ahead]))
                enter(vocabulary.merged(cells[at], cells[nexts[at]]), at)
                continue
        spots.sort()
        for done, left in enumerate(spots, 1):
            right = after[left]
            if right < 0 or piece[left] < 0 or pairs.get(piece[left] << 32 | piece[right]) != rank:
                continue  # an earlier merge took one of the two
            piece[left], piece[right] = rank, -1
            beyond = after[right]
            after[left] = beyond
            lower = False
            if beyond >= 0:
                before[beyond] = left
                new = pairs.get(rank << 32 | piece[beyond])
                if new is not None:
                    _enter(index, queue, new, (left,))
                    lower = new < rank
            ahead = before[left]
            if ahead >= 0:
                new = pairs.get(piece[ahead] << 32 | rank)
                if new is not None:
                    _enter(index, queue, new, (ahead,))
                    lower = lower or new < rank
            if lower:
                if spots[done:]:
                    _enter(index, queue, rank, spots[done:])
                break
    # what is left of a word are its live cells
    live = np.flatnonzero(cells[:n] >= 0)
    ids = cells[live].tolist()
    cut = np.searchsorted(live, ends).tolist()
    return [ids[i:j] for i, j in zip([0, *cut], cut)]


def _enter(index: dict[int, list[int]], queue: list[int], rank: int, spots: Iterable[int]) -> None:
    known = index.get(rank)
    if known is None:
        index[rank] = list(spots)
        heappush(queue, rank)
    else:
        known.extend(spots)


class Encoder:
    """Encodes blocks of texts; ids of words seen before are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> Iterable[str]:
        if len(text) <= LONG_TEXT:
            return self.pattern.findall(text)
        return (match.group() for match in self.pattern.finditer(text))

    def learn(self, words: set[str]) -> None:
        """Replay the merges over all new words of a block at once."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        whole = [(w, w.encode()) for w in new]
        parts = [(w, b) for w, b in whole if b not in self.vocabulary]
        self.known.update((w, struct.pack("<I", self.vocabulary[b])) for w, b in whole if b in self.vocabulary)
        for (word, _), ids in zip(parts, replay((b for _, b in parts), self.vocabulary)):
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, hash of the ids and hash of the bytes decoded from them."""
        listed = [self.words(t) for t in texts]
        distinct: set[str] = set()
        for text, words in zip(texts, listed):
            distinct.update(words if isinstance(words, list) else self.words(text))
        self.learn(distinct)
        for words in listed:
            n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            for ids in _chunks(words, self.known):
                n += len(ids) // 4
                ids_hash.update(ids)
                text_hash.update(self.decode(ids))
            yield n, ids_hash.hexdigest(), text_hash.hexdigest()

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        self.learn(set(self.words(text)))
        return b"".join(map(self.known.__getitem__, self.words(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def _chunks(words: Iterable[str], known: dict[str, bytes]) -> Iterator[bytes]:
    if isinstance(words, list):
        yield b"".join(map(known.__getitem__, words))
        return
    held: list[bytes] = []
    for word in words:
        held.append(known[word])
        if len(held) >= 100_000:
            yield b"".join(held)
            held = []
    yield b"".join(held)


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``ids``, an array, on demand).

    A task takes blocks of its rows, applies the merges to the distinct new
    words of a block together, and writes each text's ids from the words. Rows
    need no other row, so there is no shuffle, and a lost task is simply run
    again. The rank file and its table of pairs (a fixed vocabulary, well under
    10 MB) are made on the driver and broadcast.

    Null text counts as empty: no ids, hashes of nothing. Repeated rows give
    repeated rows, a null id stays null, an empty table gives an empty table,
    other columns are not read.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    ranks = load_ranks(vocabulary)
    shared = spark.sparkContext.broadcast((ranks, pair_table(ranks)))
    key = docs.schema[id_column].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value), pattern)
        for block in rows_of(batches, "id", "text"):
            texts = [t or "" for _, t in block]
            n, ids_hash, text_hash = map(list, zip(*encoder.digests(texts)))
            columns = [
                pa.array([i for i, _ in block], id_type), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)
            ]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ids = [struct.unpack(f"<{len(b) // 4}I", b) for b in map(encoder.ids, texts)]
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(key)
    schema = f"id {key.simpleString()}, {ENCODED}" + ", ids array<bigint>" * with_ids
    picked = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_column)
