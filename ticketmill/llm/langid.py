"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ticketmill.llm.common import BLOCK_CHARS, materialise, prepare, rows_of

ORDER = 4
# Documents per language that the models are fitted on (expected number, whole
# texts), and n-grams that all models together may hold.
TRAIN_DOCS, MAX_NGRAMS = 4000, 4_000_000
# One in so many of them is kept from counting and calibrates the rejection.
CALIBRATION = 8
# A text is rejected whose cross-entropy lies beyond the median of calibration
# stretches of its length by more than SPREAD quartile distances and by more than
# REACH of the way to the median of the same stretches with their symbols shuffled.
SPREAD, REACH = 4.0, 0.4
# Lengths of the stretches as powers of two, and how many a limit needs.
SHORTEST, LONGEST, LEAST = 3, 10, 8
# Characters after which a longer text no longer sharpens the score.
CONFIDENCE = 60
# Characters scored at once: arrays of a few numbers per character.
SCORED_CHARS = 250_000
UNKNOWN = "und"
BOUNDARY, SPACE, BITS = 1, 32, np.uint64(16)


# --- characters ----------------------------------------------------------------
def symbol_table() -> np.ndarray:
    """Symbol of each code point: letters and marks themselves, anything else a space."""
    table = np.full(0x110000, SPACE, np.uint16)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            table[code] = min(code, 0xFFFF)
    table[0] = BOUNDARY
    return table


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased symbols of all texts, each after three boundaries, with white space collapsed.

    Returns the symbols and the position of the first boundary of each text.
    """
    pad = "\0" * (ORDER - 1)
    joined = pad + pad.join(t.replace("\0", " ") for t in texts)
    codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = table[codes]
    blank = s == SPACE
    keep = ~(blank & np.concatenate([[True], blank[:-1] | (s[:-1] == BOUNDARY)]))
    s = s[keep]
    s = s[~((s == SPACE) & np.concatenate([s[1:] == BOUNDARY, [True]]))]
    return s, np.flatnonzero(s == BOUNDARY)[:: ORDER - 1]


def ngrams(s: np.ndarray) -> np.ndarray:
    """The ``ORDER`` symbols that end at each position, packed; only for positions that hold a symbol."""
    wide = s.astype(np.uint64)
    g = np.zeros(len(s), np.uint64)
    for back in range(ORDER):
        g[back:] |= wide[: len(wide) - back] << (BITS * np.uint64(back))
    return g


def parts(text: str | None) -> list[str]:
    """A text, or pieces of a very long one, each of which begins anew."""
    text = text or ""
    return [text[i : i + SCORED_CHARS] for i in range(0, max(1, len(text)), SCORED_CHARS)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of packed n-grams."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


# --- models --------------------------------------------------------------------
@dataclass
class Table:
    """Rows of values by n-gram: a sorted array of hashes and one column per language."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def build(cls, grams: np.ndarray, values: np.ndarray) -> Table:
        hashes = mixed(grams)
        order = np.argsort(hashes)
        return cls(hashes[order], values[order].astype(np.float32))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row of each n-gram, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(grams), -1)
        h = mixed(grams)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, -1)


def _suffix(grams: np.ndarray, length: int) -> np.ndarray:
    return grams & np.uint64((1 << (16 * length)) - 1)


@dataclass
class Models:
    languages: list[str]
    probability: list[Table]  # natural logarithms, by order from 1
    backoff: list[Table]  # by length of the context from 0
    symbols: np.ndarray
    centre: np.ndarray | None = None  # by language and power of two of the length
    limit: np.ndarray | None = None  # how far above the centre a text is kept

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probability per text and language, scored positions and letters per text."""
        s, starts = symbols(texts, self.symbols)
        scored = s != BOUNDARY
        g = ngrams(s)[scored]
        total = np.zeros((len(s), len(self.languages)), np.float32)
        total[scored] = self.log_probability(g)
        sums = np.add.reduceat(total, starts, axis=0, dtype=np.float64)
        count = np.add.reduceat(scored.astype(np.int64), starts)
        letters = np.add.reduceat((scored & (s != SPACE)).astype(np.int64), starts)
        return sums, count, letters

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Interpolated estimate of each n-gram's last symbol; unknown n-grams back off."""
        row = self.probability[ORDER - 1].find(grams)
        out = self.probability[ORDER - 1].values[row]
        left = np.flatnonzero(row < 0)
        if len(left):
            out[left] = 0
        for order in range(ORDER, 0, -1):
            if not len(left):
                break
            g = _suffix(grams[left], order)
            context = self.backoff[order - 1].find(g >> BITS)
            known = context >= 0
            out[left[known]] += self.backoff[order - 1].values[context[known]]
            if order == 1:
                break
            row = self.probability[order - 2].find(_suffix(g, order - 1))
            found = row >= 0
            out[left[found]] += self.probability[order - 2].values[row[found]]
            left = left[~found]
        return out


def _counts_by_order(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of the highest order and continuation counts of the lower ones, by order from 1."""
    levels = [(grams, counts.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):
        g, c = np.unique(_suffix(levels[0][0], order), return_counts=True)
        levels.insert(0, (g, c.astype(np.float64)))
    return levels


def build_models(languages: list[str], language: np.ndarray, grams: np.ndarray, counts: np.ndarray, table: np.ndarray) -> Models:
    """Kneser-Ney models: absolute discounting, interpolated with continuation counts down to a uniform floor."""
    n = len(languages)
    levels = [_counts_by_order(grams[language == i], counts[language == i]) for i in range(n)]
    alphabet = len(np.unique(_suffix(grams, 1))) + 1
    probability, backoff = [], []
    lower = np.full((1, n), 1 / alphabet)
    lower_grams = np.zeros(1, np.uint64)
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([levels[i][order - 1][0] for i in range(n)]))
        contexts, context_of = np.unique(union >> BITS, return_inverse=True)
        below = np.searchsorted(lower_grams, _suffix(union, order - 1))
        p, weight = np.empty((len(union), n)), np.ones((len(contexts), n))
        for i in range(n):
            g, c = levels[i][order - 1]
            ones, twos = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            at = np.searchsorted(union, g)
            where = context_of[at]
            total = np.bincount(where, c, len(contexts))
            types = np.bincount(where, minlength=len(contexts))
            seen = total > 0
            weight[seen, i] = discount * types[seen] / total[seen]
            p[:, i] = weight[context_of, i] * lower[below, i]
            p[at, i] += (c - discount) / total[where]
        probability.append(Table.build(union, np.log(p)))
        backoff.append(Table.build(contexts, np.log(weight) + (np.log(1 / alphabet) if order == 1 else 0)))
        lower, lower_grams = p, union
    return Models(languages, probability, backoff, table)


# --- training --------------------------------------------------------------------
def training_sample(labelled: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """``language``, ``text``, ``calibrate`` of about ``per_language`` documents of each language.

    A document is taken if a hash of its id lies below the share that leaves
    that many; counts are combined before the shuffle, so a language may hold
    any part of the rows.
    """
    rows = labelled.where("language IS NOT NULL AND text IS NOT NULL")
    share = rows.groupBy("language").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    spread = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    return rows.join(F.broadcast(share) if share.limit(10_001).count() <= 10_000 else share, "language").where(
        spread < F.col("share")
    ).select("language", "text", (F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(CALIBRATION)) == 0).alias("calibrate"))


def count_ngrams(sample: DataFrame, table) -> DataFrame:
    """``language``, ``gram`` (packed, signed), ``count``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in rows_of(batches, "language", "text"):
            texts: dict[str, list[str]] = {}
            for language, text in block:
                texts.setdefault(language, []).extend(parts(text))
            for language, own in texts.items():
                s, _ = symbols(own, table.value)
                g, c = np.unique(ngrams(s)[s != BOUNDARY], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(g)), pa.array(g.view(np.int64)), pa.array(c)], ["language", "gram", "count"]
                )

    found = sample.select("language", "text").mapInArrow(run, "language string, gram bigint, count bigint")
    return found.groupBy("language", "gram").agg(F.sum("count").alias("count"))


def train(labelled: DataFrame, per_language: int = TRAIN_DOCS, max_ngrams: int = MAX_NGRAMS) -> Models:
    """Models of all languages in ``labelled`` (columns ``id``, ``language``, ``text``).

    Where the sample has more than ``max_ngrams`` distinct n-grams, those of the
    lowest counts are left out (count cut-offs), so what reaches the driver and
    every task is bounded.
    """
    spark = prepare(labelled.sparkSession)
    table = spark.sparkContext.broadcast(symbol_table())
    sample = materialise(training_sample(labelled, per_language))
    counted = materialise(count_ngrams(sample.where("NOT calibrate"), table))
    histogram = counted.groupBy(F.least("count", F.lit(1000)).alias("count")).agg(F.count("*").alias("n")).collect()
    cutoff, left = 0, sum(r["n"] for r in histogram)
    for r in sorted(histogram, key=lambda r: r["count"]):
        if left <= max_ngrams:
            break
        cutoff, left = r["count"], left - r["n"]
    if left > max_ngrams:
        raise ValueError("more frequent n-grams than max_ngrams")
    rows = counted.where(F.col("count") > cutoff).toArrow()
    names = rows["language"].to_pylist()
    languages = sorted(set(names))
    if not languages:
        return Models([], [], [], table.value)
    number = {name: i for i, name in enumerate(languages)}
    models = build_models(
        languages, np.array([number[x] for x in names]), rows["gram"].to_numpy().view(np.uint64),
        rows["count"].to_numpy(), table.value,
    )
    return _calibrated(models, sample.where("calibrate"))


def stretches(text: str) -> list[str]:
    """The text, and its consecutive stretches of doubling length."""
    starts = [((1 << k) - (1 << SHORTEST), 1 << k) for k in range(SHORTEST, LONGEST + 1)]
    return [text[:BLOCK_CHARS], *(text[at : at + size] for at, size in starts if at + size < len(text))]


def shuffled(text: str) -> str:
    """The text with its characters in a fixed pseudo-random order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.random.default_rng(len(codes)).permutation(codes).tobytes().decode("utf-32-le", "surrogatepass")


def length_class(n: np.ndarray) -> np.ndarray:
    """Logarithm of the number of symbols to base two, from 0 at the shortest stretch to the longest."""
    return np.clip(np.log2(np.maximum(n, 1)), SHORTEST, LONGEST) - SHORTEST


def _calibrated(models: Models, sample: DataFrame) -> Models:
    """Set each language's usual cross-entropy by length, and the distance beyond which a text is rejected.

    Both come from medians and quartiles of one class of lengths, so a few junk
    texts among the calibration texts move neither.
    """
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.languages, object)
        for block in rows_of(batches, "language", "text"):
            cut = [(language, t) for language, text in block for t in stretches(text)]
            own = np.array([language for language, _ in cut], object)
            sums, count, letters = _scored(m, [t for _, t in cut])
            junk = (-_scored(m, [shuffled(t) for _, t in cut])[0] / np.maximum(count, 1)[:, None]).min(axis=1)
            entropy = -sums / np.maximum(count, 1)[:, None]
            good = (letters > 0) & (names[entropy.argmin(axis=1)] == own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[good].tolist(), pa.string()), pa.array(np.rint(length_class(count[good])).astype(np.int32)),
                 pa.array(entropy.min(axis=1)[good]), pa.array(junk[good])], ["language", "k", "clean", "junk"]
            )

    scored = sample.select("language", "text").mapInArrow(run, "language string, k int, clean double, junk double")
    quartiles = F.percentile_approx("clean", [0.25, 0.5, 0.75], 10_000)
    found = scored.groupBy("language", "k").agg(
        F.count("*").alias("n"), quartiles.alias("q"), F.percentile_approx("junk", 0.5, 10_000).alias("junk")
    ).where(F.col("n") >= LEAST).collect()
    number = {name: i for i, name in enumerate(models.languages)}
    shape = len(number), LONGEST - SHORTEST + 1
    centre, limit = np.full(shape, np.nan), np.full(shape, np.nan)
    for r in found:
        low, middle, high = r["q"]
        at = number[r["language"]], r["k"]
        centre[at], limit[at] = middle, max(SPREAD * (high - low), REACH * (r["junk"] - middle))
    models.centre, models.limit = _filled(centre, 0.0), _filled(limit, np.inf)
    return models


def _filled(values: np.ndarray, usual: float) -> np.ndarray:
    """Gaps take the next shorter length of the language, else the next longer one, else the mean of the others."""
    for step in (1, -1):
        for row in values[:, ::step]:
            for k in range(1, len(row)):
                if np.isnan(row[k]):
                    row[k] = row[k - 1]
    known = ~np.isnan(values)
    n = known.sum(axis=0)
    mean = np.where(n > 0, np.where(known, values, 0).sum(axis=0) / np.maximum(n, 1), usual)
    return np.where(known, values, mean)


# --- prediction --------------------------------------------------------------------
def predict(docs: DataFrame, models: Models, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, ``lang_pred``, ``score``, ``cross_entropy``, ``n_symbols``, ``rejected``.

    The language of the lowest cross-entropy per character wins, the first in
    order on a tie. ``score`` is its share of the likelihoods (of at most
    ``CONFIDENCE`` characters), lowered where the cross-entropy lies beyond the
    calibrated limit; such a text is ``rejected``. Null text, empty text and
    text without letters give ``und``, score 0, null entropy, rejected. Very
    long texts are summed over parts. Repeated rows give repeated rows, a null
    id stays null, an empty table gives an empty table, other columns are not
    read. Without any learned language all rows are ``und``.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(models)
    key = docs.schema[id_column].dataType
    id_type = to_arrow_type(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in rows_of(batches, "id", "text"):
            pieces = [parts(t) for _, t in block]
            first = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
            sums, count, letters = _scored(m, [x for p in pieces for x in p])
            sums, count, letters = (np.add.reduceat(x, first, axis=0) for x in (sums, count, letters))
            yield _judged(m, pa.array([i for i, _ in block], id_type), sums, count, letters)

    fields = "lang_pred string, score double, cross_entropy double, n_symbols bigint, rejected boolean"
    picked = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return picked.mapInArrow(run, f"id {key.simpleString()}, {fields}").withColumnRenamed("id", id_column)


def _scored(m: Models, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores in blocks of at most about ``SCORED_CHARS`` characters."""
    if not m.languages:
        return np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    found, at = [], 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= SCORED_CHARS:
            size += len(texts[end])
            end += 1
        found.append(m.score(texts[at:end]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


def _judged(m: Models, ids: pa.Array, sums: np.ndarray, count: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
    some = (letters > 0) & bool(m.languages)
    n = np.maximum(count, 1)
    entropy = -sums / n[:, None]
    best = entropy.argmin(axis=1)
    lowest = entropy.min(axis=1)
    share = 1 / np.exp(-(entropy - lowest[:, None]) * np.minimum(n, CONFIDENCE)[:, None]).sum(axis=1)
    rejected = ~some
    if m.limit is not None:
        at = length_class(n)
        low = np.floor(at).astype(np.int64)
        high, part = np.minimum(low + 1, LONGEST - SHORTEST), at - low
        apart = lowest - (m.centre[best, low] * (1 - part) + m.centre[best, high] * part)
        limit = m.limit[best, low] * (1 - part) + m.limit[best, high] * part if np.isfinite(m.limit).all() else np.full(len(n), np.inf)
        rejected = rejected | (apart > limit)
        share = share * np.minimum(1, limit / np.maximum(apart, 1e-9))
    names = np.array([*m.languages, UNKNOWN], object)[np.where(some, best, len(m.languages))]
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array(names.tolist(), pa.string()), pa.array(np.where(some, share, 0.0)),
            pa.array(lowest, mask=~some), pa.array(count, pa.int64()), pa.array(rejected),
        ],
        ["id", "lang_pred", "score", "cross_entropy", "n_symbols", "rejected"],
    )


def accepted(docs: DataFrame, models: Models, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that ``predict`` rejects; all columns pass unchanged."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(models)
    at = docs.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in _slices(batches, at):
            pieces = [parts(t) for t in batch.column(at).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
            found = _scored(m, [x for p in pieces for x in p])
            judged = _judged(m, pa.nulls(batch.num_rows), *(np.add.reduceat(x, first, axis=0) for x in found))
            yield batch.filter(pa.array(~judged.column(5).to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, docs.schema)


def _slices(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``SCORED_CHARS`` bytes of text each, at least one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64) + 64) // SCORED_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def identify(docs: DataFrame, holds_out: Column) -> DataFrame:
    """Learn from the labelled rows outside ``holds_out`` and predict every row (``doc_id``, ``lang``, ``text``)."""
    labelled = docs.where(~holds_out).select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text")
    return predict(docs, train(labelled))
