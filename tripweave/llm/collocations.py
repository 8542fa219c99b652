"""Phrase mining by marginalising the longest windows.

Every word of a piece leads one window: the word and up to four that follow, padded where the piece ends. Only these
windows are counted. ROLLUP over their columns then sums them over ever shorter prefixes, and as each occurrence of a phrase is the
prefix of exactly one window, these sums are the counts of all phrases of one to five words.

A phrase of enough occurrences holds only words, and pairs of neighbours, of as many. So words and pairs are counted first, and windows end
before a rare word and between the words of a rare pair. Windows carry numbers: a dictionary of fixed size has the most frequent
words, and words beyond it go by their 64-bit hash. Frequent pairs are known by a bitmap that grows with them up to a fixed size; a
rare pair it takes for a frequent one only makes a window longer than need be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.common import Words, flat_bytes, mix, runs, saved, signed, small_batches, span_hashes
from tripweave.runtime import small

LONGEST = 5
LEAST = 100  # occurrences of a phrase
TOP = 2000  # phrases of a language
SHARE = 100  # percent of a phrase's occurrences that lie inside one longer phrase, from which on it is dropped
NO_LANG = "und"
DICTIONARY_ROWS = 1 << 21  # words with a number of their own: 8 bytes each in every task
PAIR_BITS = 1 << 23  # at most, of the bitmap of frequent pairs; it has CELLS_A_PAIR bits for each as long as they fit
CELLS_A_PAIR = 16
PART_BITS = 22  # of the 32-bit hashes of pairs: the cells a task counts at a time
PAIRS_HELD = 4_000_000  # different pairs a task holds before it sends them
MOST_COUNTED = (1 << 32) - 1
RUN_BYTES = 2 << 20
SALTS = 64
LANGS = 100_000  # broadcast bound of the table of languages

# What ends a piece, and blank and tab, which separate its words.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
_ENDS = np.array([chr(b) in PIECE_ENDS for b in range(256)])
WORD_BYTES = np.array([chr(b) not in PIECE_ENDS + " \t" for b in range(256)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAD = 0
_OF_LANG = np.uint64(0x5851F42D4C957F2D)  # a word and a language may be the same letters


def word_counts(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, word, n`` of words with ``least`` occurrences in their language; the others' sum has a null word."""
    raw = texts.select("lang", F.explode(F.split("text", r"[.,;:!?\x0A-\x0D\x20\x09]+")).alias("word")).where("word <> ''")
    raw = raw.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    lowered = raw.groupBy("lang", F.translate("word", UPPER, LOWER).alias("word")).agg(F.sum("n").alias("n"))
    return lowered.groupBy("lang", F.when(F.col("n") >= least, F.col("word")).alias("word")).agg(F.sum("n").alias("n"))


def _keys(langs: pa.Array, words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The 64-bit name of each word in the language of its text."""
    data, starts = flat_bytes(langs)
    return mix(words + mix(span_hashes(data, starts[:-1], starts[1:]) + _OF_LANG)[of])


def _key_column(langs: pa.Array, words: pa.Array) -> np.ndarray:
    data, starts = flat_bytes(words)
    return _keys(langs, span_hashes(data, starts[:-1], starts[1:]), np.arange(len(words)))


class Dictionary:
    """Numbers of words: 1 and up for those it holds, ``PAD`` for rare ones; frequent ones beyond it have negative numbers."""

    def __init__(self, keys: np.ndarray, complete: bool) -> None:
        self.keys, self.complete = np.sort(keys), complete

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        held = np.zeros(len(keys), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        others = np.full(len(keys), PAD, np.int64) if self.complete else signed(keys | np.uint64(1 << 63))
        return np.where(held, at + 1, others)


def _dictionary(frequent: DataFrame, rows: int) -> Dictionary:
    """The ``rows`` most frequent words; only their 64-bit names come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(signed(_key_column(batch.column(0), batch.column(1)))), batch.column(2)], names=["key", "n"])

    named = frequent.select("lang", "word", "n").mapInArrow(work, "key long, n long")
    complete = frequent.count() <= rows
    if not complete:
        named = named.orderBy(F.desc("n"), "key").limit(rows)
    return Dictionary(np.asarray(named.select("key").toArrow().column(0)).view(np.uint64), complete)


def _numbered(frequent: DataFrame, dictionary) -> DataFrame:
    """``number, lang, word`` of the frequent words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = dictionary.value.numbers(_key_column(batch.column(0), batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column(0), batch.column(1)], names=["number", "lang", "word"])

    return frequent.select("lang", "word").mapInArrow(work, "number long, lang string, word string")


class Pairs:
    """A bitmap of frequent pairs of numbers; without one every pair may be frequent."""

    def __init__(self, bits: np.ndarray | None = None) -> None:
        self.bits = bits

    @staticmethod
    def cells(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """A 32-bit hash of each pair."""
        return (mix(mix(one.astype(np.uint64)) + two.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)

    def frequent(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.ones(len(one), bool) if self.bits is None else self.bits[self.cells(one, two) & (len(self.bits) - 1)]


def _packed(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted cells and their counts as one compressed block for each part of the cells: steps between cells, then counts."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    parts, first = np.unique(cells >> PART_BITS, return_index=True)
    ends = [*first[1:].tolist(), len(cells)]
    blocks = []
    for a, b in zip(first.tolist(), ends):
        steps = np.diff(cells[a:b] & ((1 << PART_BITS) - 1), prepend=0).astype(np.uint32)
        blocks.append(press.compress(np.concatenate([steps, np.minimum(counts[a:b], MOST_COUNTED).astype(np.uint32)]).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"])


def frequent_cells(texts: DataFrame, dictionary, least: int) -> DataFrame:
    """``cell``: hashes of pairs that occur ``least`` times or more. Pairs are counted by hash: a count may be too high, never too low.

    Tasks send compressed blocks by parts of the hashes, so a pair costs two or three bytes; a part is a table of fixed size.
    """
    small_batches(texts.sparkSession)

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        cells, counts = (np.concatenate(p) for p in zip(*held))
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        return cells[first], np.add.reduceat(counts, first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for start, stop in runs(batch.column(1), RUN_BYTES):
                part = batch.slice(start, stop - start)
                rows = lead_windows(part.column(0), part.column(1), dictionary.value, Pairs(), 2)
                rows = rows[rows[:, 1] != PAD]
                if len(rows):
                    held.append(np.unique(Pairs.cells(rows[:, 0], rows[:, 1]), return_counts=True))
                if sum(len(c) for c, _ in held) > PAIRS_HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > PAIRS_HELD // 2:
                        yield _packed(*held.pop())
        if held:
            yield _packed(*merged(held))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        now, table = None, np.zeros(1 << PART_BITS, np.int64)

        def ready() -> pa.RecordBatch:
            found = np.flatnonzero(table >= least) + (now << PART_BITS)
            table.fill(0)
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], names=["cell"])

        for batch in batches:  # blocks of a part follow each other
            for part, block in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and part != now:
                    yield ready()
                now = part
                steps, counts = np.frombuffer(unpress.decompress(block), np.uint32).reshape(2, -1)
                table[np.cumsum(steps, dtype=np.int64)] += counts
        if now is not None:
            yield ready()

    blocks = texts.select("lang", "text").mapInArrow(count, "part int, block binary")
    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(add, "cell long")


def _pair_bitmap(cells: DataFrame, limit: int = PAIR_BITS) -> Pairs:
    """The bitmap of frequent pairs; only its cells come to the driver, ``limit`` at most."""
    size = 1 << 10
    wanted = CELLS_A_PAIR * cells.count()
    while size < min(wanted, limit):
        size *= 2
    bits = np.zeros(size, bool)
    for batch in cells.select(F.col("cell").bitwiseAND(size - 1).alias("cell")).distinct().toArrow().to_batches():
        bits[np.asarray(batch.column(0))] = True
    return Pairs(bits)


def lead_windows(langs: pa.Array, texts: pa.Array, dictionary: Dictionary, pairs: Pairs, longest: int = LONGEST) -> np.ndarray:
    """One row per word that is not rare: its number and those that follow in its piece, ``PAD`` from the end, a rare word or a rare pair on."""
    words = Words(texts, WORD_BYTES)
    of = np.repeat(np.arange(len(texts)), words.counts)
    numbers = dictionary.numbers(_keys(langs, words.hashes, of))
    piece = np.concatenate([[0], np.cumsum(_ENDS[words.data])])[words.starts]
    joined = (piece[1:] == piece[:-1]) & (of[1:] == of[:-1]) & (numbers[1:] != PAD) & (numbers[:-1] != PAD)
    at = np.flatnonzero(joined)
    joined[at] = pairs.frequent(numbers[at], numbers[at + 1])
    columns = [numbers]
    for k in range(1, longest):
        lead = np.full(len(numbers), PAD, np.int64)
        goes_on = np.flatnonzero((columns[-1][:-k] != PAD) & joined[k - 1 :])
        lead[goes_on] = numbers[goes_on + k]
        columns.append(lead)
    made = np.stack(columns, axis=1)
    return made[numbers != PAD]


def count_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs; sorted by a hash, and by all columns should two rows share one."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    total = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        total = mix(total + rows[:, k].astype(np.uint64) + np.uint64(k + 1))
    order = np.argsort(total)
    total, ordered = total[order], rows[order]
    new = np.concatenate([[True], total[1:] != total[:-1]])
    first = np.flatnonzero(new)
    if (ordered[first][np.cumsum(new) - 1] != ordered).any():
        return np.unique(rows, axis=0, return_counts=True)
    return ordered[first], np.diff(np.concatenate([first, [len(rows)]]))


def _windows(texts: DataFrame, dictionary, pairs, longest: int) -> DataFrame:
    """``w1`` and on, and ``n``: the padded windows of ``longest`` words, counted within each run of ``texts(lang, text)``."""
    names = [f"w{k + 1}" for k in range(longest)]
    small_batches(texts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in runs(batch.column(1), RUN_BYTES):
                part = batch.slice(start, stop - start)
                rows, counts = count_rows(lead_windows(part.column(0), part.column(1), dictionary.value, pairs.value, longest))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(longest)), pa.array(counts.astype(np.int64))], names=[*names, "n"])

    return texts.select("lang", "text").mapInArrow(work, ", ".join(f"{c} long" for c in [*names, "n"]))


def phrase_counts(texts: DataFrame, frequent: DataFrame, least: int = LEAST, longest: int = LONGEST, dictionary_rows: int = DICTIONARY_ROWS) -> DataFrame:
    """``lang, words, a`` of every phrase of up to ``longest`` words with ``least`` occurrences; ``texts`` is ``lang, text``."""
    send = texts.sparkSession.sparkContext.broadcast
    dictionary = send(_dictionary(frequent, dictionary_rows))
    pairs = send(_pair_bitmap(saved(frequent_cells(texts, dictionary, least))))
    names = [f"w{k + 1}" for k in range(longest)]
    windows = _windows(texts, dictionary, pairs, longest).groupBy(*names).agg(F.sum("n").alias("n"))
    sums = windows.rollup(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    # Columns a prefix leaves out are null; a prefix that ends in padding is no phrase.
    numbers = F.filter(F.array(*names), lambda x: x.isNotNull())
    phrases = sums.select(numbers.alias("numbers"), "a").where((F.size("numbers") > 0) & (F.get("numbers", F.size("numbers") - 1) != PAD))
    phrases = saved(phrases)
    spelled = phrases.select("numbers", "a", F.posexplode("numbers").alias("at", "number")).join(saved(_numbered(frequent, dictionary)), "number")
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return spelled.groupBy("numbers").agg(F.first("a").alias("a"), F.first("lang").alias("lang"), words.alias("words")).select("lang", "words", "a")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, words, a, l, r, n, score`` of phrases of two words and more, at the cut with the lowest score."""
    cut = phrases.where(F.size("words") > 1).select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cut = cut.withColumns({"one": F.slice("words", F.lit(1), F.col("cut")), "two": F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut"))})
    part = lambda name, count: phrases.select("lang", F.col("words").alias(name), F.col("a").alias(count))
    whole = cut.join(part("one", "l"), ["lang", "one"]).join(part("two", "r"), ["lang", "two"]).join(small(totals, totals.count(), LANGS), "lang")
    exact = lambda c: f"CAST({c} AS DECIMAL(18,0))"
    score = F.expr(f"CAST(({exact('a')} * {exact('n')} * 1000BD) div ({exact('l')} * {exact('r')}) AS BIGINT)")
    best = F.min(F.struct(score.alias("score"), F.col("cut"), F.col("l"), F.col("r"))).alias("best")
    return whole.groupBy("lang", "words", "a", "n").agg(best).select("lang", "words", "a", "best.l", "best.r", "n", "best.score")


def inside_longer(phrases: DataFrame) -> DataFrame:
    """``lang, words, longer``: the most frequent longer phrase around each phrase of two words and more."""
    size = F.size("words")
    parts = F.flatten(
        F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice("words", i, k)))
    )
    return phrases.where(size > 2).select("lang", F.explode(parts).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("longer"))


def first_of(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, ``rank`` from 1; first of each of ``SALTS`` parts of it, so no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    few = salted.withColumn("rank", part).where(F.col("rank") <= top).drop("salt", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 share: int = SHARE, dictionary_rows: int = DICTIONARY_ROWS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two to ``longest`` words.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut of the lowest score, ``n`` all words of the language; null
    languages are ``und``. Phrases with ``share`` percent of their occurrences inside one longer phrase go. Null and empty texts have no words;
    repeated rows count each time; ties in score and ``a`` go by the phrase's bytes; without phrases the result is empty. Other
    columns are not read, whatever their names. Counts may have 18 digits.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have at least two words and one occurrence")
    texts = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    counts = saved(word_counts(texts, least))
    totals = saved(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    phrases = saved(phrase_counts(texts, counts.where("word IS NOT NULL"), least, longest, dictionary_rows))
    kept = scored(phrases, totals).join(inside_longer(phrases), ["lang", "words"], "left").where(
        F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))
    )
    ranked = first_of(kept.withColumn("phrase", F.array_join("words", " ")).drop("words", "longer"), top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
