"""Secrets in text: fixed patterns, and values of credential contexts that would be costly to guess.

The guess cost of a value is the least sum of costs over all ways to cut it into corpus words, dates, repeats,
keyboard walks and brute-force characters, found by dynamic programming over its places. Costs are in bits.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import map_runs, runs, saved

# The base patterns of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
# Wider contexts, whose values are judged by their guess cost.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|bearer|login|(?:api|access|private|client)[_-]?(?:key|secret))"""
    r"""["']?(?:\x20*[:=]\x20*|\x20+is\x20+)["']?([^\s"'<>,;]+)""",
    re.ASCII | re.IGNORECASE,
)
COSTLY_BITS = 40.0  # a value that takes 2 ** 40 guesses or more is a secret
CORPUS_WORDS = 20_000  # the most frequent words of all documents that guessing starts with
LEAST_SHARE = 1e-4  # a corpus word is in so many of the documents, those aside that hold the value it is looked up for
LONGEST_WORD = 24
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEXT_KEY = {pair for row in KEY_ROWS for a, b in zip(row, row[1:]) for pair in (a + b, b + a)}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
DATE_BITS, YEAR_BITS, CUT_BITS = math.log2(365 * 119) + 2, math.log2(119), 1.0
KEY_BITS, STEP_BITS = math.log2(sum(map(len, KEY_ROWS))), 1.0


def _char_bits(c: str) -> float:
    return math.log2(10 if c.isdigit() else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 1 << 12)


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """Bits to guess ``value``: the least cost over all its segmentations. Time grows with its length, not the square."""
    n, low = len(value), value.lower() if len(value.lower()) == len(value) else value
    best = [0.0] + [math.inf] * n
    walk = same = 0  # where the walk, and the run of one character, that end at the place began
    dates: dict[int, list[tuple[int, float]]] = {}
    for start in range(n) if any(c.isdigit() for c in value) else ():
        if found := DATE.match(value, start):
            dates.setdefault(found.end(), []).append((start, YEAR_BITS if found.end() - start == 4 else DATE_BITS))
    for end in range(1, n + 1):
        least = best[end - 1] + _char_bits(value[end - 1])
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            rank = ranks.get(low[start:end])
            if rank is not None:
                upper = sum(a != b for a, b in zip(value[start:end], low[start:end]))
                least = min(least, best[start] + CUT_BITS + math.log2(rank + 2) + (math.log2(math.comb(end - start, upper)) + 1 if upper else 0.0))
        for start, bits in dates.get(end, ()):
            least = min(least, best[start] + CUT_BITS + bits)
        if end > 1:
            walk = walk if low[end - 2 : end] in _NEXT_KEY else end - 1
            same = same if value[end - 2] == value[end - 1] else end - 1
        if end - walk >= 3:
            least = min(least, best[walk] + CUT_BITS + KEY_BITS + STEP_BITS * (end - walk - 1))
        if end - same >= 3:
            least = min(least, best[same] + CUT_BITS + _char_bits(value[end - 1]) + math.log2(end - same))
        for unit in range(2, min(9, end // 2 + 1)):  # a unit that stands twice or more in a row
            times = 1
            while end >= unit * (times + 1) and value[end - unit * (times + 1) : end - unit * times] == value[end - unit : end] and times < 8:
                times += 1
            if times > 1:
                least = min(least, best[end - unit * (times - 1)] + CUT_BITS + math.log2(times))
        best[end] = least
    return best[n]


def _matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, bool]]]:
    """Base spans as start, kind and end, and wider contexts as start, end, value and whether the span is a base span."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    taken = {(start, end) for start, _, end in found}
    return found, [(*m.span(), m[1], m.span() in taken) for m in CONTEXT.finditer(text)]


def find_spans(text: str, ranks: dict[str, int], bits: float = COSTLY_BITS) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of base spans and of costly values in ``text``, by start and then kind."""
    found, wider = _matches(text)
    found += [(start, 3, end) for start, end, value, taken in wider if not taken and guess_bits(value, ranks) >= bits]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


KINDS = ("assign", "access", "hex", "guess")
WORD = re.compile(r"[^\W\d_]{3,24}")


def corpus_words(documents: DataFrame, text: str = "text", most: int = CORPUS_WORDS) -> list[str]:
    """The frequent words of three letters or more over all documents, the most frequent first: as many as ``most`` allows.

    Words of about equal counts come in together or not at all, so no more than ``most`` words reach the driver.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for start, stop in runs(batch.column(0)):
                for value in batch.column(0).slice(start, stop - start).to_pylist():
                    counts.update(WORD.findall((value or "").lower()))
                if len(counts) > 200_000:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    counted = documents.select(text).mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = saved(counted.withColumn("level", F.floor(20 * F.log2("n")).cast("int")))
    least, words = None, 0
    for level, n in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # some hundred levels
        words += n
        if words > most:
            break
        least = level
    if least is None:
        return []
    return [r[0] for r in counted.where(F.col("level") >= least).orderBy(F.desc("n"), "word").select("word").collect()]


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def word_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: how many documents hold each word of three letters or more."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for start, stop in runs(batch.column(0)):
                for value in batch.column(0).slice(start, stop - start).to_pylist():
                    counts.update(set(WORD.findall((value or "").lower())))
                if len(counts) > 200_000:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    return documents.select(text).mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _level(n: int) -> int:
    return math.floor(20 * math.log2(n))


def _parts(value: str) -> list[tuple[str, bool]]:
    """The runs of 3 to 24 letters in a value that may be corpus words, and whether the value's own text counts as one of that word."""
    low = value.lower() if len(value.lower()) == len(value) else value
    own = set(WORD.findall(value.lower()))
    found = set()
    for m in re.finditer(r"[^\W\d_]{3,}", low):
        found.update(m[0][i:j] for i in range(len(m[0]) - 2) for j in range(i + 3, min(len(m[0]), i + LONGEST_WORD) + 1))
    return [(w, w in own) for w in sorted(found | own)]


def _costly(wider: DataFrame, documents: DataFrame, text: str, bits: float) -> DataFrame:
    """The values among ``id, value`` that cost ``bits`` or more, each guessed with the corpus words it holds."""
    counted = saved(word_documents(documents, text))
    total = documents.where(F.col(text).isNotNull()).count()
    above, ranks = 0, {}
    for level, n in counted.groupBy(F.floor(20 * F.log2("n")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred levels
        ranks[level] = above
        above += n
    levels = sorted(ranks)
    values = saved(wider.distinct().groupBy("value").agg(F.count(F.lit(1)).alias("held")))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = [(v, h, w, own) for v, h in zip(*(c.to_pylist() for c in batch.columns)) for w, own in _parts(v)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*flat) if flat else ([],) * 4, (pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["value", "held", "word", "own"])

    parts = map_runs(values.select("value", "held"), "value", "value string, held long, word string, own boolean", cut)
    others = F.col("n") - F.when(F.col("own"), F.col("held")).otherwise(0)
    known = parts.join(counted, "word").withColumn("n", others).where((F.col("n") > 0) & (F.col("n") >= LEAST_SHARE * total))
    words = known.groupBy("value").agg(F.collect_list(F.struct("word", "n")).alias("words"))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for value, words in zip(*(c.to_pylist() for c in batch.columns)):
            # A count that was lowered may have no level of its own: the next higher one's words come before it.
            own = {w["word"]: ranks[levels[min(bisect_left(levels, _level(w["n"])), len(levels) - 1)]] for w in words or ()}
            if guess_bits(value, own) >= bits:
                keep.append(value)
        return pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], names=["value"])

    return map_runs(values.select("value").join(words, "value", "left").select("value", "words"), "value", "value string", judge)


def find_secrets(documents: DataFrame, key: str = "doc_id", text: str = "text", words: list[str] | None = None, bits: float = COSTLY_BITS) -> DataFrame:
    """``doc_id, spans`` for every row: an array of ``kind, start, end`` in code points, end exclusive.

    Base spans (assign, access, hex) are the fixed patterns' matches; ``guess`` spans are added where a wider credential
    context holds a value of at least ``bits``. Null and empty texts have no spans. Repeated rows stay rows. ``words`` is the list that
    guessing starts with, by default each value's own parts that are words of the corpus, which are joined to it. Other columns are not read.
    """
    spark = documents.sparkSession
    if words is None:
        return _find_with_corpus(documents, key, text, bits)
    sent = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks = sent.value
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t or "", ranks, bits)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], names=["doc_id", "spans"])

    kind = documents.schema[key].dataType.simpleString()
    return map_runs(
        documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text",
        f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>", work,
    )


def _find_with_corpus(documents: DataFrame, key: str, text: str, bits: float) -> DataFrame:
    kind = documents.schema[key].dataType.simpleString()
    base, wide = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("taken", pa.bool_())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_matches(t or "") for t in batch.column(1).to_pylist()]
        spans = [[{"start": s, "kind": k, "end": e} for s, k, e in f] for f, _ in found]
        wider = [[{"start": s, "end": e, "value": v, "taken": t} for s, e, v, t in w] for _, w in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, base), pa.array(wider, wide)], names=["doc_id", "found", "wider"])

    scanned = map_runs(
        documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text",
        f"doc_id {kind}, found array<struct<start:int,kind:int,end:int>>, wider array<struct<start:int,end:int,value:string,taken:boolean>>", scan,
    )
    scanned = saved(scanned.withColumn("id", F.monotonically_increasing_id()))  # no texts, so it is small
    wider = scanned.select("id", F.explode("wider").alias("w")).select("id", "w.*")
    costly = _costly(wider.select("id", "value"), documents, text, bits)
    guessed = wider.where(~F.col("taken")).join(costly, "value").groupBy("id").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("guessed"))
    every = F.array_sort(F.concat("found", F.coalesce("guessed", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    name = F.array(*map(F.lit, KINDS))
    spans = F.transform(every, lambda s: F.struct(F.get(name, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.join(guessed, "id", "left").select("doc_id", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, a hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count("guess"),
    )
