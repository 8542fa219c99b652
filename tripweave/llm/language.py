"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has raw-content zstandard dictionaries cut from whole training texts. A text is compressed in pieces,
so that the dictionary counts from its first to its last byte, and the sizes add up; the smallest sum wins, of equal
ones the language with more training texts. Both sides are normalised: lower case, one blank for anything but letters.
Where the runner-up is close, the answer is marked as rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tripweave.llm.common import map_runs

SAMPLE_TEXTS = 60  # training texts of a language that its dictionaries are cut from: a bounded sample
DICTIONARY_BYTES = 16_000
DICTIONARIES, LONG_DICTIONARIES = 6, 2  # per language, for short texts and for longer ones
PIECE_BYTES = 4_000
SHORT_BYTES = 600
LEVEL, SHORT_LEVEL = 6, 19
NARROW = 0.02  # rejected if the runner-up is larger by less than this share of the text
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_WIDE_OTHER = re.compile(r"[^\x00-\x7F](?<![^\W\d_])")
# ASCII letters in lower case, a blank for other ASCII, the bytes of wider characters as they are.
_PLAIN = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normalised(text: str) -> bytes:
    """Letters in lower case, one blank for each run of anything else and at both ends."""
    data = text.encode().translate(_PLAIN)
    if not text.isascii():
        data = _WIDE_OTHER.sub(" ", data.decode()).lower().encode()
    return b" " + b" ".join(data.split()) + b" "


def held_out(key: str, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == part


def training_sample(labelled: DataFrame, lang: str, text: str, most: int = SAMPLE_TEXTS) -> dict[str, list[str]]:
    """Up to ``most`` distinct texts of each language, those of the smallest hash; tasks pass on no more than that each."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, str]] = {}
        for batch in batches:
            for name, value in zip(*(c.to_pylist() for c in batch.columns)):
                if _LETTER.search(value):
                    best = kept.setdefault(name, {})
                    best[zlib.crc32(value.encode()) << 31 | zlib.adler32(value.encode()) >> 1] = value
                    if len(best) > most:
                        del best[max(best)]
        flat = [(name, at, value) for name, best in kept.items() for at, value in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*flat) if flat else ([], [], []), (pa.string(), pa.int64(), pa.string()))], names=["lang", "at", "text"])

    chosen = rows.mapInArrow(task, "lang string, at long, text string").dropDuplicates(["lang", "at"])
    order = W.Window.partitionBy("lang").orderBy("at")
    found: dict[str, list[str]] = {}
    for row in chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).orderBy("lang", "at").collect():
        found.setdefault(row.lang, []).append(row.text)
    return found


def dictionaries(sample: dict[str, list[str]], size: int = DICTIONARY_BYTES, count: int = DICTIONARIES) -> dict[str, list[bytes]]:
    """Up to ``count`` dictionaries of up to ``size`` bytes for each language, from its sample's texts in turn."""
    made = {}
    for lang, texts in sample.items():
        # No text fills more than an eighth of a dictionary.
        parts = [b"".join(normalised(t)[: size // 8] for t in texts[i::count])[:size] for i in range(count)]
        made[lang] = [p for p in parts if p]
    return made


class Classifier:
    def __init__(self, content: dict[str, list[bytes]]) -> None:
        import zstandard as z

        self.langs = list(content)
        self.machines: dict[int, list[list]] = {LEVEL: [], SHORT_LEVEL: []}  # by level and language
        for level, used in ((LEVEL, LONG_DICTIONARIES), (SHORT_LEVEL, DICTIONARIES)):
            for parts in content.values():
                made = []
                for part in parts[:used]:
                    shared = z.ZstdCompressionDict(part, dict_type=z.DICT_TYPE_RAWCONTENT)
                    shared.precompute_compress(level=level)
                    made.append(z.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False))
                self.machines[level].append(made)

    def __call__(self, texts: Sequence[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether the answer is rejected, for each text.

        A dictionary's tables are larger than a core's cache, so each compresses the pieces of all texts before the next has its turn.
        """
        answers = [(UNDETERMINED, 0.0, True) if text is None or not _LETTER.search(text) or not self.langs else None for text in texts]
        pieces: dict[int, list[tuple[int, bytes]]] = {level: [] for level in self.machines}
        lengths = {}
        for at, (text, answer) in enumerate(zip(texts, answers)):
            if answer is None:
                data = normalised(text)
                lengths[at] = len(data)
                pieces[SHORT_LEVEL if len(data) < SHORT_BYTES else LEVEL] += [(at, data[i : i + PIECE_BYTES]) for i in range(0, len(data), PIECE_BYTES)]
        sizes = np.zeros((len(answers), len(self.langs)))
        for level, by_lang in self.machines.items():
            for lang, made in enumerate(by_lang):
                sums: dict[int, int] = {}
                for m in made:
                    for at, piece in pieces[level]:
                        sums[at] = sums.get(at, 0) + len(m.compress(piece))
                for at, total in sums.items():
                    sizes[at, lang] = total / len(made)
        for at, length in lengths.items():
            answers[at] = self._answer(sizes[at], length)
        return answers

    def _answer(self, sizes: np.ndarray, length: int) -> tuple[str, float, bool]:
        order = np.argsort(sizes, kind="stable")
        gap = float(sizes[order[1]] - sizes[order[0]]) if len(order) > 1 else float(length)
        score = 1.0 / float(np.exp2(np.clip(sizes[order[0]] - sizes, -60, 0)).sum())
        return self.langs[order[0]], score, gap < NARROW * length


@lru_cache(maxsize=1)
def _classifier(content: tuple) -> Classifier:
    return Classifier({lang: list(parts) for lang, parts in content})


def identify(documents: DataFrame, content: dict[str, list[bytes]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, rejected`` for every row, from the text alone.

    ``score`` is the winner's share if each byte a language needs more halves its weight. Null texts, texts without a letter, and
    all texts where nothing was learnt are ``und`` with score 0. Rows that repeat stay rows; other columns are not read.
    """
    sent = documents.sparkSession.sparkContext.broadcast(tuple((k, tuple(v)) for k, v in content.items()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        answers = _classifier(sent.value)(batch.column(1).to_pylist())
        made = [pa.array([a[i] for a in answers], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *made], names=[key, "lang_pred", "score", "rejected"])

    kind = documents.schema[key].dataType.simpleString()
    return map_runs(documents.select(key, text), text, f"`{key}` {kind}, lang_pred string, score double, rejected boolean", work)


def language_id(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 4, part: int = 2) -> DataFrame:
    """``key, held_out, lang_pred, score, rejected``: learn from the rows not held out, then predict every row."""
    labelled = documents.where(~held_out(key, parts, part) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    sample = training_sample(labelled, lang, text)
    texts = {r[0]: r[1] for r in labelled.groupBy(lang).count().where(F.col(lang).isin(list(sample))).collect()}
    content = dictionaries({name: sample[name] for name in sorted(sample, key=lambda name: (-texts[name], name))})
    return identify(documents, content, key, text).select(key, held_out(key, parts, part).alias("held_out"), "lang_pred", "score", "rejected")
