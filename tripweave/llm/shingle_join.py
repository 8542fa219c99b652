"""Jaccard join of shingle sets with skips that rest on relations between sets.

Equal sets are one class. Classes order their shingles by one global order, rare ones first, and only the prefix that any set of
enough overlap must share goes into index lists. Answers are derived from those of similar sets: a class is first compared with one class of its
lists (the head), and classes that are connected by then are not compared again. The lists are read in blocks of similar set size, and a block or
entry whose position leaves too few shingles behind it is skipped. In the blocks left, a set's overlap with all others comes from the lists of
the shingles that tell it from the set before it, and only links that join two components are written. All is exact, on the
texts themselves. The global order only steers cost: any order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import NONSPACE_BYTES, Words, free_name, map_runs, mix, runs, saved, signed
from tripweave.llm.components import components

SHINGLE = 5
PERCENT = 80  # two sets link if 100 * |common| >= PERCENT * |union|
ORDER_BITS = 22  # cells of the table of shingle counts: a fixed size, sent to every task
ORDER_PARTS = 64
SKETCH_BITS = 512  # of the bit set that bounds the overlap of two sets
NEEDED_BITS = 23
GROUP = 2000  # compared with one copy of a head's text
PART_SETS, PART_SHINGLES = 2000, 1_000_000  # of a part, two of which a task holds at a time; a larger set is a part of its own
SALTS = 16


class Sets:
    """Distinct shingle hashes of each text of a run, in one array by text."""

    def __init__(self, texts: pa.Array, size: int = SHINGLE) -> None:
        words = Words(texts, NONSPACE_BYTES)
        rows = len(texts)
        whole = words.whole(size)
        of = np.repeat(np.arange(rows), words.counts)[whole]
        hashes = words.shingles(size)[whole]
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        # A text of fewer words is one shingle: all its words.
        extra = [words.shingles(int(words.counts[i]))[words.first[i]] ^ np.uint64(words.counts[i]) for i in short.tolist()]
        of = np.concatenate([of, short])
        hashes = np.concatenate([hashes, np.array(extra, np.uint64)])
        order = np.lexsort((hashes, of))
        of, hashes = of[order], hashes[order]
        keep = np.concatenate([[True], (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])]) if len(of) else np.zeros(0, bool)
        self.of, self.hashes = of[keep], hashes[keep]
        self.counts = np.bincount(self.of, minlength=rows)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums that name a set whatever its order."""
        sums = []
        for salt in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hashes ^ np.uint64(salt)), dtype=np.uint64)])
            sums.append(signed(total[self.first[1:]] - total[self.first[:-1]]))
        return sums[0], sums[1]


def _order_table(documents: DataFrame, text: str) -> np.ndarray:
    """How many texts (equal ones of a task once) have a shingle of each cell, over all documents."""
    import zstandard

    cells, width = 1 << ORDER_BITS, (1 << ORDER_BITS) // ORDER_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros(cells, np.uint32), set()
        for batch in batches:
            for start, stop in runs(batch.column(0)):
                sets = Sets(batch.column(0).slice(start, stop - start))
                fresh = np.zeros(len(sets.counts), bool)
                for i, name in enumerate(zip(*(p.tolist() for p in sets.prints()))):
                    fresh[i] = name not in seen
                    if len(seen) < 1_000_000:  # memory only: a copy counted twice changes the order, not the links
                        seen.add(name)
                table += np.bincount((sets.hashes[fresh[sets.of]] & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint32)
        yield _parts(table)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = np.frombuffer(unpress.decompress(data), np.uint16).astype(np.uint32)
                sums[part] = sums[part] + one if part in sums else one
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([press.compress(np.minimum(total, 65535).astype(np.uint16).tobytes())])], names=["part", "counts"])

    def _parts(table: np.ndarray) -> pa.RecordBatch:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        small = np.minimum(table, 65535).astype(np.uint16)
        return pa.RecordBatch.from_arrays(
            [pa.array(range(ORDER_PARTS), pa.int32()), pa.array([press.compress(small[i * width : (i + 1) * width].tobytes()) for i in range(ORDER_PARTS)])], names=["part", "counts"]
        )

    kind = "part int, counts binary"
    counted = documents.select(text).mapInArrow(count, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    once = counted.repartition("part", "salt").select("part", "counts").mapInArrow(add, kind)
    whole = np.zeros(cells, np.uint16)
    for part, data in once.repartition("part").mapInArrow(add, kind).collect():  # ORDER_PARTS rows, 2 bytes a cell
        whole[part * width : (part + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint16)
    return whole


def _described(documents: DataFrame, key: str, text: str, table) -> DataFrame:
    """Per row: set size, its two prints, a name of the row, the prefix in global order and the bit set; the last two once a task and set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for start, stop in runs(batch.column(1)):
                part = batch.slice(start, stop - start)
                yield describe(part, seen)

    def describe(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
        sets = Sets(batch.column(1))
        one, two = sets.prints()
        rank = table.value[(sets.hashes & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)]
        order = np.lexsort((sets.hashes, rank, sets.of))
        hashes, n = signed(sets.hashes[order]), sets.counts
        # |common| of sets that link is PERCENT/100 of the larger set at least, so the prefix leaves out one less than that.
        least = -(-PERCENT * n // 100)
        prefix = np.where(n > 0, n - least + 1, 0)
        keys, sketches = [], []
        for i, name in enumerate(zip(one.tolist(), two.tolist())):
            if n[i] == 0 or name in seen:
                keys.append(None)
                sketches.append(None)
                continue
            if len(seen) < 1_000_000:
                seen.add(name)
            a = sets.first[i]
            keys.append(hashes[a : a + prefix[i]])
            bits = np.bincount((sets.hashes[a : a + n[i]] >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
            sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n.astype(np.int64)), pa.array(one), pa.array(two), batch.column(2), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
            names=["key", "n", "one", "two", "row", "keys", "bits"],
        )

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(key, text).alias("row"))
    return rows.mapInArrow(work, f"key {kind}, n long, one long, two long, row long, keys array<long>, bits array<long>")


def _enough(common: Column, one: Column, two: Column) -> Column:
    return 100 * common >= PERCENT * (one + two - common)


def _allowed() -> Column:
    """What sizes and bit sets of ``n_a, bits_a, n_b, bits_b`` allow: a differing bit is a shingle that only one of both has."""
    words = [F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(SKETCH_BITS // 64)]
    differing = sum(words[1:], words[0])
    most = F.least("n_a", "n_b", F.floor((F.col("n_a") + F.col("n_b") - differing) / 2))
    return _enough(most, F.col("n_a"), F.col("n_b"))


def _could_link(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that sizes and bit sets allow."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_allowed()).select("a", "b")


def _texts(documents: DataFrame, key: str, text: str, needed: DataFrame) -> DataFrame:
    """``node, data``: the compressed text of each needed class; ``needed`` is ``node, row``."""
    spark = documents.sparkSession
    cells = needed.select(F.col("row").bitwiseAND((1 << NEEDED_BITS) - 1).alias("cell")).distinct()
    found = np.zeros(1 << NEEDED_BITS, bool)
    for batch in cells.toArrow().to_batches():  # at most 2 ** NEEDED_BITS cells
        found[np.asarray(batch.column(0))] = True
    marks = spark.sparkContext.broadcast(np.packbits(found, bitorder="little"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        cell = np.asarray(batch.column(0)).view(np.uint64) & np.uint64((1 << NEEDED_BITS) - 1)
        on = np.flatnonzero((marks.value[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1)
        press = zstandard.ZstdCompressor(level=3)
        data = [press.compress((batch.column(1)[i].as_py() or "").encode()) for i in on.tolist()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(on)), pa.array(data, pa.binary())], names=["row", "data"])

    rows = map_runs(documents.select(F.xxhash64(key, text).alias("row"), F.col(text).alias("text")), "text", "row long, data binary", work)
    return rows.join(needed, "row").groupBy("node").agg(F.first("data").alias("data"))


def _verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """``a, b, common, n_a, n_b`` of each pair, counted on the texts; pairs of one ``b`` travel to it in groups."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    grouped = pairs.join(sizes, "b").withColumn("group", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int"))
    grouped = saved(grouped.select("b", "group", "a"))
    heads = grouped.select("b", "group").distinct().select("b", "group", F.col("b").alias("node"), F.lit(0).alias("place"))
    asked = grouped.select("b", "group", F.col("a").alias("node"), F.lit(1).alias("place")).unionByName(heads)
    needed = asked.select("node").distinct().join(classes.select("node", "row"), "node")
    dealt = asked.join(_texts(documents, key, text, saved(needed)), "node").repartition("b", "group").sortWithinPartitions("b", "group", "place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        head, head_set, found = None, None, []
        for batch in batches:
            for node, b, place, data in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = Sets(pa.array([unpress.decompress(data).decode()])).hashes
                if place == 0:
                    head, head_set = b, hashes
                else:
                    both = np.concatenate([head_set, hashes])
                    both.sort()
                    found.append((node, head, int((both[1:] == both[:-1]).sum()), len(hashes), len(head_set)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b", "common", "n_a", "n_b"])
                found = []

    return saved(dealt.select("node", "b", "place", "data").mapInArrow(compare, "a long, b long, common long, n_a long, n_b long"))


def _links(answers: DataFrame) -> DataFrame:
    return answers.where(_enough(F.col("common"), F.col("n_a"), F.col("n_b"))).select("a", "b")


class Answers:
    """Links among the sets of one block pair, as far as they join two components.

    The answer of a set, its overlap with every set of the other side, is derived from the answer before it: shingles that only
    one of the two sets has are looked up in the lists, those of both are not. Sets are taken in an order that puts similar ones next to each other.
    """

    def __init__(self, texts: pa.Array, labels: np.ndarray) -> None:
        sets = Sets(texts)
        self.sizes, self.first, self.of = sets.counts, sets.first, sets.of
        self.shingles = np.unique(sets.hashes, return_inverse=True)[1]
        self.labels = np.unique(labels, return_inverse=True)[1]
        self.looked_up = 0  # list entries read

    def _lists(self, rights: np.ndarray) -> None:
        place = np.full(len(self.sizes), -1)
        place[rights] = np.arange(len(rights))
        inside = place[self.of] >= 0
        shingles = self.shingles[inside]
        order = np.argsort(shingles, kind="stable")
        self.entries = place[self.of[inside]][order]
        self.starts = np.searchsorted(shingles[order], np.arange(int(self.shingles.max(initial=-1)) + 2))
        self.width = len(rights)

    def _read(self, shingles: np.ndarray) -> np.ndarray:
        """How many of ``shingles`` each set of the lists has."""
        start, length = self.starts[shingles], self.starts[shingles + 1] - self.starts[shingles]
        ends = np.cumsum(length)
        at = np.repeat(start - ends + length, length) + np.arange(int(length.sum()))
        self.looked_up += len(at)
        return np.bincount(self.entries[at], minlength=self.width)

    def joining(self, lefts: np.ndarray, rights: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links between ``lefts`` and ``rights`` that join two components, by place."""
        if not len(lefts) or not len(rights):
            return
        self._lists(rights)
        least = np.array([self.shingles[self.first[i] : self.first[i + 1]].min(initial=0) for i in lefts.tolist()])
        before, row = np.zeros(0, np.int64), np.zeros(self.width, np.int64)
        for left in lefts[np.lexsort((self.sizes[lefts], least))].tolist():
            if not (self.labels[rights] != self.labels[left]).any():
                continue
            own = np.sort(self.shingles[self.first[left] : self.first[left + 1]])
            gone, come = np.setdiff1d(before, own, assume_unique=True), np.setdiff1d(own, before, assume_unique=True)
            row = row - self._read(gone) + self._read(come) if len(gone) + len(come) < len(own) else self._read(own)
            before = own
            common = 100 * row >= PERCENT * (self.sizes[left] + self.sizes[rights] - row)
            linked = rights[common & (self.labels[rights] != self.labels[left])]
            for right in linked[np.unique(self.labels[linked], return_index=True)[1]].tolist():
                self.labels[self.labels == self.labels[right]] = self.labels[left]
                yield left, right


def _block_links(nodes: np.ndarray, labels: np.ndarray, sides: np.ndarray, texts: pa.Array) -> list[tuple[int, int]]:
    """Joining links of a block pair; sets of the component with most of them are not compared with each other."""
    answers = Answers(texts, labels)
    main = answers.labels == np.bincount(answers.labels).argmax()
    one, two = sides == 0, sides == 1
    if two.any():
        turns = [(one & ~main, two), (two & ~main, one & main)]
    else:
        turns = [(~main, one)]
    found = []
    for lefts, rights in turns:
        for left, right in answers.joining(np.flatnonzero(lefts), np.flatnonzero(rights)):
            a, b = int(nodes[left]), int(nodes[right])
            found.append((max(a, b), min(a, b)))
    return found


def _blocks(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """``head, size, node, n, component``: which classes are to be compared with each other; ``lists`` is ``hash, head, node, n, at``.

    Lists are read in blocks: linked sizes differ by 100 / PERCENT at most, so they are in one block of sizes or the next. A class is left out
    of a block for whose sizes its position in the list leaves too few shingles, a block goes if no position in it leaves enough for its
    smallest set or if its classes are connected. Blocks of lists with one head are put together, so that a class comes once.
    """
    entries = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ratio = 100 / PERCENT
    size = F.floor(F.log("n") / F.log(F.lit(ratio)) + F.lit(1e-9)).cast("int")
    # The largest set that can still link, if this is the first shingle both have.
    most = F.floor((F.col("n") - F.col("at") + 1) * (100 + PERCENT) / PERCENT) - F.col("n")
    # A block holds the sets of its size, to be compared among themselves, and those of the next.
    placed = entries.select("hash", "head", "node", "n", "component", most.alias("most"), F.explode(F.array(size, size - 1)).alias("size"))
    placed = saved(placed.where(F.col("most") + 1 >= F.pow(F.lit(ratio), F.col("size"))))
    spread = placed.groupBy("hash", "size").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("most").alias("reach"), F.min("n").alias("least"))
    open_ = spread.where("x <> y and reach >= least").select("hash", "size")
    return saved(placed.join(open_, ["hash", "size"]).groupBy("head", "size", "node").agg(F.first("n").alias("n"), F.first("component").alias("component")))


def _dealt(blocks: DataFrame) -> DataFrame:
    """``blocks`` by pairs of parts ``one <= two`` of bounded size; ``side`` 1 are the classes of ``two``."""
    sums = blocks.groupBy("head", "size").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    parts = sums.select("head", "size", F.greatest(F.ceil(F.col("m") / PART_SETS), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int").alias("parts"))
    parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = blocks.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    own = salted.join(parts, ["head", "size", "salt"]).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one, two = F.least("part", "other"), F.greatest("part", "other")
    return own.select("head", "size", one.alias("one"), two.alias("two"), (F.col("part") > one).cast("int").alias("side"), "node", "component")


def _list_links(lists: DataFrame, labels: DataFrame, classes: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """Links ``a, b`` that, with those behind ``labels``, connect whatever links connect."""
    blocks = _blocks(lists, labels)
    needed = saved(blocks.select("node").distinct().join(classes.select("node", "row"), "node"))
    names = ["head", "size", "one", "two"]
    dealt = _dealt(blocks).join(_texts(documents, key, text, needed), "node").repartition(*names).sortWithinPartitions(*names, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()

        def links(rows: list[tuple]) -> pa.RecordBatch:
            nodes, labels, sides, data = zip(*rows)
            texts = pa.array([unpress.decompress(d).decode() for d in data], pa.large_string())
            found = _block_links(np.array(nodes), np.array(labels), np.array(sides), texts)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        place, rows = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for here, row in zip(zip(*columns[:4]), zip(*columns[4:])):
                if here != place:
                    if len(rows) > 1:
                        yield links(rows)
                    place, rows = here, []
                rows.append(row)
        if len(rows) > 1:
            yield links(rows)

    return saved(dealt.select(*names, "node", "component", "side", "data").mapInArrow(compare, "a long, b long"))


def _with_components(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, row, n, node, component_id`` of every row; ``node`` names its component, null without words."""
    spark = documents.sparkSession
    order = spark.sparkContext.broadcast(_order_table(documents, text))
    rows = saved(_described(documents, key, text, order))
    classes = (
        rows.where("n > 0").groupBy("one", "two")
        .agg(F.min("key").alias("key"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys", True).alias("keys"), F.first("bits", True).alias("bits"))
    )
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()))  # what is written is what counts
    entries = classes.select("node", "n", F.posexplode("keys").alias("at", "hash")).withColumn("at", F.col("at") + 1)
    heads = entries.groupBy("hash").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    lists = saved(entries.join(heads, "hash"))

    # First each class with one head only, then what is not connected by that in the blocks of its lists.
    with_head = _could_link(lists.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), classes)
    links = saved(_links(_verified(saved(with_head.groupBy("a").agg(F.min("b").alias("b"))), classes, documents, key, text)))
    more = _list_links(lists, components(links), classes, documents, key, text)
    labels = components(links.unionByName(more))

    named = classes.join(labels, "node", "left").select("one", "two", "key", F.coalesce("component", "node").alias("node"))
    smallest = named.groupBy("node").agg(F.min("key").alias("component_id"))
    by_set = named.drop("key").join(smallest, "node")
    words = rows.select("key", "row", "n", F.when(F.col("n") > 0, F.col("one")).alias("one"), "two")
    return words.join(by_set, ["one", "two"], "left").select("key", "row", "n", "node", F.coalesce("component_id", "key").alias("component_id"))


def jaccard_components(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``documents``; ids are integers.

    A text's set is its distinct shingles of ``SHINGLE`` words, lower-cased in A-Z; with fewer words all of them are the one shingle. Null
    texts and texts without words have the empty set, link with nothing and are their own component. Every row stays, repeated
    ones too. ``component_id`` is the smallest id connected by links; rows without an id take part, but are
    named only if no other row is connected. Other columns are not read.
    """
    found = _with_components(documents, key, text)
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each component: that of the smallest id (of equal ids, one of them).

    Rows without words are in no component and all stay.
    """
    found = saved(_with_components(documents, key, text))
    name = free_name(documents, "_row")
    kept = found.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("first")).select(F.col("first.row").alias(name))
    named = documents.withColumn(name, F.xxhash64(key, text))
    empty = ~F.coalesce(F.regexp_like(F.col(text), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    one = named.where(~empty).join(kept, name, "left_semi").dropDuplicates([name])
    return one.unionByName(named.where(empty)).select(*documents.columns)
