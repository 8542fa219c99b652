"""Phrases, robust rules and ranked search against brute force, with awkward rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import plain
from tripweave.llm import collocations as phrases
from tripweave.llm import ranked_search as search
from tripweave.llm import robust_rules as rules

DOCS = "doc_id long, text string, lang string, source string"


def prose(rng: random.Random, n: int, words: int = 12) -> str:
    return "".join(rng.choice(["Ab", "cé", "d-e", "fg", "hi", "x1", "of", "the"][:words]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(n))


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clashing(df, *names):
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit("taken") for name in names})


# Phrases


def phrase_docs() -> list[tuple]:
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.choice([0, 1, 3, 40, 200])), rng.choice(["en", "es", None, "und"]), None) for i in range(60)]
    docs += [(60, None, "en", None), (60, "", None, None), (None, "en es en es.en es", "en", None), (61, "es en es en es", "es", None)]
    return docs + docs[:7] + [(99, " ".join(["longer"] * 3000 + ["text"] * 500), "de", None)]


@pytest.mark.parametrize("dictionary_rows", [1 << 21, 3, 0])
def test_phrases(spark, dictionary_rows):
    docs = phrase_docs()
    df = clashing(spark.createDataFrame(docs, DOCS).repartition(5), "n", "word", "words", "w1", "score", "number", "rank")
    got = phrases.collocations(df, least=4, dictionary_rows=dictionary_rows)
    assert rows_of(got) == sorted(plain.phrase_rows([(t, g) for _, t, g, _ in docs], 4), key=repr)


def test_phrases_top_and_share(spark):
    docs = phrase_docs()
    got = phrases.collocations(spark.createDataFrame(docs, DOCS), least=3, top=5, share=70)
    assert rows_of(got) == sorted(plain.phrase_rows([(t, g) for _, t, g, _ in docs], 3, 5, 70), key=repr)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None), (2, "", "en", None)], DOCS)).collect() == []


def test_score_beyond_64_bits(spark):
    big = 10**15
    rows = [("en", ["a"], 3 * big), ("en", ["b"], 2 * big), ("en", ["a", "b"], big)]
    one = phrases.scored(spark.createDataFrame(rows, "lang string, words array<string>, a long"), spark.createDataFrame([("en", 10**17)], "lang string, n long")).first()
    assert one["score"] == 1000 * big * 10**17 // (6 * big * big)


def test_rows_that_share_a_hash_are_counted_apart(monkeypatch):
    monkeypatch.setattr(phrases, "mix", lambda x: x & np.uint64(1))
    rows = np.array([[1, 2], [3, 4], [1, 2], [5, 6]])
    distinct, counts = phrases.count_rows(rows)
    assert {tuple(r): c for r, c in zip(distinct.tolist(), counts.tolist())} == {(1, 2): 2, (3, 4): 1, (5, 6): 1}


# Robust rules


def test_text_statistics(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([0, 1, 2, 3, 5, 80])) for _ in range(60)]
    texts += [None, "", " \n\t", "a b c a b c a", "x x x x x x", "#* $%\n#* $%\n\n \n#* $%", "é ü b", "a\u0000b |<>&", "a b c " * 4000, " lead\x0b\x0ctrail "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["s"] for r in df.select("i", rules.text_statistics(df["text"]).alias("s")).collect()}
    for i, text in enumerate(texts):
        words, lines = got[i]["words"], got[i]["lines"]
        mine = (words["n_words"], words["word_chars"], words["n_symbols"], lines["n_dup_lines"], words["n_repeat_words"], lines["n_lines"])
        assert mine == plain.statistics(text), text


def ordinary(rng: random.Random) -> str:
    return ". ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 9))) for _ in range(rng.randint(12, 25)))


def rule_docs() -> list[tuple]:
    rng = random.Random(8)
    docs = [(i, ordinary(rng), "en", "big" if i % 3 else f"small{i % 9}") for i in range(400)]
    odd = [(1000 + i, ordinary(rng).replace(" ", "### "), "en", "big") for i in range(40)]
    return docs + odd + [(2000 + i, ordinary(rng), "fr" if i % 2 else None, None) for i in range(12)]


def test_outliers_go_and_the_bulk_stays(spark):
    docs = rule_docs() + [(3000, None, None, None), (3001, "", "en", "big"), (None, "a b", "en", None)]
    df = clashing(spark.createDataFrame(docs, DOCS), "d", "a0", "y0", "half", "start", "kept", "lang_group", "n_words", "t")
    got = rules.robust_rules(df)
    assert got.columns == ["doc_id", *rules.COUNTS, "base_failed", "kept", "distance"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(docs)
    assert sum(not rows[i]["kept"] for i in range(400)) <= 2
    assert not any(rows[1000 + i]["kept"] for i in range(40))
    assert all(rows[2000 + i]["kept"] and rows[2000 + i]["distance"] is None for i in range(12))  # too few for an estimate
    assert all(rows[i]["base_failed"] and not rows[i]["kept"] for i in (3000, 3001, None))


def test_verdicts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(rule_docs(), DOCS)
    assert rows_of(rules.robust_rules(df.repartition(1))) == rows_of(rules.robust_rules(df.repartition(7)))


def test_repeated_rows_all_count(spark):
    docs = rule_docs()
    one = {r["doc_id"]: r["kept"] for r in rules.robust_rules(spark.createDataFrame(docs, DOCS)).collect()}
    two = rules.robust_rules(spark.createDataFrame(docs + docs, DOCS)).collect()
    assert len(two) == 2 * len(docs)
    assert sum(r["kept"] != one[r["doc_id"]] for r in two if r["doc_id"] < 2000) <= 8  # small sources may get estimates of their own


def test_concentration_steps_shrink_the_determinant(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(5000, 300, (300, rules.SIZE)), rng.normal(9000, 300, (100, rules.SIZE))]).astype(int)
    rows = spark.createDataFrame([("l", "s", *map(int, v)) for v in values], "lang_group string, source_group string, " + ", ".join(f"a{j} long" for j in range(rules.SIZE)))
    root = F.expr(" * ".join(f"l{j}{j}" for j in range(rules.SIZE)))
    whole = rules.starts_of(rows).where("start = 's'").select(root).first()[0]
    final = rules.robust_estimates(rows, 1)
    assert final.select(root).first()[0] < whole / 5
    centre = final.select(*[f"m{j}" for j in range(rules.SIZE)]).first()
    assert np.abs(np.array(centre) - 5000).max() < 100 and final.first()["n_used"] <= 300


def test_rules_of_an_empty_table(spark):
    assert rules.robust_rules(spark.createDataFrame([], DOCS)).collect() == []


# Ranked search


def search_docs() -> tuple[list, list]:
    rng = random.Random(11)
    docs = [(i, prose(rng, rng.choice([0, 1, 4, 30, 90]), rng.randint(2, 8))) for i in range(90)]
    docs += docs[:10] + [(200 - i, "same words here") for i in range(30)] + [(None, "same words here"), (300, None), (301, ""), (302, "!?"), (303, "words " * 20000)]
    items = [(i, prose(rng, 8)) for i in range(15)] + [(50, "same words"), (51, None), (52, ""), (53, "nowhere"), (50, "here here words"), (None, "of the")]
    return docs, items


@pytest.mark.parametrize("block_bytes,query_bytes,top", [(1, 1 << 20, 20), (200, 64, 3), (1 << 20, 1 << 20, 20)])
def test_ranked_search(spark, block_bytes, query_bytes, top):
    docs, items = search_docs()
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "ids", "score", "id", "item", "rank")
    asked = clashing(spark.createDataFrame(items, "item_id int, text string"), "item", "block", "score", "doc_id")
    got = search.ranked_search(df, asked, top=top, block_bytes=block_bytes, query_bytes=query_bytes)
    assert rows_of(got) == sorted(plain.search(docs, items, top), key=repr)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q", "b"), (None, None)], "item_id string, text string")
    assert rows_of(search.ranked_search(docs, items)) == sorted(plain.search([(1, "a b"), (2, None)], [("q", "b")]), key=repr)
    assert search.ranked_search(docs.limit(0), items).collect() == []
    assert search.ranked_search(docs, items.limit(0)).collect() == []
    assert search.ranked_search(docs.where("text IS NULL"), items).collect() == []


def test_treap_holds_every_cell():
    rng = np.random.default_rng(1)
    for rows, columns, n in ((1, 1, 1), (5, 3, 9), (300, 70, 2000)):
        cells = np.unique(rng.integers(0, rows * columns, n))
        row, column = cells // columns, cells % columns
        values = rng.integers(1, 1000, len(cells))
        height = max(1, int(max(rows, columns) - 1).bit_length())
        built = search.Treap.build(row, column, values, height)
        treap = search.Treap.unpacked(*built.packed(), height)
        assert (treap.peaks == built.peaks).all() and treap.peaks[0] == values.max()
        best = search.Best(rows, columns)
        queries = search.Queries(pa.array([f"t{i}" for i in range(rows)]), np.arange(rows))
        queries.weights[:] = 1
        names = queries.terms.copy()
        # The term of query i is row i of the grid.
        order = queries.term[np.argsort(queries.of)]
        place = np.empty(rows, np.int64)
        place[order] = np.arange(rows)
        treap = search.Treap.build(order[row], column, values, height)
        search.search_block(treap, np.arange(columns), names, queries, best)
        assert sorted(zip(best.query.tolist(), best.id.tolist(), best.score.tolist())) == sorted(zip(row.tolist(), column.tolist(), values.tolist()))


def test_frequent_pairs_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PAIRS_HELD", 4)
    rng = random.Random(4)
    texts = [prose(rng, 60) for _ in range(30)]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(3)
    words = sorted({w for t in texts for w in plain.IN_PIECE.findall(plain.lower(plain.PIECE_END.sub(" ", t)))})
    frequent = spark.createDataFrame([("en", w, 1) for w in words], "lang string, word string, n long")
    dictionary = spark.sparkContext.broadcast(phrases._dictionary(frequent, 1 << 20))
    cells = {r["cell"] for r in phrases.frequent_cells(df, dictionary, 9).collect()}
    number = {r["word"]: r["number"] for r in phrases._numbered(frequent, dictionary).collect()}
    counts: dict[tuple, int] = {}
    for t in texts:
        for piece in plain.PIECE_END.split(plain.lower(t)):
            found = plain.IN_PIECE.findall(piece)
            for pair in zip(found, found[1:]):
                counts[pair] = counts.get(pair, 0) + 1
    cell = lambda a, b: int(phrases.Pairs.cells(np.array([number[a]]), np.array([number[b]]))[0])
    assert cells == {cell(*pair) for pair, n in counts.items() if n >= 9} and cells
