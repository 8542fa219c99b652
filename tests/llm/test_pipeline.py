"""Each stage of the pipeline on its predecessor's documents, against plain versions."""

import pyarrow as pa
import sentencepiece

import corpus_pipeline
from tests.llm import plain
from tripweave.llm import pieces
from tripweave.llm.common import table
from tripweave.llm.line_dedup import Chunks

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, tmp_path):
    docs = table(spark, SF_DIR, "documents")
    columns, seen = docs.columns, [rows(docs)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns[: len(columns)] == columns and (docs.columns == columns or i == 4)
        seen.append(rows(docs))
        assert set(seen[-1]) <= set(seen[-2])
    source, good, cut, single, clean, coded = seen

    labels = {r.doc_id: r.quality for r in table(spark, SF_DIR, "labels").collect()}
    right = [(i in good) == bool(q) for i, q in labels.items() if i in source]
    assert sum(right) >= 0.9 * len(right) and all(good[i] == source[i] for i in good)

    first = {}
    chunks = {i: [(c.text(k), int(c.lines[k])) for k in range(len(c.lines))] for i in sorted(good) for c in [Chunks(pa.array([good[i].text], pa.string()))]}
    for i, parts in chunks.items():
        for k, (text, n) in enumerate(parts):
            first.setdefault(text, (i, k))
    for i, parts in chunks.items():
        stay = [t for k, (t, n) in enumerate(parts) if n < 2 or first[t] == (i, k)]
        want = good[i].text if len(stay) == len(parts) else b"\n".join(stay).decode()
        assert (cut[i].text == want if i in cut else not want.strip()), i
    assert all(cut[i].n_chars == len(cut[i].text) for i in cut if cut[i].text != good[i].text)

    groups = {i: c for i, n, c in plain.jaccard([(i, r.text) for i, r in sorted(cut.items())])}
    assert set(single) == {i for i, c in groups.items() if i == c}
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    ids = sorted(single)
    dirty = {i for i, r in zip(ids, plain.contamination([single[i].text for i in ids], items)) if r[-1]}
    assert set(clean) == set(ids) - dirty
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert set(coded) == set(clean) and all(r.token_ids == own.encode(r.text) and r.round_trip for r in coded.values())


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0 and corpus_pipeline.ORACLE_SQL is None
