"""The stages of the pipeline, each held against what it has to do."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from oakmill.llm import bpe, near_dedup, packing, substring_dedup, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder, out = tmp_path_factory.mktemp("stages"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_toxic_documents_go(spark, sf, stages):
    model = toxicity.train(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    score = dict(zip(rows(stages[0]), model.score(toxicity.Reader(model.terms), [t or "" for t in rows(stages[0]).values()])))
    assert set(rows(stages[1])) == {d for d, s in score.items() if s < toxicity.THRESHOLD}


def test_one_row_for_each_text(stages):
    best: dict = {}
    for d, t in rows(stages[1]).items():
        best[t] = max(d, best.get(t, d))
    assert set(rows(stages[2])) == set(best.values())


def test_one_row_for_each_class(stages):
    from tests.llm.test_texts import near_by_force

    assert set(rows(stages[3])) == {c for _, c in near_by_force(sorted(rows(stages[2]).items()))}


def test_repeated_passages_go(stages):
    from tests.llm.test_texts import spans_by_force

    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    cuts: dict = {}
    for d, a, b, *_ in spans_by_force(sorted(before.items()), substring_dedup.MIN_WORDS):
        cuts.setdefault(d, []).append((a, b))
    for d, text in before.items():
        for a, b in sorted(cuts.get(d, []), reverse=True):
            text = text[:a] + text[b:]
        assert after[d] == text


def test_packing_has_every_document(stages):
    packed = stages[5].toPandas()
    assert set(packed.doc_id) == set(rows(stages[4]))
    ordered = packed.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum()
    assert (ends - ordered.length == ordered.offset).all() and ends.max() <= 2048


def test_run_is_the_stages(spark, sf, stages):
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect()} == {tuple(r)[:5] for r in stages[5].collect()}


def test_pipeline_of_awkward_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "kind words", "en", "s", 10, "x"), (4, "kind words", "en", "s", 10, "x")], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns[-1] == "kept"
    assert rows(docs) == {2: "", 4: "kind words"}
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, sf) if nothing.columns[:2] == ["doc_id", "text"] else nothing
    assert nothing.count() == 0


def test_a_repeated_row_keeps_its_text_once(spark, sf):
    long = " ".join(f"word{k}" for k in range(60)) + "."
    own = " ".join(f"own{k}" for k in range(60)) + "."
    docs = spark.createDataFrame([(1, long), (1, long), (2, f"{own} {long}"), (3, None), (3, ""), (None, "no id"), (None, "no id")], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, sf)
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    assert got == [(0, "no id"), (1, long), (2, own), (3, "")]


def test_packing_in_the_pipeline_takes_little_memory_of_a_worker(spark, monkeypatch):
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    words = np.random.default_rng(5).integers(0, 26**5, (3000, 250))
    texts = [" ".join(np.base_repr(w, 36) for w in row) for row in words.tolist()]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    monkeypatch.setattr(packing, "packed", lambda parts, capacity: parts)
    whole, few = packing.public_pack(Docs()), corpus_pipeline.best_fit_packing(spark, Docs(), "")
    expected = pa.Table.from_batches(whole(iter([batch])))  # loads the vocabulary too
    tracemalloc.start()
    got = pa.Table.from_batches(few(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert got.combine_chunks().equals(expected.combine_chunks())
    assert peak < 100, peak


def test_groups_of_texts_are_bounded_and_whole():
    texts = ["a" * 5, "", "b" * 30, "é" * 4, "c", "", "d" * 9]
    groups = list(bpe.text_groups(pa.array(texts), 10))
    assert [t for _, _, own in groups for t in own] == texts
    assert all(texts[a:b] == own and (len(own) == 1 or len("".join(own).encode()) <= 10) for a, b, own in groups)
    assert [list(bpe.text_groups(pa.array(x, pa.string()), 10)) for x in ([], [""])] == [[], [(0, 1, [""])]]
