from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from furrow.llm import queries, toxicity
from furrow.session import materialise

from . import test_linededup, test_pii, test_shinglegroups

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents and what each stage returns."""
    docs = queries.table(spark, SF_DIR, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF_DIR)))
    return out


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for df in stages[1:5]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_toxicity(spark, stages):
    lexicon = toxicity.learn(stages[0], queries.table(spark, SF_DIR, "labels"))
    rejected = {r["doc_id"] for r in toxicity.toxicity(stages[0], lexicon).filter("score >= 0.7").collect()}
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in stages[:2])
    assert after == {d: t for d, t in before.items() if d not in rejected}


def test_lines(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = {d: t for d, _, _, t in test_linededup.plain(rows)}
    assert {r["doc_id"]: r["text"] for r in stages[2].collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_duplicates(stages):
    before, after = ([(r["doc_id"], r["text"]) for r in df.collect()] for df in stages[2:4])
    assert test_shinglegroups.check(before, after, 0.9) > 0 and set(after) < set(before)


def test_odd_rows_pass_all_stages(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns as a chain; and a table without rows."""
    queries.table(spark, SF_DIR, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    for given in (odd, none):
        docs = given
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = materialise(stage(spark, docs, str(tmp_path)))
            if number < 4:
                assert docs.columns == given.columns
        rows = docs.collect()
        assert bool(rows) == (given is odd) and all(len(r["ids"]) == 4 * r["length"] for r in rows)


def test_privacy(stages):
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in stages[3:5])
    assert before.keys() == after.keys()
    assert any(test_pii.plain(t) for t in before.values()) and not any(test_pii.plain(t) for t in after.values())
    changed = [d for d in before if before[d] != after[d]]
    assert all("[" in after[d] for d in changed)
    assert all(d in changed for d, t in before.items() if test_pii.plain(t))


def test_packing(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    rows = stages[5].collect()
    found = {}
    for r in rows:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == tokens


def test_the_last_stage_holds_the_ids(stages):
    assert all(len(r["ids"]) == 4 * r["length"] for r in stages[5].collect())


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(tuple, stages[5].collect()))
