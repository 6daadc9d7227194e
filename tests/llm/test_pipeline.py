"""The pipeline's stages against brute force on their own inputs."""

import numpy as np
import pytest

import corpus_pipeline as p
from nodeloom.llm import bytebpe, decontam, langid, toxicity
from tests.conftest import SF
from tests.llm.test_text_ops import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out, folder = [spark.read.parquet(f"{SF}/documents.parquet")], tmp_path_factory.mktemp("steps")
    for name, stage in p.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"file://{folder}/{name}")
        out.append(spark.read.parquet(f"file://{folder}/{name}"))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_return_documents(steps):
    for df in steps[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_and_language_keep_clean_documents(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = ids(steps[0]) - ids(steps[1])
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(labels)
    model = toxicity.train(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in toxicity.score(steps[0], model).where("score >= 0.3").collect()} == gone
    judged = langid.identify(steps[1], langid.train(steps[1])).where("rejected")
    assert ids(steps[1]) - ids(steps[2]) == ids(judged) and len(ids(judged)) <= 0.01 * steps[1].count()


def test_dedup_keeps_one_of_each_group(steps):
    want = brute_components({i: brute_fingerprint(t) for i, t in texts(steps[2]).items()})
    assert ids(steps[3]) == set(want.values())


def test_decontamination(spark, steps):
    import re

    words = lambda t: np.array([hash(w) for w in re.findall(r"\w+", (t or "").lower())], dtype=int)
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, t in texts(steps[3]).items() if not any(decontam.best_match(q, words(t))[0] <= int(0.2 * len(q)) for q in items)}
    assert ids(steps[4]) == clean


def test_last_stage_and_run(spark, steps):
    v = bytebpe.vocabulary(None)
    assert {r.doc_id: r.n_tokens for r in steps[5].collect()} == {i: len(v.encode(t or "")) // 4 for i, t in texts(steps[4]).items()}
    assert sorted(p.run(spark, SF).collect()) == sorted(steps[5].collect())
    assert 4 <= len(p.STAGES) <= 5 and p.ORACLE_SQL is None


def odd_table(spark, schema):
    """Nulls, empty and very long texts, ties, repeated rows, one doc_id with two texts, and columns whose names clash."""
    rows = [(None, None, None, None, None), (1, "", None, None, None), (2, "the house", None, None, 3), (2, "the house", None, None, 3), (3, "the house", "en", "s", 9), (900001, "the house", None, None, 9)]
    rows += [(900001, "quite another text of its own stands here", None, None, 1), (900002, "lorem ipsum dolor sit amet " * 20_000, None, None, 1)]
    return spark.createDataFrame(rows, schema).selectExpr("*", "'mine' AS score", "7L AS rejected", "doc_id AS component_id", "'x' AS fp", "'y' AS lang_pred", "'z' AS _said", "1 AS n")


def test_odd_documents_have_defined_results(spark, steps):
    docs = odd_table(spark, steps[0].schema)
    more = steps[0].selectExpr("*", "'mine' AS score", "7L AS rejected", "doc_id AS component_id", "'x' AS fp", "'y' AS lang_pred", "'z' AS _said", "1 AS n").where("doc_id > 3").unionByName(docs)
    given = {(r.doc_id, r.text): r for r in more.collect()}
    now = more
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == more.columns, name
        kept = now.collect()
        assert kept and all(given[r.doc_id, r.text] == r for r in kept), name  # all columns as they came
    left = [(r.doc_id, r.text) for r in now.where("doc_id < 4 or doc_id > 900000 or doc_id is null").collect()]
    assert not [x for x in left if not x[1]]  # without a letter: no language
    assert [x[0] for x in left if x[1] == "the house"] in ([], [2, 2], [2, 2, 900001])
    assert {r.doc_id for r in p.STAGES[-1][1](spark, now, SF).collect()} == {r.doc_id for r in now.collect()}


def test_simhash_stage_keeps_a_key_with_a_first_text(spark, steps):
    docs = odd_table(spark, steps[0].schema)
    kept = sorted(((r.doc_id, r.text) for r in p.stage_simhash(spark, docs, SF).collect()), key=str)
    # 3 has the text of 2; 900001 has that text too, but its other text is a first one.
    assert [x[0] for x in kept] == [1, 2, 2, 900001, 900001, 900002, None]


def test_nothing_to_learn_keeps_all_documents(spark, steps, tmp_path):
    """No labels, no languages, no benchmark: the filtering stages drop nothing."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"file://{tmp_path}/{name}.parquet")
    docs, sf = steps[0], f"file://{tmp_path}"
    assert p.stage_toxicity(spark, docs, sf).count() == docs.count() == p.stage_decontamination(spark, docs, sf).count()
    assert p.stage_language(spark, docs.selectExpr("doc_id", "text", "string(null) AS lang", "source", "n_chars"), sf).count() == docs.count()


def test_empty_documents(spark, steps):
    now = steps[0].where("false")
    for _, stage in p.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0


def test_stages_say_what_odd_rows_give():
    assert all(len(stage.__doc__) > 100 for _, stage in p.STAGES)


def test_language_stage_drops_unlearned_languages(spark, steps):
    import tests.llm.test_text_ops as text_ops

    docs = steps[0].limit(150).unionByName(spark.createDataFrame([(800000 + i, t, None, None, 1) for i, t in enumerate(text_ops.UNLEARNED.values())], steps[0].schema))
    kept = ids(p.stage_language(spark, docs, SF))
    assert not [i for i in kept if i >= 800000] and len(kept) >= 148
