"""The stages in a row, on the smallest table: each one's decision takes effect on what the one before kept."""

import re
from collections import Counter

import corpus_pipeline
from packsieve.llm import exact_dedup, language_id, mixing, packing, simhash

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r.doc_id for r in language_id.identify(docs).where("lang_pred <> 'und'").collect()}
    seen = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    assert all(s.columns == docs.columns for s in seen[:-1])
    assert {r.doc_id for r in seen[1].collect()} == told
    assert {r.doc_id for r in seen[2].collect()} == {r.doc_id for r in exact_dedup.find(seen[1]).where("kept").collect()}
    assert {r.doc_id for r in seen[3].collect()} == {r.component_id for r in simhash.cluster(seen[2]).collect()}
    taken = {r.doc_id: r.taken for r in mixing.report(seen[3]).collect() if r.taken}
    words = Counter()
    for r in seen[4].collect():
        words[r.doc_id] += len(re.findall(mixing.WORD, r.text))
    assert words == taken
    total = sum(r.n for r in packing.pack(seen[4]).selectExpr("sum(length) n").collect())
    assert sum(r.n for r in seen[5].selectExpr("sum(length) n").collect()) == total > 0


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:3] == ["doc_id", "start", "length"] and rows.count() > 0


def test_odd_rows_pass_through_all_stages(spark):
    """Nulls, repeats, long texts and clashing names: each stage's rule holds row by row."""
    said = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200").orderBy("doc_id").limit(30).collect()}
    rows = [(i, r.text, r.lang, r.source, r.n_chars, i, "mine") for i, r in said.items()]
    first = rows[0]
    rows += [first, (None, first[1], "en", None, 5, 0, "mine"), (None, None, None, None, None, None, None), (9001, None, "en", "s", 0, 1, "x"), (9002, "", "en", "s", 0, 1, "x"), (9003, " 12 -- 3 ", "en", "s", 0, 1, "x")]
    rows += [(9004, " ".join(r[1] for r in rows[:30]) * 20, "en", None, 1, 2, "long"), (9005, first[1].replace(" ", "\n"), None, "s", 1, 3, "copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int, _doc string")
    seen = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    assert all(s.columns == docs.columns for s in seen[:-1])
    letters = Counter((r.doc_id, r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    assert Counter((r.doc_id, r.text) for r in seen[1].collect()) == letters
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    kept = seen[2].collect()
    assert Counter(normal(r.text) for r in kept) == Counter({normal(t) for _, t in letters})
    assert {r.doc_id for r in kept}.isdisjoint({None, 9005}) and all(r._doc in ("mine", "long") for r in kept)
    assert {r.doc_id for r in seen[3].collect()} <= {r.doc_id for r in kept}
    assert sum(r.n for r in seen[5].selectExpr("sum(length) n").collect()) > 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
        assert nothing.count() == 0
