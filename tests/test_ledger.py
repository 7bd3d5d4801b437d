"""Executions taken up again: what holds is kept, the rest is run, and nothing else."""

from pyspark.sql import functions as F

from packsieve.operators import matching
from packsieve.operators.ledger import Ledger
from packsieve.operators.predicates import Field, Leaf

CATALOG = {"a": Field("a", "integer", "a")}
TREES = {"low": Leaf("a", "lt", 3), "high": Leaf("a", "ge", 3), "none": Leaf("a", "lt", 0)}


def test_only_missing_and_spoiled_batches_run_again(spark, tmp_path, monkeypatch):
    frames = spark.createDataFrame([(p, i, i) for p in "xyz" for i in range(6)], "probe_id string, frame long, a int")
    probes = frames.select("probe_id").distinct()
    book = Ledger(spark, f"file://{tmp_path}/book")
    assert book.valid().count() == 0 and book.matches().count() == 0
    ran = []
    monkeypatch.setattr(matching, "matches", lambda f, t, c, real=matching.matches: ran.append((sorted(t), sorted(r[0] for r in f.select("probe_id").distinct().collect()))) or real(f, t, c))
    half = spark.createDataFrame([("low", "x"), ("high", "x"), ("low", "y"), ("none", "y")], "candidate string, probe_id string")
    assert sorted(book.execute(frames, TREES, CATALOG, probes, half)) == [("high", "x"), ("low", "x"), ("low", "y"), ("none", "y")]
    # killed between the rows and their entries: rows that no entry names don't count
    matching.matches(frames, {"low": TREES["low"]}, CATALOG).where("probe_id = 'z'").select("candidate", "probe_id", "frame").write.parquet(f"file://{tmp_path}/book/rows/run=lost")
    book.spoil("low", "x")
    assert {(r.candidate, r.probe_id) for r in book.valid().collect()} == {("high", "x"), ("low", "y"), ("none", "y")}
    again = Ledger(spark, f"file://{tmp_path}/book").execute(frames, TREES, CATALOG, probes)
    assert sorted(again) == [("high", "y"), ("high", "z"), ("low", "x"), ("low", "z"), ("none", "x"), ("none", "z")]
    assert book.execute(frames, TREES, CATALOG, probes) == []
    got = sorted(map(tuple, book.matches().collect()))
    assert got == sorted((c, p, i) for c, keep in (("low", range(3)), ("high", range(3, 6))) for p in "xyz" for i in keep)
    # a row that changed or went spoils its batch too
    run = book.valid().where("candidate = 'high' and probe_id = 'z'").first().run
    kept = book.rows().where(F.col("run") == run).drop("run").where("not (candidate = 'high' and probe_id = 'z' and frame = 4)").collect()
    spark.createDataFrame(kept, "candidate string, probe_id string, frame long").write.mode("overwrite").parquet(f"file://{tmp_path}/book/rows/run={run}")
    assert book.execute(frames, TREES, CATALOG, probes) == [("high", "z")]
    assert sorted(map(tuple, book.matches().collect())) == got
