from pyspark.sql import functions as F

from packsieve.operators import prompts


def test_prompts_are_rebuilt_byte_for_byte(spark):
    items = spark.createDataFrame([("a", 'say "hi"\n'), ("b", "plain")], "item_id string, intent string")
    fields = spark.createDataFrame([("a", 2, "tcp.port"), ("a", 1, "ip.src")], "item_id string, rank int, name string")
    context = prompts.listed(fields, "item_id", "rank", ["name"], "context")
    made = prompts.assembled(items, "Answer.", context=context)
    got = {r.item_id: r.prompt for r in made.collect()}
    assert got == {"a": 'Answer.\n{"context":[{"name":"ip.src"},{"name":"tcp.port"}]}\n{"request":"say \\"hi\\"\\n"}', "b": 'Answer.\n{"context":[]}\n{"request":"plain"}'}
    assert prompts.not_rebuilt(made, prompts.assembled(items, "Answer.", context=context)).count() == 0
    assert [r.item_id for r in prompts.not_rebuilt(made.where("item_id = 'a'"), made).collect()] == ["b"]
    assert prompts.not_as_shown(made, context).count() == 0
    assert [r.item_id for r in prompts.not_as_shown(made, context.withColumn("context", F.lit("[1]"))).orderBy("item_id").collect()] == ["a"]
    row = made.select(prompts.follow_up(F.lit("P"), F.lit("x"), F.lit("[1]")).alias("p"), prompts.follow_up(F.lit("P"), F.lit("x"), F.lit(None).cast("string")).alias("q")).first()
    assert (row.p, row.q) == ('P\n{"answer":"x"}\n{"card":[1]}', 'P\n{"answer":"x"}')


def test_receipts_are_listed(spark):
    rows = spark.createDataFrame([("r", "C1", "i", [([], [1], False), ([2, 3], [], False), ([], [], True)])], "run_id string, condition string, item_id string, probes array<struct<reference_only: array<int>, candidate_only: array<int>, exact: boolean>>")
    assert tuple(prompts.receipts(rows).first())[3:] == (3, 1, 2, 1)
