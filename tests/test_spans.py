import random

from pyspark.sql import functions as F

from palimpsest.operators import scan, spans

KIND = "id int, s array<struct<begin:int,end:int,category:string,priority:int,value:string>>"


def _random(n, seed):
    rng = random.Random(seed)
    return [(i, [(a := rng.randint(0, 30), a + rng.randint(1, 9), rng.choice("abc"), rng.randint(1, 4), "") for _ in range(rng.randint(0, 9))]) for i in range(n)]


def test_resolve_equals_loop(spark):
    rows = _random(60, 1)
    got = {r["id"]: [tuple(x)[:4] for x in r["r"]] for r in spark.createDataFrame(rows, KIND).select("id", spans.resolve(F.col("s")).alias("r")).collect()}
    for i, s in rows:
        assert got[i] == scan.resolve([x[:4] for x in s]), s


def test_merge_equals_loop(spark):
    rows = _random(60, 2)
    got = {r["id"]: [tuple(x) for x in r["r"]] for r in spark.createDataFrame(rows, KIND).select("id", spans.merge(F.col("s")).alias("r")).collect()}
    for i, s in rows:
        assert got[i] == scan.merge([x[:2] for x in s])


def test_substitute(spark):
    df = spark.createDataFrame([("héllo wörld", [(6, 11, "[B]"), (0, 5, "[A]")]), ("plain", []), (None, [])], "text string, h array<struct<begin:int,end:int,replacement:string>>")
    out = [r[0] for r in df.select(spans.substitute(F.col("text"), F.col("h"))).collect()]
    assert out == ["[A] [B]", "plain", None]


def test_lift_and_containment(spark):
    df = spark.createDataFrame([(1, [(0, 5, "a", 1, ""), (1, 3, "b", 1, "")])], KIND)
    row = df.select(spans.drop_within(F.col("s"), F.col("s"), True).alias("w"), spans.lift(F.col("s"), F.slice("s", 2, 1), 96).alias("l")).first()
    assert [x["category"] for x in row["w"]] == ["a"]
    assert [x["priority"] for x in row["l"]] == [96, 96]
