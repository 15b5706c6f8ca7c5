"""Names that hold one another, against all pairs."""

import random

from fieldmark.operators.names import containing


def test_pairs_as_by_all_pairs(spark):
    rng = random.Random(7)
    made = lambda n, most: ["".join(rng.choice("abcä") for _ in range(rng.randint(1, most))) for _ in range(n)]
    short, long = made(150, 5), made(200, 9)
    df = lambda rows, name: spark.createDataFrame([(x,) for x in [*rows, rows[0], "", None]], f"{name} string")
    got = containing(df(short, "s"), "s", df(long, "l"), "l").collect()
    want = {(s, x) for s in short for x in long if s in x}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 500
    assert containing(df(short, "s").filter("false"), "s", df(long, "l"), "l").count() == 0
