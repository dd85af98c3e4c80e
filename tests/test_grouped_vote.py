"""The grouped vote gives the rows of the interval sweep on random spans."""
import random

from spanweave.operators.grouped_vote import vote_grouped
from spanweave.operators.spans import majority_vote

SCHEMA = "id string, model string, weight int, start int, end int, lead int, trail int"


def test_grouped_vote_equals_the_sweep(spark):
    rng = random.Random(4)
    rows = []
    for pair in range(60):
        note = "".join(rng.choice("ab  \n") for _ in range(rng.randint(1, 40)))
        for model, weight in (("m1", 2), ("m2", 1), (None, 1)):
            for _ in range(rng.randint(0, 5)):
                s = rng.randrange(len(note))
                e = rng.randint(s + 1, len(note))
                rest, left = note[s:], note[:e]
                rows.append((None if pair == 7 else f"p{pair}", model, weight, s, e, len(rest) - len(rest.lstrip(" \n")), len(left) - len(left.rstrip(" \n"))))
    df = spark.createDataFrame(rows + rows[:20], SCHEMA)
    for threshold, n_voters in ((1, None), (2, 4), (3, 4), (9, 4)):
        want = majority_vote(df, threshold, n_voters=n_voters).select("id", "start", "end")
        got = vote_grouped(df, threshold, n_voters=n_voters)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_pair_is_cut_before_its_group(spark):
    df = spark.range(30000).selectExpr("'p' id", "'m' || id % 2 model", "1 weight", "cast(id % 40 as int) start",
                                       "cast(id % 40 + 5 + id % 4 as int) end", "0 lead", "0 trail")
    out = vote_grouped(df, 2)
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in majority_vote(df, 2).select("id", "start", "end").collect()]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("FlatMapGroupsInArrow"):]
    assert vote_grouped(df.limit(0), 2).count() == 0
