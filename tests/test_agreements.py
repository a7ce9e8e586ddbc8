"""Quote keys that agree, against every pair, and what meets on the way."""

import random

from test_contexts import _agree

from citeloom.operators import cards as C


def _keys(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["a", "ab", "abc", "w1 w1", "long word here"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    cut = [k[rng.randint(0, 3) :].strip() for k in base]
    return sorted({*base, *cut, *(" ".join(k.split(" ")[:-2]) for k in base), ""})


def test_keys_that_agree_are_those_of_every_pair(spark):
    keys = _keys(1, 120)
    df = spark.createDataFrame([("g", k) for k in keys] + [("h", k) for k in keys[::5]], "grp string, key string").repartition(3)
    got = {tuple(r) for r in C.agreements(df).collect()}
    want = {("g", a, b) for a in keys for b in keys if _agree(a, b)} | {("h", a, b) for a in keys[::5] for b in keys[::5] if _agree(a, b)}
    assert len(want) > len(keys) and got == want


def test_keys_meet_as_numbers(spark):
    """No text is joined by words: unlike keys are told apart in that join by the bits of their words."""
    df = spark.createDataFrame([("g", k) for k in _keys(2, 20)], "grp string, key string")
    plan = C.agreements(df)._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in plan.split("\n") if "Join Inner" in line and "bit_count" in line]
    assert len(met) == 1 and "chars" in met[0]
