import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from seqlytics.operators import markov as m
from seqlytics.operators import sequence as s
from seqlytics.plans import chains

STEPS = [
    ("q", 1, "a", "0-0", 0), ("q", 2, "b", "0-1", 1), ("q", 3, "a", "1-1", 0), ("q", 4, "c", "1-2", 1), ("r", 1, "b", "0-0", 0),
]


def steps(spark):
    return spark.createDataFrame(STEPS, "seq string, i int, act string, sit string, ok int")


def test_states_by_hand(spark, both_ways):
    out = s.state_columns(steps(spark), ["seq"], ["i"], "sit", "act", "ok")
    got = rows(out.select("seq", "i", "is_first", "prev_action", "state", "next_state"), "seq", "i")
    assert got == [
        ("q", 1, 1, "None", "0-0_None", "0-1_a"),
        ("q", 2, 0, "a", "0-1_a", "1-1_b"),
        ("q", 3, 0, "b", "1-1_b", "1-2_a"),
        ("q", 4, 0, "a", "1-2_a", "terminal_out"),
        ("r", 1, 1, "None", "0-0_None", "terminal_hit"),
    ]
    assert [r[-1] for r in rows(s.first_flag(steps(spark), ["seq"], ["i"]), "seq", "i")] == [1, 0, 0, 0, 1]
    assert [r[-1] for r in rows(s.prev_action(steps(spark), ["seq"], ["i"], "act"), "seq", "i")] == ["None", "a", "b", "a", "None"]
    last = rows(s.next_situation(steps(spark), ["seq"], ["i"], "sit", "ok"), "seq", "i")
    assert [r[-1] for r in last] == ["0-1", "1-1", "1-2", "terminal_out", "terminal_hit"]


def test_place_and_states_in_one_pass(spark, both_ways):
    """A situation made of the place comes with the states, as if it had been added before."""
    data = [(k, i, f"a{i * 7 % 3}" if i % 4 else None, i % 2) for k, n in (("q", 70), ("r", 1), (None, 30), ("s", 5)) for i in range(n)]
    df = spark.createDataFrame(data, "seq string, i int, act string, success int")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = chains._states(df.mapInArrow(counted, df.schema), ["seq"], ["i"], "act")
    want = s.state_columns(chains.situated(df, ["seq"], ["i"]), ["seq"], ["i"], "situation", "act", "success")
    assert got.columns == want.columns and sorted(map(str, rows(got))) == sorted(map(str, rows(want)))
    # for their number and for the pass; pieces have cuts, which are drawn and ordered, and help
    assert seen.value == len(data) * (2 if both_ways > len(data) else 5)


def test_labels(spark):
    df = spark.createDataFrame([(2, 1, "STRIKE", 0), (0, 0, "Ball", 1), (3, 2, None, None)], "b int, s int, call string, outs int")
    out = s.success_label(s.count_label(df, "b", "s"), "call", "outs")
    assert [(r["count"], r["successful"]) for r in out.collect()] == [("2-1", 1), ("0-0", 1), ("3-2", 0)]
    texts = spark.createDataFrame([("2-1",), ("x",), (None,), ("1-2-3",)], "t string")
    assert [r[1:] for r in rows(s.parse_count(texts, "t"))] == [(2, 1), (0, 0), (0, 0), (0, 0)]


def test_training_rows(spark):
    data = [("a", 1, 1), ("a", 1, 1), ("Unknown", 1, 1), ("b", None, 1), ("c", 1, 0), (None, 1, 1)]
    df = spark.createDataFrame(data, "act string, x int, ok int")
    assert rows(s.training_rows(df, ["x"], "act", "ok")) == [("a", 1, 1, "a")]


def test_transitions_sum_to_one(spark):
    out = s.state_columns(steps(spark), ["seq"], ["i"], "sit", "act", "ok").withColumnRenamed("act", "action")
    for t in (m.transitions(out), m.transitions(out, alpha=1.0)):
        sums = t.groupBy("state", "action").agg(F.sum("p").alias("p"))
        assert all(math.isclose(r[2], 1.0) for r in rows(sums))
    t = m.transitions(out, alpha=0.5, support="all")
    n = t.select("next_state").distinct().count()
    sums = t.groupBy("state", "action").agg((F.sum("p") + (n - F.count("*")) * F.any_value("p_other")).alias("p"))
    assert all(math.isclose(r[2], 1.0) for r in rows(sums))


def tiny(spark):
    """From s1, stay ends well half the time; go reaches s2, which always ends well."""
    data = [
        ("s1", "go", "s2", 1.0), ("s1", "stay", "terminal_out", 0.5), ("s1", "stay", "terminal_hit", 0.5),
        ("s2", "go", "terminal_out", 1.0), ("s2", "stay", "s1", 0.5), ("s2", "stay", "elsewhere", 0.5),
    ]
    return spark.createDataFrame(data, "state string, action string, next_state string, p double")


def test_values_and_policies(spark):
    t = tiny(spark)
    v = m.value_iteration(t)
    assert rows(v, "state") == [("s1", 0.9), ("s2", 1.0)]
    assert [r[:2] for r in rows(m.greedy_policy(t, v), "state")] == [("s1", "go"), ("s2", "go")]
    assert rows(m.policy_iteration(t), "state") == [("s1", "go", 0.9), ("s2", "go", 1.0)]
    assert rows(m.value_iteration(t, theta=0.0, max_iter=1), "state") == [("s1", 0.0), ("s2", 1.0)]
    # powered: (0.9 * 1) ** 2
    assert math.isclose(rows(m.value_iteration(t, degree=2), "state")[0][1], 0.81)


def test_ties_and_missing_states(spark):
    data = [("s", "b", "terminal_out", 1.0), ("s", "a", "terminal_out", 1.0)]
    t = spark.createDataFrame(data, "state string, action string, next_state string, p double")
    v = m.value_iteration(t)
    want = spark.createDataFrame([("s",), ("lost",)], "state string")
    assert rows(m.greedy_policy(t, v, states=want).select("state", "action"), "state") == [("lost", "a"), ("s", "a")]
    assert rows(m.greedy_policy(t, v, states=want, fallback="z").select("state", "action"), "state") == [("lost", "z"), ("s", "a")]
    none = m.greedy_policy(t.limit(0), v.limit(0), states=want, fallback="z")
    assert [r[1] for r in rows(none.select("state", "action"))] == ["z", "z"]


def test_greedy_equals_policy_iteration(spark):
    import random

    rnd = random.Random(5)
    data = []
    for st_ in range(6):
        for act in "xyz":
            w = [rnd.random() for _ in range(4)]
            to = rnd.sample([f"s{k}" for k in range(6)], 2) + ["terminal_out", "terminal_hit"]
            data += [(f"s{st_}", act, n, x / sum(w)) for n, x in zip(to, w)]
    t = spark.createDataFrame(data, "state string, action string, next_state string, p double")
    model = m.Model(t)
    v = m.value_iteration(model, theta=1e-9)
    greedy = rows(m.greedy_policy(model, v).select("state", "action"), "state")
    found = rows(m.policy_iteration(model, theta=1e-9), "state")
    assert [r[:2] for r in found] == greedy
    assert all(abs(a[2] - b[1]) < 1e-6 for a, b in zip(found, rows(v, "state")))


def test_situations(spark):
    hist = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, None)], "e int, x double")
    sit = spark.createDataFrame([(1, None), (1, 0.0), (1, 7.0), (2, None), (3, None)], "e int, x double")
    assert sorted(rows(m.fill_situation(sit, hist, "e", ["x"]))) == [(1, 7.0), (1, 15.0), (1, 15.0), (2, 0.0), (3, 0.0)]


def recommend(spark, **options):
    sit = spark.createDataFrame([("p", "s"), ("p", "s"), ("new", "s")], "e string, state string")
    probs = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.3), ("s", "c", 0.1), ("s", "Unknown", 0.1)], "state string, action string, p double")
    own = spark.createDataFrame([("p", "a"), ("p", "b"), ("other", "c")], "e string, action string")
    policy = spark.createDataFrame([("s", "b")], "state string, action string")
    return m.recommend_distribution(sit, probs, own, policy, "e", **options)


def test_recommendation(spark):
    got = {(r["e"], r["action"]): r["p"] for r in recommend(spark).collect()}
    # p knows a and b: 0.5 and 0.3 + 0.1, scaled to 1, a tenth of it even
    assert set(got) == {("p", "a"), ("p", "b"), ("new", "a"), ("new", "b"), ("new", "c")}
    assert math.isclose(got["p", "a"], 0.9 * 0.5 / 0.9 + 0.05) and math.isclose(got["p", "b"], 0.9 * 0.4 / 0.9 + 0.05)
    for e in ("p", "new"):
        assert math.isclose(sum(p for (k, _), p in got.items() if k == e), 1.0)
    sharp = {(r["e"], r["action"]): r["p"] for r in recommend(spark, epsilon=0.0, temperature=0.5).collect()}
    assert math.isclose(sharp["p", "a"], 0.25 / (0.25 + 0.16))


def test_picks(spark):
    dist = recommend(spark).where("e = 'p'")
    assert [r[2] for r in rows(m.pick_action(dist, ["e", "state"]))] == ["a"]
    many = dist.select(F.explode(F.sequence(F.lit(0), F.lit(3999))).alias("id"), "action", "p")
    drawn = m.pick_action(many, ["id"], seed=1)
    assert rows(drawn, "id") == rows(m.pick_action(many.repartition(7), ["id"], seed=1), "id")
    share = drawn.where("action = 'a'").count() / 4000
    assert abs(share - 0.55) < 0.03


def test_propagate_keeps_the_mass(spark):
    t = tiny(spark)
    acts = t.select("state", "action").distinct().withColumn("p", F.lit(0.5))
    start = spark.createDataFrame([("x", "s1", 1.0)], "id string, state string, mass double")
    states, mixes = m.propagate(start, acts, t, 3, ids=["id"])
    got = {(r["step"], r["state"]): r["mass"] for r in states.collect()}
    # s1 -> go: s2; stay: ends, spreads to the other state s2
    assert got == {(1, "s1"): 1.0, (2, "s2"): 1.0, (3, "s1"): 1.0}
    sums = mixes.groupBy("step").agg(F.sum("p").alias("p"))
    assert all(math.isclose(r[1], 1.0) for r in rows(sums))


def ahead_by_hand(start, acts, model, n, smooth):
    """Every id over every state: the dense form of what ``propagate`` keeps apart."""
    space = sorted({s for s, *_ in model})
    reached = {t for _, _, t, *_ in model} & set(space)
    seen = {(s, a): {t: p for s2, a2, t, p, _ in model if (s2, a2) == (s, a)} for s, a, *_ in model}
    other = {(s, a): o for s, a, _, _, o in model}
    states, mixes = {}, {}
    for id_ in {i for i, *_ in start}:
        mass = {s: sum(m for i, s2, m in start if (i, s2) == (id_, s)) for s in space}
        for step in range(1, n + 1):
            states |= {(id_, step, s): m for s, m in mass.items() if m > 1e-12}
            flow, left = dict.fromkeys(space, 0.0), dict.fromkeys(space, 0.0)
            for s, a, q in acts:
                if mass.get(s):
                    mixes[id_, step, a] = mixes.get((id_, step, a), 0.0) + mass[s] * q
                for t in reached if (s, a) in seen else ():
                    p = seen[s, a].get(t, other[s, a] if smooth else 0.0)
                    flow[t] += mass[s] * q * p
                    left[s] += mass[s] * q * p
            lost = {s: mass[s] - left[s] for s in space}
            mass = {s: flow[s] + (sum(lost.values()) - lost[s]) / (len(space) - 1) for s in space}
    return states, mixes


@pytest.mark.parametrize("smooth", [False, True])
def test_propagate_against_every_state(spark, smooth):
    rnd = random.Random(6)
    names = [f"s{i}" for i in range(9)]
    used = [(rnd.choice(names), rnd.choice("abc"), rnd.choice([*names[:6], "Ball", "Hit"])) for _ in range(70)]
    t = m.transitions(spark.createDataFrame(used, "state string, action string, next_state string"), **({"alpha": 0.5, "support": "all"} if smooth else {}))
    model = [(r.state, r.action, r.next_state, r.p, r.p_other if smooth else 0.0) for r in t.collect()]
    for s, a in {(s, a) for s, a, *_ in model} if smooth else ():
        seen = {t_: p for s2, a2, t_, p, _ in model if (s2, a2) == (s, a)}
        o = next(o for s2, a2, _, _, o in model if (s2, a2) == (s, a))
        assert math.isclose(sum(seen.values()) + o * (len({x[2] for x in model}) - len(seen)), 1.0)
    pairs = sorted({(s, a) for s, a, *_ in model})
    acts = [(s, a, 1 / sum(s2 == s for s2, _ in pairs)) for s, a in pairs]
    have = sorted({s for s, _ in pairs})
    start = [("x", have[0], 0.25), ("x", have[1], 0.75), ("y", have[2], 1.0)]
    frames = [spark.createDataFrame(r, c) for r, c in ((start, "id string, state string, mass double"), (acts, "state string, action string, p double"))]
    states, mixes = m.propagate(*frames, t, 5, ids=["id"])
    want = ahead_by_hand(start, acts, model, 5, smooth)
    for frame, by_hand, of, value in ((states, want[0], "state", "mass"), (mixes, want[1], "action", "p")):
        got = {(r.id, r.step, r[of]): r[value] for r in frame.collect() if r[value] > 1e-12}
        assert got.keys() == by_hand.keys() and all(math.isclose(v, by_hand[k], abs_tol=1e-9) for k, v in got.items())
    by_id = frames[1].withColumn("id", F.lit("x")).union(frames[1].withColumn("id", F.lit("y"))).select("id", "state", "action", "p")
    same = m.propagate(frames[0], by_id, t, 5, ids=["id"], on=["id"])[1]
    assert {(r.id, r.step, r.action): round(r.p, 9) for r in same.collect()} == {k: round(v, 9) for k, v in want[1].items()}
    assert m.propagate(frames[0], frames[1], t, 1, ids=["id"])[0].count() == 3


def test_plans_of_situations(spark):
    """Own starts, lengths and arsenals; equal situations share their look-ahead; no steps and no possible action."""
    t = m.transitions(spark.createDataFrame(STEPS_OF_A_MODEL, "state string, action string, next_state string"))
    acts = t.groupBy("state", "action").agg(F.sum("n").alias("n"))
    acts = acts.join(acts.groupBy("state").agg(F.sum("n").alias("all")), "state").select("state", "action", (F.col("n") / F.col("all")).alias("p"))
    data = [(1, "s1", 2, ["a", "b"]), (2, "s1", 2, ["a", "b"]), (3, "s1", 3, ["b"]), (4, "s2", 1, None), (5, "s2", 0, ["a"]), (6, "s1", 1, ["z"]), (7, "s1", None, ["a"])]
    asked = spark.createDataFrame(data, "id int, state string, n int, may array<string>")
    got = {(r.id, r.step): (r.action, r.p) for r in m.predict_plan(asked, acts, t, ["id"], arsenal="may").collect()}
    assert got[1, 1] == got[2, 1] == ("a", 0.75) and got[3, 1] == ("b", 0.25) and got[6, 1] == (None, None)
    assert {k for k in got if k[0] in (1, 2, 3, 4, 5, 7)} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 1)}
    drawn = m.predict_plan(asked, acts, t, ["id"], arsenal="may", seed=3)
    assert drawn.columns == ["id", "step", "action"] and {r.action for r in drawn.where("id = 3").collect()} == {"b"}
    assert m.predict_plan(asked.where("n = 0"), acts, t, ["id"]).count() == 0
    assert m.predict_sequence(asked, 2, acts, t, ["id"]).count() == 14


STEPS_OF_A_MODEL = [("s1", "a", "s2")] * 3 + [("s1", "b", "s1"), ("s2", "a", "s1"), ("s2", "b", "s2"), ("s2", "b", "Out")]
