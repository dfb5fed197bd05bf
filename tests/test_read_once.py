"""Queries that need their rows several times work them out once; tasks that order rows hold a bounded number."""

import datetime

import pytest

from seqlytics import session
from seqlytics.operators import features, reports
from seqlytics.plans import chains, encoding, fitted, grouped, reported, scored
from seqlytics.sources import tables
from tests.conftest import rows

N = 240
QUERIES = [
    (fitted, "score_candidates_fitted"), (fitted, "outcome_classifier"), (encoding, "mutual_info"), (reported, "explode_parallel"),
    (grouped, "features_joined_left"), (scored, "plan_situations"), (grouped, "feature_stage"), (grouped, "mean_diff"), (grouped, "below_median_share"),
    (reported, "rollup_sequences"), (reported, "last_in_sequence"),
]


def _events(spark):
    """Events of a few games, with the columns that ``pitches`` gives."""
    one = lambda i: (
        2020 + i % 2, datetime.date(2020, 1, 1 + i % 28), i // 6, i % 6 + 1, i % 4, i % 5, f"team {i // 6 % 3}", i % 7,
        ["SMALL a", "LARGE b", "MEDIUM c"][i % 3], ["Strike", "Ball", "Hit"][i * i % 3], ["Strikeout", "Hit", "Out"][i // 6 % 3],
        float(i * 37 % 101), float(i % 50), float(i * 7 % 9), float(i % 11), float(i) if i % 3 else None, i % 2, i % 4, i % 3, i % 3,
    )
    kinds = "season int, ship_date date, game_id long, pitch_of_pa int, pitcher_id long, batter_id int, team string, part_id long, pitch_type string, "
    kinds += "pitch_call string, play_result string, rel_speed double, spin_rate double, plate_height double, speed_drop double, exit_speed double, "
    kinds += "outs_on_play int, balls int, strikes int, runs_scored int"
    return spark.createDataFrame([one(i) for i in range(N)], kinds)


@pytest.mark.parametrize("module,name", QUERIES)
def test_rows_are_worked_out_once(spark, monkeypatch, module, name):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def pitches(spark, folder, cols):
        df = _events(spark).select(*cols)
        return df.mapInArrow(counted, df.schema)

    # game states come from chains, whichever module asks for them
    monkeypatch.setattr(chains if name == "plan_situations" else module, "pitches", pitches)
    getattr(module, name)(spark, "").collect()
    assert seen.value == N


def test_recommended_distribution_is_worked_out_once(spark, monkeypatch):
    data = [(i // 6 if i % 40 else None, datetime.date(2020, 1, 1), i, i, ["view", "click", "purchase"][i * i % 3], int(i % 3 == 0), float(i)) for i in range(N)]
    events = spark.createDataFrame(data, "user_id long, day date, ts long, event_id long, action string, success int, value double")
    monkeypatch.setattr(chains, "steps", lambda spark, folder: events)
    got = fitted.recommend_fitted(spark, "")
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in text.splitlines() if "Window [max(_own" in x]) == 1
    found = rows(got)
    assert len(found) == len(set(found)) and found and all(r[0] is not None and r[3] == 1 for r in found)
    own = {u: {r[4] for r in data if r[0] == u} for u in {r[0] for r in data}}
    assert {(u, a) for u, _, a, _ in found} == {(u, a) for u in own if u is not None for a in own[u]}


def test_stored_rows_come_back(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, float("nan"), None)], "`a b` long, `x;y` double, `A B` string")
    back = session.stored(df)
    assert back.columns == df.columns and back.dtypes == df.dtypes and sorted(map(str, rows(back))) == sorted(map(str, rows(df)))
    assert session.stored(df.limit(0)).count() == 0


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    df = _events(spark)
    assert session.dealt(df, ["game_id"], N).rdd.getNumPartitions() == N // 10
    rolled = reports.rollup_sequences(df, ["game_id"], ["pitch_of_pa"], ["pitch_type"], [])
    assert rolled.rdd.getNumPartitions() == N // 10 and rolled.count() == N // 6
    assert features.over(df, ["game_id"], ["pitch_of_pa"], {"_p": features.previous("balls")}).rdd.getNumPartitions() == N // 10


def test_lines_are_shuffled_once_for_orders_and_customers(spark, tmp_path):
    """Orders meet customers before they meet the lines; rows without a partner go, as before."""
    put = lambda name, data, kinds: spark.createDataFrame(data, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    put("nation", [(1, "n", 7), (2, "m", 8)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(1, 1), (2, 2), (3, None), (3, 1)], "c_custkey long, c_nationkey int")
    put("orders", [(10, 1), (11, 2), (11, 1), (12, 9), (13, 3), (None, 1)], "o_orderkey long, o_custkey long")
    put("lineitem", [(10,), (10,), (11,), (12,), (13,), (None,)], "l_orderkey long")
    got = tables.pitches(spark, str(tmp_path), ["game_id", "batter_id", "team"])
    want = [(10, 7, "n"), (10, 7, "n"), (11, 7, "n"), (11, 8, "m"), (13, 7, "n")]
    assert rows(got, "game_id", "batter_id") == want
    text = got._jdf.queryExecution().optimizedPlan().toString()
    # the lines are a side of the outermost join
    assert text.index("l_orderkey") < text.index("o_custkey") and len([x for x in text.splitlines() if "Join" in x]) == 3
