"""Transition model, best actions, recommendations and look-ahead.

All tables here are aggregates (states, actions), far smaller than the rows they
come from. Loops run a few rounds per job and write the values to the
checkpoint folder, so the plan does not grow with the number of rounds.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from copy import copy
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seqlytics.functions.expressions import argbest, is_terminal, reward_of, uniform
from seqlytics.operators.spread import split_join
from seqlytics.session import checkpoint

ROUNDS_PER_JOB = 6


# --- transition model ------------------------------------------------------


def transitions(
    df: DataFrame,
    state: str = "state",
    action: str = "action",
    next_state: str = "next_state",
    alpha: float | None = None,
    support: str = "observed",
    weight: str | None = None,
) -> DataFrame:
    """(state, action, next_state, n, p) over the observed next states.

    ``weight`` names a column of row counts where the rows are counted already.

    With ``alpha`` p is (n + alpha) / (total + alpha * N). N counts the next
    states seen in the group, or with ``support="all"`` those of the whole model.
    The unseen ones of a group are not written out one by one: ``p_other`` is
    the probability of each of them.
    """
    counts = df.groupBy(
        F.col(state).alias("state"), F.col(action).alias("action"), F.col(next_state).alias("next_state")
    ).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    if alpha is None:
        sums = counts.groupBy("state", "action").agg(F.sum("n").alias("_total"))
        return counts.join(sums, ["state", "action"]).select(
            "state", "action", "next_state", "n", (F.col("n") / F.col("_total")).alias("p")
        )
    a = F.lit(float(alpha))
    sums = counts.groupBy("state", "action").agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_seen"))
    if support == "all":
        every = counts.agg(F.count_distinct("next_state")).scalar()
        other = F.lit(1.0)
    else:
        every, other = F.col("_seen"), F.lit(0.0)
    below = F.col("_total") + a * every
    return counts.join(sums, ["state", "action"]).select(
        "state", "action", "next_state", "n", ((F.col("n") + a) / below).alias("p"), (other * a / below).alias("p_other")
    )


def with_reward(model: DataFrame) -> DataFrame:
    return model.withColumn("reward", reward_of(F.col("next_state")))


# --- values and policies ---------------------------------------------------


class Model:
    """A transition model made ready for solving: one table (state, action, p, reward, to).

    Build it once and pass it to the functions below in place of the DataFrame
    to solve and read off the policy without writing the table again.

    ``to`` is the next state, and a name of its own for every terminal row: it
    meets no value, and a terminal state that ends most groups is no hot key.
    """

    def __init__(self, model: DataFrame, gamma: float = 0.9, degree: int = 1):
        self.gamma, self.degree = gamma, degree
        end = is_terminal(F.col("next_state"))
        self.t = checkpoint(
            model.select(
                "state",
                "action",
                "p",
                F.col("p_other") if "p_other" in model.columns else F.lit(0.0).alias("p_other"),
                reward_of(F.col("next_state")).alias("reward"),
                F.when(end, F.concat_ws("|", F.lit("terminal"), "state", "action")).otherwise(F.col("next_state")).alias("to"),
            )
        )
        self.states = self.t.select("state").distinct()
        # with unseen next states in the model, every next state once, the terminals with their reward
        self.smoothed = "p_other" in model.columns
        if self.smoothed:
            reached = model.select(F.col("next_state").alias("state")).distinct()
            self.reached = checkpoint(reached.select("state", reward_of(F.col("state")).alias("reward"), is_terminal(F.col("state")).alias("end")))

    def q(self, v: DataFrame) -> DataFrame:
        """(state, action, q); a next state without a value counts 0.

        In a smoothed model each unseen next state of a group has ``p_other``: all that next states are worth, less what the seen ones are.
        """
        ahead = v.select(F.col("state").alias("to"), "v")
        worth = F.col("reward") + F.lit(self.gamma) * F.coalesce("v", F.lit(0.0))
        value = F.sum(F.col("p") * worth)
        if self.smoothed:
            each = F.col("reward") + F.when(F.col("end"), 0.0).otherwise(F.lit(self.gamma) * F.coalesce("v", F.lit(0.0)))
            whole = self.reached.join(v, "state", "left").agg(F.sum(each)).scalar()
            value = value + F.max("p_other") * (F.max(whole) - F.sum(worth))
        if self.degree > 1:
            value = F.pow(value, F.lit(float(self.degree)))
        return self.t.join(ahead, "to", "left").groupBy("state", "action").agg(value.alias("q"))

    def zero(self) -> DataFrame:
        return self.states.withColumn("v", F.lit(0.0))


def _ready(model: DataFrame | Model, gamma: float, degree: int) -> Model:
    return model if isinstance(model, Model) else Model(model, gamma, degree)


def _iterate(start: DataFrame, step, theta: float, max_iter: int, rounds_per_job: int = ROUNDS_PER_JOB) -> DataFrame:
    """Apply ``step`` until the largest change of v is below ``theta``, or ``max_iter`` times."""
    v, done = start, 0
    while done < max_iter:
        rounds = min(rounds_per_job, max_iter - done)
        last = v
        for _ in range(rounds - 1):
            last = step(last)
        new = step(last)
        done += rounds
        if theta > 0:
            new = new.join(last.withColumnRenamed("v", "_was"), "state", "left")
            new = checkpoint(new)
            change = new.agg(F.max(F.abs(F.col("v") - F.coalesce("_was", F.lit(0.0))))).first()[0]
            v = new.drop("_was")
            if change is None or change < theta:
                break
        else:
            v = checkpoint(new)
    else:
        if theta > 0:
            warnings.warn(f"values still changed by {theta} or more after {max_iter} rounds", stacklevel=3)
    return v


def value_iteration(
    model: DataFrame | Model, gamma: float = 0.9, theta: float = 1e-4, max_iter: int = 1000, degree: int = 1
) -> DataFrame:
    """(state, v): all states updated together each round; ``theta=0`` runs exactly ``max_iter`` rounds."""
    m = _ready(model, gamma, degree)
    # a smoothed model reads the values twice in a round, so each round is written
    rounds = 1 if m.smoothed else ROUNDS_PER_JOB
    return _iterate(m.zero(), lambda v: m.q(v).groupBy("state").agg(F.max("q").alias("v")), theta, max_iter, rounds)


def q_values(model: DataFrame | Model, values: DataFrame, gamma: float = 0.9, degree: int = 1) -> DataFrame:
    """(state, action, q)."""
    return _ready(model, gamma, degree).q(values)


def _best(q: DataFrame) -> DataFrame:
    return q.groupBy("state").agg(argbest(F.col("q"), F.col("action")).alias("action"), F.max("q").alias("q"))


def greedy_policy(
    model: DataFrame | Model,
    values: DataFrame,
    gamma: float = 0.9,
    degree: int = 1,
    states: DataFrame | None = None,
    fallback: str | None = None,
) -> DataFrame:
    """(state, action, q): best action, the first name on ties.

    ``states`` lists states that need an action even without transitions: they
    get ``fallback``, or the first action of the model. With an empty model every
    listed state gets ``fallback``.
    """
    m = _ready(model, gamma, degree)
    best = _best(m.q(values))
    if states is None:
        return best
    first = F.lit(fallback) if fallback is not None else m.t.agg(F.min("action")).scalar()
    return states.select("state").distinct().join(best, "state", "left").withColumn("action", F.coalesce("action", first))


def policy_iteration(
    model: DataFrame | Model, gamma: float = 0.9, theta: float = 1e-4, max_iter: int = 1000, degree: int = 1
) -> DataFrame:
    """(state, action, v): evaluate the policy, improve it, until it is stable."""
    m = _ready(model, gamma, degree)
    plain = copy(m)
    plain.degree = 1  # a fixed policy is evaluated with plain values
    # the first action that a state has, in name order
    policy = checkpoint(m.t.groupBy("state").agg(F.min("action").alias("action")))
    v = m.zero()
    for _ in range(max_iter):
        def follow(values: DataFrame, policy: DataFrame = policy) -> DataFrame:
            chosen = plain.q(values).join(policy, ["state", "action"], "left_semi")
            return chosen.select("state", F.col("q").alias("v"))

        v = _iterate(v, follow, theta, max_iter, 1 if m.smoothed else ROUNDS_PER_JOB)
        better = checkpoint(_best(m.q(v)).select("state", "action"))
        moved = better.join(policy.withColumnRenamed("action", "_old"), "state").where(F.col("action") != F.col("_old"))
        policy = better
        if moved.isEmpty():
            break
    return policy.join(v, "state")


# --- recommendation --------------------------------------------------------


def fill_situation(sit: DataFrame, hist: DataFrame, entity: str, cols: Sequence[str]) -> DataFrame:
    """Measures that are missing or 0 take the entity's mean; 0 without a history."""
    means = hist.groupBy(entity).agg(*[F.avg(c).alias(f"_avg_{c}") for c in cols])
    filled = {
        c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.col(f"_avg_{c}"), F.lit(0.0)) for c in cols
    }
    return split_join(sit, means, [entity], "left").withColumns(filled).drop(*[f"_avg_{c}" for c in cols])


def recommend_distribution(
    sit: DataFrame,
    probs: DataFrame,
    arsenal: DataFrame,
    policy: DataFrame,
    entity: str,
    state: str = "state",
    on: Sequence[str] = ("state",),
    epsilon: float = 0.1,
    temperature: float = 1.0,
    bonus: float = 0.1,
    unknown: str = "Unknown",
) -> DataFrame:
    """(entity, state, action, p) for every distinct (entity, state) of ``sit``.

    ``probs`` holds the model's (on, action, p), ``arsenal`` (entity, action) and
    ``policy`` (state, action). Every situation with the same entity and state
    has the same distribution, so it is worked out once per pair; windows see
    one row per action.
    """
    pairs = sit.select(entity, state, *[c for c in on if c not in (entity, state)]).distinct()
    own = arsenal.select(entity, "action").distinct().withColumn("_own", F.lit(1))
    best = policy.select(F.col("state").alias(state), "action", F.lit(bonus).alias("_bonus"))
    w = Window.partitionBy(entity, state)
    scored = (
        split_join(pairs, probs.where(F.col("action") != unknown), on)
        .join(own, [entity, "action"], "left")
        .withColumn("_any", F.max("_own").over(w))
        .where(F.col("_own").isNotNull() | F.col("_any").isNull())
        .transform(lambda x: split_join(x, best, [state, "action"], "left"))
        .withColumn("p", F.col("p") + F.coalesce("_bonus", F.lit(0.0)))
        .withColumn("_k", F.count(F.lit(1)).over(w))
    )
    def evened(p: Column) -> Column:
        total = F.sum(p).over(w)
        return F.when(total > 0, p / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1.0) / F.col("_k"))

    even = scored.withColumn("p", evened(F.col("p")))
    tempered = even.withColumn("p", evened(F.pow("p", F.lit(1.0 / temperature))))
    mixed = F.lit(1.0 - epsilon) * F.col("p") + F.lit(epsilon) / F.col("_k")
    return tempered.select(entity, state, "action", mixed.alias("p"))


def pick_action(dist: DataFrame, group: Sequence[str], seed: int | None = None) -> DataFrame:
    """One action per group: the most likely, or a draw that is the same for the same seed."""
    keys = list(group)
    if seed is None:
        return dist.groupBy(*keys).agg(
            argbest(F.col("p"), F.col("action")).alias("action"), F.max("p").alias("p")
        )
    u = uniform(keys, seed)
    w = Window.partitionBy(*keys).orderBy("action").rowsBetween(Window.unboundedPreceding, 0)
    upto = dist.withColumn("_upto", F.sum("p").over(w)).withColumn("_u", u)
    pick = F.coalesce(
        F.min(F.when(F.col("_upto") > F.col("_u"), F.col("action"))), F.max("action")
    )
    return upto.groupBy(*keys).agg(pick.alias("action"))


def propagate(
    start: DataFrame, actions: DataFrame, model: DataFrame, n: int, ids: Sequence[str] = (), on: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Expected state and action mix over ``n`` steps.

    ``start`` is (ids, state, mass) with states of the model, ``actions`` (on, state, action, p), where
    ``on`` are those of the ids the action mix depends on. Returns (ids, step,
    state, mass) before each step and (ids, step, action, p). Mass that ends, or
    has no transition, spreads evenly over the other states of the model; in a smoothed model (``p_other``) each
    next state that a state and action were not seen to reach gets its share too.

    What spreads evenly is not written state by state: an id has its few states, and for each step a number, the share that spread
    then. Where such a share is a step later is the same for all ids with the same ``on``, and worked out once for these. So the
    actions cost ids times reached states; only the first result, if it is read, has a row for each id and state.
    """
    ids, on = list(ids), list(on)
    cols = ["state", "action", "next_state", "p", *(["p_other"] if "p_other" in model.columns else [])]
    model = checkpoint(model.select(*cols))
    if "p_other" not in model.columns:
        model = model.withColumn("p_other", F.lit(0.0))
    actions = checkpoint(actions.select(*on, "state", "action", "p"))
    space = checkpoint(model.select("state").distinct())
    size = space.count()
    reached = checkpoint(model.select(F.col("next_state").alias("state")).join(space, "state", "left_semi").distinct())
    within = reached.count()
    known = model.join(space.select(F.col("state").alias("next_state")), "next_state", "left_semi")
    other = model.groupBy("state", "action").agg(F.max("p_other").alias("p_other"))

    # tracks: an id's own states, and for each ``on`` one unit in every state and one in every reached state
    groups = start.select(*on).distinct()
    track = [*ids, "_seed"]
    # fields of ids that a seed's track has no value for
    blank = [F.lit(None).cast(start.schema[c].dataType).alias(c) for c in ids if c not in on]
    own = start.select(*ids, F.lit("own").alias("_seed"), "state", "mass")
    seeds = [
        _each(groups, on, table).select(*on, *blank, F.lit(name).alias("_seed"), "state", F.lit(1.0).alias("mass")).select(*track, "state", "mass")
        for name, table in (("even", space), ("unseen", reached))
    ]
    mass = checkpoint(own.unionByName(seeds[0]).unionByName(seeds[1]).groupBy(*track, "state").agg(F.sum("mass").alias("mass")))
    masses, mixes, spread = [], [], []
    for step in range(n):
        masses.append(mass.withColumn("_age", F.lit(step)))
        played = checkpoint(
            _same(mass, actions, [*on, "state"]).select(*track, "state", "action", (F.col("mass") * F.col("p")).alias("m"))
        )
        mixes.append(played.groupBy(*track, "action").agg(F.sum("m").alias("p")).withColumn("_age", F.lit(step)))
        if step == n - 1:
            break
        # every move leaves one state and reaches another; unseen next states have p_other each, which the seen ones give back
        flow, none = F.col("m") * (F.col("p") - F.col("p_other")), F.lit(0.0)
        ends = F.array(
            F.struct(F.col("state"), none.alias("mass"), flow.alias("left"), none.alias("in")),
            F.struct(F.col("next_state").alias("state"), none.alias("mass"), none.alias("left"), flow.alias("in")),
        )
        moved = played.join(known, ["state", "action"]).select(*track, F.explode(ends).alias("e")).select(*track, "e.*")
        unseen = played.join(other, ["state", "action"]).select(*track, "state", (F.col("m") * F.col("p_other")).alias("u"))
        away = unseen.select(*track, "state", none.alias("mass"), (F.col("u") * float(within)).alias("left"), none.alias("in"))
        flows = mass.select(*track, "state", "mass", none.alias("left"), none.alias("in")).unionByName(moved).unionByName(away)
        sums = checkpoint(flows.groupBy(*track, "state").agg(*[F.sum(c).alias(c) for c in ("mass", "left", "in")]))
        lost = F.col("mass") - F.col("left")
        parts = sums.select(*track, lost.alias("lost"), none.alias("u")).unionByName(unseen.select(*track, none.alias("lost"), "u"))
        spread.append(checkpoint(parts.groupBy(*track).agg(F.sum("lost").alias("lost"), F.sum("u").alias("u"))).withColumn("_age", F.lit(step)))
        # what is lost in a state goes to the others: everybody gets the whole, less the own share
        keeps = F.col("in") - (lost / F.lit(float(size - 1)) if size > 1 else F.lit(0.0))
        mass = checkpoint(sums.select(*track, "state", keeps.alias("mass")).where("mass <> 0"))

    shares = _shares(start.select(*ids).distinct(), spread, ids, on, n, size)

    def ahead(parts: list[DataFrame], of: str, value: str) -> DataFrame:
        """An id's own track at each step, and the seeds' tracks as often as their shares spread before it."""
        every = reduce(DataFrame.unionByName, parts)
        mine = every.where("_seed = 'own'").select(*ids, (F.col("_age") + 1).alias("step"), of, value)
        seed = every.where("_seed <> 'own'").select(*on, F.col("_seed").alias("seed"), F.col("_age").alias("age"), of, F.col(value).alias("_unit"))
        spread_ = _same(shares, seed, [*on, "seed", "age"]).select(*ids, "step", of, (F.col("share") * F.col("_unit")).alias(value))
        return mine.unionByName(spread_).groupBy(*ids, "step", of).agg(F.sum(value).alias(value)).select(*ids, "step", of, value)

    return ahead(masses, "state", "mass").where(F.col("mass") > 0), ahead(mixes, "action", "p")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys))


def _each(groups: DataFrame, on: Sequence[str], table: DataFrame) -> DataFrame:
    """The states of the model for each group of ids that shares its actions."""
    states = table.agg(F.collect_list("state")).scalar()
    return (groups if on else groups.sparkSession.range(1)).withColumn("state", F.explode(states))


def _shares(starts: DataFrame, spread: list[DataFrame], ids: list, on: list, n: int, size: int) -> DataFrame:
    """(ids, step, seed, age, share): how much of a seed's unit, spread ``age`` steps before, an id has at each step.

    What an id spreads at a step is what its own states and the seeds' units it has by then spread: a short sum over the steps before.
    """
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in starts.schema.fields], "step int, seed string, age int, share double"])
    if not spread:
        return starts.sparkSession.createDataFrame([], schema)
    every = reduce(DataFrame.unionByName, spread)
    own = every.groupBy(*ids).agg(_listed("own").alias("_own")).where(F.size("_own") > 0)
    seed = every.where("_seed <> 'own'").groupBy(*on).agg(
        *[_listed(name).alias(f"_{name}") for name in ("even", "unseen")]
    )
    both = _same(own, seed, on) if on else own.withColumns({f"_{c}": seed.agg(F.max(f"_{c}")).scalar() for c in ("even", "unseen")})
    none = F.array().cast("array<struct<even:double,unseen:double>>")

    def upto(acc: Column, t: Column) -> Column:
        # shares that spread at step i have had t - 1 - i steps since
        def sum_of(field: str) -> Column:
            def part(i: Column) -> Column:
                age = t - 1 - i
                e, u = F.get("_even", age), F.get("_unseen", age)
                a = F.get(acc, i)
                return a["even"] * F.coalesce(e[field], F.lit(0.0)) + a["unseen"] * F.coalesce(u[field], F.lit(0.0))

            places = F.when(t > 0, F.sequence(F.lit(0), t - 1)).otherwise(F.array().cast("array<int>"))
            mine = F.coalesce(F.get("_own", t)[field], F.lit(0.0))
            return F.aggregate(F.transform(places, part), mine, lambda x, y: x + y)

        even = sum_of("lost") / F.lit(float(size - 1)) if size > 1 else F.lit(0.0) * sum_of("lost")
        return F.concat(acc, F.array(F.struct(even.alias("even"), sum_of("u").alias("unseen"))))

    made = both.withColumn("_c", F.aggregate(F.sequence(F.lit(0), F.lit(n - 2)), none, upto))
    one = made.select(*ids, F.posexplode("_c").alias("_at", "_s"))
    two = F.explode(F.array(F.struct(F.lit("even").alias("seed"), F.col("_s.even").alias("share")), F.struct(F.lit("unseen").alias("seed"), F.col("_s.unseen").alias("share"))))
    long = one.select(*ids, "_at", two.alias("_x")).select(*ids, "_at", "_x.*").where("share <> 0")
    # spread at step _at (from 0), so first there at step _at + 2 (from 1), of age 0
    steps = long.withColumn("step", F.explode(F.sequence(F.col("_at") + 2, F.lit(n))))
    return checkpoint(steps.select(*ids, "step", "seed", (F.col("step") - F.col("_at") - 2).alias("age"), "share"))


def _listed(name: str) -> Column:
    """The (lost, u) of one seed by age."""
    found = F.sort_array(F.collect_list(F.when(F.col("_seed") == name, F.struct("_age", "lost", "u"))))
    return F.transform(found, lambda x: F.struct(x["lost"], x["u"]))


# --- plans ---------------------------------------------------------------------


def predict_plan(
    situations: DataFrame, actions: DataFrame, model: DataFrame, key: Sequence[str], state: str = "state", length: str = "n",
    on: Sequence[str] = (), arsenal: str | None = None, seed: int | None = None,
) -> DataFrame:
    """(key, step, action, p): the action of each of the next ``length`` steps of every situation.

    Each row of ``situations`` has its own start state, number of steps and, by name, the columns ``on`` that the action mix ``actions``
    depends on and the array ``arsenal`` of the actions it may take. The action is the likeliest of these, or with ``seed`` a draw by their
    likelihoods (without p); null where none of them can come. ``key`` has to identify a situation; no steps, no rows.

    The look-ahead runs once for each different start and picks once for each different arsenal, however many situations ask for it.
    """
    key, on = list(key), list(on)
    named = situations.select(
        *key, *[F.col(c).alias(f"_on_{c}") for c in on], F.col(state).alias("_start"), F.col(length).cast("int").alias("_n"),
        (F.array_sort(F.array_distinct(arsenal)) if arsenal else F.lit(None).cast("array<string>")).alias("_may"),
    )
    ids = [*[f"_on_{c}" for c in on], "_start"]
    asked = checkpoint(named.where("_n > 0").groupBy(*ids, "_may").agg(F.max("_n").alias("_most")))
    longest = asked.agg(F.max("_most")).first()[0]
    if longest is None:
        cols = [situations[c] for c in key]
        return situations.limit(0).select(*cols, F.lit(1).alias("step"), F.lit("").alias("action"), *([] if seed is not None else [F.lit(0.0).alias("p")]))
    start = asked.select(*ids).distinct().select(*ids, F.col("_start").alias("state"), F.lit(1.0).alias("mass"))
    renamed = actions.withColumnsRenamed({c: f"_on_{c}" for c in on})
    mixes = propagate(start, renamed, model, longest, ids=ids, on=[f"_on_{c}" for c in on])[1]
    allowed = F.col("_may").isNull() | F.array_contains("_may", F.col("action"))
    may = asked.join(mixes, ids).where((F.col("step") <= F.col("_most")) & allowed & (F.col("p") > 0))
    picks = [*ids, "_may", "step"]
    # sums in another order differ by rounding, which must not decide between equals
    if seed is None:
        best = F.min(F.struct((-F.round("p", 9)).alias("less"), "action", "p")).alias("best")
        picked = may.groupBy(*picks).agg(best).select(*picks, "best.action", "best.p")
    else:
        rounded = may.withColumn("p", F.round("p", 9))
        picked = pick_action(rounded.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*picks))), picks, seed)
    each = named.where("_n > 0").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    # structs with equal or with null fields are equal
    same = lambda df: df.withColumn("_asked", F.struct(*ids, "_may", "step"))
    found = same(each).join(same(picked).drop(*ids, "_may", "step"), "_asked", "left")
    return found.select(*key, "step", "action", *(["p"] if seed is None else []))


def predict_sequence(situations: DataFrame, n: int, actions: DataFrame, model: DataFrame, key: Sequence[str], **options) -> DataFrame:
    """(key, step, action, p): the next ``n`` steps of every situation, as ``predict_plan`` makes them."""
    return predict_plan(situations.withColumn("_steps", F.lit(n)), actions, model, key, length="_steps", **options)
