"""Queries for imputation, encodings, scaling and sequence packing."""

from pyspark.sql import functions as F

from seqlytics.operators import encode as e
from seqlytics.plans.sql import PITCHES, STEPS, with_
from seqlytics.sources.tables import STEP_ORDER, STEP_SEQUENCE, pitches, steps, table


def _gappy_orders(spark, d):
    """Orders with missing numbers and texts."""
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("cust"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.lit(None).cast("double").alias("empty"),
    )


_GAPPY = """g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS cust, nullif(o_orderstatus, 'P') AS status FROM orders)"""


def impute_median(spark, d):
    out = e.impute_median(_gappy_orders(spark, d), ["price", "cust", "empty"])
    return out.withColumns({c: F.round(c, 4) for c in ("price", "cust", "empty")})


def impute_missing(spark, d):
    return e.impute_const(_gappy_orders(spark, d).select("o_orderkey", "status"), ["status"])


def impute_mean_mode(spark, d):
    out = e.impute_mean_mode(_gappy_orders(spark, d).select("o_orderkey", "cust", "status"), ["cust"], ["status"])
    return out.withColumn("cust", F.round("cust", 4))


def label_encode(spark, d):
    return e.label_encode(table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name"), ["p_brand", "p_type", "p_name"])[0]


def apply_labels(spark, d):
    parts = table(spark, d, "part")
    mapping = e.fit_labels(parts.select(F.col("p_type").alias("pitch_type")), ["pitch_type"])
    rows = pitches(spark, d, ["pitcher_id", "pitch_type"])
    coded = e.apply_labels(rows, mapping, ["pitch_type"])
    return coded.groupBy("pitcher_id", "pitch_type").agg(F.count(F.lit(1)).alias("n"))


def standardize(spark, d):
    rows = pitches(spark, d, ["game_id", "spin_rate", "plate_height"]).withColumn("same", F.lit(7.0))
    out = e.standardize(rows, ["spin_rate", "plate_height", "same"])
    return out.withColumns({c: F.round(c, 5) for c in ("spin_rate", "plate_height", "same")})


def _team_rows(spark, d):
    return pitches(spark, d, ["team", "pitcher_id", "spin_rate"])


def target_encode(spark, d):
    return e.fit_target_encoding(_team_rows(spark, d), "pitcher_id", "spin_rate").withColumn("encoding", F.round("encoding", 5))


def apply_target_encode(spark, d):
    known = _team_rows(spark, d)
    overall = known.agg(F.avg("spin_rate")).scalar()
    enc = e.fit_target_encoding(known, "pitcher_id", "spin_rate")
    key = F.col("s_suppkey")
    # every other asked key is one that no row has
    asked = table(spark, d, "supplier").select(F.when(key % 2 == 1, key + 1000000000).otherwise(key).alias("pitcher_id"), "s_name")
    return e.apply_target_encoding(asked, enc, "pitcher_id", overall, "encoding").withColumn("encoding", F.round("encoding", 5))


MI_COLUMNS = ["rel_speed", "spin_rate", "plate_height", "exit_speed", "outs_on_play"]


def mutual_info(spark, d):
    rows = pitches(spark, d, ["play_result", *MI_COLUMNS])
    return e.mutual_info(rows, MI_COLUMNS, "play_result", bins=8, k=4).withColumn("mi", F.round("mi", 6))


def _mi_sql(bins, k):
    long_ = " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS value, play_result AS y FROM pitches WHERE {c} IS NOT NULL" for c in MI_COLUMNS
    )
    edges = ", ".join(f"{i / bins}" for i in range(1, bins))
    return (
        with_(
            PITCHES,
            f"l AS MATERIALIZED ({long_})",
            f"q AS (SELECT name, quantile_cont(value, [{edges}]) AS cuts FROM l GROUP BY name)",
            "b AS (SELECT l.name, y, len(list_filter(q.cuts, lambda c: l.value > c)) AS bin FROM l JOIN q ON l.name = q.name)",
            "j AS (SELECT name, bin, y, count(*) AS c FROM b GROUP BY ALL)",
            """s AS (SELECT name, c, sum(c) OVER (PARTITION BY name) AS n, sum(c) OVER (PARTITION BY name, bin) AS nx,
              sum(c) OVER (PARTITION BY name, y) AS ny FROM j)""",
        )
        + f"SELECT name AS feature, round(sum(c / n * ln(c * n / (nx * ny))), 6) AS mi FROM s GROUP BY name "
        f"ORDER BY sum(c / n * ln(c * n / (nx * ny))) DESC, name LIMIT {k}"
    )


def polynomial_features(spark, d):
    return e.polynomial(pitches(spark, d, ["game_id", "spin_rate", "plate_height", "speed_drop"]), ["spin_rate", "plate_height", "speed_drop"])


def class_weights(spark, d):
    rows = pitches(spark, d, ["pitch_call"])
    out = e.class_weights(rows, "pitch_call", ["Ball", "Hit", "Strike", "Walk"])
    return out.withColumn("weight", F.round("weight", 6))


def column_defaults(spark, d):
    return e.column_defaults(table(spark, d, "part")).withColumn("number", F.round("number", 4))


def fill_from_defaults(spark, d):
    defaults = e.column_defaults(table(spark, d, "part"))
    asked = table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("p_size"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("p_type"),
    )
    return e.fill_from_defaults(asked, defaults, ["p_size", "p_retailprice"], ["p_type", "p_brand"])


def add_noise(spark, d):
    rows = pitches(spark, d, ["game_id", "pitch_of_pa", "spin_rate"])
    return e.add_noise(rows, ["spin_rate"], ["game_id", "pitch_of_pa"], 0.01, 7).withColumn("spin_rate", F.round("spin_rate", 6))


def _draw(seed):
    return f"(('0x' || substr(md5(game_id || '|' || pitch_of_pa || '|{seed}'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"


def min_max(spark, d):
    rows = pitches(spark, d, ["game_id", "spin_rate"]).withColumn("same", F.lit(3.0))
    out = e.min_max(e.min_max(rows, "spin_rate", "scaled"), "same", "one")
    return out.withColumn("scaled", F.round("scaled", 6))


def _weighted(spark, d):
    bad = F.col("o_custkey") % 10 == 0
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.when(bad, F.lit(0.0)).otherwise(F.round(F.col("o_totalprice") * 100)).alias("w")
    )


_WEIGHTED = """w AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 10 = 0 THEN 0.0
  ELSE round(o_totalprice * 100) END AS w FROM orders)"""


def normalize_weights(spark, d):
    return e.normalize_weights(_weighted(spark, d), ["o_custkey"], "w").withColumn("w", F.round("w", 6))


def temper(spark, d):
    return e.temper(_weighted(spark, d), ["o_custkey"], "w", 2.0).withColumn("w", F.round("w", 6))


def one_hot(spark, d):
    return e.one_hot(table(spark, d, "part").select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"], 10)


_KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


# far fewer steps to a part than in use, so that sequences of several parts are read here as well
PART = 2


def _packed(spark, d):
    return e.sequences(steps(spark, d), STEP_SEQUENCE, STEP_ORDER, ["value", "success"], "action", PART)


def ragged_sequences(spark, d):
    """The own steps of each sequence, by part."""
    return _packed(spark, d).select("user_id", F.col("day").cast("string").alias("day"), "part", F.transform("steps", lambda v: v[0]).alias("values"), "length", "longest", "label").withColumn("values", F.to_json("values"))


def padded_sequences(spark, d):
    return e.padded(_packed(spark, d), STEP_SEQUENCE, 2, PART).select(
        "user_id", F.col("day").cast("string").alias("day"), "length", "longest", "label", "part", F.posexplode("steps").alias("pos", "v")
    ).select("user_id", "day", "length", "longest", "label", (F.col("part") * PART + F.col("pos")).alias("pos"), F.col("v")[0].alias("value"), F.col("v")[1].alias("success"))


def surrogate_id(spark, d):
    return e.ensure_seq_id(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "seq_id", ["o_custkey", "o_orderkey"])


def _defaults_sql(col, kind):
    if kind == "number":
        return f"SELECT '{col}' AS name, round(median(CAST({col} AS DOUBLE)), 4) AS number, CAST(NULL AS VARCHAR) AS text FROM part"
    return f"""SELECT '{col}' AS name, CAST(NULL AS DOUBLE) AS number, {col} AS text FROM (
      SELECT {col}, row_number() OVER (ORDER BY count(*) DESC, {col}) AS rn FROM part GROUP BY {col}) WHERE rn = 1"""


QUERIES = {
    "impute_median": (
        impute_median,
        f"""WITH {_GAPPY} SELECT o_orderkey, status, round(coalesce(price, (SELECT median(price) FROM g)), 4) AS price,
          round(coalesce(CAST(cust AS DOUBLE), (SELECT median(cust) FROM g)), 4) AS cust, CAST(0 AS DOUBLE) AS empty FROM g""",
    ),
    "impute_missing": (impute_missing, f"WITH {_GAPPY} SELECT o_orderkey, coalesce(status, 'Missing') AS status FROM g"),
    "impute_mean_mode": (
        impute_mean_mode,
        f"""WITH {_GAPPY} SELECT o_orderkey, round(coalesce(CAST(cust AS DOUBLE), (SELECT avg(cust) FROM g)), 4) AS cust,
          coalesce(status, (SELECT status FROM g WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1))
            AS status FROM g""",
    ),
    "label_encode": (
        label_encode,
        """SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type,
          dense_rank() OVER (ORDER BY p_name) - 1 AS p_name FROM part""",
    ),
    "apply_labels": (
        apply_labels,
        with_(PITCHES, "c AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part))")
        + "SELECT pitcher_id, code AS pitch_type, count(*) AS n FROM pitches JOIN c ON p_type = pitch_type GROUP BY ALL",
    ),
    "standardize": (
        standardize,
        with_(PITCHES)
        + """SELECT game_id, round((spin_rate - avg(spin_rate) OVER ()) / stddev_pop(spin_rate) OVER (), 5) AS spin_rate,
          round((plate_height - avg(plate_height) OVER ()) / stddev_pop(plate_height) OVER (), 5) AS plate_height,
          CAST(0 AS DOUBLE) AS same FROM pitches""",
    ),
    "target_encode": (
        target_encode,
        with_(PITCHES)
        + """SELECT pitcher_id AS value, round(count(*) / (count(*) + 10) * avg(spin_rate)
          + (1 - count(*) / (count(*) + 10)) * (SELECT avg(spin_rate) FROM pitches), 5) AS encoding FROM pitches GROUP BY pitcher_id""",
    ),
    "apply_target_encode": (
        apply_target_encode,
        with_(
            PITCHES,
            "g AS (SELECT avg(spin_rate) AS m FROM pitches)",
            """enc AS (SELECT pitcher_id, count(*) / (count(*) + 10) * avg(spin_rate)
              + (1 - count(*) / (count(*) + 10)) * (SELECT m FROM g) AS e FROM pitches GROUP BY pitcher_id)""",
        )
        + """SELECT CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey + 1000000000 ELSE s_suppkey END AS pitcher_id, s_name,
          round(coalesce(e, (SELECT m FROM g)), 5) AS encoding
          FROM supplier LEFT JOIN enc ON pitcher_id = s_suppkey AND s_suppkey % 2 = 0""",
    ),
    "mutual_info": (mutual_info, _mi_sql(8, 4)),
    "polynomial_features": (
        polynomial_features,
        with_(PITCHES)
        + """SELECT game_id, spin_rate, plate_height, speed_drop, spin_rate * spin_rate AS spin_rate_x_spin_rate,
          spin_rate * plate_height AS spin_rate_x_plate_height, spin_rate * speed_drop AS spin_rate_x_speed_drop,
          plate_height * plate_height AS plate_height_x_plate_height, plate_height * speed_drop AS plate_height_x_speed_drop,
          speed_drop * speed_drop AS speed_drop_x_speed_drop FROM pitches""",
    ),
    "class_weights": (
        class_weights,
        with_(PITCHES, "c AS (SELECT pitch_call, count(*) AS n FROM pitches GROUP BY pitch_call UNION ALL SELECT 'Walk', 0)")
        + """SELECT pitch_call, n, round(coalesce((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * nullif(n, 0)), 0), 6) AS weight
          FROM c""",
    ),
    "column_defaults": (
        column_defaults,
        " UNION ALL ".join(
            [_defaults_sql(c, "number") for c in ("p_partkey", "p_size", "p_retailprice")]
            + [_defaults_sql(c, "text") for c in ("p_name", "p_brand", "p_type")]
        ),
    ),
    "fill_from_defaults": (
        fill_from_defaults,
        """SELECT p_partkey,
          CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE (SELECT median(CAST(p_size AS DOUBLE)) FROM part) END AS p_size,
          (SELECT median(p_retailprice) FROM part) AS p_retailprice,
          CASE WHEN p_partkey % 3 = 0 THEN p_type
            ELSE (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1) END AS p_type,
          (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1) AS p_brand FROM part""",
    ),
    "add_noise": (
        add_noise,
        with_(PITCHES)
        + f"""SELECT game_id, pitch_of_pa, round(spin_rate + sqrt(-2 * ln({_draw(7)})) * cos(2 * pi() * {_draw(8)})
          * (SELECT stddev_pop(spin_rate) FROM pitches) * 0.01, 6) AS spin_rate FROM pitches""",
    ),
    "min_max": (
        min_max,
        with_(PITCHES)
        + """SELECT game_id, spin_rate, CAST(3 AS DOUBLE) AS same, CAST(1 AS DOUBLE) AS one,
          round((spin_rate - min(spin_rate) OVER ()) / (max(spin_rate) OVER () - min(spin_rate) OVER ()), 6) AS scaled FROM pitches""",
    ),
    "normalize_weights": (
        normalize_weights,
        f"""WITH {_WEIGHTED} SELECT o_orderkey, o_custkey, round(CASE WHEN sum(w) OVER c > 0 THEN w / sum(w) OVER c
          ELSE 1 / count(*) OVER c END, 6) AS w FROM w WINDOW c AS (PARTITION BY o_custkey)""",
    ),
    "temper": (
        temper,
        f"""WITH {_WEIGHTED} SELECT o_orderkey, o_custkey, round(CASE WHEN sum(sqrt(w)) OVER c > 0 THEN sqrt(w) / sum(sqrt(w)) OVER c
          ELSE 1 / count(*) OVER c END, 6) AS w FROM w WINDOW c AS (PARTITION BY o_custkey)""",
    ),
    "one_hot": (
        one_hot,
        "SELECT p_partkey, p_brand, " + ", ".join(f"CASE WHEN p_type = '{k}' THEN 1 ELSE 0 END AS p_type_{k}" for k in _KINDS) + " FROM part",
    ),
    "padded_sequences": (
        padded_sequences,
        with_(
            STEPS,
            "ends AS (SELECT user_id, day, count(*) AS length, max_by(action, place) AS label FROM steps GROUP BY user_id, day)",
            "longest AS (SELECT max(length) AS longest FROM ends)",
        )
        + """SELECT e.user_id, strftime(e.day, '%Y-%m-%d') AS day, length, longest, label, CAST(pos AS INTEGER) AS pos,
            coalesce(value, 0) AS value, CAST(coalesce(success, 0) AS DOUBLE) AS success
          FROM ends e, longest, LATERAL (SELECT unnest(range(longest)) AS pos) LEFT JOIN steps s
            ON s.user_id = e.user_id AND s.day = e.day AND s.place = pos + 1""",
    ),
    "ragged_sequences": (
        ragged_sequences,
        with_(
            STEPS,
            "ends AS (SELECT user_id, day, count(*) AS length, max_by(action, place) AS label FROM steps GROUP BY user_id, day)",
        )
        + f"""SELECT s.user_id, strftime(s.day, '%Y-%m-%d') AS day, CAST((place - 1) // {PART} AS INTEGER) AS part,
            '[' || string_agg(CAST(CAST(value AS DOUBLE) AS VARCHAR), ',' ORDER BY place) || ']' AS values, any_value(length) AS length,
            (SELECT max(length) FROM ends) AS longest, any_value(label) AS label
          FROM steps s JOIN ends e ON s.user_id = e.user_id AND s.day = e.day GROUP BY s.user_id, s.day, (place - 1) // {PART}""",
    ),
    "surrogate_id": (
        surrogate_id,
        "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS seq_id FROM orders",
    ),
}
