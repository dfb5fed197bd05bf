"""Queries for the scans and the cleaning operators."""

from pyspark.sql import functions as F

from seqlytics.operators import clean
from seqlytics.plans.sql import PITCHES, with_
from seqlytics.sources.files import newest, read_table
from seqlytics.sources.tables import pitches, table

_CALLS = {
    "AF": "StrikeCalled", "AO": "StrikeSwinging", "NF": "BallCalled",
    "NO": "FoulBallNotFieldable", "RF": "InPlay", "RO": "HitByPitch",
}
_TYPES = {"ECONOMY": "changeup", "MEDIUM": "ChangeUp now", "PROMO": "OneSeamFastBall", "STANDARD": "twoseamfastball"}


def _case(col, mapping, otherwise=None):
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(otherwise)


def _sql_case(col, mapping, otherwise="NULL"):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {otherwise} END"


def _orders(spark, d):
    return table(spark, d, "orders")


def scan_parquet(spark, d):
    return read_table(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"])


def latest_version(spark, d):
    stamp = F.date_format(F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400), "yyyyMMdd_HHmmss")
    names = _orders(spark, d).select(
        F.col("o_orderstatus").alias("kind"),
        F.concat("o_orderstatus", F.lit("_v_")).alias("prefix"),
        F.concat(
            "o_orderstatus", F.lit("_v_"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("zzz")).otherwise(stamp)
        ).alias("name"),
    )
    return newest(names, "name", "prefix", ["kind"])


def drop_columns(spark, d):
    return clean.drop_columns(table(spark, d, "customer"), ["c_name", "c_acctbal"])


def blank_to_null(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return clean.blank_to_null(_orders(spark, d).select("o_orderkey", status.alias("status")))


def parse_dates(spark, d):
    bad = F.col("event_id") % 11 == 0
    raw = table(spark, d, "events").select(
        "event_id",
        F.when(bad, F.lit("no date")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.when(bad, F.lit("25 o'clock")).otherwise(F.date_format("ts", "HH:mm:ss.SSSSSS")).alias("at"),
    )
    parsed = clean.parse_dates(raw, "day", "at")
    return parsed.select(
        "event_id", F.col("day").cast("string").alias("day"), F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")
    )


def _tagged(spark, d):
    tag = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("unDefined "), "o_orderpriority")).otherwise(
        F.col("o_orderpriority")
    )
    return _orders(spark, d).select("o_orderkey", tag.alias("tag"), F.col("o_orderstatus").alias("auto_tag"))


_TAGGED = """tagged AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unDefined ' || o_orderpriority
  ELSE o_orderpriority END AS tag, o_orderstatus AS auto_tag FROM orders)"""
_NULLED = "CASE WHEN NOT regexp_matches(tag, '(?i)^undefined') THEN tag END"


def regex_to_null(spark, d):
    return clean.regex_to_null(_tagged(spark, d), "tag")


def coalesce_tags(spark, d):
    return clean.coalesce_cols(clean.regex_to_null(_tagged(spark, d), "tag"), "clean_tag", "tag", "auto_tag")


def canonical_outcome(spark, d):
    raw = table(spark, d, "lineitem").select(
        _case(F.concat("l_returnflag", "l_linestatus"), _CALLS).alias("raw")
    )
    return clean.canonicalize(raw, "raw", "label").groupBy("raw", "label").agg(F.count(F.lit(1)).alias("n"))


def canonical_action(spark, d):
    raw = table(spark, d, "part").select("p_partkey", _case(F.col("p_type"), _TYPES, F.col("p_type")).alias("raw"))
    return clean.canonicalize_regex(raw, "raw", "label")


def fill_sentinel(spark, d):
    df = clean.regex_to_null(_tagged(spark, d), "tag")
    df = df.withColumn("auto_tag", F.nullif("auto_tag", F.lit("O")))
    return clean.fill_sentinel(df, exclude=["auto_tag"])


def select_columns(spark, d):
    return clean.select_columns(table(spark, d, "part"), ["p_partkey", "p_type", "p_size"])


def normalize_names(spark, d):
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("BatterID"), F.col("c_mktsegment").alias("Segment"))
    return clean.normalize_names(raw, {"batterid": "batter_id", "pitcherid": "pitcher_id"})


def year_ffill(spark, d):
    day = F.when(F.col("o_orderkey") % 3 == 0, F.to_date("o_orderdate"))
    rows = _orders(spark, d).select("o_orderkey", day.alias("day"))
    return clean.year_ffill(rows, "day", ["o_orderkey"]).select("o_orderkey", "year")


def map_values(spark, d):
    labels = {"F": "finished", "O": "open"}
    return clean.map_values(_orders(spark, d).select("o_orderkey", "o_orderstatus"), "o_orderstatus", labels, "label")


def exclude_values(spark, d):
    rows = _orders(spark, d).select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return clean.exclude_values(rows, "status", ["F"])


def filter_members(spark, d):
    rows = _orders(spark, d).select("o_orderkey", "o_orderpriority")
    return clean.filter_eq(rows, "o_orderpriority", ["1-URGENT", "5-LOW"], all_token="All")


def encode_binary(spark, d):
    side = F.when(F.col("l_returnflag") == "A", "R").when(F.col("l_returnflag") == "N", "l")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", side.alias("side"))
    return clean.encode_binary(clean.encode_binary(rows, "side", "side_num"), "hand", "hand_num")


def ensure_numeric(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 4 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("known"),
    )
    return clean.ensure_numeric(rows, ["balance", "known", "absent"])


def distinct_rows(spark, d):
    return clean.distinct_rows(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


def require_columns(spark, d):
    rows = _orders(spark, d).select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("price"),
    )
    return clean.require(rows, ["status", "price"])


def dates_to_epoch(spark, d):
    return clean.dates_to_epoch(table(spark, d, "events").select("event_id", "ts", F.to_date("ts").alias("day")))


def distinct_values(spark, d):
    return clean.distinct_values(table(spark, d, "part"), "p_brand")


def distinct_members(spark, d):
    return clean.members(pitches(spark, d, ["team", "pitcher_id"]), "team", "pitcher_id")


QUERIES = {
    "scan_parquet": (scan_parquet, "SELECT o_orderkey, o_totalprice FROM orders"),
    "latest_version": (
        latest_version,
        """WITH n AS (SELECT o_orderstatus AS kind, o_orderkey % 7 = 0 AS bad, CASE WHEN o_orderkey % 7 = 0 THEN 'zzz'
          ELSE strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y%m%d_%H%M%S') END AS s FROM orders)
        SELECT kind, kind || '_v_' || s AS name FROM (
          SELECT *, row_number() OVER (PARTITION BY kind ORDER BY bad, s DESC) AS rn FROM n) WHERE rn = 1""",
    ),
    "drop_columns": (drop_columns, "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "blank_to_null": (
        blank_to_null,
        "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders",
    ),
    "parse_dates": (
        parse_dates,
        """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day,
          CASE WHEN event_id % 11 <> 0 THEN '1970-01-01 ' || strftime(ts, '%H:%M:%S.%f') END AS at FROM events""",
    ),
    "regex_to_null": (regex_to_null, f"WITH {_TAGGED} SELECT o_orderkey, {_NULLED} AS tag, auto_tag FROM tagged"),
    "coalesce_tags": (
        coalesce_tags,
        f"WITH {_TAGGED} SELECT o_orderkey, {_NULLED} AS tag, auto_tag, coalesce({_NULLED}, auto_tag) AS clean_tag FROM tagged",
    ),
    "canonical_outcome": (
        canonical_outcome,
        f"""WITH r AS (SELECT {_sql_case("l_returnflag || l_linestatus", _CALLS)} AS raw FROM lineitem)
        SELECT raw, CASE WHEN contains(lower(raw), 'strike') THEN 'Strike' WHEN contains(lower(raw), 'ball') THEN 'Ball'
          WHEN contains(lower(raw), 'inplay') THEN 'Hit' WHEN contains(lower(raw), 'hitbypitch') THEN 'Walk'
          WHEN contains(lower(raw), 'foul') THEN 'Foul' ELSE raw END AS label, count(*) AS n FROM r GROUP BY ALL""",
    ),
    "canonical_action": (
        canonical_action,
        f"""WITH r AS (SELECT p_partkey, {_sql_case("p_type", _TYPES, "p_type")} AS raw FROM part)
        SELECT p_partkey, raw, CASE WHEN regexp_matches(raw, '(?i)^changeup$') THEN 'ChangeUp'
          WHEN regexp_matches(raw, '(?i)(twoseamfastball|oneseamfastball)') THEN 'TwoSeamFastBall' ELSE raw END AS label
        FROM r""",
    ),
    "fill_sentinel": (
        fill_sentinel,
        f"""WITH {_TAGGED} SELECT o_orderkey, coalesce({_NULLED}, 'no recorded value') AS tag,
          nullif(auto_tag, 'O') AS auto_tag FROM tagged""",
    ),
    "select_columns": (select_columns, "SELECT p_partkey, p_type, p_size FROM part"),
    "normalize_names": (normalize_names, "SELECT c_custkey AS batter_id, c_mktsegment AS segment FROM customer"),
    "year_ffill": (
        year_ffill,
        """SELECT o_orderkey, CAST(last_value(CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) END IGNORE NULLS)
          OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS INTEGER) AS year FROM orders""",
    ),
    "map_values": (
        map_values,
        "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS label FROM orders",
    ),
    "exclude_values": (
        exclude_values,
        """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders
        WHERE nullif(o_orderstatus, 'P') IS NULL OR o_orderstatus NOT IN ('F')""",
    ),
    "filter_members": (
        filter_members,
        "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
    ),
    "encode_binary": (
        encode_binary,
        """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'N' THEN 'l' END AS side,
          CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE -1 END AS side_num, CAST(0 AS DOUBLE) AS hand_num
        FROM lineitem""",
    ),
    "ensure_numeric": (
        ensure_numeric,
        """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS balance,
          CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal ELSE 0.0 END AS known, CAST(0 AS DOUBLE) AS absent FROM customer""",
    ),
    "distinct_rows": (distinct_rows, "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem"),
    "require_columns": (
        require_columns,
        """SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders
        WHERE o_orderstatus <> 'P' AND o_totalprice > 200000""",
    ),
    "dates_to_epoch": (
        dates_to_epoch,
        "SELECT event_id, epoch_us(ts) * 1000 AS ts, epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) * 1000 AS day FROM events",
    ),
    "distinct_values": (distinct_values, "SELECT DISTINCT p_brand FROM part ORDER BY p_brand"),
    "distinct_members": (
        distinct_members,
        with_(PITCHES) + "SELECT DISTINCT team, pitcher_id FROM pitches ORDER BY ALL",
    ),
}
