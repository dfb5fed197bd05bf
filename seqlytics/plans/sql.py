"""SQL texts of the test-table adapters, for the side-by-side check."""

KEYS = "season, pitch_of_pa, pitcher_id, batter_id"
ORDER = "game_id, pitch_of_pa, part_id, pitcher_id, rel_speed"

PITCHES = """pitches AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS season, CAST(l_shipdate AS DATE) AS ship_date,
    l_orderkey AS game_id, l_linenumber AS pitch_of_pa, l_suppkey AS pitcher_id, n_regionkey AS batter_id,
    n_name AS team, l_partkey AS part_id, p_type AS pitch_type,
    CASE l_returnflag WHEN 'A' THEN 'Strike' WHEN 'N' THEN 'Ball' WHEN 'R' THEN 'Hit' END AS pitch_call,
    CASE o_orderstatus WHEN 'F' THEN 'Strikeout' WHEN 'O' THEN 'Hit' WHEN 'P' THEN 'Out' END AS play_result,
    round(l_extendedprice * 100) AS rel_speed, l_quantity AS spin_rate, round(l_tax * 100) AS plate_height,
    round(l_discount * 100) AS speed_drop,
    CASE WHEN l_returnflag = 'R' THEN round(l_extendedprice * 100) * (100 - round(l_discount * 100)) END AS exit_speed,
    CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS outs_on_play,
    CAST((l_linenumber - 1) % 4 AS INTEGER) AS balls,
    CAST(CAST(floor(l_quantity) AS BIGINT) % 3 AS INTEGER) AS strikes,
    CAST(l_partkey % 3 AS INTEGER) AS runs_scored
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

# Sequences of events: one per user and day, the situation is the place up to 3.
STEPS = """steps AS (
  SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, event_type AS action,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS success, value,
    row_number() OVER w AS place,
    CAST(least(row_number() OVER w - 1, 3) AS VARCHAR) AS situation
  FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)),
states AS (
  SELECT *, CASE WHEN substr(next_situation, 1, 8) = 'terminal' THEN next_situation
      ELSE next_situation || '_' || action END AS next_state,
    situation || '_' || prev_action AS state
  FROM (SELECT *, coalesce(lag(action) OVER w, 'None') AS prev_action,
      coalesce(lead(situation) OVER w, CASE WHEN success = 1 THEN 'terminal_out' ELSE 'terminal_hit' END)
        AS next_situation
    FROM steps WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)))"""

# The same on games of line items: a strike is a success.
GAMES = f"""gsteps AS (
  SELECT *, CAST(least(row_number() OVER w - 1, 3) AS VARCHAR) AS situation,
    CASE WHEN pitch_call = 'Strike' OR outs_on_play > 0 THEN 1 ELSE 0 END AS success
  FROM pitches WINDOW w AS (PARTITION BY game_id ORDER BY {ORDER})),
gstates AS (
  SELECT *, CASE WHEN substr(next_situation, 1, 8) = 'terminal' THEN next_situation
      ELSE next_situation || '_' || pitch_type END AS next_state,
    situation || '_' || prev_action AS state
  FROM (SELECT *, coalesce(lag(pitch_type) OVER w, 'None') AS prev_action,
      coalesce(lead(situation) OVER w, CASE WHEN success = 1 THEN 'terminal_out' ELSE 'terminal_hit' END)
        AS next_situation
    FROM gsteps WINDOW w AS (PARTITION BY game_id ORDER BY {ORDER})))"""


def model(rows: str = "states", action: str = "action") -> str:
    """t(state, action, next_state, n, p), base, moves."""
    return f"""t AS (
  SELECT state, {action} AS action, next_state, count(*) AS n,
    count(*) / sum(count(*)) OVER (PARTITION BY state, {action}) AS p
  FROM {rows} GROUP BY state, {action}, next_state),
{_BASE}"""


def smoothed_model(alpha: float, rows: str = "states", action: str = "action") -> str:
    """The same with every next state of the model written out for every state and action."""
    return f"""seen AS (SELECT state, {action} AS action, next_state, count(*) AS n FROM {rows} GROUP BY ALL),
t AS (
  SELECT g.state, g.action, x.next_state, coalesce(n, 0) AS n,
    (coalesce(n, 0) + CAST({alpha} AS DOUBLE)) / (total + CAST({alpha} AS DOUBLE) * (SELECT count(DISTINCT next_state) FROM seen)) AS p
  FROM (SELECT state, action, sum(n) AS total FROM seen GROUP BY ALL) g CROSS JOIN (SELECT DISTINCT next_state FROM seen) x
  LEFT JOIN seen s ON s.state = g.state AND s.action = g.action AND s.next_state = x.next_state),
{_BASE}"""


_BASE = """base AS (
  SELECT state, action, sum(p * CASE next_state WHEN 'terminal_out' THEN 1 WHEN 'terminal_hit' THEN -1 ELSE 0 END) AS base
  FROM t GROUP BY state, action),
moves AS (SELECT * FROM t WHERE substr(next_state, 1, 8) <> 'terminal')"""


def _q(i: int, gamma: float, degree: int) -> str:
    value = f"base.base + {gamma} * coalesce(a.ahead, 0)"
    if degree > 1:
        value = f"pow({value}, {degree})"
    return f"""q{i} AS (
  SELECT base.state, base.action, {value} AS q
  FROM base LEFT JOIN (SELECT m.state, m.action, sum(m.p * v.v) AS ahead FROM moves m JOIN v{i} v ON v.state = m.next_state
    GROUP BY m.state, m.action) a ON a.state = base.state AND a.action = base.action)"""


def rounds(n: int, gamma: float = 0.9, degree: int = 1) -> str:
    """v0 ... vn, and qn: q of the values vn."""
    parts = ["v0 AS (SELECT DISTINCT state, CAST(0 AS DOUBLE) AS v FROM t)"]
    for i in range(n):
        parts.append(_q(i, gamma, degree))
        parts.append(f"v{i + 1} AS MATERIALIZED (SELECT state, max(q) AS v FROM q{i} GROUP BY state)")
    parts.append(_q(n, gamma, degree))
    return ",\n".join(parts)


def policy(n: int) -> str:
    """policy(state, action, q): best action of qn."""
    return f"""policy AS (
  SELECT state, action, q FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY q DESC, action) AS rn FROM q{n})
  WHERE rn = 1)"""


def spread(n: int, ids: str, start: str, actions_on: str = "") -> str:
    """m1 ... mn (ids, state, mass) and a1 ... an (ids, action, p) from ``start`` and ``acts``."""
    on = f" AND x.{actions_on} = m.{actions_on}" if actions_on else ""
    parts = [f"space AS (SELECT DISTINCT state FROM t)", f"m1 AS MATERIALIZED ({start})"]
    for i in range(1, n + 1):
        parts.append(f"""p{i} AS MATERIALIZED (
  SELECT m.{ids}, m.state, x.action, m.mass * x.p AS m FROM m{i} m JOIN acts x ON x.state = m.state{on})""")
        parts.append(f"a{i} AS (SELECT {ids}, action, sum(m) AS p FROM p{i} GROUP BY {ids}, action)")
        if i < n:
            parts.append(f"""mv{i} AS MATERIALIZED (
  SELECT p.{ids}, p.state, t.next_state, p.m * t.p AS m FROM p{i} p JOIN t ON t.state = p.state AND t.action = p.action
  WHERE t.next_state IN (SELECT state FROM space))""")
            parts.append(f"""lost{i} AS MATERIALIZED (
  SELECT m.{ids}, m.state, m.mass - coalesce(l.m, 0) AS lost FROM m{i} m
  LEFT JOIN (SELECT {ids}, state, sum(m) AS m FROM mv{i} GROUP BY {ids}, state) l ON l.{ids} = m.{ids} AND l.state = m.state)""")
            parts.append(f"""m{i + 1} AS MATERIALIZED (
  SELECT e.{ids}, e.state, coalesce(i.m, 0) + (e.total - coalesce(l.lost, 0)) / greatest((SELECT count(*) FROM space) - 1, 1) AS mass
  FROM (SELECT g.{ids}, s.state, g.total FROM (SELECT {ids}, sum(lost) AS total FROM lost{i} GROUP BY {ids}) g, space s) e
  LEFT JOIN lost{i} l ON l.{ids} = e.{ids} AND l.state = e.state
  LEFT JOIN (SELECT {ids}, next_state AS state, sum(m) AS m FROM mv{i} GROUP BY {ids}, next_state) i
    ON i.{ids} = e.{ids} AND i.state = e.state)""")
    return ",\n".join(parts)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
