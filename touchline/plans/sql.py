"""Pieces of the SQL that checks queries; DuckDB's dialect."""

from __future__ import annotations

import math

from touchline import fixed

N = len(fixed.STATES)

POSITION = "CASE WHEN user_id % 15 < 2 THEN 'GK' WHEN user_id % 15 < 7 THEN 'DEF' WHEN user_id % 15 < 12 THEN 'MID' ELSE 'FWD' END"
WEEK = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1"

PF = f"""
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
pf AS (SELECT user_id AS player_id, {WEEK} AS gameweek, event_id AS fixture_id, {POSITION} AS position, user_id % 20 AS team, 40 + (user_id * 7) % 41 AS price_tenths,
    CAST(floor(value / 12) AS BIGINT) AS points, CASE WHEN k < 15 THEN 0 ELSE least(k, 90) END AS minutes,
    CAST(event_type = 'purchase' AS BIGINT) AS goals, CAST(event_type = 'signup' AS BIGINT) AS assists, CAST(event_type = 'view' AS BIGINT) AS clean_sheets, CAST(event_type = 'error' AS BIGINT) AS yellow_cards,
    k % 4 AS bonus, k % 5 AS saves, k % 3 AS goals_conceded, (k % 10) / 10e0 AS xG, (k % 7) / 10e0 AS xA, CAST(k % 6 AS DOUBLE) AS xP,
    event_id % 2 AS was_home, (user_id + event_id) % 20 + 1 AS opponent_team, 40 + k % 5 AS value FROM e)"""

SUMMED = ["points", "minutes", "goals", "assists", "bonus", "clean_sheets", "goals_conceded", "saves", "yellow_cards"]
LAST = ["position", "team", "price_tenths", "was_home", "opponent_team", "value"]
GW = f"""{PF},
gw AS (SELECT player_id, gameweek, count(*) AS n_fixtures, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in SUMMED)},
    {', '.join(f'avg({c}) AS {c}' for c in ('xG', 'xA', 'xP'))}, {', '.join(f'arg_max({c}, fixture_id) AS {c}' for c in LAST)} FROM pf GROUP BY ALL)"""

OBS = f"""{GW},
o AS (SELECT player_id, gameweek, CAST(points AS DOUBLE) AS y, row_number() OVER (PARTITION BY player_id ORDER BY gameweek) - 1 AS t FROM gw)"""

Q, R, M0, P0 = (f"{x!r}e0" for x in (fixed.PROCESS_NOISE, fixed.OBSERVATION_NOISE, fixed.FIRST_MEAN, fixed.FIRST_VARIANCE))

#: needs WITH RECURSIVE
KF = f"""
kf AS (
    SELECT player_id, gameweek, t, y, {M0} AS am, {P0} AS ap, {M0} + {P0} / ({P0} + {R}) * (y - {M0}) AS m, (1 - {P0} / ({P0} + {R})) * {P0} AS p FROM o WHERE t = 0
    UNION ALL
    SELECT o.player_id, o.gameweek, o.t, o.y, k.m, k.p + {Q}, k.m + (k.p + {Q}) / (k.p + {Q} + {R}) * (o.y - k.m), (1 - (k.p + {Q}) / (k.p + {Q} + {R})) * (k.p + {Q}) FROM kf k JOIN o ON o.player_id = k.player_id AND o.t = k.t + 1)"""


def density(y: str, j: int) -> str:
    mean, sd = fixed.EMISSIONS[j]
    return f"(exp(-0.5e0 * (({y} - {mean}e0) / {sd}e0) * (({y} - {mean}e0) / {sd}e0)) / ({sd}e0 * sqrt(2e0 * pi())))"


def _hm() -> str:
    ahead = [" + ".join(f"h.b{i} * {fixed.TRANSITION[i][j]}e0" for i in range(N)) for j in range(N)]
    first = ", ".join(f"{fixed.INITIAL[j]}e0 AS a{j}, {fixed.INITIAL[j]}e0 * {density('y', j)} AS u{j}" for j in range(N))
    later = ", ".join(f"{ahead[j]} AS a{j}, ({ahead[j]}) * {density('o.y', j)} AS u{j}" for j in range(N))
    total = " + ".join(f"u{j}" for j in range(N))
    every = f"{', '.join(f'a{j}' for j in range(N))}, {', '.join(f'u{j} / ({total}) AS b{j}' for j in range(N))}, {total} AS scale"
    return f"""
hm AS (
    SELECT player_id, gameweek, t, y, {every} FROM (SELECT player_id, gameweek, t, y, {first} FROM o WHERE t = 0)
    UNION ALL
    SELECT player_id, gameweek, t, y, {every} FROM (SELECT o.player_id, o.gameweek, o.t, o.y, {later} FROM hm h JOIN o ON o.player_id = h.player_id AND o.t = h.t + 1))"""


#: needs WITH RECURSIVE
HM = _hm()


def mixture(names: list[str], floor: float = 0.0) -> tuple[str, str]:
    """Mean and variance under a distribution over states."""
    mean = " + ".join(f"{names[j]} * {fixed.EMISSIONS[j][0]}e0" for j in range(N))
    second = " + ".join(f"{names[j]} * {max(fixed.EMISSIONS[j][1] ** 2, floor) + fixed.EMISSIONS[j][0] ** 2}e0" for j in range(N))
    return f"({mean})", f"greatest(0e0, ({second}) - ({mean}) * ({mean}))"


_MEAN, _VAR = mixture([f"a{j}" for j in range(N)])
FUSE = lambda ma, va, mb, vb: (f"(({ma}) / greatest({va}, 1e-6) + ({mb}) / greatest({vb}, 1e-6)) / (1 / greatest({va}, 1e-6) + 1 / greatest({vb}, 1e-6))", f"1 / (1 / greatest({va}, 1e-6) + 1 / greatest({vb}, 1e-6))")
_FM, _FV = FUSE("hmm_mean", f"greatest(hmm_var, {fixed.VARIANCE_FLOOR}e0)", "kf_mean", "kf_var")
AHEAD = f"""
ahead AS (SELECT *, {_FM} AS fused_mean, {_FV} AS fused_var FROM (
    SELECT h.player_id, h.gameweek, h.t, h.y, k.am AS kf_mean, k.ap + {R} AS kf_var, {_MEAN} AS hmm_mean, {_VAR} AS hmm_var FROM hm h JOIN kf k ON k.player_id = h.player_id AND k.t = h.t))"""


def xpoints(x: str, goals: str, assists: str) -> str:
    case = lambda d, other: f"CASE {x}position " + " ".join(f"WHEN '{p}' THEN {v}" for p, v in d.items()) + f" ELSE {other} END"
    return f"""(CASE WHEN {x}minutes > 0 THEN CASE WHEN {x}minutes >= 60 THEN 2e0 ELSE 1e0 END + ({goals}) * ({case(fixed.GOAL_POINTS, 4)}) + ({assists}) * {fixed.ASSIST_POINTS}
        + {x}clean_sheets * ({case(fixed.CLEAN_SHEET_POINTS, 0)}) + floor({x}goals_conceded / 2e0) * ({case(fixed.CONCEDED_POINTS, 0)}) + {x}bonus
        + CASE WHEN {x}position = 'GK' THEN floor({x}saves / 3e0) ELSE 0e0 END - {x}yellow_cards ELSE 0e0 END)"""


XP = f"""{GW},
xp AS (SELECT *, {xpoints('', 'CASE WHEN max(abs(xG)) OVER p > 0 THEN xG ELSE goals END', 'CASE WHEN max(abs(xA)) OVER p > 0 THEN xA ELSE assists END')} AS xpts FROM gw WINDOW p AS (PARTITION BY player_id))"""

FACTORS = """
vf AS (SELECT *, row_number() OVER w AS rn,
    avg(CASE WHEN minutes > 0 THEN points END) OVER past AS overall, count(CASE WHEN minutes > 0 THEN 1 END) OVER past AS n_played,
    avg(CASE WHEN minutes > 0 AND was_home = 1 THEN points END) OVER past AS h_mean, count(CASE WHEN minutes > 0 AND was_home = 1 THEN 1 END) OVER past AS h_n,
    avg(CASE WHEN minutes > 0 AND was_home = 0 THEN points END) OVER past AS a_mean, count(CASE WHEN minutes > 0 AND was_home = 0 THEN 1 END) OVER past AS a_n,
    avg(CASE WHEN minutes > 0 THEN points END) OVER (PARTITION BY player_id, opponent_team ORDER BY gameweek ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o_mean
    FROM gw WINDOW w AS (PARTITION BY player_id ORDER BY gameweek), past AS (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fac AS (SELECT *, CASE WHEN n_played >= 4 AND overall >= 0.5 AND h_n >= 2 THEN least(1.3e0, greatest(0.8e0, h_mean / overall)) ELSE 1e0 END AS home_factor,
    CASE WHEN n_played >= 4 AND overall >= 0.5 AND a_n >= 2 THEN least(1.3e0, greatest(0.8e0, a_mean / overall)) ELSE 1e0 END AS away_factor,
    CASE WHEN opponent_team > 0 AND coalesce(overall, 2e0) >= 0.5 AND o_mean IS NOT NULL THEN least(1.6e0, greatest(0.6e0, o_mean / overall)) ELSE 1e0 END AS opponent_factor FROM vf)"""

_HX = xpoints("h.", "CASE WHEN f.xg_any THEN h.xG ELSE h.goals END", "CASE WHEN f.xa_any THEN h.xA ELSE h.assists END")
ENRICHED = f"""{GW},{FACTORS},
flags AS (SELECT t.player_id, t.rn, max(abs(h.xG)) > 0 AS xg_any, max(abs(h.xA)) > 0 AS xa_any, count(*) AS n, avg(CASE WHEN h.rn >= t.rn - 3 THEN CAST(h.minutes > 0 AS INT) END) AS avail
    FROM fac t JOIN fac h ON h.player_id = t.player_id AND h.rn BETWEEN t.rn - 15 AND t.rn - 1 GROUP BY ALL),
hist AS (SELECT f.player_id, f.rn, h.points, {_HX} AS x, row_number() OVER (PARTITION BY f.player_id, f.rn ORDER BY h.rn) AS i, count(*) OVER (PARTITION BY f.player_id, f.rn) AS n
    FROM flags f JOIN fac h ON h.player_id = f.player_id AND h.rn BETWEEN f.rn - 15 AND f.rn - 1 AND h.minutes > 0),
agg AS (SELECT player_id, rn, max(n) AS n, greatest(0e0, sum(x * pow(0.7e0, n - i) * CASE WHEN i = 1 THEN 1e0 ELSE 0.3e0 END)) AS form, var_pop(points - x) + 1 AS var,
    count(CASE WHEN points - x < 0 THEN 1 END) AS neg_n, sqrt(avg(CASE WHEN points - x < 0 THEN (points - x) * (points - x) END)) AS neg FROM hist GROUP BY ALL),
whole AS (SELECT t.player_id, t.gameweek, t.position, t.team, t.price_tenths, t.points, coalesce(a.n, 0) AS n, f.avail, a.var, CASE WHEN a.neg_n >= 2 THEN a.neg ELSE sqrt(a.var) * 0.5e0 END AS down,
    CASE WHEN t.xP > 0 THEN 0.7e0 * (a.form * CASE WHEN t.was_home = 1 THEN t.home_factor ELSE t.away_factor END * t.opponent_factor) + 0.3e0 * t.xP
         ELSE a.form * CASE WHEN t.was_home = 1 THEN t.home_factor ELSE t.away_factor END * t.opponent_factor END AS form
    FROM fac t LEFT JOIN flags f ON f.player_id = t.player_id AND f.rn = t.rn LEFT JOIN agg a ON a.player_id = t.player_id AND a.rn = t.rn),
enr AS (SELECT player_id, gameweek, position, team, price_tenths, points, CASE WHEN n < 2 OR avail < 0.1 THEN 0e0 ELSE form * avail END AS enr_mean,
    CASE WHEN n < 2 THEN 4e0 WHEN avail < 0.1 THEN 1e0 ELSE avail * var + avail * (1 - avail) * form * form END AS enr_var, CASE WHEN n < 2 OR avail < 0.1 THEN 0e0 ELSE down * avail END AS enr_down FROM whole)"""

NEWS = f"""
news AS (SELECT event_id, user_id AS player_id, {WEEK} AS gameweek, CASE event_type WHEN 'error' THEN 'Ruled out for 3 weeks' WHEN 'click' THEN 'Doubtful for Saturday' WHEN 'view' THEN 'Rotation risk' WHEN 'signup' THEN 'Back in training' ELSE '' END AS news_text,
    CASE k % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'a' WHEN 2 THEN 'd' WHEN 3 THEN 'i' WHEN 4 THEN 's' ELSE 'u' END AS status, CASE WHEN k % 5 <> 0 THEN (k % 5) / 4e0 END AS chance
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
_ANY = lambda ps: "regexp_matches(lower(news_text), '" + "|".join(f"(?:{p})" for p in ps) + "')"
SIGNAL = f"""{NEWS},
sig AS (SELECT *, CASE WHEN trim(news_text) = '' THEN 1e0 WHEN {_ANY(fixed.UNAVAILABLE)} THEN 0e0 WHEN {_ANY(fixed.DOUBTFUL)} THEN 0.5e0 WHEN {_ANY(fixed.POSITIVE)} THEN 0.9e0 ELSE 1e0 END AS availability,
    CASE WHEN trim(news_text) = '' THEN 0e0 WHEN {_ANY(fixed.ROTATION)} THEN 0.7e0 WHEN {_ANY(fixed.DOUBTFUL)} THEN 0.3e0 ELSE 0e0 END AS minutes_risk,
    CASE WHEN trim(news_text) = '' THEN 1e0 WHEN {_ANY(fixed.SURE)} THEN 0.9e0 WHEN {_ANY(fixed.LIKELY)} THEN 0.7e0 WHEN {_ANY(fixed.UNSURE)} THEN 0.4e0 ELSE 0.6e0 END AS confidence FROM news)"""


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c.split('.')[-1]}" for c in columns)


def steady(columns: list[str]) -> str:
    """To six digits; a value just at a boundary is moved off it first, since engines differ there by their last bits."""
    return ", ".join(f"round({c} + 1e-9, 6) AS {c.split('.')[-1]}" for c in columns)


def _viterbi() -> str:
    """The forward pass by recursion over t, five best ways and where each came from; then the way back."""
    log = lambda p: repr(math.log(p + 1e-300)) + "e0"
    seen = lambda y, j: f"greatest(-0.5e0 * (({y} - {fixed.EMISSIONS[j][0]}e0) / {fixed.EMISSIONS[j][1]}e0) * (({y} - {fixed.EMISSIONS[j][0]}e0) / {fixed.EMISSIONS[j][1]}e0) - {math.log(fixed.EMISSIONS[j][1] * math.sqrt(2 * math.pi))!r}e0, {math.log(1e-300)!r}e0)"
    ways = [[f"(v.b{i} + {log(fixed.TRANSITION[i][j])})" for i in range(N)] for j in range(N)]
    first_of = lambda xs: "CASE " + " ".join(f"WHEN {x} >= greatest({', '.join(xs)}) THEN {i}" for i, x in enumerate(xs)) + " END"
    first = ", ".join(f"{log(fixed.INITIAL[j])} + {seen('y', j)} AS b{j}, 0 AS f{j}" for j in range(N))
    later = ", ".join(f"greatest({', '.join(ways[j])}) + {seen('o.y', j)}, {first_of(ways[j])}" for j in range(N))
    ends = first_of([f"v.b{j}" for j in range(N)])
    came = "CASE p.state " + " ".join(f"WHEN {j} THEN v.f{j}" for j in range(N)) + " END"
    return f"""{OBS},
v AS (SELECT player_id, t, {first} FROM o WHERE t = 0 UNION ALL SELECT o.player_id, o.t, {later} FROM v JOIN o ON o.player_id = v.player_id AND o.t = v.t + 1),
p AS (SELECT v.player_id, v.t, {ends} AS state FROM v JOIN (SELECT player_id, max(t) AS t FROM o GROUP BY ALL) l ON l.player_id = v.player_id AND l.t = v.t
    UNION ALL SELECT v.player_id, v.t - 1, {came} FROM p JOIN v ON v.player_id = p.player_id AND v.t = p.t WHERE p.t > 0)"""


#: needs WITH RECURSIVE
VITERBI = _viterbi()
