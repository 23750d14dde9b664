"""DuckDB SQL with the results of the registered queries, from one set of common table expressions."""

from __future__ import annotations

from pennant.operators.postseason import SEED, shuffles

SIDE = """
SELECT season_year, game_id, went_ot, game_phase, is_nonconference, '{me}' AS side, {me}_team_id AS team_id, {it}_team_id AS opponent_id,
       {me}_conference AS conference, {it}_conference AS opponent_conference, {me}_score AS points_for, {it}_score AS points_against FROM enriched"""

PTS = "CASE WHEN points_for > points_against THEN 2e0 WHEN went_ot = 1 AND points_for < points_against THEN 1e0 ELSE 0e0 END"
GAME = "CASE WHEN points_for IS NULL OR points_against IS NULL THEN 0 ELSE 1 END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0e0 ELSE coalesce(CAST({a} AS DOUBLE) / {b}, 0e0) END"


def _team_base(name: str, flag: int) -> str:
    return f"""SELECT season_year, team_id, sum({PTS}) AS points, CAST(sum({GAME}) AS BIGINT) AS games_counted, '{name}' AS component, 'v0' AS formula_version
FROM side WHERE is_nonconference = {flag} GROUP BY season_year, team_id"""


def _pot(rank: str, finish: str, six: int) -> str:
    return f"""CASE WHEN {rank} <= 2 AND {finish} <= 2 OR {rank} BETWEEN 3 AND 6 AND {finish} = 1 THEN 0
WHEN {rank} <= 2 AND {finish} = 3 OR {rank} IN (3, 4) AND {finish} IN (2, 3) OR {rank} = 5 AND {finish} = 2 OR {six} = 1 AND {rank} = 6 AND {finish} = 2 THEN 1 ELSE 2 END"""


def _rolling(table: str, key: str) -> str:
    r = ratio("total_points_5yr", "games_counted_5yr")
    return f"""SELECT *, s - 4 AS window_start_year, s AS window_end_year, {r} AS points_per_game_5yr FROM (
SELECT t.season_year AS s, t.season_year, {key}, formula_version, sum(total_points) AS total_points_5yr, CAST(sum(games_counted) AS BIGINT) AS games_counted_5yr
FROM {table} y JOIN (SELECT DISTINCT season_year FROM {table}) t ON y.season_year BETWEEN t.season_year - 4 AND t.season_year GROUP BY ALL)"""


def _bids(ruleset: str, ind: str = "NATION_3", mid: str = "NATION_7") -> dict[str, str]:
    six = 2 if ruleset == "year1" else 1
    p = ruleset
    return {
        f"b0_{p}": f"""SELECT season_year, conference, conf_coe_rank, base_bids, CASE WHEN conference = '{ind}' THEN least(base_bids, 2) WHEN conference = '{mid}' THEN greatest(base_bids, 1) ELSE base_bids END AS b
FROM (SELECT *, CASE WHEN conf_coe_rank <= 4 THEN 4 WHEN conf_coe_rank = 5 THEN 3 WHEN conf_coe_rank = 6 THEN {six} WHEN conf_coe_rank <= 10 THEN 1 ELSE 0 END AS base_bids FROM crank)""",
        f"b1_{p}": f"""SELECT *, sum(b) OVER (PARTITION BY season_year) AS total, CASE WHEN b > 1 AND conference <> '{mid}' THEN b - 1 ELSE 0 END AS give,
greatest(CASE WHEN conference = '{ind}' THEN 2 ELSE 4 END - b, 0) AS take FROM b0_{p}""",
        f"b2_{p}": f"""SELECT *, coalesce(sum(give) OVER (PARTITION BY season_year ORDER BY conf_coe_rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS given,
coalesce(sum(take) OVER (PARTITION BY season_year ORDER BY conf_coe_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM b1_{p}""",
        f"bids_{p}": f"""SELECT season_year, conference, conf_coe_rank, base_bids, CAST(b - least(greatest(total - 24 - given, 0), give) + least(greatest(24 - total - taken, 0), take) AS INTEGER) AS bids FROM b2_{p}""",
        f"qual_{p}": f"""SELECT season_year, conference, team_id, conf_rank, conf_coe_rank, CASE WHEN conf_rank = 1 THEN 'champion' ELSE 'at_large' END AS bid_type
FROM stand JOIN bids_{p} USING (season_year, conference) WHERE conf_rank <= bids""",
        f"pot0_{p}": f"""SELECT q.*, team_name, coalesce(r.total_points_5yr, 0e0) AS tp, coalesce(r.points_per_game_5yr, 0e0) AS ppg, {_pot('conf_coe_rank', 'conf_rank', 1 if six == 2 else 0)} AS pot0
FROM qual_{p} q JOIN team USING (team_id) LEFT JOIN troll r ON r.season_year = q.season_year AND r.team_id = q.team_id""",
        f"pot1_{p}": f"""SELECT *, count(*) FILTER (pot0 = 1) OVER (PARTITION BY season_year) AS p1, count(*) FILTER (pot0 = 2) OVER (PARTITION BY season_year) AS p2,
row_number() OVER (PARTITION BY season_year, pot0 ORDER BY tp DESC, ppg DESC, conf_coe_rank, conf_rank, team_name DESC, team_id DESC) AS best,
row_number() OVER (PARTITION BY season_year, pot0 ORDER BY tp, ppg, conf_coe_rank, conf_rank, team_name, team_id) AS worst FROM pot0_{p}""",
        f"pots_{p}": f"""SELECT season_year, conference, team_id, team_name, conf_rank, conf_coe_rank, bid_type, tp, ppg,
CASE WHEN pot0 = 2 AND best <= greatest(least(8 - p1, p2 - 8), 0) THEN 1 WHEN pot0 = 1 AND worst <= greatest(least(p1 - 8, 8 - p2), 0) THEN 2 ELSE pot0 END AS pot,
CAST(CASE WHEN pot0 = 2 AND best <= greatest(least(8 - p1, p2 - 8), 0) THEN best WHEN pot0 = 1 AND worst <= greatest(least(p1 - 8, 8 - p2), 0) THEN worst ELSE 0 END AS INTEGER) AS moved FROM pot1_{p}""",
    }


def _ratings(rounds: int = 15) -> dict[str, str]:
    found = {
        "rt": "SELECT season_year, team_id, count(*) OVER (PARTITION BY season_year) AS n FROM (SELECT DISTINCT season_year, team_id FROM side)",
        "edge": """SELECT season_year, CASE WHEN home_score > away_score THEN home_team_id ELSE away_team_id END AS w, CASE WHEN home_score > away_score THEN away_team_id ELSE home_team_id END AS l,
CASE game_phase WHEN 'bowl' THEN 2e0 WHEN 'cfp' THEN 3e0 ELSE 1e0 END AS weight FROM game WHERE home_score <> away_score""",
        "gain": "SELECT season_year, w AS team_id, l AS source, sum(weight) AS f FROM edge GROUP BY ALL UNION ALL SELECT season_year, l, w, sum(weight) * 0.15e0 FROM edge GROUP BY ALL",
        "r0": "SELECT season_year, team_id, 1e0 AS rating FROM rt",
    }
    for k in range(1, rounds + 1):
        found[f"s{k}"] = f"SELECT g.season_year, g.team_id, sum(r.rating * f) AS s FROM gain g JOIN r{k - 1} r ON r.season_year = g.season_year AND r.team_id = g.source GROUP BY ALL"
        found[f"r{k}"] = f"SELECT rt.season_year, rt.team_id, coalesce(s, 0e0) * n / sum(s) OVER (PARTITION BY rt.season_year) AS rating FROM rt LEFT JOIN s{k} USING (season_year, team_id)"
    found["rated"] = f"SELECT season_year, team_id, round(rating, 6) AS rating, conference FROM r{rounds} LEFT JOIN member USING (season_year, team_id)"
    found["champ12"] = "SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY season_year, conference ORDER BY rating DESC, team_id) AS k FROM rated WHERE conference IS NOT NULL) WHERE k = 1"
    found["auto12"] = "SELECT season_year, team_id, ar FROM (SELECT *, row_number() OVER (PARTITION BY season_year ORDER BY rating DESC, team_id) AS ar FROM champ12) WHERE ar <= 5"
    found["pool12"] = "SELECT r.*, ar, row_number() OVER (PARTITION BY r.season_year, ar IS NULL ORDER BY rating DESC, team_id) AS ork FROM rated r LEFT JOIN auto12 a USING (season_year, team_id)"
    found["field12"] = """SELECT season_year, CAST(row_number() OVER (PARTITION BY season_year ORDER BY CASE WHEN ar <= 4 THEN ar ELSE 99 END, rating DESC, team_id) AS INTEGER) AS seed, team_id, conference,
CASE WHEN ar IS NULL THEN 'at_large' ELSE 'auto' END AS bid_type, rating FROM pool12 WHERE ar IS NOT NULL OR ork <= 7"""
    return found


_DRAWN = ", ".join(f"({pot}, {old + 1}, {8 * pot + new + 1})" for pot, places in enumerate(shuffles((8, 8, 8), SEED)) for new, old in enumerate(places))

COMMON = {
    "n": "SELECT count(*) AS n FROM customer",
    "team": "SELECT c_custkey AS team_id, c_name AS team_name FROM customer",
    "season": "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS season_year FROM orders",
    "member": "SELECT c_custkey AS team_id, season_year, n_name AS conference FROM customer JOIN nation ON n_nationkey = c_nationkey CROSS JOIN season WHERE c_mktsegment <> 'HOUSEHOLD'",
    "game": """SELECT o_orderkey AS game_id, CAST(year(o_orderdate) AS INTEGER) AS season_year, CAST(o_orderdate AS DATE) AS game_date, o_custkey AS home_team_id,
(o_custkey + 1 + o_orderkey % (n - 1)) % n AS away_team_id,
CASE WHEN o_orderkey % 97 <> 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 50 AS INTEGER) END AS home_score,
CASE WHEN o_orderkey % 97 <> 0 THEN CAST(CAST(floor(o_totalprice / 50) AS BIGINT) % 50 AS INTEGER) END AS away_score,
CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS went_ot,
CASE WHEN month(o_orderdate) = 1 AND o_orderpriority = '1-URGENT' THEN 'cfp' WHEN month(o_orderdate) = 1 THEN 'bowl' ELSE 'regular' END AS game_phase FROM orders, n""",
    "enriched": """SELECT g.*, h.conference AS home_conference, a.conference AS away_conference, CAST(h.conference <> a.conference AS INTEGER) AS is_nonconference,
CASE WHEN home_score > away_score THEN 'home' WHEN away_score > home_score THEN 'away' WHEN home_score = away_score THEN 'tie' END AS winner,
CASE WHEN home_score IS NOT NULL AND away_score IS NOT NULL THEN CAST(went_ot = 1 AND home_score < away_score AS INTEGER) END AS home_ot_loss,
CASE WHEN home_score IS NOT NULL AND away_score IS NOT NULL THEN CAST(went_ot = 1 AND away_score < home_score AS INTEGER) END AS away_ot_loss
FROM game g LEFT JOIN member h ON h.team_id = home_team_id AND h.season_year = g.season_year LEFT JOIN member a ON a.team_id = away_team_id AND a.season_year = g.season_year""",
    "side": SIDE.format(me="home", it="away") + " UNION ALL " + SIDE.format(me="away", it="home"),
    "tnon": _team_base("nonconf_base", 1),
    "tconf": _team_base("conf_base", 0),
    "tgames": "SELECT season_year, team_id, count(*) AS n FROM side WHERE game_phase = 'cfp' GROUP BY ALL",
    "tplay": """SELECT season_year, team_id, 6e0 AS points, CAST(1 AS BIGINT) AS games_counted, 'playoff_participation' AS component, 'v0' AS formula_version FROM tgames
UNION ALL SELECT season_year, team_id, n * 1.5e0, n, 'playoff_games', 'v0' FROM tgames""",
    "tcomp": "SELECT * FROM tnon UNION ALL SELECT * FROM tconf UNION ALL SELECT * FROM tplay",
    "tyear": f"SELECT *, {ratio('total_points', 'games_counted')} AS points_per_game FROM (SELECT season_year, team_id, formula_version, sum(points) AS total_points, CAST(sum(games_counted) AS BIGINT) AS games_counted FROM tcomp GROUP BY ALL)",
    "troll": _rolling("tyear", "team_id"),
    "cgames": "SELECT season_year, conference, count(*) AS n, count(DISTINCT team_id) AS teams FROM side WHERE game_phase = 'cfp' AND conference IS NOT NULL GROUP BY ALL",
    "ccomp": f"""SELECT season_year, conference, 'nonconf_base' AS component, sum(CASE WHEN is_nonconference = 1 THEN {PTS} ELSE 0e0 END) AS points,
count(*) FILTER (is_nonconference = 1) AS games_counted, 'v0' AS formula_version FROM side WHERE conference IS NOT NULL GROUP BY ALL
UNION ALL SELECT season_year, conference, 'playoff_participation', 6e0 * teams, teams, 'v0' FROM cgames UNION ALL SELECT season_year, conference, 'playoff_games', 1.5e0 * n, n, 'v0' FROM cgames""",
    "cyear": f"""SELECT *, {ratio('total_points', 'games_counted')} AS points_per_game FROM (SELECT season_year, conference, formula_version, sum(points) AS total_points,
CAST(sum(CASE WHEN component <> 'playoff_participation' THEN games_counted ELSE 0 END) AS BIGINT) AS games_counted FROM ccomp GROUP BY ALL)""",
    "croll": _rolling("cyear", "conference"),
    "crank": "SELECT *, CAST(row_number() OVER (PARTITION BY season_year ORDER BY total_points_5yr DESC, points_per_game_5yr DESC, conference) AS INTEGER) AS conf_coe_rank FROM croll",
    "rec0": "SELECT season_year, conference, team_id, " + ", ".join(
        f"count(*) FILTER ({flag}{extra}) AS {p}_{name}"
        for p, extra in (("conf", " AND conference = opponent_conference"), ("overall", ""))
        for name, flag in (("wins", "points_for > points_against"), ("losses", "points_for < points_against"), ("ties", "points_for = points_against"), ("games", "points_for IS NOT NULL AND points_against IS NOT NULL"))
    ) + " FROM side WHERE conference IS NOT NULL GROUP BY ALL",
    "rec": f"SELECT *, {ratio('(conf_wins + 0.5e0 * conf_ties)', 'conf_games')} AS conf_win_pct, {ratio('(overall_wins + 0.5e0 * overall_ties)', 'overall_games')} AS overall_win_pct FROM rec0",
    "stand": """SELECT season_year, conference, team_id, team_name, CAST(row_number() OVER (PARTITION BY season_year, conference ORDER BY conf_win_pct DESC, conf_wins DESC, conf_losses, overall_win_pct DESC,
overall_wins DESC, team_name, team_id) AS INTEGER) AS conf_rank FROM rec JOIN team USING (team_id)""",
    **_bids("year1"),
    **_bids("year2"),
    "placed": "SELECT *, row_number() OVER (PARTITION BY season_year, pot ORDER BY moved, conference, team_id) AS place FROM pots_year2",
    "bracket": f"SELECT p.* EXCLUDE place, d.slot FROM placed p JOIN (VALUES {_DRAWN}) d(pot, place, slot) ON d.pot = p.pot AND d.place = p.place",
    "r24": """SELECT season_year, max(pick) AS pick FROM (SELECT season_year, arg_min(path, key) AS pick FROM walk WHERE len(path) = 8 GROUP BY season_year) GROUP BY season_year""",
    **_ratings(),
}

#: All perfect matchings of the bracket's second pots, the options of each place in the order that prefers the team across.
WALK = """walk(season_year, path, key) AS (
SELECT DISTINCT season_year, CAST([] AS INTEGER[]), CAST([] AS INTEGER[]) FROM bracket
UNION ALL
SELECT w.season_year, list_append(w.path, b.slot - 16), list_append(w.key, CASE WHEN b.slot - 16 = len(w.path) + 1 THEN 0 ELSE b.slot END)
FROM walk w JOIN bracket a ON a.season_year = w.season_year AND a.slot = 9 + len(w.path) JOIN bracket b ON b.season_year = w.season_year AND b.slot > 16
WHERE a.conference <> b.conference AND NOT list_contains(w.path, b.slot - 16))"""


def sql(final: str, **more: str) -> str:
    """The final SELECT over the common tables and some more of its own."""
    tables = {**COMMON, **more}
    parts = [f"{name} AS ({body})" for name, body in tables.items()]
    at = next(k for k, name in enumerate(tables) if name == "bracket") + 1
    parts.insert(at, WALK)
    for k, name in enumerate(tables):  # what many others read is computed once
        if name in ("side", "tyear", "cyear", "stand", "crank", "bracket", "rt", "gain") or name[0] in "rs" and name[1:].isdigit():
            parts[k + (k >= at)] = f"{name} AS MATERIALIZED ({tables[name]})"
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final
