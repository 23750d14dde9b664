"""The registered queries, by the row of the inventory they cover, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.functions import parsing, text
from pennant.operators import bids, coefficients, games, names, postseason, ratings, records, reports, store
from pennant.plans.oracle import _pot, sql
from pennant.sources import files, projection

#: Nations that stand in for the independents and the protected conference, which the test tables do not have.
INDEPENDENTS, PROTECTED = "NATION_3", "NATION_7"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


class League:
    """The derived tables over one set of base tables, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        made = _TABLES[name](self)
        setattr(self, name, made)
        return made

    def _shared(self) -> League:
        """This league with what the postseason's branches all read (sides, team seasons) computed once."""
        other = League(self.spark, self.sf_dir)
        other.games, other.teams, other.members = self.games, self.teams, self.members
        other.sides = store.settled(self.sides)
        other.team_seasons = store.settled(other.team_seasons)
        return other


_TABLES = {
    "shared": lambda x: x._shared(),
    "teams": lambda x: projection.teams(x.spark, x.sf_dir),
    "seasons": lambda x: projection.seasons(x.spark, x.sf_dir),
    "members": lambda x: projection.membership(x.spark, x.sf_dir),
    "games": lambda x: projection.games(x.spark, x.sf_dir),
    "enriched": lambda x: games.enrich(x.games, x.members),
    "sides": lambda x: games.sides(x.enriched),
    "team_parts": lambda x: coefficients.team_components(x.sides),
    "team_seasons": lambda x: coefficients.by_season(x.team_parts, "team_id"),
    "team_rolling": lambda x: coefficients.rolling(x.team_seasons, "team_id"),
    "conf_parts": lambda x: coefficients.conference_components(x.sides),
    "conf_seasons": lambda x: coefficients.by_season(x.conf_parts, "conference"),
    "conf_rolling": lambda x: coefficients.rolling(x.conf_seasons, "conference"),
    "conf_ranks": lambda x: coefficients.conference_ranks(x.conf_rolling),
    "records": lambda x: records.records(x.sides),
    "standings": lambda x: records.standings(x.records, x.teams),
    "bids1": lambda x: bids.allocate(x.conf_ranks, "year1", INDEPENDENTS, PROTECTED),
    "bids2": lambda x: bids.allocate(x.conf_ranks, "year2", INDEPENDENTS, PROTECTED),
    "qualified1": lambda x: bids.qualifiers(x.bids1, x.standings),
    "qualified2": lambda x: bids.qualifiers(x.bids2, x.standings),
    "pots1": lambda x: postseason.pots(x.qualified1, x.team_rolling, x.teams, postseason.YEAR1_POTS),
    "pots2": lambda x: postseason.pots(x.qualified2, x.team_rolling, x.teams),
    "balanced": lambda x: store.settled(postseason.balance(x.shared.pots2)),
    "bracket": lambda x: store.settled(postseason.draw(x.balanced)),
    "pairs": lambda x: postseason.round_of_24(x.bracket),
    "ratings": lambda x: ratings.iterative_ratings(x.games).withColumn("rating", F.round("rating", 6)),
    "rated": lambda x: x.ratings.join(x.members, ["season_year", "team_id"], "left"),
    "twelve": lambda x: ratings.field_of_twelve(x.rated),
    "aliases": lambda x: x.teams.where("team_id % 5 = 0").select(F.concat(F.lit("The "), "team_name").alias("alias"), "team_name"),
    "raw_names": lambda x: x.teams.select(F.when(F.col("team_id") % 5 == 0, F.concat(F.lit("  The "), "team_name")).when(F.col("team_id") % 7 == 0, F.concat("team_name", F.lit(" B"))).otherwise(F.concat("team_name", F.lit(" "))).alias("name")),
}


def query(name: str, final: str | None = None, **more: str):
    """Register a function of the League as a query, with its SQL over the common tables."""

    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(League(spark, sf_dir))
        if final is not None:
            ORACLE_SQL[name] = sql(final, **more)
        return build

    return register


def _plain(name: str, table: str, final: str) -> None:
    query(name, final)(lambda x: getattr(x, table))


CONF_NAMES = """SELECT CASE WHEN c_custkey % 5 = 0 THEN '  The ' || c_name WHEN c_custkey % 7 = 0 THEN c_name || ' B' ELSE c_name || ' ' END AS name FROM customer"""
ALIASES = "SELECT 'The ' || c_name AS alias, c_name AS team_name FROM customer WHERE c_custkey % 5 = 0"

# scans, views, enrichment
_DAY = "* REPLACE (CAST(game_date AS VARCHAR) AS game_date)"
_day = lambda rows: rows.withColumn("game_date", F.col("game_date").cast("string"))
query("sc8_games_scan", f"SELECT {_DAY} FROM game")(lambda x: _day(x.games))
query("sc9_jn1_enriched_view", f"SELECT {_DAY} FROM enriched")(lambda x: _day(x.enriched))
_plain("un1_sides", "sides", "SELECT * FROM side")
query("pf1_pf3_flags", "SELECT game_id, is_nonconference, winner, home_ot_loss, away_ot_loss FROM enriched")(lambda x: x.enriched.select("game_id", "is_nonconference", "winner", "home_ot_loss", "away_ot_loss"))
query("jn2_model_games", "SELECT season_year, game_phase, home_score, away_score, h.team_name AS home_team, a.team_name AS away_team FROM game JOIN team h ON h.team_id = home_team_id JOIN team a ON a.team_id = away_team_id")(
    lambda x: x.games.join(x.teams.select(F.col("team_id").alias("home_team_id"), F.col("team_name").alias("home_team")), "home_team_id").join(x.teams.select(F.col("team_id").alias("away_team_id"), F.col("team_name").alias("away_team")), "away_team_id").select("season_year", "game_phase", "home_score", "away_score", "home_team", "away_team")
)
# coefficients
query("pf4_pf5_team_points", "SELECT game_id, side, CASE WHEN points_for > points_against THEN 2e0 WHEN went_ot = 1 AND points_for < points_against THEN 1e0 ELSE 0e0 END AS points, CASE WHEN points_for IS NULL OR points_against IS NULL THEN 0 ELSE 1 END AS counted FROM side")(
    lambda x: x.sides.select("game_id", "side", coefficients.result_points().alias("points"), coefficients.played().cast("int").alias("counted"))
)
query("ag1_team_nonconf", "SELECT * FROM tnon")(lambda x: coefficients.team_nonconference(x.sides))
query("ag2_team_conf", "SELECT * FROM tconf")(lambda x: coefficients.team_conference(x.sides))
query("ag3_ag4_team_playoff", "SELECT * FROM tplay")(lambda x: coefficients.team_playoff(x.sides))
_plain("ag5_team_by_season", "team_seasons", "SELECT * FROM tyear")
_plain("ag6_ag7_conference_components", "conf_parts", "SELECT * FROM ccomp")
_plain("ag8_conference_by_season", "conf_seasons", "SELECT * FROM cyear")
_plain("ag10_team_rolling", "team_rolling", "SELECT * EXCLUDE s FROM troll")
_plain("ag11_conference_rolling", "conf_rolling", "SELECT * EXCLUDE s FROM croll")
query("wn1_rolling_of_three", "SELECT t.season_year, team_id, formula_version, sum(total_points) AS total_points_5yr FROM tyear y JOIN season t ON y.season_year BETWEEN t.season_year - 2 AND t.season_year GROUP BY ALL")(
    lambda x: coefficients.rolling(x.team_seasons, "team_id", 3).select("season_year", "team_id", "formula_version", "total_points_5yr")
)
query("wn2_team_coe_rank", "SELECT *, CAST(row_number() OVER (PARTITION BY season_year ORDER BY points_per_game DESC, team_id) AS INTEGER) AS coe_rank FROM tyear")(lambda x: coefficients.season_ranks(x.team_seasons, "team_id"))
query("wn3_conference_season_rank", "SELECT *, CAST(row_number() OVER (PARTITION BY season_year ORDER BY points_per_game DESC, conference) AS INTEGER) AS coe_rank FROM cyear")(lambda x: coefficients.season_ranks(x.conf_seasons, "conference"))
_plain("wn4_conference_rank", "conf_ranks", "SELECT * EXCLUDE s FROM crank")
# records and standings
_plain("ag9_records", "records", "SELECT * FROM rec")
_plain("wn6_standings", "standings", "SELECT * FROM stand")
query("jn3_rp10_validation", "SELECT rec.*, conf_rank AS imported_rank FROM rec LEFT JOIN (SELECT * FROM stand WHERE conf_rank <= 3) USING (season_year, conference, team_id)")(lambda x: records.validate(x.records, x.standings.where("conf_rank <= 3")))
query("jn12_known_conferences", "SELECT * FROM rec WHERE (season_year, conference) IN (SELECT (season_year, conference) FROM crank WHERE conf_coe_rank <= 10)")(
    lambda x: x.records.join(x.conf_ranks.where("conf_coe_rank <= 10"), ["season_year", "conference"], "left_semi").select(x.records.columns)
)
# bids and qualifiers
_plain("al2_al4_bids_year1", "bids1", "SELECT * FROM bids_year1")
_plain("al2_al4_bids_year2", "bids2", "SELECT * FROM bids_year2")
query("al4_bids_no_exceptions", "SELECT season_year, conference, CAST(CASE WHEN conf_coe_rank <= 4 THEN 4 WHEN conf_coe_rank = 5 THEN 3 WHEN conf_coe_rank <= 10 THEN 1 ELSE 0 END AS INTEGER) AS bids FROM crank")(lambda x: bids.allocate(x.conf_ranks).select("season_year", "conference", "bids"))
query("rp7_bids_snapshot", "SELECT *, CASE WHEN bids <> base_bids THEN '*' ELSE '' END AS mark FROM bids_year2")(lambda x: reports.bids_snapshot(x.bids2))
query("ag17_total_bids", "SELECT season_year, CAST(sum(bids) AS BIGINT) AS total FROM bids_year2 GROUP BY season_year")(lambda x: x.bids2.groupBy("season_year").agg(F.sum("bids").alias("total")))
_plain("al5_st3_qualifiers", "qualified2", "SELECT * FROM qual_year2")
query("ag14_bid_counts", "SELECT season_year, bid_type, count(*) AS n FROM qual_year2 GROUP BY ALL")(lambda x: x.qualified2.groupBy("season_year", "bid_type").agg(F.count("*").alias("n")))
# pots, draw, first round
query("al8_pots_year1", "SELECT season_year, team_id, pot0 AS pot FROM pot0_year1")(lambda x: x.pots1.select("season_year", "team_id", "pot"))
query("al8_pots_year2", "SELECT season_year, team_id, pot0 AS pot FROM pot0_year2")(lambda x: x.pots2.select("season_year", "team_id", "pot"))
query("al9_balanced_pots", "SELECT season_year, team_id, pot, moved FROM pots_year2")(lambda x: x.balanced.select("season_year", "team_id", "pot", "moved"))
query(
    "al10_nit_pots",
    """SELECT season_year, team_id, CASE WHEN nit THEN CASE WHEN conf_coe_rank <= 6 THEN 1 ELSE 2 END WHEN low AND conf_coe_rank = 7 AND conf_rank = 1 THEN 1 ELSE pot0 END AS pot
FROM (SELECT *, max(nit AND conf_coe_rank BETWEEN 7 AND 10) OVER (PARTITION BY season_year) AS low FROM (SELECT *, conf_coe_rank = 9 AS nit FROM pot0_year2))""",
)(lambda x: postseason.nit_override(x.pots2, x.pots2.where("conf_coe_rank = 9").select("season_year", "team_id")).select("season_year", "team_id", "pot"))
query("al11_draw", f"SELECT season_year, slot, team_id, pot, {postseason.SEED} AS draw_seed FROM bracket")(lambda x: x.bracket.select("season_year", "slot", "team_id", "pot", "draw_seed"))
_PAIRS = """(SELECT season_year, k AS game_no, a.team_id AS team_a, b.team_id AS team_b FROM (SELECT season_year, pick, CAST(unnest(range(1, 9)) AS INTEGER) AS k FROM r24)
JOIN bracket a USING (season_year) JOIN bracket b USING (season_year) WHERE a.slot = 8 + k AND b.slot = 16 + pick[k])"""
query("al12_round_of_24", f"SELECT * FROM {_PAIRS}")(lambda x: x.pairs)
query(
    "al13_hosts",
    f"""SELECT season_year, 'R24' AS round, game_no, CASE WHEN f THEN a.team_id ELSE b.team_id END AS home_team_id, CASE WHEN f THEN a.slot ELSE b.slot END AS home_slot, CASE WHEN f THEN a.pot ELSE b.pot END AS home_pot,
CASE WHEN f THEN b.team_id ELSE a.team_id END AS away_team_id, CASE WHEN f THEN b.slot ELSE a.slot END AS away_slot, CASE WHEN f THEN b.pot ELSE a.pot END AS away_pot, home_is_host_by
FROM (SELECT p.*, a, b, (a.tp, a.ppg) > (b.tp, b.ppg) OR (a.tp, a.ppg) = (b.tp, b.ppg) AND a.team_name <= b.team_name AS f,
CASE WHEN a.tp <> b.tp THEN 'total_points_5yr' WHEN a.ppg <> b.ppg THEN 'points_per_game_5yr' ELSE 'team_name' END AS home_is_host_by
FROM {_PAIRS} p JOIN bracket a ON a.season_year = p.season_year AND a.team_id = team_a JOIN bracket b ON b.season_year = p.season_year AND b.team_id = team_b)""",
)(lambda x: postseason.hosts(x.pairs, x.bracket))
query(
    "jn16_al14_rp9_bracket",
    """SELECT a.season_year, a.slot, b.slot AS other_slot, a.team_id AS team_a, b.team_id AS team_b, CASE WHEN (a.tp, a.ppg, -a.slot) > (b.tp, b.ppg, -b.slot) THEN a.team_id ELSE b.team_id END AS host_team_id, 17 - a.slot AS bye_slot
FROM bracket a JOIN bracket b ON b.season_year = a.season_year AND b.slot = 33 - a.slot WHERE a.slot BETWEEN 9 AND 16""",
)(lambda x: postseason.slot_bracket(x.bracket))
query("jn15_allowed_pairs", "SELECT a.season_year, a.team_id AS team_a, b.team_id AS team_b FROM bracket a JOIN bracket b ON b.season_year = a.season_year AND a.conference <> b.conference WHERE a.pot = 1 AND b.pot = 2")(
    lambda x: x.bracket.where("pot = 1").select("season_year", F.col("team_id").alias("team_a"), F.col("conference").alias("c")).join(x.bracket.where("pot = 2").select("season_year", F.col("team_id").alias("team_b"), "conference"), "season_year").where("c <> conference").select("season_year", "team_a", "team_b")
)
query("sec2_12_checks", "SELECT season_year, count(*) AS teams, count(*) FILTER (pot = 0) AS byes, count(*) FILTER (pot = 1) AS pot1, count(*) FILTER (pot = 2) AS pot2, count(DISTINCT slot) AS slots FROM bracket GROUP BY season_year")(
    lambda x: x.bracket.groupBy("season_year").agg(F.count("*").alias("teams"), *[F.count_if(F.col("pot") == p).alias(n) for p, n in ((0, "byes"), (1, "pot1"), (2, "pot2"))], F.count_distinct("slot").alias("slots"))
)
# the second selection
_TIERS = f"(SELECT * FROM (SELECT season_year, conference, CAST(row_number() OVER (PARTITION BY season_year ORDER BY points_per_game DESC, conference) AS INTEGER) AS tier FROM cyear WHERE conference <> '{INDEPENDENTS}') WHERE tier <= 10)"
query("wn5_tiers", f"SELECT * FROM {_TIERS}")(lambda x: postseason.tiers(x.conf_seasons, INDEPENDENTS))
_FIELD = f"""SELECT season_year, conference, team_id, tier, slot, pot, CASE WHEN pot = 0 THEN 'bye' WHEN conf_rank = 1 THEN 'champion' ELSE 'at_large' END AS bid_type FROM (SELECT *, {_pot('tier', 'slot', 0)} AS pot FROM (
SELECT m.season_year, m.conference, m.team_id, tier, conf_rank, CAST(row_number() OVER (PARTITION BY m.season_year, m.conference ORDER BY coalesce(conf_rank = 1, false) DESC, coalesce(conf_rank, 999), coalesce(coe_rank, 999999), m.team_id) AS INTEGER) AS slot
FROM member m JOIN tier t USING (season_year, conference) LEFT JOIN stand s USING (season_year, conference, team_id) LEFT JOIN tcoe c USING (season_year, team_id)) WHERE slot <= CASE WHEN tier <= 4 THEN 4 WHEN tier = 5 THEN 3 ELSE 1 END)
UNION ALL SELECT season_year, conference, team_id, NULL, slot, slot, 'at_large' FROM (SELECT m.*, CAST(row_number() OVER (PARTITION BY season_year ORDER BY coe_rank, team_id) AS INTEGER) AS slot FROM member m JOIN tcoe USING (season_year, team_id) WHERE conference = '{INDEPENDENTS}') WHERE slot <= 2"""
query("al6_al7_wn8_field", "SELECT *, count(*) OVER (PARTITION BY season_year) AS field_size FROM field2", tier=f"SELECT * FROM {_TIERS}", tcoe="SELECT season_year, team_id, row_number() OVER (PARTITION BY season_year ORDER BY points_per_game DESC, team_id) AS coe_rank FROM tyear", field2=_FIELD)(
    lambda x: postseason.select_field(postseason.tiers(x.shared.conf_seasons, INDEPENDENTS), x.members, x.shared.standings, coefficients.season_ranks(x.shared.team_seasons, "team_id"), INDEPENDENTS)
)
# ratings
_plain("al1_ratings", "ratings", "SELECT season_year, team_id, rating FROM rated")
query("al1_spread_ratings", "SELECT season_year, team_id, rating FROM rated")(lambda x: ratings.iterative_ratings(x.games, in_task=0).withColumn("rating", F.round("rating", 6)))
query("ag12_pf36_decayed", """SELECT end_year, CAST(end_year - 4 AS INTEGER) AS window_start, team_id, round(sum(rating * pow(0.92e0, end_year - season_year)), 4) AS coeff_5yr
FROM rated JOIN (SELECT season_year AS end_year FROM season WHERE season_year - 4 IN (SELECT season_year FROM season)) ON season_year BETWEEN end_year - 4 AND end_year GROUP BY ALL""")(
    lambda x: ratings.decayed(x.ratings).withColumn("coeff_5yr", F.round("coeff_5yr", 4))
)
query("ag13_conference_champions", "SELECT season_year, conference, team_id, rating FROM champ12")(lambda x: ratings.champions(x.rated).select("season_year", "conference", "team_id", "rating"))
_plain("al15_field_of_twelve", "twelve", "SELECT * FROM field12")
query("al16_first_round", "SELECT h.season_year, h.seed AS high_seed, h.team_id AS high_team, l.seed AS low_seed, l.team_id AS low_team FROM field12 h JOIN field12 l ON l.season_year = h.season_year AND h.seed + l.seed = 17 WHERE h.seed BETWEEN 5 AND 8")(lambda x: ratings.first_round_of_twelve(x.twelve))
query("sk6_rounded_ratings", "SELECT season_year, team_id, round(points_per_game, 6) AS points_per_game FROM tyear")(lambda x: store.rounded(x.team_seasons.select("season_year", "team_id", "points_per_game")))
# reports
query("rp1_team_report", "SELECT season_year, total_points, games_counted, points_per_game FROM tyear WHERE team_id = 7 AND season_year BETWEEN 1996 AND 2000")(lambda x: reports.between_seasons(x.team_seasons.where("team_id = 7"), start=1996, end=2000).select("season_year", "total_points", "games_counted", "points_per_game"))
query("rp2_conference_report", "SELECT * FROM cyear WHERE conference = 'NATION_5'")(lambda x: x.conf_seasons.where("conference = 'NATION_5'"))
query("rp4_st2_season_top", "SELECT season_year, team_id, total_points FROM tyear WHERE season_year = 1999 ORDER BY total_points DESC, points_per_game DESC, team_id LIMIT 25")(lambda x: reports.top(reports.between_seasons(x.team_seasons, year=1999), 25, F.desc("total_points"), F.desc("points_per_game"), "team_id").select("season_year", "team_id", "total_points"))
query("rp12_latest_top", "SELECT * EXCLUDE s FROM troll WHERE season_year = (SELECT max(season_year) FROM season) ORDER BY total_points_5yr DESC, team_id LIMIT 20")(
    lambda x: reports.top(x.team_rolling.join(F.broadcast(x.seasons.agg(F.max("season_year").alias("season_year"))), "season_year"), 20, F.desc("total_points_5yr"), "team_id").select(x.team_rolling.columns)
)
query("rp5_jn7_field_view", """SELECT season_year, team_id, team_name, conference, pot, bid_type, CAST(pot = 0 AS INTEGER) AS is_bye, CAST(lower(bid_type) = 'champion' AS INTEGER) AS is_champion, CASE WHEN pot = 0 THEN 0 ELSE 1 END AS sort_group, total_points_5yr
FROM pots_year2 LEFT JOIN troll USING (season_year, team_id)""")(lambda x: reports.field_view(x.balanced.select("season_year", "team_id", "conference", "pot", "bid_type"), x.teams, x.team_rolling))
query("ag15_field_counts", "SELECT season_year, count(*) FILTER (pot = 0) AS byes, count(*) FILTER (bid_type = 'champion') AS champions, count(*) AS teams FROM pots_year2 GROUP BY season_year")(lambda x: reports.field_counts(x.balanced))
query("rp8_wn7_jn4_seed_list", "SELECT season_year, CAST(row_number() OVER (PARTITION BY season_year ORDER BY tp DESC, ppg DESC, team_name) AS INTEGER) AS seed, team_id, team_name, tp AS total_points_5yr, ppg AS points_per_game_5yr, CAST(row_number() OVER (PARTITION BY season_year ORDER BY tp DESC, ppg DESC, team_name) <= 8 AS INTEGER) AS is_bye FROM pot0_year2")(
    lambda x: reports.seed_list(x.qualified2, x.team_rolling, x.teams)
)
query("rp6_st5_selectors", "SELECT DISTINCT season_year, formula_version FROM tyear")(lambda x: x.team_seasons.select("season_year", "formula_version").distinct())
query("st1_mixed_order", "SELECT season_year, conference, team_id, conf_rank, CAST(row_number() OVER (PARTITION BY season_year ORDER BY conference, conf_rank DESC, team_id) AS INTEGER) AS place FROM stand")(
    lambda x: coefficients.ranked(x.standings, "place", "conference", F.desc("conf_rank"), "team_id").select("season_year", "conference", "team_id", "conf_rank", "place")
)
query("pf30_like", "SELECT team_name FROM team WHERE team_name ILIKE '%mer#00000001%' ORDER BY team_name LIMIT 8")(lambda x: reports.like_names(x.teams, "team_name", "MER#00000001"))
query("ag16_counts", "SELECT season_year, count(*) AS games, count(home_score) AS scored, count(*) FILTER (home_conference IS NULL OR away_conference IS NULL) AS outside FROM enriched GROUP BY season_year")(
    lambda x: x.enriched.groupBy("season_year").agg(F.count("*").alias("games"), F.count("home_score").alias("scored"), F.count_if(F.col("home_conference").isNull() | F.col("away_conference").isNull()).alias("outside"))
)
_SEASON = lambda x: reports.season_report(1999, x.teams, x.standings.join(x.records.select("season_year", "team_id", "overall_wins", "overall_losses", "conf_wins", "conf_losses"), ["season_year", "team_id"]) if "overall_wins" not in x.standings.columns else x.standings, x.team_seasons, x.conf_seasons, x.balanced)
query("rp4_standings", "SELECT s.conference, s.conf_rank, team.team_name, r.overall_wins, r.overall_losses, r.conf_wins, r.conf_losses FROM stand s JOIN rec r USING (season_year, team_id) JOIN team USING (team_id) WHERE season_year = 1999")(lambda x: _SEASON(x)["standings"])
query("rp4_teams", "SELECT team_name, total_points, games_counted, points_per_game FROM tyear JOIN team USING (team_id) WHERE season_year = 1999 ORDER BY points_per_game DESC, total_points DESC, team_name LIMIT 25")(lambda x: _SEASON(x)["teams"])
query("rp4_conferences", "SELECT conference, total_points, points_per_game FROM cyear WHERE season_year = 1999")(lambda x: _SEASON(x)["conferences"])
query("rp4_field", "SELECT team_name, conference, pot FROM pots_year2 WHERE season_year = 1999")(lambda x: _SEASON(x)["field"].select("team_name", "conference", "pot"))
# names
query("jn8_resolve", "SELECT name, coalesce(t.team_id, b.team_id) AS team_id FROM raw LEFT JOIN team t ON t.team_name = trim(name) LEFT JOIN al ON al.alias = trim(name) LEFT JOIN team b ON b.team_name = al.team_name", raw=CONF_NAMES, al=ALIASES)(lambda x: names.resolve(x.raw_names, x.teams, x.aliases))
query("jn9_canonical", "SELECT name, coalesce(al.team_name, trim(name)) AS team_name FROM raw LEFT JOIN al ON al.alias = trim(name)", raw=CONF_NAMES, al=ALIASES)(lambda x: names.canonical(x.raw_names, x.aliases))
query("jn13_rp11_unknown", "SELECT DISTINCT trim(name) AS name FROM raw WHERE trim(name) NOT IN (SELECT team_name FROM team UNION SELECT alias FROM al)", raw=CONF_NAMES, al=ALIASES)(lambda x: names.unknown(x.raw_names, x.teams, x.aliases))
query("un2_known_names", "SELECT team_name AS name FROM team UNION SELECT alias FROM al", al=ALIASES)(lambda x: x.teams.select(F.col("team_name").alias("name")).union(x.aliases.select("alias")).distinct())
query("pf25_pf27_pf28_keys", "SELECT team_id, lower(replace(team_name, '#', '')) AS key, list_aggregate(list_sort(string_split(team_name || ' zeta Alpha', ' ')), 'string_agg', ' ') AS sorted, CASE WHEN team_id % 2 = 0 THEN 1e0 / 3 ELSE 0.5e0 END AS common FROM team")(
    lambda x: x.teams.select("team_id", text.team_key(F.concat(F.lit(" "), "team_name", F.lit("  "))).alias("key"), text.sorted_tokens(F.concat("team_name", F.lit(" zeta Alpha"))).alias("sorted"), text.overlap(F.concat("team_name", F.lit(" x")), F.when(F.col("team_id") % 2 == 0, F.concat("team_name", F.lit(" y z"))).otherwise(F.col("team_name"))).alias("common"))
)
query("pf29_confidence", "SELECT season_year, team_id, CASE WHEN conf_win_pct >= 0.92 THEN 'HIGH' WHEN conf_win_pct >= 0.86 THEN 'MED' ELSE 'LOW' END AS confidence FROM rec")(lambda x: x.records.select("season_year", "team_id", text.confidence(F.col("conf_win_pct")).alias("confidence")))
query("jn10_jn11_conference_map", """SELECT season_year, team_id, conference FROM member UNION ALL
SELECT season_year, team_id, arg_max(conference_name, (effective_year_start, conference_name)) FROM season JOIN ali ON effective_year_start <= season_year WHERE (season_year, team_id) NOT IN (SELECT season_year, team_id FROM member) GROUP BY ALL""",
    ali="SELECT c_custkey AS team_id, 'CONF_' || (c_custkey % 8) AS conference_name, CAST(1996 + c_custkey % 3 AS INTEGER) AS effective_year_start FROM customer UNION ALL SELECT c_custkey, 'NEW', 2000 FROM customer WHERE c_custkey % 4 = 0")(
    lambda x: names.conference_map(x.members, x.teams.select("team_id", F.concat(F.lit("CONF_"), (F.col("team_id") % 8).cast("string")).alias("conference_name"), (1996 + F.col("team_id") % 3).cast("int").alias("effective_year_start")).unionByName(x.teams.where("team_id % 4 = 0").select("team_id", F.lit("NEW").alias("conference_name"), F.lit(2000).alias("effective_year_start"))), x.seasons)
)
query("jn14_al17_al18_pf26_suggestions")(lambda x: names.suggest(names.unknown(x.raw_names, x.teams, x.aliases), x.teams, x.aliases, {"Customer#000000007 B": "Customer#000000008"}, explain=False)[0])
# stores
query("sk1_append_keep_first", """SELECT game_id, home_team_id AS v FROM game WHERE game_id % 3 <> 0 UNION ALL SELECT game_id, least(home_team_id, away_team_id) FROM game WHERE game_id % 3 = 0
UNION ALL SELECT NULL, away_team_id FROM game WHERE game_id % 11 = 0""")(
    lambda x: store.append_keep_first(
        x.games.where("game_id % 3 <> 0").select("game_id", F.col("home_team_id").alias("v")),
        x.games.select("game_id", F.explode(F.array("away_team_id", "home_team_id")).alias("v")).unionByName(x.games.where("game_id % 11 = 0").select(F.lit(None).cast("long").alias("game_id"), F.col("away_team_id").alias("v"))),
        ["game_id"], "v",
    )
)
query("sk2_upsert", "SELECT season_year, slot, team_id FROM old WHERE (season_year, slot) NOT IN (SELECT season_year, slot FROM fresh) AND (season_year, team_id) NOT IN (SELECT season_year, team_id FROM fresh) UNION ALL SELECT * FROM fresh",
    old="SELECT season_year, slot, team_id FROM bracket", fresh="SELECT season_year, slot, team_id + 1 AS team_id FROM bracket WHERE slot <= 3")(
    lambda x: store.upsert_keep_last(x.bracket.select("season_year", "slot", "team_id"), x.bracket.where("slot <= 3").select("season_year", "slot", (F.col("team_id") + 1).alias("team_id")), [["season_year", "slot"], ["season_year", "team_id"]], "slot")
)


def _stored(x: League) -> DataFrame:
    """All games, stored in three writes: two thirds of them, all from either side and some without a game_id, all once more."""
    table = store.Stored(x.spark, store.own_path(x.spark, "games"), "game_id long, v long")
    table.append_keep_first(x.games.where("game_id % 3 <> 0").select("game_id", F.col("home_team_id").alias("v")), ["game_id"], "v")
    loose = x.games.where("game_id % 11 = 0").select(F.lit(None).cast("long").alias("game_id"), F.col("away_team_id").alias("v"))
    table.append_keep_first(x.games.select("game_id", F.explode(F.array("away_team_id", "home_team_id")).alias("v")).unionByName(loose), ["game_id"], "v")
    table.append_keep_first(x.games.select("game_id", F.lit(-1).cast("long").alias("v")), ["game_id"], "v")
    return table.read()


def _replaced(x: League) -> DataFrame:
    """The team seasons in partitions; then those of 1999 are replaced by nothing, and those of 2000 by half of them."""
    path, rows = store.own_path(x.spark, "seasons"), store.settled(x.team_seasons)
    store.replace_partitions(rows, path, ["season_year", "formula_version"])
    gone = rows.where("season_year in (1999, 2000)").select("season_year", "formula_version")
    store.replace_partitions(rows.where("season_year = 2000 and team_id % 2 = 0"), path, ["season_year", "formula_version"], gone)
    return x.spark.read.parquet(path).select(rows.columns)


def _rebuilt(x: League) -> DataFrame:
    """What a change of 1997 writes anew: the seasons of three tables with their rows."""
    from pennant.plans import rebuild

    return rebuild.save(x, store.own_path(x.spark, "derived"), [1997], ["team_seasons", "team_rolling", "records"]).withColumnRenamed("table", "name")


_LOOSE = "SELECT NULL, away_team_id FROM game WHERE game_id % 11 = 0"
query("sk1_stored_keep_first", f"SELECT game_id, home_team_id AS v FROM game WHERE game_id % 3 <> 0 UNION ALL SELECT game_id, least(home_team_id, away_team_id) FROM game WHERE game_id % 3 = 0 UNION ALL {_LOOSE}")(_stored)
query("sk3_replaced_partitions", "SELECT * FROM tyear WHERE season_year <> 1999 AND (season_year <> 2000 OR team_id % 2 = 0)")(_replaced)
query("sk8_rebuilt_seasons", """SELECT 'team_seasons' AS name, season_year, count(*) AS n FROM tyear WHERE season_year = 1997 GROUP BY season_year UNION ALL SELECT 'records', season_year, count(*) FROM rec WHERE season_year = 1997 GROUP BY season_year
UNION ALL SELECT 'team_rolling', season_year, count(*) FROM troll WHERE season_year BETWEEN 1997 AND 2001 GROUP BY season_year""")(_rebuilt)
query("sk7_alias_script", "SELECT 'INSERT OR IGNORE INTO team_aliases (alias, team_name) VALUES (''' || replace(alias, '''', '''''') || ''', ''' || replace(team_name, '''', '''''') || ''');' AS value FROM al", al="SELECT 'O''' || c_name AS alias, c_name AS team_name FROM customer")(
    lambda x: store.alias_script(x.teams.select(F.concat(F.lit("O'"), "team_name").alias("alias"), "team_name"))
)
query("al19_membership_backfill", "SELECT DISTINCT season_year, team_id, 'HISTORICAL' AS conference FROM side WHERE conference IS NULL")(lambda x: x.sides.where("conference is null").select("season_year", "team_id", F.lit("HISTORICAL").alias("conference")).distinct())
# sources and parsing
query("sc2_clean_ratings", "SELECT CAST(season_year AS INTEGER) AS season_year, team_name, CAST(max(rating) AS DOUBLE) AS rating FROM (SELECT season_year, team_name, conf_coe_rank + 0e0 AS rating FROM crank JOIN team ON team_id % 25 = conf_coe_rank - 1) GROUP BY ALL")(
    lambda x: files.clean_ratings(x.teams.join(F.broadcast(x.conf_ranks.select("season_year", "conf_coe_rank")), F.col("team_id") % 25 == F.col("conf_coe_rank") - 1).select(F.col("season_year").cast("string").alias("Year"), F.concat(F.lit(" "), "team_name").alias("School"), F.col("conf_coe_rank").cast("string").alias("Score"), F.lit(1).alias("_order"))
        .unionByName(x.teams.select(F.lit("bad").alias("Year"), F.col("team_name").alias("School"), F.lit("1").alias("Score"), F.lit(2).alias("_order"))))
)
query("pf20_pf22_parsing", "SELECT game_id, went_ot AS api, CASE WHEN went_ot = 1 THEN 1 ELSE 0 END AS flag, CAST(game_date AS VARCHAR) AS day FROM game")(
    lambda x: x.games.select("game_id", parsing.flag_from_api(F.when(F.col("went_ot") == 1, "True").otherwise("None")).alias("api"), parsing.flag_from_text(F.when(F.col("went_ot") == 1, " Yes ").otherwise("")).alias("flag"), parsing.game_date(F.concat(F.col("game_date").cast("string"), F.lit("T12:00Z"))).cast("string").alias("day"))
)
_KIND = """CASE WHEN game_phase <> 'regular' AND (game_id % 7 = 0 OR game_id % 6 IN (0, 4) OR home_team_id % 4 = 0 AND away_team_id % 4 = 0) THEN 'playoff' ELSE 'regular' END"""
_PHASE = "CASE WHEN game_phase = 'regular' THEN 'regular' WHEN kind = 'playoff' THEN 'cfp' ELSE 'bowl' END"
_TOP = "CASE WHEN game_id % 10 IN (0, 1) OR game_id % 4 = 0 THEN game_id % 10 = 0 AND game_id % 4 = 0 ELSE game_id % 6 NOT IN (1, 2) END"
_NOTES = ["A CFP Semifinal", "FCS opponent", "Championship Subdivision", "Exhibition for the playoff", "College Football Playoff", None]
_notes = lambda: F.element_at(F.array(*map(F.lit, _NOTES)), (F.col("game_id") % 6 + 1).cast("int"))
_home_class = lambda: F.when(F.col("game_id") % 10 == 0, "FBS ").when(F.col("game_id") % 10 == 1, "fcs")
_away_class = lambda: F.when(F.col("game_id") % 4 == 0, " fbs").otherwise("")
_part = lambda: F.when(F.col("game_phase") == "regular", F.when(F.col("game_id") % 2 == 0, "Regular")).otherwise("postseason")
query("pf15_pf17_classes", f"SELECT game_id, top, kind, {_PHASE} AS phase FROM (SELECT *, {_TOP} AS top, {_KIND} AS kind FROM game)")(
    lambda x: x.games.withColumn("kind", parsing.game_type(parsing.season_part(_part()), F.col("game_id") % 7 == 0, _notes(), (F.col("home_team_id") % 4 == 0) & (F.col("away_team_id") % 4 == 0)))
    .select("game_id", parsing.is_top_division(_home_class(), _away_class(), _notes()).alias("top"), "kind", parsing.game_phase(parsing.season_part(_part()), F.col("kind")).alias("phase"))
)


def _rankings(x: League, entity: DataFrame) -> DataFrame:
    """Weekly polls over entity (season, place, school): the committee's in two weeks, in even seasons a later one two places down."""
    ranks = lambda down: F.transform("all", lambda r: F.struct((r["place"] - down).alias("rank"), F.concat(F.lit(" "), r["school"], F.lit("! ")).alias("school")))
    poll = lambda name, of: F.struct(F.lit(name).alias("poll"), of.alias("ranks"))
    week = lambda w, kind, *polls: F.struct(F.lit(w).alias("week"), F.lit(kind).alias("seasonType"), F.array(*polls).alias("polls"))
    committee = " Playoff Selection Committee"
    later = F.when(F.col("season") % 2 == 0, ranks(2)).otherwise(F.slice(ranks(0), F.lit(1), F.lit(3)))
    weeks = [week(12, "regular", poll(committee, ranks(0))), week(13, "regular", poll("AP Top 25", ranks(4)), poll(committee, ranks(0))), week(15, "regular", poll("AP Top 25", ranks(4)), poll("CFP", later)), week(16, "postseason", poll(committee, ranks(5))), week(17, "regular", poll(committee, ranks(6)))]
    every = entity.groupBy("season").agg(F.sort_array(F.collect_list(F.struct("place", "school"))).alias("all"))
    return every.select("season", F.explode(F.array(*weeks)).alias("w")).select("season", "w.*")


query("pf34_sc5_top_four", "SELECT season_year AS season, lower(conference) AS team FROM crank WHERE conf_coe_rank BETWEEN CASE WHEN season_year % 2 = 0 THEN 3 ELSE 1 END AND CASE WHEN season_year % 2 = 0 THEN 6 ELSE 4 END")(
    lambda x: files.top_four(_rankings(x, x.conf_ranks.select(F.col("season_year").alias("season"), F.col("conf_coe_rank").alias("place"), F.col("conference").alias("school"))))
)


def _payload(x: League) -> DataFrame:
    """The games as an API gives them, half of the names in each spelling, eighteen years later: from before 2014 to after it."""
    name = lambda side: x.teams.select(F.col("team_id").alias(f"{side}_team_id"), F.regexp_replace("team_name", "#", " ").alias(side))
    even = lambda c: F.when(F.col("game_id") % 2 == 0, F.col(c))
    odd = lambda c: F.when(F.col("game_id") % 2 == 1, F.col(c))
    return x.games.join(name("home"), "home_team_id").join(name("away"), "away_team_id").select(
        even("game_id").alias("id"), odd("game_id").alias("gameId"), (F.col("season_year") + 18).alias("season"), F.when(F.col("game_id") % 13 > 0, (F.col("game_id") % 16).cast("int")).alias("week"), _part().alias("seasonType"),
        F.when(F.col("game_id") % 17 > 0, F.concat(F.col("game_date").cast("string"), F.lit("T00:00Z"))).alias("startDate"), even("home").alias("homeTeam"), odd("home").alias("home_team"), F.col("away").alias("awayTeam"),
        F.col("home_score").alias("homePoints"), even("away_score").alias("awayPoints"), odd("away_score").alias("away_points"), _home_class().alias("homeClassification"), _away_class().alias("away_classification"),
        (F.col("game_id") % 3 == 0).cast("string").alias("neutralSite"), F.when(F.col("game_id") % 7 == 0, "true").alias("playoff"), even("went_ot").cast("string").alias("overtimes"), odd("went_ot").cast("string").alias("over_time"), _notes().alias("notes"),
    )


_BEST = "lower(replace({}.team_name, '#', ' ')) IN (SELECT lower(replace(team_name, '#', ' ')) FROM team WHERE team_id BETWEEN CASE WHEN season_year % 2 = 0 THEN 2 ELSE 0 END AND CASE WHEN season_year % 2 = 0 THEN 5 ELSE 3 END)"
query("sc4_sk5_pf19_api_games", f"""SELECT game_id, season_year + 18 AS season_year, week, date, season_type, home_team, away_team, home_score, away_score, went_ot, kind AS game_type, {_PHASE} AS game_phase, neutral_site, notes FROM (
SELECT *, CASE WHEN game_phase <> 'regular' AND (game_id % 7 = 0 OR game_id % 6 IN (0, 4) OR in_h AND in_a AND season_year + 18 BETWEEN 2014 AND 2023) THEN 'playoff' ELSE 'regular' END AS kind FROM (
SELECT game_id, season_year, game_phase, home_score, away_score, went_ot, CASE WHEN game_id % 13 = 0 THEN '' ELSE CAST(game_id % 16 AS VARCHAR) END AS week, CASE WHEN game_id % 17 = 0 THEN '1900-01-01' ELSE CAST(game_date AS VARCHAR) END AS date,
CASE WHEN game_phase = 'regular' THEN 'regular' ELSE 'postseason' END AS season_type, replace(h.team_name, '#', ' ') AS home_team, replace(a.team_name, '#', ' ') AS away_team, CAST(game_id % 3 = 0 AS INTEGER) AS neutral_site,
coalesce(['A CFP Semifinal', 'FCS opponent', 'Championship Subdivision', 'Exhibition for the playoff', 'College Football Playoff', ''][game_id % 6 + 1], '') AS notes, {_BEST.format('h')} AS in_h, {_BEST.format('a')} AS in_a
FROM game JOIN team h ON h.team_id = home_team_id JOIN team a ON a.team_id = away_team_id WHERE home_score IS NOT NULL AND ({_TOP})))""")(
    lambda x: files.api_games(_payload(x), files.top_four(_rankings(x, x.seasons.select((F.col("season_year") + 18).alias("season")).crossJoin(F.broadcast(x.teams.where("team_id < 12").select((F.col("team_id") + 1).cast("int").alias("place"), F.regexp_replace("team_name", "#", " ").alias("school")))))))
)


def _landed(x: League) -> DataFrame:
    """Rows of a games file over all games: some repeated, some with faults, some with names that are no team's."""
    name = lambda side: x.teams.select(F.col("team_id").alias(f"{side}_team_id"), F.concat(F.lit(" "), "team_name").alias(side))
    rows = x.games.where("home_score is not null").join(name("home"), "home_team_id").join(name("away"), "away_team_id")
    rows = rows.select(
        F.when(F.col("game_id") % 37 > 0, F.col("game_id").cast("string")).alias("game_id"), F.col("season_year").cast("string").alias("season_year"), F.when(F.col("game_id") % 2 == 0, "3").otherwise(" ").alias("week"), F.col("game_date").cast("string").alias("date"),
        F.when(F.col("game_id") % 23 == 0, F.concat("home", F.lit("?"))).otherwise(F.col("home")).alias("home_team"), F.col("away").alias("away_team"), F.col("home_score").cast("string").alias("home_score"), F.col("away_score").cast("string").alias("away_score"),
        F.when(F.col("game_id") % 41 == 0, "maybe").when(F.col("went_ot") == 1, "Yes").otherwise("").alias("went_ot"), F.when(F.col("game_id") % 19 == 0, "preseason").when(F.col("game_phase") == "cfp", " Playoff").otherwise("regular").alias("game_type"),
        F.when(F.col("game_id") % 43 > 0, F.col("game_phase")).alias("game_phase"), F.lit("0").alias("neutral_site"), F.lit(" ").alias("notes"), (F.col("game_id") % 29 == 0).alias("again"),
    )
    return rows.unionByName(rows.where("again")).drop("again")


query("ag16_pf23_load_counts", """SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN game_id % 19 = 0 THEN 'game_type' WHEN game_id % 43 = 0 THEN 'game_phase' WHEN game_id % 41 = 0 THEN 'flag' WHEN game_id % 23 = 0 THEN 'unknown team'
WHEN game_id % 37 > 0 AND (game_id % 31 = 0 OR k = 2) THEN 'repeated' ELSE 'inserted' END AS disposition FROM game, (SELECT unnest([1, 2]) AS k) WHERE home_score IS NOT NULL AND (k = 1 OR game_id % 29 = 0)) GROUP BY disposition""")(
    lambda x: games.load_counts(games.load(_landed(x), x.teams, x.aliases, x.games.where("game_id % 31 = 0").select("game_id")))
)
query("pf33_flat_records", "SELECT season_year AS year, team_id, coalesce(CASE WHEN conf_games > 2 THEN conf_wins END, 0) AS conf_wins, overall_losses FROM rec")(
    lambda x: files.flat_records(x.records.select(F.col("season_year").alias("year"), F.col("team_id").alias("team"), "conference", F.when(F.col("conf_games") > 2, F.struct(F.col("conf_wins").alias("wins"), F.col("conf_losses").alias("losses"), F.col("conf_ties").alias("ties"))).alias("conferenceGames"), F.struct(F.col("overall_wins").alias("wins"), F.col("overall_losses").alias("losses"), F.col("overall_ties").alias("ties")).alias("total")))
    .select("year", F.col("team").alias("team_id"), "conf_wins", "overall_losses")
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games to rolling team coefficients, the best 25 of each season."""
    x = League(spark, sf_dir)
    return coefficients.ranked(x.team_rolling, "rank", F.desc("total_points_5yr"), "team_id").where("rank <= 25")


QUERIES["flagship_rolling_top25"] = flagship
ORACLE_SQL["flagship_rolling_top25"] = sql("SELECT * FROM (SELECT * EXCLUDE s, CAST(row_number() OVER (PARTITION BY season_year ORDER BY total_points_5yr DESC, team_id) AS INTEGER) AS rank FROM troll) WHERE rank <= 25")
