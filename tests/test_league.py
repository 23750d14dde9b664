"""Hand-computed cases and properties of the league's operators."""

import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pennant.functions import parsing, text
from pennant.operators import bids, coefficients, games, names, postseason, ratings, records, reports, store
from pennant.plans import queries as league
from pennant.sources import files
from pennant.streaming import ingest

SF = "/root/testdata/sf0.001"
GAME = "game_id long, season_year int, home_team_id long, away_team_id long, home_score int, away_score int, went_ot int, game_phase string"


def enriched(spark, rows, members):
    return games.enrich(spark.createDataFrame(rows, GAME), spark.createDataFrame(members, "team_id long, season_year int, conference string"))


def test_flags_and_counters(spark):
    rows = [(1, 2014, 1, 2, 10, 20, 1, "regular"), (2, 2014, 1, 2, None, None, 0, "cfp"), (3, 2014, 1, 3, 7, 7, 0, "regular"), (4, 2014, 2, 1, 3, 1, 0, "cfp")]
    both = enriched(spark, rows, [(1, 2014, "A"), (2, 2014, "B")])
    by_id = {r.game_id: r for r in both.collect()}
    assert (by_id[1].winner, by_id[1].home_ot_loss, by_id[1].away_ot_loss, by_id[1].is_nonconference) == ("away", 1, 0, 1)
    assert (by_id[3].winner, by_id[3].is_nonconference, by_id[2].winner, by_id[2].home_ot_loss) == ("tie", None, None, None)
    sides = games.sides(both)
    team = {r.team_id: r for r in coefficients.by_season(coefficients.team_components(sides), "team_id").collect()}
    # an overtime loss 1, participation 6, two playoff games 3; games 2 of base, 1 for participation, 2 of the playoff
    assert (team[1].total_points, team[1].games_counted) == (10.0, 5)
    conference = {r.conference: r for r in coefficients.by_season(coefficients.conference_components(sides), "conference").collect()}
    assert (conference["A"].total_points, conference["A"].games_counted) == (10.0, 5)  # three base games, the one without scores too


def test_rolling_keeps_absent_entities(spark):
    totals = spark.createDataFrame([(2014, 1, "v0", 2.0, 1), (2016, 1, "v0", 4.0, 1), (2018, 2, "v0", 1.0, 1)], "season_year int, team_id long, formula_version string, total_points double, games_counted long")
    found = {(r.season_year, r.team_id): r.total_points_5yr for r in coefficients.rolling(totals, "team_id").collect()}
    assert found[2018, 1] == 6.0 and found[2016, 1] == 6.0 and (2014, 2) not in found


@pytest.mark.parametrize("ruleset, changes, expected", [
    ("year1", {}, [4, 4, 4, 4, 3, 1, 1, 1, 1, 1]),
    ("year2", {2: bids.INDEPENDENTS}, [4, 2, 4, 4, 4, 2, 1, 1, 1, 1]),
])
def test_bids(spark, ruleset, changes, expected):
    ranks = spark.createDataFrame([(2014, changes.get(k, f"C{k}"), k) for k in range(1, 11)], "season_year int, conference string, conf_coe_rank int")
    found = bids.allocate(ranks, ruleset).orderBy("conf_coe_rank").collect()
    assert [r.bids for r in found] == expected


def test_bids_as_one_by_one(spark):
    generator, rows, expected = random.Random(5), [], {}
    for season in range(60):
        field = generator.choice([20, 24, 30])
        place = generator.sample(range(1, 13), 2)
        confs = {k: bids.INDEPENDENTS if k == place[0] else bids.PROTECTED if k == place[1] else f"C{k:02}" for k in range(1, 13)}
        now = {k: [4, 4, 4, 4, 3, 2, 1, 1, 1, 1, 0, 0][k - 1] for k in confs}
        now[place[0]], now[place[1]] = min(now[place[0]], 2), max(now[place[1]], 1)
        while sum(now.values()) > field and (can := [k for k in now if now[k] > 1 and k != place[1]]):
            now[max(can)] -= 1
        while sum(now.values()) < field and (can := [k for k in now if now[k] < (2 if k == place[0] else 4)]):
            now[min(can)] += 1
        rows += [(season, confs[k], k, field) for k in confs]
        expected |= {(season, k): now[k] for k in confs}
    ranks = spark.createDataFrame(rows, "season_year int, conference string, conf_coe_rank int, field int")
    for field in (20, 24, 30):
        for r in bids.allocate(ranks.where(F.col("field") == field), "year1", field=field).collect():
            assert r.bids == expected[r.season_year, r.conf_coe_rank]


def test_balance_promotes_the_strongest(spark):
    teams = [(k, "pot", 0 if k < 8 else 1 if k < 15 else 2, float(k % 20), 9, 9, f"T{k:02}") for k in range(24)]
    potted = spark.createDataFrame([(2014, k, pot, tp, 1.0, r, f, n, "C", 0) for k, _, pot, tp, r, f, n in teams],
        "season_year int, team_id long, pot int, total_points_5yr double, points_per_game_5yr double, conf_coe_rank int, conf_rank int, team_name string, conference string, moved int")
    found = {r.team_id: (r.pot, r.moved) for r in postseason.balance(potted).collect()}
    assert found[19] == (1, 1) and sum(pot == 1 for pot, _ in found.values()) == 8


def test_draw_permutations():
    assert postseason.shuffles((8, 8, 8)) == [[2, 4, 3, 1, 6, 7, 0, 5], [5, 6, 2, 3, 7, 1, 4, 0], [1, 7, 3, 5, 4, 6, 2, 0]]


def test_round_of_24(spark):
    def bracket(second):
        rows = [(2014, 9 + k, 1, k, f"A{k}") for k in range(8)] + [(2014, 17 + k, 2, 100 + k, c) for k, c in enumerate(second)]
        return spark.createDataFrame(rows, "season_year int, slot int, pot int, team_id long, conference string")

    straight = postseason.round_of_24(bracket([f"B{k}" for k in range(8)])).collect()
    assert [r.team_b for r in sorted(straight, key=lambda r: r.game_no)] == [100 + k for k in range(8)]
    crossed = postseason.round_of_24(bracket(["A0", *[f"B{k}" for k in range(1, 8)]])).collect()
    assert [r.team_b for r in sorted(crossed, key=lambda r: r.game_no)][:2] == [101, 100]


def test_ratings(spark):
    rows = [(1, 2014, 1, 2, 9, 3, 0, "regular"), (2, 2015, 1, 2, 3, 3, 0, "regular"), (3, 2016, 3, 4, None, 2, 0, "cfp")]
    found = {(r.season_year, r.team_id): r.rating for r in ratings.iterative_ratings(spark.createDataFrame(rows, GAME)).collect()}
    a = b = 1.0
    for _ in range(15):
        a, b = b, a * 0.15
        a, b = a * 2 / (a + b), b * 2 / (a + b)
    assert found[2014, 1] == pytest.approx(a) and found[2014, 2] == pytest.approx(b)
    assert found[2015, 1] == found[2015, 2] == found[2016, 3] == 1.0


def test_seasons_ratings_mean_is_one(spark):
    means = league.QUERIES["al1_ratings"](spark, SF).groupBy("season_year").agg(F.avg("rating").alias("m")).collect()
    assert all(r.m == pytest.approx(1, abs=1e-4) for r in means)


def test_wins_are_losses(spark):
    found = league.QUERIES["un1_sides"](spark, SF).agg(F.count_if(F.col("points_for") > F.col("points_against")).alias("w"), F.count_if(F.col("points_for") < F.col("points_against")).alias("l")).first()
    assert found.w == found.l > 0


def test_flags_from_text(spark):
    rows = spark.createDataFrame([(v,) for v in ["", "Yes", "0", "7", "maybe", None]], "v string")
    assert [r[0] for r in rows.select(parsing.flag_from_text(F.col("v"))).collect()] == [0, 1, 0, 1, None, 0]
    api = spark.createDataFrame([(v,) for v in ["True", "false", None, "3", "-1", "x"]], "v string")
    assert [r[0] for r in api.select(parsing.flag_from_api(F.col("v"))).collect()] == [1, 0, 0, 1, 0, 0]
    days = spark.createDataFrame([("2014-09-06T12:00Z",), ("no date",), (None,)], "v string")
    assert [str(r[0]) for r in days.select(parsing.game_date(F.col("v"))).collect()] == ["2014-09-06", "None", "1900-01-01"]


def test_names(spark):
    row = spark.createDataFrame([("  San  José St. (A&M)",)], "n string").select(text.team_key(F.col("n")).alias("a"), text.loose_key(F.col("n")).alias("b")).first()
    assert (row.a, row.b) == ("san josé st a&m", "san jose st a m")
    teams = spark.createDataFrame([(1, "Miami Ohio"), (2, "San Jose State")], "team_id long, team_name string")
    made, skipped = names.suggest(spark.createDataFrame([("Ohio Miami",), ("San José State",), ("Zzz",), ("Ohio",), ("MIAMI-O",)], "name string"), teams, spark.createDataFrame([("Ohio", "x")], "alias string, team_name string"), {"Miami O": "Miami Ohio"})
    assert [(r.alias, r.team_name, r.reason) for r in names.in_order(made).collect()] == [("MIAMI-O", "Miami Ohio", "manual override (normalized key)"), ("San José State", "San Jose State", "fuzzy match")]
    reasons = {r.alias: (r.reason, r.team_name, r.missing) for r in skipped.collect()}
    assert reasons == {"Ohio": ("already in team_aliases", None, None), "Ohio Miami": ("score below the threshold", "Miami Ohio", None), "Zzz": ("alias too short for non-exact match", "Miami Ohio", None)}


def test_suggestions_as_one_by_one(spark):
    from difflib import SequenceMatcher

    generator = random.Random(4)
    words = ["north", "south", "state", "tech", "texas", "iowa", "a", "m", "ohio", "miami", "college"]
    teams = [" ".join(generator.sample(words, generator.randint(1, 3))) for _ in range(60)]
    unknown = [generator.choice([t, t[::-1], t.replace("o", "0", 1), t + "s", t[1:], " ".join(reversed(t.split())), t.replace("state", "st")]) for t in teams] + ["utx", "osu", ""]
    score = lambda a, b: 0.55 * SequenceMatcher(None, a, b).ratio() + 0.35 * SequenceMatcher(None, *(" ".join(sorted(x.split())) for x in (a, b))).ratio() + 0.1 * len(set(a.split()) & set(b.split())) / max(len(set(a.split())), len(set(b.split())))
    expected, refused = {}, {"": ("alias too short for non-exact match", teams[0], 0.0, None)}
    for raw in set(unknown):
        a = " ".join(raw.split())
        if not a:
            continue
        best = max(range(len(teams)), key=lambda k: (score(a, teams[k]), -k))
        s = score(a, teams[best])
        lost = sorted({w for w in a.split() if len(w) >= 4 and w not in teams[best].split()})
        weak = "alias too short for non-exact match" if len(a) <= 4 and s < 0.95 else "missing token" if lost and s < 0.92 else "score below the threshold" if s < 0.86 else None
        if weak:
            refused[raw] = (weak, teams[best], round(s, 9), lost if weak == "missing token" else None)
        else:
            expected[raw] = (teams[best], round(s, 9))
    rows = spark.createDataFrame(list(enumerate(teams)), "team_id long, team_name string")
    found, skipped = names.suggest(spark.createDataFrame([(a,) for a in sorted(set(unknown))], "name string"), rows)
    assert {r.alias: (r.team_name, round(r.score, 9)) for r in found.collect()} == expected and 10 < len(expected) < 60
    assert {r.alias: (r.reason, r.team_name, round(r.score, 9), r.missing) for r in skipped.collect()} == refused
    quick, left = names.suggest(spark.createDataFrame([(a,) for a in unknown], "name string"), rows, explain=False)
    assert {r.alias: (r.team_name, round(r.score, 9)) for r in quick.collect()} == expected and {r.alias for r in left.collect()} == set(refused)


def test_suggestions_of_weak_names_and_without_teams(spark):
    generator = random.Random(9)
    teams = ["".join(generator.choice("abcdexyz  12") for _ in range(generator.randint(1, 24))) for _ in range(150)]
    unknown = ["".join(generator.choice("abqrstz 129") for _ in range(generator.randint(1, 16))) for _ in range(60)] + ["!!", "0000"]
    key = lambda s: " ".join(s.split())
    schema = "team_id long, team_name string"
    made, skipped = names.suggest(spark.createDataFrame([(a,) for a in unknown], "name string"), spark.createDataFrame(list(enumerate(teams)), schema))
    found = {r.alias: (r.team_name, round(r.score, 9)) for r in [*made.collect(), *skipped.collect()]}
    for raw in unknown:
        scores = [plain_score(key(raw.replace("!", " ")), key(t)) for t in teams]
        assert found[raw] == (teams[scores.index(max(scores))], round(max(scores), 9)), raw
    made, skipped = names.suggest(spark.createDataFrame([("Zzz",), ("",)], "name string"), spark.createDataFrame([], schema))
    assert made.count() == 0 and {(r.alias, r.reason, r.score) for r in skipped.collect()} == {("Zzz", "no teams to compare", None), ("", "no teams to compare", None)}


def plain_score(a, b):
    from difflib import SequenceMatcher

    if not a or not b:
        return 0.0
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    words, others = set(a.split()), set(b.split())
    return 0.55 * ratio(a, b) + 0.35 * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) + 0.1 * len(words & others) / max(len(words), len(others))


def test_no_nested_loops_among_names(spark):
    x = league.League(spark, SF)
    own = names.conference_map(x.members.limit(0), x.teams.selectExpr("team_id", "'A' as conference_name", "1996 as effective_year_start"), spark.createDataFrame([(1996,)], "season_year int"))
    made, skipped = names.suggest(x.raw_names, x.teams)
    for rows in (own, made, skipped):
        assert "NestedLoop" not in rows._jdf.queryExecution().toString()


def test_ratings_over_all_tasks_are_those_of_one(spark):
    games_of = league.League(spark, SF).games.unionByName(spark.createDataFrame([(-1, 2050, None, 3, 4, 3, 3, 0, "regular"), (-2, 2051, None, 3, 4, None, 3, 0, "cfp")], "game_id long, season_year int, game_date date, home_team_id long, away_team_id long, home_score int, away_score int, went_ot int, game_phase string"))
    one = {(r.season_year, r.team_id): r.rating for r in ratings.iterative_ratings(games_of).collect()}
    spread = {(r.season_year, r.team_id): r.rating for r in ratings.iterative_ratings(games_of, in_task=0).collect()}
    assert one.keys() == spread.keys() and all(spread[k] == pytest.approx(v, abs=1e-9) for k, v in one.items())
    assert spread[2050, 3] == spread[2051, 4] == 1.0
    some = {(r.season_year, r.team_id): r.rating for r in ratings.iterative_ratings(games_of, rounds=4, in_task=100).collect()}
    assert some == pytest.approx({(r.season_year, r.team_id): r.rating for r in ratings.iterative_ratings(games_of, rounds=4).collect()}, abs=1e-9)


def test_a_season_is_rated_in_little_memory(spark):
    generator, teams, n = np.random.default_rng(3), 20_000, 600_000

    def batches():
        for _ in range(0, n, 10_000):
            home = generator.integers(0, teams, 10_000)
            yield pa.RecordBatch.from_pydict({
                "season_year": np.full(10_000, 2014, np.int32), "home_team_id": home, "away_team_id": (home + generator.integers(1, teams, 10_000)) % teams,
                "sign": generator.integers(-1, 2, 10_000).astype(float), "weight": generator.integers(1, 4, 10_000).astype(float),
            })

    tracemalloc.start()
    rated = list(ratings._rate(15, 0.15)(batches()))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 60 * n  # 2/3 are decided, 24 bytes each, and the arrays of one round
    assert sum(b.num_rows for b in rated) == teams and sum(pc.sum(b["rating"]).as_py() for b in rated) == pytest.approx(teams)


def test_ratings_are_made_once(spark):
    for name in ("al15_field_of_twelve", "al16_first_round", "ag12_pf36_decayed"):
        assert "FlatMapGroups" not in league.QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_rows_are_dealt_before_they_are_held(spark):
    rows = spark.createDataFrame([("2014", "A", "1.5", 1), ("2014", "A ", "2.5", 2), ("x", "B", "1", 3)], "Year string, School string, Score string, _order int")
    clean = files.clean_ratings(rows)
    after, before = clean._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning", 1)
    assert "WindowGroupLimit" in after and "WindowGroupLimit" not in before
    assert [tuple(r) for r in clean.collect()] == [(2014, "A", 2.5)]
    league_of = league.QUERIES["sc2_clean_ratings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*conf_coe_rank.*rightHint=\(strategy=broadcast\)", league_of)  # the ranks are few, the teams are not


def test_members_are_dealt_before_they_are_told_apart(spark):
    members = spark.createDataFrame([(1, 2014, "Old"), (1, 2014, "Old "), (2, 2014, "Low")], "team_id long, season_year int, conference string")
    alignment = spark.createDataFrame([(1, "New", 2010), (3, "C", 2010)], "team_id long, conference_name string, effective_year_start int")
    found = names.conference_map(members, alignment, spark.createDataFrame([(2014,)], "season_year int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Exchange", 1)[0].count("HashAggregate(keys=[season_year") == 2  # both halves of it run after the exchange
    assert not re.search(r"Exchange hashpartitioning\(season_year#\d+, \d+\), ENSURE_REQUIREMENTS.*\n.*Generate", plan)  # whole seasons to a task
    assert sorted(tuple(r) for r in found.collect()) == [(2014, 1, "Old"), (2014, 2, "Low"), (2014, 3, "C")]


def test_seasons_that_do_not_fit(spark):
    field = spark.createDataFrame([(2014, k, 0 if k < 8 else 1 if k < 16 else 2) for k in range(24)], "season_year int, team_id long, pot int")
    assert postseason.complete(postseason.sized(field)).count() == 24 and postseason.at_least(field, 10, "tiers").count() == 24
    for check in (postseason.sized, postseason.complete, lambda rows: postseason.at_least(rows, 24, "tiers")):
        with pytest.raises(Exception, match="2014"):
            check(field.where("team_id < 23")).collect()
    with pytest.raises(Exception, match="byes"):
        postseason.complete(field.withColumn("pot", F.lit(0))).collect()
    slots = field.withColumn("slot", (F.col("team_id") + 1).cast("int"))
    assert postseason.slots_filled(slots).count() == 24
    for odd in (slots.withColumn("slot", F.greatest("slot", F.lit(2))), slots.withColumn("pot", 2 - F.col("pot"))):
        with pytest.raises(Exception, match="slots 1 to 24 by pots in 2014"):
            postseason.slots_filled(odd).collect()


def test_strict_selections_stop(spark):
    x = league.League(spark, SF)
    assert postseason.draw(x.balanced, strict=True).count() == x.bracket.count()
    with pytest.raises(Exception, match="not 24 teams with 8 byes and two equal pots in 19"):
        postseason.draw(x.balanced.where("pot > 0 or conference > 'NATION_2'"), strict=True).collect()
    assert postseason.tiers(x.conf_seasons, league.INDEPENDENTS, strict=True).count() == 70
    with pytest.raises(Exception, match="fewer than 10 tiers in 1999"):
        postseason.tiers(x.conf_seasons.where("season_year <> 1999 or conference = 'NATION_2'"), league.INDEPENDENTS, strict=True).collect()
    with pytest.raises(Exception, match="not 24 teams in 199"):
        coe = coefficients.season_ranks(x.team_seasons, "team_id")
        postseason.select_field(postseason.tiers(x.conf_seasons, league.INDEPENDENTS), x.members, x.standings, coe, league.INDEPENDENTS, strict=True).collect()


def test_faults_of_rows(spark):
    rows = spark.createDataFrame([("regular", "bowl", 1), (None, "bowl", 1), ("regular", None, 1), ("regular", "cfp", None)], "kind string, phase string, flag int")
    assert [r[0] for r in rows.select(parsing.row_fault(F.col("kind"), F.col("phase"), F.col("flag"))).collect()] == [None, "game_type", "game_phase", "flag"]
    weeks = spark.createDataFrame([("3",), (" ",), (None,), ("x",)], "week string")
    assert [r[0] for r in weeks.select(parsing.week_number(F.col("week"))).collect()] == [3, 0, 0, None]


def test_tables_and_answers(spark):
    assert reports.find_table(["a", "team_coefficient_x"], reports.TEAM_TABLES, ["team_coefficient"]) == "team_coefficient_x"
    assert reports.find_table(["league_coe"], reports.CONFERENCE_TABLES, ["conference", "league"], ["coe"]) == "league_coe" and reports.find_table(["a"], ["b"]) is None
    spark.range(1).createOrReplaceTempView("team_coefficient_by_year")
    assert reports.coefficient_tables(spark)[0] == "team_coefficient_by_year" and reports.table_columns(spark, "team_coefficient_by_year") == ["id"] and reports.table_columns(spark, "none") == []
    spark.catalog.dropTempView("team_coefficient_by_year")
    with pytest.raises(ValueError, match="team coefficients"):
        reports.coefficient_tables(spark)
    assert files.filtered_or_all(spark.range(0), spark.range(3)).count() == 3
    with pytest.raises(ValueError, match="no records"):
        files.filtered_or_all(spark.range(0), spark.range(0))


def test_keep_first_and_last(spark):
    schema = "game_id long, v string"
    target, incoming = spark.createDataFrame([(1, "old")], schema), spark.createDataFrame([(1, "b"), (2, "d"), (2, "c"), (None, "x"), (None, "y")], schema)
    assert sorted(r.v for r in store.append_keep_first(target, incoming, ["game_id"], "v").collect()) == ["c", "old", "x", "y"]
    old = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "slot int, team int")
    new = spark.createDataFrame([(1, 30)], "slot int, team int")
    assert sorted(map(tuple, store.upsert_keep_last(old, new, [["slot"], ["team"]], "slot").collect())) == [(1, 30), (2, 20)]


def test_partitions_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "season_year int, v int"
    store.replace_partitions(spark.createDataFrame([(2014, 1), (2015, 2)], schema), path, ["season_year"])
    store.replace_partitions(spark.createDataFrame([(2015, 3)], schema), path, ["season_year"])
    rows = lambda: sorted((r.season_year, r.v) for r in spark.read.parquet(path).collect())
    assert rows() == [(2014, 1), (2015, 3)]
    none = spark.createDataFrame([], schema)
    seasons = lambda *years: spark.createDataFrame([(y,) for y in years], "season_year int")
    store.replace_partitions(none, path, ["season_year"])
    assert rows() == [(2014, 1), (2015, 3)]
    store.replace_partitions(none, path, ["season_year"], seasons(2015, 2019))
    assert rows() == [(2014, 1)]
    store.replace_partitions(spark.createDataFrame([(2016, 4), (2014, 5)], schema), path, ["season_year"], seasons(2014))
    assert rows() == [(2014, 5), (2016, 4)]
    odd = str(tmp_path / "odd")
    named = spark.createDataFrame([("a/b=c %", 1), (None, 2), ("é", 3)], "name string, v int")
    store.replace_partitions(named, odd, ["name"])
    store.replace_partitions(named.limit(0), odd, ["name"], named.where("v < 3").select("name"))
    assert sorted(r.v for r in spark.read.parquet(odd).collect()) == [2, 3]  # a null names no partition


def test_stored_versions(spark, tmp_path):
    schema = "game_id long, v string"
    table = store.Stored(spark, str(tmp_path / "t"), schema)
    rows = lambda version=None: sorted((r.game_id or 0, r.v) for r in table.read(version).collect())
    make = lambda *x: spark.createDataFrame(list(x), schema)
    assert table.version() == 0 and rows() == []
    assert table.append_keep_first(make((1, "b"), (1, "a"), (None, "n")), ["game_id"], "v") == 1
    assert table.append_keep_first(make((1, "z")), ["game_id"], "v") == 1  # nothing new, no version
    old = table.read()
    assert table.append_keep_first(make((1, "z"), (2, "c")), ["game_id"], "v") == 2
    assert rows() == [(0, "n"), (1, "a"), (2, "c")] and rows(1) == [(0, "n"), (1, "a")] and old.count() == 2
    assert table.upsert_keep_last(make((2, "new"), (3, "d"), (3, "e")), [["game_id"]], "v") == 3
    assert rows() == [(0, "n"), (1, "a"), (2, "new"), (3, "e")]


def test_stored_writes_that_fail(spark, tmp_path, monkeypatch):
    schema = "game_id long, v string"
    table, other = (store.Stored(spark, str(tmp_path / "t"), schema) for _ in range(2))
    make = lambda *x: spark.createDataFrame(list(x), schema)
    table.append_keep_first(make((1, "a")), ["game_id"], "v")

    def fails(*_):
        raise OSError("lost between the write and the switch")

    with monkeypatch.context() as patch:
        patch.setattr(table, "_switch", fails)
        with pytest.raises(OSError, match="lost"):
            table.append_keep_first(make((2, "b")), ["game_id"], "v")
    assert [r.v for r in table.read().collect()] == ["a"] and table.version() == 1
    assert table.append_keep_first(make((2, "b")), ["game_id"], "v") == 2
    (tmp_path / "t" / "_log" / "000000000003.txt").write_text("rows-unfinished\n")
    assert table.version() == 2 and table.read().count() == 2  # an entry that is not whole is none
    with pytest.raises(store.Conflict):
        other.append_keep_first(make((3, "c")), ["game_id"], "v")
    (tmp_path / "t" / "_log" / "000000000003.txt").unlink()
    (tmp_path / "t" / "_log" / ".000000000003.txt.crc").unlink(missing_ok=True)
    assert other.upsert_keep_last(make((3, "c")), [["game_id"]], "v") == 3
    other.clean(keep=1)
    assert sorted(r.v for r in table.read().collect()) == ["a", "b", "c"]
    assert sum(p.name.startswith("rows-") for p in (tmp_path / "t").iterdir()) == 1


def test_one_csv_file(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b, \"q\"", 0.1234565, None), (1, "a", 2.0, 3), (3, None, 0.0005, 4)], "k int, n string, x double, y int")
    path = tmp_path / "out.csv"
    path.write_text("older")
    store.write_csv(rows, str(path), ["k"], ["n", "x", "y"])
    assert path.read_bytes() == b'n,x,y\na,2.0,3\n"b, \\"q\\"",0.123457,\n,0.0005,4\n'
    assert not [p for p in tmp_path.iterdir() if "tmp" in p.name and not p.name.endswith(".crc")]


def test_landed_answers(spark, tmp_path):
    import json

    for year, text in ((2014, json.dumps([{"school": "A", "conference": "X", "classification": "FBS"}, {"school": "B", "conference": "Y", "classification": "fcs"}])),
                       (2015, '[{"school": "A", "conference": "X"'), (2016, json.dumps({"school": "A", "conference": "Z", "classification": "fbs"}))):
        (tmp_path / f"teams_{year}.json").write_text(text)
    rows, broken = files.landed_json(spark, [str(tmp_path)], files.TEAMS)
    assert sorted((r.year, r.school, r.conference) for r in rows.collect()) == [(2014, "A", "X"), (2014, "B", "Y"), (2016, "A", "Z")]
    assert [(r.file.rsplit("/", 1)[-1], r.text) for r in broken.collect()] == [("teams_2015.json", '[{"school": "A", "conference": "X"')]
    members = files.fbs_members(rows, spark.createDataFrame([(7, "A"), (8, "B")], "team_id long, team_name string"))
    assert sorted(tuple(r) for r in members.collect()) == [(7, 2014, "X", 1), (7, 2016, "Z", 1)]
    (tmp_path / "g").mkdir()
    game = {"id": 1, "season": 2014, "seasonType": "postseason", "homeTeam": "A", "awayTeam": "B", "homePoints": 3, "awayPoints": 2}
    games = [game | {"overTime": True}, game | {"id": 2, "overtime": 0}, game | {"id": 3, "overtimes": "2", "startDate": "2015-01-12T1"}, game | {"id": 4, "season": 2024}, game | {"id": 5, "startDate": "soon"}]
    (tmp_path / "g" / "games.json").write_text(json.dumps(games))
    payload = files.payload_json(spark, [str(tmp_path / "g")], files.GAMES)
    best = spark.createDataFrame([(s, t) for s in (2014, 2024) for t in "abcd"], "season int, team string")
    found = {r.game_id: (r.went_ot, r.game_type, r.date) for r in files.api_games(payload, best).collect()}
    assert found == {1: (1, "playoff", "1900-01-01"), 2: (0, "playoff", "1900-01-01"), 3: (1, "playoff", "2015-01-12"), 4: (0, "regular", "1900-01-01")}
    assert [r.game_id for r in files.api_games(payload, best, refused=True).collect()] == [5]
    assert {r.game_id: r.game_type for r in files.api_games(payload, best, best_seasons=(2024, 2024)).collect()} == {1: "regular", 2: "regular", 3: "regular", 4: "playoff"}


def test_schools_under_three_names(spark):
    ranks = [{"rank": 1, "school": "A"}, {"rank": 2, "team": "B"}, {"rank": 3, "name": "C"}, {"rank": 4, "school": None, "team": "D", "name": "x"}]
    rows = spark.createDataFrame([{"season": 2014, "seasonType": "regular", "week": 12, "polls": [{"poll": "CFP", "ranks": ranks}]}], files.RANKINGS)
    assert sorted(r.team for r in files.top_four(rows).collect()) == ["a", "b", "c", "d"]


def test_rebuild_of_what_a_game_touches(spark, tmp_path):
    from pennant.plans import rebuild

    root, names_of = str(tmp_path / "derived"), ["team_seasons", "team_rolling", "records", "bracket"]
    x = league.League(spark, SF)
    rebuild.save(x, root, tables=names_of)
    state = lambda: {str(p.relative_to(root)): p.stat().st_mtime_ns for p in (tmp_path / "derived").rglob("*.parquet")}
    whole = {n: sorted(map(str, spark.read.parquet(f"{root}/{n}").collect())) for n in names_of}
    before = state()
    changed = league.League(spark, SF)
    first = x.enriched.where("season_year = 1997 and is_nonconference is not null and home_score <> away_score").orderBy("game_id").first().game_id
    changed.games = x.games.withColumn("home_score", F.when(F.col("game_id") == first, F.when(F.col("home_score") > F.col("away_score"), -1).otherwise(99)).otherwise(F.col("home_score")))
    dry = rebuild.save(changed, root, [1997], names_of, dry_run=True).collect()
    assert state() == before and {(r.table, r.season_year) for r in dry} == {(n, s) for n in names_of for s in ([1997] if n in ("team_seasons", "records") else [1997, 1998, 1999, 2000, 2001])}
    rebuild.save(changed, root, [1997], names_of)
    after = state()
    moved = {p.split("/")[0] + "/" + p.split("season_year=")[1][:4] for p in {*before, *after} if before.get(p) != after.get(p)}
    assert moved == {f"{r.table}/{r.season_year}" for r in dry}
    for n in names_of:
        fresh = getattr(changed, n).select(spark.read.parquet(f"{root}/{n}").columns)
        assert sorted(map(str, spark.read.parquet(f"{root}/{n}").collect())) == sorted(map(str, fresh.collect())), n
    assert whole["team_seasons"] != sorted(map(str, spark.read.parquet(f"{root}/team_seasons").collect()))
    # a season without games any more has no partition left
    changed.games = x.games.where("season_year <> 1997")
    gone = rebuild.save(changed, root, [1997], ["team_seasons", "records"]).collect()
    assert {(r.table, r.season_year, r.n) for r in gone} == {("team_seasons", 1997, 0), ("records", 1997, 0)}
    assert not [p for p in state() if p.startswith("team_seasons/season_year=1997") or p.startswith("records/season_year=1997")]


def test_files(spark, tmp_path):
    short = tmp_path / "short.csv"
    short.write_text("season_year,week\n2014,1\n")
    with pytest.raises(ValueError, match="game_phase"):
        files.games_csv(spark, str(short))
    (tmp_path / "r.csv").write_text("Year,School,Score\n2014,A,1.5\n2014,A,2.5\nx,B,1\n")
    assert [tuple(r) for r in files.ratings_csv(spark, str(tmp_path / "r.csv")).collect()] == [(2014, "A", 2.5)]
    (tmp_path / "n.txt").write_text(" a \n\nb\n")
    assert [r.name for r in files.names_text(spark, str(tmp_path / "n.txt")).collect()] == ["a", "b"]
    poll = {10: "ABCD", 12: "ABC", 13: "BCDE"}
    payload = [{"season": 2014, "week": w, "polls": [{"poll": "Playoff Committee Rankings", "ranks": [{"rank": k + 1, "school": s} for k, s in enumerate(x)]}]} for w, x in poll.items()]
    import json

    (tmp_path / "p.json").write_text(json.dumps(payload))
    assert "".join(sorted(r.team for r in files.top_four(files.payload_json(spark, [str(tmp_path / "p.json")], files.RANKINGS)).collect())) == "bcde"
    assert files.pick_column(["Foo", "PPG"], ["ppg"]) == "PPG" and files.pick_column(["avg_ppg"], ["ppg"], contains=True) == "avg_ppg"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = '{"game_id": 1, "season_year": 2014, "game_date": "2014-09-06", "home_team_id": 1, "away_team_id": 2}\n'
    (tmp_path / "in" / "a.json").write_text(rows + rows)
    seen = []

    def run(checkpoint):
        stream = ingest.game_stream(spark, str(tmp_path / "in"))
        ingest.keep_up(stream, str(tmp_path / "out"), str(tmp_path / checkpoint), lambda batch: seen.append(batch.count())).awaitTermination()
        return store.Stored(spark, str(tmp_path / "out"), ingest.GAMES)

    assert run("check").read().count() == 1 and sum(seen) == 1
    (tmp_path / "in" / "b.json").write_text(rows.replace("09-06", "12-31") + rows.replace('"game_id": 1', '"game_id": 2'))
    table = run("check")
    assert sorted((r.game_id, str(r.game_date)) for r in table.read().collect()) == [(1, "2014-09-06"), (2, "2014-09-06")]
    version = table.version()
    assert run("check-lost").version() == version and table.read().count() == 2  # everything comes again and changes nothing


def test_console(spark):
    rows = spark.createDataFrame([("a", 1.50, None), ("b", 2.0, 1)], "n string, x double, y int")
    assert reports.console(rows.limit(1)) == "n  x    y\n-  ---  -\na  1.5   " and reports.console(rows, 1).endswith("\n... more than 1 rows")
    assert reports.console(rows.select("x"), formats={"x": ".0f"}) == "x\n-\n2\n2" and reports.section("A b") == "\nA b\n==="


def test_known_by_alias_and_alignment(spark):
    seasons = spark.createDataFrame([(2014,), (2026,)], "season_year int")
    members = spark.createDataFrame([(1, 2014, " Old ", None), (2, 2014, "Low", 0), (3, 2014, " ", 1), (3, 2026, None, 1)], "team_id long, season_year int, conference string, is_fbs int")
    alignment = spark.createDataFrame([(1, "New", 2020), (1, "Newer ", 2026), (2, "B", 1990), (2, "A", 1990), (2, None, 2010), (3, "C", 2030), (None, "D", 2000), (4, "E", None)], "team_id long, conference_name string, effective_year_start int")
    found = {(r.season_year, r.team_id): r.conference for r in names.conference_map(members, alignment, seasons).collect()}
    assert found == {(2014, 1): "Old", (2026, 1): "Newer", (2014, 2): "B", (2026, 2): "B"}


@pytest.mark.parametrize("name", ["ag10_team_rolling", "wn6_standings", "al2_al4_bids_year2", "al13_hosts", "al6_al7_wn8_field", "al16_first_round", "jn8_resolve", "pf15_pf17_classes", "pf34_sc5_top_four", "sc4_sk5_pf19_api_games", "ag16_pf23_load_counts", "rp4_standings", "rp4_teams", "rp4_conferences", "rp4_field", "sk6_rounded_ratings", "st1_mixed_order", "sk1_append_keep_first", "sc2_clean_ratings", "al19_membership_backfill", "jn12_known_conferences"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    rows = entry.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    known = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(tuple, rows.select(columns).collect()), key=key) == sorted(known, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
