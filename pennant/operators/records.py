"""Win-loss records and standings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennant.functions.scoring import played, ratio
from pennant.operators.coefficients import ranked


def records(sides: DataFrame) -> DataFrame:
    """Wins, losses, ties and games of each team of a conference, within it and overall."""
    mine, theirs = F.col("points_for"), F.col("points_against")
    inside = F.col("conference") == F.col("opponent_conference")
    flags = {"wins": mine > theirs, "losses": mine < theirs, "ties": mine == theirs, "games": played()}
    sums = [F.count_if(flag & inside).alias(f"conf_{name}") for name, flag in flags.items()]
    sums += [F.count_if(flag).alias(f"overall_{name}") for name, flag in flags.items()]
    rows = sides.where("conference is not null").groupBy("season_year", "conference", "team_id").agg(*sums)
    share = lambda p: ratio(F.col(f"{p}_wins") + 0.5 * F.col(f"{p}_ties"), F.col(f"{p}_games"))
    return rows.withColumns({"conf_win_pct": share("conf"), "overall_win_pct": share("overall")})


def standings(recorded: DataFrame, teams: DataFrame) -> DataFrame:
    """conf_rank within season and conference; teams without a name do not take up a rank."""
    order = [F.desc("conf_win_pct"), F.desc("conf_wins"), F.asc("conf_losses"), F.desc("overall_win_pct"), F.desc("overall_wins"), F.asc("team_name"), F.asc("team_id")]
    named = recorded.join(teams, "team_id")
    return ranked(named, "conf_rank", *order, by=("season_year", "conference")).select("season_year", "conference", "team_id", "team_name", "conf_rank")


def validate(recorded: DataFrame, imported: DataFrame) -> DataFrame:
    """Computed records beside imported standings ranks; null where a team has none."""
    rank = imported.select("season_year", "conference", "team_id", F.col("conf_rank").alias("imported_rank"))
    return recorded.join(rank, ["season_year", "conference", "team_id"], "left")
