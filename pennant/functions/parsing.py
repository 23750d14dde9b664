"""Values of raw game rows: flags, dates, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in notes, classes and spellings of flags.
LOWER_DIVISION_NOTES = ["fcs", "championship subdivision", "division ii", "division iii"]
PLAYOFF_NOTES = ["semifinal", "national championship", "college football playoff", "cfp"]
TRUE_WORDS, FALSE_WORDS = ["1", "true", "t", "yes", "y"], ["0", "false", "f", "no", "n"]


def flag_from_api(value: Column) -> Column:
    """1 for true and positive whole numbers, else 0."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when((text == "true") | (F.try_to_number(text, F.lit("999999999999")) > 0), 1).otherwise(0)


def flag_from_text(value: Column) -> Column:
    """Blank 0; words for yes 1 and no 0; whole numbers other than 0 are 1; anything else null (a row to quarantine)."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    number = text.try_cast("int")
    return F.when(text == "", 0).when(text.isin(TRUE_WORDS), 1).when(text.isin(FALSE_WORDS), 0).when(number.isNotNull(), F.when(number != 0, 1).otherwise(0))


def game_date(value: Column) -> Column:
    """The first ten characters as a date, 1900-01-01 where there is no text; null for text that is no date (a row to set aside)."""
    day = F.substring(value, 1, 10)
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("1900-01-01").cast("date")).when(day.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), day.try_cast("date"))


def _mentions(notes: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(F.lower(F.coalesce(notes, F.lit(""))), F.lit(word))
    return found


def is_top_division(home_class: Column, away_class: Column, notes: Column) -> Column:
    """Both classes are the top one; where none is given, the notes name no lower one."""
    home, away = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (home_class, away_class))
    return F.when((home != "") | (away != ""), (home == "fbs") & (away == "fbs")).otherwise(~_mentions(notes, LOWER_DIVISION_NOTES))


def season_part(value: Column) -> Column:
    """regular, postseason or another part of the season, regular where none is given."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text == "", "regular").otherwise(text)


def game_type(part: Column, flagged: Column, notes: Column, both_in_top_four: Column) -> Column:
    """playoff for a postseason game that is flagged, has such notes, or is between two top-four teams; else regular."""
    named = F.coalesce(flagged, F.lit(False)) | _mentions(notes, PLAYOFF_NOTES) | F.coalesce(both_in_top_four, F.lit(False))
    return F.when((part == "postseason") & named, "playoff").otherwise("regular")


def game_phase(part: Column, kind: Column) -> Column:
    """regular, cfp or bowl."""
    return F.when(part == "regular", "regular").when(kind == "playoff", "cfp").otherwise("bowl")


def week_number(value: Column) -> Column:
    """A whole number, 0 where blank; null for anything else."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(text == "", 0).otherwise(text.try_cast("int"))


def row_fault(kind: Column, phase: Column, *flags: Column, week: Column | None = None) -> Column:
    """What is wrong with a row, null if nothing: an unknown or missing type or phase, or a flag or week that could not be read."""
    fault = F.when(~F.coalesce(kind.isin("regular", "playoff"), F.lit(False)), "game_type")
    fault = fault.when(~F.coalesce(phase.isin("regular", "bowl", "cfp"), F.lit(False)), "game_phase")
    for flag in flags:
        fault = fault.when(flag.isNull(), "flag")
    return fault if week is None else fault.when(week.isNull(), "week")
