"""Columns of tracked pitch files."""

from __future__ import annotations

from pyspark.sql import types as T

# Identity columns that are dropped.
IDENTITY = ("Batter", "Pitcher", "Catcher")

# The columns of the filtered table, by type.
_DATES = "Date"
_TIMES = "Time"
_LONGS = "PitcherId BatterId"
_INTS = "PAofInning PitchofPA Inning Outs Balls Strikes OutsOnPlay RunsScored"

# The filtered table, in order.
FILTERED = (
    "Date Time PAofInning PitchofPA PitcherId BatterId PitcherThrows BatterSide BatterTeam Inning Top/Bottom Outs "
    "Balls Strikes CleanPitchCall KorBB CleanPitchType CleanHitType PlayResult OutsOnPlay RunsScored RelSpeed "
    "VertRelAngle HorzRelAngle SpinRate SpinAxis Tilt RelHeight RelSide Extension VertBreak InducedVertBreak "
    "HorzBreak PlateLocHeight PlateLocSide ZoneSpeed VertApprAngle HorzApprAngle ZoneTime ExitSpeed Angle Direction "
    "HitSpinRate PositionAt110X PositionAt110Y PositionAt110Z Distance LastTrackedDistance Bearing HangTime pfxx pfxz "
    "x0 y0 z0 vx0 vy0 vz0 ax0 ay0 az0 GameID PitchUID EffectiveVelo MaxHeight SpeedDrop PitcherTeam HitSpinAxis"
).split()

# Text columns of the filtered table.
_STRINGS = (
    "PitcherThrows BatterSide BatterTeam Top/Bottom CleanPitchCall KorBB CleanPitchType CleanHitType PlayResult Tilt "
    "GameID PitchUID PitcherTeam"
).split()

# Raw text columns that cleaning turns into the three Clean columns.
_RAW_STRINGS = "Batter Pitcher Catcher PitchCall TaggedPitchType AutoPitchType TaggedHitType AutoHitType".split()


def _type(name: str) -> T.DataType:
    if name in _LONGS.split():
        return T.LongType()
    if name in _INTS.split():
        return T.IntegerType()
    if name in (_DATES, _TIMES) or name in _STRINGS or name in _RAW_STRINGS:
        return T.StringType()
    return T.DoubleType()


RAW_SCHEMA = T.StructType(
    [T.StructField(c, _type(c)) for c in [*_RAW_STRINGS, *(c for c in FILTERED if not c.startswith("Clean"))]]
)
