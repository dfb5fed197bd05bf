"""Which column of a table plays which part.

Operators never name a column themselves: they take a ``Roles`` (or plain
column names), so the same code runs on any event table.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Column names of an event table.

    ``group`` is the feature grain, ``sequence`` + ``order`` give the place of a
    row; ``order`` has to make a row unique inside its sequence.
    """

    entity_a: str = "pitcher_id"
    entity_b: str = "batter_id"
    group: tuple[str, ...] = ("season", "pitch_of_pa", "pitcher_id", "batter_id")
    sequence: tuple[str, ...] = ("game_id",)
    order: tuple[str, ...] = ("game_id", "pitch_of_pa", "part_id", "pitcher_id", "rel_speed")
    action: str = "pitch_type"
    outcome: str = "pitch_call"
    result: str = "play_result"
    outs: str = "outs_on_play"
    balls: str = "balls"
    strikes: str = "strikes"
    runs: str = "runs_scored"
    length: str = "pitch_of_pa"
    means: tuple[tuple[str, str], ...] = (
        ("avg_pitch_speed", "rel_speed"),
        ("avg_spin_rate", "spin_rate"),
        ("avg_platelocheight", "plate_height"),
    )
    velocity: str = "rel_speed"
    drop: str = "speed_drop"
    height: str = "plate_height"
    vertical: str = "spin_rate"
    horizontal: str = "plate_height"
    extension: str = "plate_height"
    exit_speed: str = "exit_speed"
    success: str = "Strike"
    failure: str = "Ball"
    breaking: str = "LARGE|MEDIUM"
    fast: str = "SMALL"
    hit_event: str = "Hit"
    out_event: str = "Strikeout"


# Columns of tracked pitch files, for use on the raw event tables.
PITCH_FILES = Roles(
    entity_a="PitcherId",
    entity_b="BatterId",
    group=("Date", "PitchofPA", "PitcherId", "BatterId"),
    sequence=("GameID", "Inning", "Top/Bottom", "PAofInning"),
    order=("PitchofPA", "PitchUID"),
    action="CleanPitchType",
    outcome="CleanPitchCall",
    result="PlayResult",
    outs="OutsOnPlay",
    balls="Balls",
    strikes="Strikes",
    runs="RunsScored",
    length="PitchofPA",
    means=(
        ("avg_pitch_speed", "RelSpeed"),
        ("avg_vertical_release_angle", "VertRelAngle"),
        ("avg_horizontal_release_angle", "HorzRelAngle"),
        ("avg_spin_rate", "SpinRate"),
        ("avg_spin_axis", "SpinAxis"),
        ("avg_platelocheight", "PlateLocHeight"),
        ("avg_platelocside", "PlateLocSide"),
    ),
    velocity="EffectiveVelo",
    drop="SpeedDrop",
    height="PlateLocHeight",
    vertical="InducedVertBreak",
    horizontal="HorzBreak",
    extension="Extension",
    exit_speed="ExitSpeed",
    breaking="Curve|Slider",
    fast="Fastball",
)
