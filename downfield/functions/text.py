"""The one-line description of a play, built from its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Texts that stand for "no value" in the source files.
MISSING_TEXTS = ["None", "nan", "NaN", ""]

_TEXTS = [
    "season", "season_type", "posteam", "defteam", "play_type", "passer_player_name", "rusher_player_name",
    "receiver_player_name", "desc",
]
_NUMBERS = [
    "down", "ydstogo", "qtr", "week", "yardline_100", "yards_gained", "touchdown", "interception", "fumble_lost",
    "pass_attempt", "rush_attempt",
]


def _when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


def _whole(number: str) -> str:
    return f"CAST(CAST({number} AS BIGINT) AS STRING)"


def with_description(plays: DataFrame, name: str = "enhanced_description") -> DataFrame:
    """Add a text such as `3 & 8 — Q4 — Week 9 2024 (POST): KC vs BAL — PASS — QB: P.Mahomes — … — [Red Zone]`.

    Parts that cannot be built (a column that is missing, NULL or not a number) are left out. The values are
    cleaned first, as elements of two arrays: Spark does not put such a step into one method with those before and
    after it, and the JVM compiles only methods of up to 8,000 bytes. The text is put together in further steps.
    """
    present = set(plays.columns)
    missing = ", ".join(f"'{text}'" for text in MISSING_TEXTS)

    def raw(column: str) -> str:
        return f"`{column}`" if column in present else "CAST(NULL AS STRING)"

    def text(column: str) -> str:
        return f"_texts[{_TEXTS.index(column)}]"

    def number(column: str) -> str:
        return f"_numbers[{_NUMBERS.index(column)}]"

    texts = ", ".join(f"CAST({raw(c)} AS STRING)" for c in _TEXTS)
    numbers = ", ".join(f"try_cast({raw(c)} AS DOUBLE)" for c in _NUMBERS)
    cleaned = plays.selectExpr(
        *[f"`{c}`" for c in plays.columns],
        f"transform(array({texts}), t -> {_when(f't NOT IN ({missing})', 't')}) AS _texts",
        f"transform(array({numbers}), n -> {_when('NOT isnan(n)', 'n')}) AS _numbers",
    )
    down = f"CAST({number('down')} AS BIGINT)"
    gained = f"coalesce({number('yards_gained')}, 0)"
    tags = [
        _when(f"{number('yardline_100')} <= 20", "'Red Zone'"),
        _when(f"{down} = 3", "'3rd Down'"),
        _when(f"{down} = 4", "'4th Down'"),
        _when(f"{number('touchdown')} = 1", "'TOUCHDOWN'"),
        _when(f"{number('interception')} = 1 OR {number('fumble_lost')} = 1", "'TURNOVER'"),
        _when(
            f"({number('pass_attempt')} = 1 AND {gained} >= 20) OR ({number('rush_attempt')} = 1 AND {gained} >= 10)",
            "'EXPLOSIVE'",
        ),
        _when(f"{text('season_type')} = 'POST'", "'PLAYOFFS'"),
    ]
    game = (
        f"concat(coalesce({text('season')}, ''), ' (', coalesce({text('season_type')}, 'REG'), '): ', "
        f"coalesce({text('posteam')}, ''), ' vs ', coalesce({text('defteam')}, ''))"
    )
    # concat is NULL as soon as one of its parts is, and concat_ws skips NULL parts.
    grouped = cleaned.selectExpr("*", f"{game} AS _game", f"concat_ws(', ', {', '.join(tags)}) AS _tags")
    parts = [
        _when(f"{number('down')} <> 0", f"concat({_whole(number('down'))}, ' & ', {_whole(number('ydstogo'))})"),
        _when(f"{number('qtr')} <> 0", f"concat('Q', {_whole(number('qtr'))})"),
        f"coalesce(concat('Week ', {_whole(number('week'))}, ' ', _game), _game)",
        f"upper({text('play_type')})",
        f"concat('QB: ', {text('passer_player_name')})",
        f"concat('RB: ', {text('rusher_player_name')})",
        f"concat('Receiver: ', {text('receiver_player_name')})",
        text("desc"),
        "concat('[', nullif(_tags, ''), ']')",
    ]
    return grouped.selectExpr(
        *[f"`{c}`" for c in plays.columns], f"concat_ws(' — ', {', '.join(parts)}) AS {name}"
    )
