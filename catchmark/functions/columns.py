"""Choosing columns by name. These look at ``df.columns`` only and never touch data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def pick_col(columns: Sequence[str], keys: Iterable[str]) -> str | None:
    """First key with a case-insensitive exact match, else first column containing any key, else None."""
    keys = list(keys)
    # a repeated header under another case resolves to the later column
    by_name = {name.lower(): name for name in columns}
    exact = (by_name[key] for key in keys if key in by_name)
    partial = (name for name in columns if any(key in name.lower() for key in keys))
    return next(exact, None) or next(partial, None)


# Accepted spellings of the coordinate headers.
LAT_NAMES = {"lat", "latitude", "y"}
LON_NAMES = {"lon", "long", "longitude", "lng", "x"}


def find_lat_lon_columns(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """Last exact spelling wins; otherwise the first column that looks like a latitude or longitude."""
    cleaned = [(name, name.strip().lower()) for name in columns]

    def choose(names, looks_right):
        exact = [name for name, low in cleaned if low in names]
        loose = [name for name, low in cleaned if looks_right(low)]
        return exact[-1] if exact else (loose[0] if loose else None)

    return (
        choose(LAT_NAMES, lambda s: s.startswith("lat") or "latitude" in s),
        choose(LON_NAMES, lambda s: s.startswith("lon") or "long" in s),
    )


def require_col(columns: Sequence[str], options: Sequence[str]) -> str:
    """First option present under any case; raises with the available headers otherwise."""
    by_name = {name.lower(): name for name in columns}
    for option in options:
        if option.lower() in by_name:
            return by_name[option.lower()]
    raise ValueError(f"none of {list(options)} among columns {list(columns)}")


def require_cols(columns: Sequence[str], needed: Sequence[str], what: str) -> None:
    missing = [name for name in needed if name not in columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {list(columns)}")
