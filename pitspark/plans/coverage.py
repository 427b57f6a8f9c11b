"""Which registered queries cover each row of the survey."""

from __future__ import annotations

from collections import defaultdict

from .catalog import all_queries


def by_row() -> dict[str, list[str]]:
    rows: dict[str, list[str]] = defaultdict(list)
    for name, item in all_queries().items():
        for row in item.covers:
            rows[row].append(name if item.sql else f"{name} (rows only)")
    return dict(sorted(rows.items(), key=lambda kv: (kv[0][0], int(kv[0][1:]))))


if __name__ == "__main__":
    for row, names in by_row().items():
        print(f"{row:4s} {', '.join(names)}")
