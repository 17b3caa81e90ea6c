"""Results of runs as rows of a CSV file: metrics of the driver, one row a run."""

from __future__ import annotations

import csv
import os
import time
from urllib.parse import unquote, urlsplit

#: Characters of an error message that are kept.
MESSAGE = 500


def local(path: str) -> str:
    """The path itself, or that of a file: address; relative ones start at MVD_RESULTS_DIR where it is set."""
    path = unquote(urlsplit(path).path) if path.startswith("file:") else path
    return os.path.normpath(os.path.join(os.environ.get("MVD_RESULTS_DIR", ""), path))


def append(path: str, row: dict) -> None:
    """Append a row, after a header if the file is new; ``path`` may be a file: address.

    A file with another header is first renamed to <stem>.legacy-<time><ending>.
    """
    path = local(path)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    header = list(row)
    if os.path.exists(path):
        with open(path, newline="") as f:
            old = next(csv.reader(f), None)
        if old != header:
            (stem, ending), stamp, k = os.path.splitext(path), time.strftime("%Y%m%d_%H%M%S"), 0
            while os.path.exists(to := f"{stem}.legacy-{stamp}" + f"-{k}" * bool(k) + (ending or ".csv")):
                k += 1
            os.rename(path, to)
    fresh = not os.path.exists(path)
    with open(path, "a", newline="") as f:
        writer = csv.DictWriter(f, header)
        if fresh:
            writer.writeheader()
        writer.writerow(row)


def run_row(name: str, stats, mvds: list | None = None, error: Exception | None = None, settings: dict | None = None) -> dict:
    """One row of a run: outcome, ``settings``, statistics; failed runs have the same columns."""
    return {"experiment": name, "status": "error" if error else "ok", "error": f"{type(error).__name__}: {error}"[:MESSAGE] if error else ""} | (settings or {}) | stats.row() | {"mvds": "; ".join(f"{','.join(x)} ->> {','.join(y)}" for x, y in mvds or [])}
