"""Small texts of the command line and the log."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_BYTES, SECONDS_PER_CALL, MAX_INT = 240, 40, 2**31 - 1  # fixed values


def positive_int(text: str) -> int | None:
    """A whole number from 1 to 2**31 - 1, blanks around it allowed; else None."""
    word = text.strip(" ")
    return int(word) if re.fullmatch("[0-9]+", word) and 1 <= int(word) <= MAX_INT else None


def is_scope_token(token: str) -> bool:
    return token in ("*", ".") or token.startswith("#")


def take_scope_token(text: str) -> tuple[str, str]:
    """The first token and what follows it; #"..." may hold blanks."""
    m = re.fullmatch(r' *(#"[^"]*"|[^ ]*) *(.*)', text, re.S)
    return m[1], m[2]


def console_command(text: str) -> tuple[str, str]:
    """`/name rest` -> name and rest."""
    name, _, rest = text[1:].partition(" ")
    return name, rest.lstrip(" ")


def home_path(path: str, home: str | None = None) -> str:
    """~ and ~/... below the home folder; as it is without one."""
    home = os.environ.get("HOME") if home is None else home
    return home + path[1:] if home and (path == "~" or path.startswith("~/")) else path


def new_run_id(prefix: str = "tg-") -> str:
    return prefix + uuid.uuid4().hex[:8]


def minutes_of_calls(comparisons: int, evaluations: int, provider: str) -> int | None:
    """How long a local model will take, in whole minutes, one at least; None where there is nothing to tell."""
    calls = comparisons + evaluations
    return max(1, round(calls * SECONDS_PER_CALL / 60)) if calls and provider == "local" else None


def minutes(calls: Column) -> Column:
    """The same as a column, halves to the even."""
    return F.when(calls > 0, F.greatest(F.lit(1), F.bround(calls * SECONDS_PER_CALL / 60).cast("int")))


def log_line(text: Column) -> Column:
    """One line of LOG_BYTES at most, cut before a character that would be split, with dots where something was cut."""
    flat = F.translate(text, "\n\r", "  ")
    raw = flat.cast("binary")
    cuts = [F.substring(raw, 1, n).cast("string") for n in range(LOG_BYTES, LOG_BYTES - 4, -1)]
    whole = F.coalesce(*[F.when(F.is_valid_utf8(x), x) for x in cuts])
    return F.when(F.octet_length(raw) <= LOG_BYTES, flat).otherwise(F.concat(whole, F.lit("...")))
