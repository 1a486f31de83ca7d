"""Model-backed batch operators: an injected callable for each row, strict parsing, no network.

The callable gets a row as a dictionary and returns the model's answer as text. Rows run where they lie (mapInArrow); a failing or malformed
answer is that row's result and stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .curate import parse_answer

Ask = Callable[[dict], str]


def _asked(rows: DataFrame, ask: Ask, id_col: str, fields: dict[str, type], ok: Callable[[dict], bool] = lambda a: True) -> DataFrame:
    kinds = {str: (pa.string(), "string"), bool: (pa.bool_(), "boolean"), int: (pa.int64(), "bigint")}
    schema = pa.schema([(id_col, pa.int64()), *((k, kinds[t][0]) for k, t in fields.items()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    answer = parse_answer(ask(row), fields)
                    error = None if answer is not None and ok(answer) else "parse_error"
                except Exception as e:  # the service's failure is the row's result
                    answer, error = None, str(e)
                out.append((row[id_col], *((answer[k] if error is None else None) for k in fields), error))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[] for _ in schema], schema)], schema=schema)

    return rows.mapInArrow(run, f"{id_col} bigint, " + ", ".join(f"{k} {kinds[t][1]}" for k, t in fields.items()) + ", error string")


def evaluate(rows: DataFrame, ask: Ask, id_col: str = "image_id") -> DataFrame:
    """image_id, assessment, unusable, content, error; all three fields or a parse error."""
    return _asked(rows, ask, id_col, {"assessment": str, "unusable": bool, "content": str})


def compare(pairs: DataFrame, ask: Ask, id_col: str = "pair_id") -> DataFrame:
    """pair_id, winner (a or b), reason, error."""
    return _asked(pairs, ask, id_col, {"winner": str, "reason": str}, lambda a: a["winner"] in ("a", "b"))


def suggest_style(rows: DataFrame, ask: Ask, styles: list[str], id_col: str = "image_id") -> DataFrame:
    """image_id, style, error; a style outside the closed list is an error."""
    return _asked(rows, ask, id_col, {"style": str}, lambda a: a["style"] in styles)
