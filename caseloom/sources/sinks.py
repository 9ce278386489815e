"""Sinks: tables by suffix, JSON documents, and manifests with their checks."""

from __future__ import annotations

import datetime as dt
import json
import math
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

RELEASE_STATES = ("official", "promoted")


def write_frame(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet, CSV or JSON by suffix; a failure is a failure, no other format is tried."""
    writer = df.write.mode(mode)
    if path.endswith(".csv"):
        writer.option("header", "true").option("escape", '"').csv(path)
    elif path.endswith(".json"):
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def json_ready(value: object) -> object:
    """Plain JSON values: dates as ISO text, spans and paths as text, NaN as null, tuples and arrays as lists."""
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, np.ndarray)):
        return [json_ready(v) for v in value]
    if isinstance(value, np.generic):
        return json_ready(value.item())
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (dt.timedelta, Path)):
        return str(value)
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if hasattr(value, "asDict"):
        return json_ready(value.asDict(recursive=True))
    return value


def write_json(payload: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(json_ready(payload), indent=2, ensure_ascii=False), encoding="utf-8")


def load_json(path: str) -> object:
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return json.loads(Path(path).read_text(encoding="utf-8"))


def require_fields(payload: dict, fields: list[str], name: str = "manifest") -> None:
    """Dotted fields that must be there and not null."""
    for path in fields:
        at: object = payload
        for part in path.split("."):
            if not isinstance(at, dict) or at.get(part) is None:
                raise ValueError(f"{name} lacks {path}")
            at = at[part]


def validate_manifest(payload: dict, fields: list[str], name: str = "manifest") -> None:
    require_fields(payload, fields, name)
    if payload.get("release_status") not in RELEASE_STATES:
        raise ValueError(f"{name} is not released: {payload.get('release_status')!r}")


def replace_between(text: str, start: str, end: str, block: str) -> str:
    """The text between two marks replaced; both marks must be there, in order."""
    a = text.find(start)
    b = text.find(end, a + len(start))
    if a < 0 or b < 0:
        raise ValueError("marks not found")
    return text[: a + len(start)] + "\n" + block.strip() + "\n" + text[b:]
