"""Schemas from documentation: numbered field lists parsed into typed specs, and detection of the schema of a table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from pyspark.sql import types as T

DETECT_LEAST = 0.35
_FIELD = re.compile(r"^\s*(?P<index>\d{1,3})\s+(?P<name>[A-Z][A-Z0-9_]*)\s+(?P<kind>CHAR|NUMBER)\s*\((?P<size>\d+)\)\s*(?P<text>.*)$")
_CODE = re.compile(r"^\s*'?([A-Z0-9]{1,6})'?\s*=")
_LIST = re.compile(r"\[([A-Z0-9/ ,]+)\]")


@dataclass
class FieldSpec:
    index: int
    name: str
    kind: str
    size: int
    text: str
    codes: list[str] = field(default_factory=list)

    @property
    def is_date(self) -> bool:
        return "YYYYMMDD" in self.text.upper() or (self.name.endswith("date") and self.size == 8)

    @property
    def is_yes_no(self) -> bool:
        return bool(re.search(r"['\"]?Y['\"]?\s*(?:OR|/|,)\s*['\"]?N['\"]?|YES\s*/\s*NO", self.text.upper())) and self.size == 1


def identifier(value: str) -> str:
    """Lower case, other characters as underscores."""
    return re.sub(r"[^a-z0-9]+", "_", value.strip().lower()).strip("_")


def line_codes(line: str) -> list[str]:
    """Codes a line defines: ``CODE = meaning`` or ``[A,B]``."""
    single = _CODE.match(line)
    if single:
        return [single[1]]
    return [c.strip() for group in _LIST.findall(line) for c in group.split(",") if c.strip()]


def parse_schema(text: str) -> list[FieldSpec]:
    """Field specs of a documentation text; lines that continue a field add their words and codes to it. Raises if none is found."""
    specs: list[FieldSpec] = []
    for line in text.splitlines():
        m = _FIELD.match(line)
        if m and (not specs or int(m["index"]) == specs[-1].index + 1):
            specs.append(FieldSpec(int(m["index"]), identifier(m["name"]), m["kind"], int(m["size"]), m["text"].strip()))
            specs[-1].codes += [c for c in line_codes(m["text"]) if c not in specs[-1].codes]
        elif specs and line.strip() and line.startswith((" ", "\t")):
            specs[-1].text += " " + line.strip()
            specs[-1].codes += [c for c in line_codes(line) if c not in specs[-1].codes]
    if not specs:
        raise ValueError("no field is documented")
    return specs


@lru_cache(maxsize=16)
def schema_file(path: str) -> tuple[FieldSpec, ...]:
    return tuple(parse_schema(Path(path).read_text(encoding="latin-1")))


def spark_schema(specs: list[FieldSpec]) -> T.StructType:
    """All-string schema in file order; type, size and codes travel as metadata."""
    return T.StructType([T.StructField(s.name, T.StringType(), True, {"kind": s.kind, "size": s.size, "codes": s.codes}) for s in specs])


def detect_schema(columns: list[str], catalog: dict[str, list[str]], least: float = DETECT_LEAST) -> str | None:
    """The schema whose columns overlap best, if at least that share; ties to the first name."""
    have = {identifier(c) for c in columns}
    best = max(sorted(catalog), key=lambda n: len(have & set(catalog[n])) / max(1, len(catalog[n])), default=None)
    if best is None or len(have & set(catalog[best])) / max(1, len(catalog[best])) < least:
        return None
    return best


def allowed_values(spec: FieldSpec, override: dict[str, list[str]] | None = None) -> list[str] | None:
    """Override, else Y/N, else parsed codes, else none."""
    if override and spec.name in override:
        return override[spec.name]
    return ["N", "Y"] if spec.is_yes_no else spec.codes or None
