"""Schemas that drift between files of JSON records: one consistent table and an ordered report of every change.

Records are parsed into VARIANT and exploded into (file, field, type) within the scan's own stage, where they are folded through
a promotion lattice at once: a row per file and field leaves it, never a value. Files in load order with equal schemas form an
*epoch*; only the epochs' schemas reach the driver, so what it holds grows with the number of changes and not with the files.
Files are cast to the union schema, and consecutive epochs are compared. A field that vanishes and one that appears in the same
file are the *same* field when their content agrees: records delivered again in the later file must carry the same values
beyond chance (Cohen's kappa, so that two mostly-zero fields do not match by accident), or, where too few records came twice,
the value and shape distributions overlap; the report names the test. Only values of such fields are read for it.

Defined results: an unreadable payload contributes no field; a key with only nulls belongs to the file but has no type, so no
type change is reported against it; keys compare with case; an empty feed gives an empty report; rows delivered twice are
harmless; a file that the load order does not name comes last, by name.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.session import materialize

TEXT, WHOLE, DECIMAL, FLAG = "text", "whole number", "decimal number", "true/false"
KAPPA_LEAST, MATCHES_LEAST, OVERLAP_LEAST = 0.75, 4, 0.8  # MATCHES_LEAST: records beyond those expected to agree by chance
BROADCAST_ROWS = 100_000
REPORT_SCHEMA = "source_file string, load_seq int, position int, change_kind string, field_name string, old_name string, old_type string, new_type string, evidence string"

SPARK_TYPE = {TEXT: "string", WHOLE: "bigint", DECIMAL: "double", FLAG: "boolean"}


def join_types(a: str | None, b: str | None) -> str | None:
    """Least upper bound in the lattice: nothing < whole < decimal < text and nothing < true/false < text."""
    if a is None or b is None or a == b:
        return a or b
    return DECIMAL if {a, b} == {WHOLE, DECIMAL} else TEXT


def explode_records(df: DataFrame, payload: str, file_field: str, record_key: str | None = None) -> DataFrame:
    """Rows (file, rec, field, val), val a VARIANT; one per key that a record names."""
    spark = df.sparkSession
    parsed = df.select(F.col(file_field).alias("file"), F.try_parse_json(F.col(payload)).alias("v"))
    rec = F.try_variant_get("v", f"$.{record_key}", "string") if record_key else F.lit(None).cast("string")
    long = parsed.withColumn("rec", rec).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return long.select("file", "rec", F.col("key").alias("field"), F.col("value").alias("val")).filter(F.col("field").isNotNull())


def number_of(value: Column) -> Column:
    """The number a value writes, with thousands marks and a unit behind it allowed; null for other texts."""
    v = F.lower(F.trim(value))
    written = F.regexp_extract(v, r"^([-+]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]*)?)(?: ?[a-z]{1,5}\.?)?$", 1)
    return F.regexp_replace(written, ",", "").try_cast("double")


def canonical(value: Column) -> Column:
    """A value without its way of writing: case, thousands marks, units, decimals behind a whole number, yes/no words."""
    v = F.lower(F.trim(value))
    number = number_of(value)
    return F.when(v.isin("y", "yes", "true", "t"), "1").when(v.isin("n", "no", "false", "f"), "0").when(number.isNotNull(), F.floor(number).cast("string")).otherwise(v)


@dataclass
class FieldSchema:
    """A field of one epoch: its type and whether its texts are all numbers or all yes/no marks."""

    kind: str | None = None
    numeric_text: bool = True
    flag_text: bool = True
    fractional: bool = False


@dataclass
class FileSchema:
    """An epoch: its first file, the file before that, and the fields all its files have."""

    name: str
    seq: int
    epoch: int
    before: str | None
    fields: dict[str, FieldSchema] = field(default_factory=dict)


def file_fields(df: DataFrame, payload: str, file_field: str) -> DataFrame:
    """(file, field, kind, numeric, flags, fractional): the types of a file's values folded through the lattice, in one pass."""
    long = explode_records(df, payload, file_field)
    kind = F.schema_of_variant("val")
    typed = long.select("file", "field", F.when(kind == "BIGINT", WHOLE).when(kind == "BOOLEAN", FLAG).when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), DECIMAL).when(kind != "VOID", TEXT).alias("kind"), F.try_variant_get("val", "$", "string").alias("value"))
    # numbers in texts are looked for in texts only; decimal numbers speak for themselves
    v = F.lower(F.trim("value"))
    number = F.when(F.col("kind") == TEXT, number_of(F.col("value"))).when(F.col("kind") == DECIMAL, F.col("value").try_cast("double"))
    has = lambda k: F.coalesce(F.max(F.col("kind") == k), F.lit(False))
    folded = typed.groupBy("file", "field").agg(
        has(TEXT).alias("t"),
        has(WHOLE).alias("w"),
        has(DECIMAL).alias("d"),
        has(FLAG).alias("f"),
        F.every(F.when(F.col("kind") == TEXT, number.isNotNull()).otherwise(F.coalesce(F.col("kind") != FLAG, F.lit(True)))).alias("numeric"),
        F.every(F.coalesce((F.col("kind") == FLAG) | v.isin("y", "n", "yes", "no", "true", "false", "0", "1", "0.0", "1.0"), F.lit(True))).alias("flags"),
        F.some(F.coalesce(number != F.floor(number), F.lit(False))).alias("fractional"),
    )
    mixed = F.col("t") | (F.col("f") & (F.col("w") | F.col("d")))
    return folded.select("file", "field", F.when(mixed, TEXT).when(F.col("d"), DECIMAL).when(F.col("w"), WHOLE).when(F.col("f"), FLAG).alias("kind"), "numeric", "flags", "fractional")


def file_epochs(fields: DataFrame, files: DataFrame) -> DataFrame:
    """(file, load_seq, epoch, before): files in load order; an epoch begins where fields or types differ from the file before."""
    shapes = fields.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("field", F.coalesce("kind", F.lit("")).alias("kind")))).alias("shape"))  # bounded by a file's fields
    order = files.groupBy("file").agg(F.min("load_seq").alias("load_seq"))
    placed = shapes.join(order, "file", "left").select("file", "load_seq", F.xxhash64("shape").alias("a"), F.md5(F.to_json("shape")).alias("b"))
    line = Window.orderBy(F.col("load_seq").asc_nulls_last(), "file")  # one row per file
    changed = (~F.col("b").eqNullSafe(F.lag("b").over(line))).cast("int")
    return placed.withColumns({"_new": changed, "before": F.lag("file").over(line)}).withColumn("epoch", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).select("file", "load_seq", "epoch", F.when(F.col("_new") == 1, F.col("before")).alias("before"), (F.col("_new") == 1).alias("first"))


def epoch_schemas(fields: DataFrame, epochs: DataFrame) -> list[FileSchema]:
    """Schemas of the epochs in order: epochs x fields rows on the driver."""
    heads = {r["epoch"]: FileSchema(r["file"], r["load_seq"], r["epoch"], r["before"]) for r in epochs.filter("first").orderBy("epoch").collect()}
    folded = fields.join(epochs.select("file", "epoch"), "file").groupBy("epoch", "field").agg(F.max("kind").alias("kind"), F.every("numeric").alias("numeric"), F.every("flags").alias("flags"), F.some("fractional").alias("fractional"))
    for r in folded.collect():
        heads[r["epoch"]].fields[r["field"]] = FieldSchema(r["kind"], r["numeric"], r["flags"], r["fractional"])
    return [heads[e] for e in sorted(heads)]


def candidate_values(df: DataFrame, payload: str, file_field: str, record_key: str, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """(now, side, field, rec, raw): the values of lost fields in the file before, and of new fields in the file itself, as written."""
    spark = df.sparkSession
    wanted = sorted({(b, lo, n, "a") for b, lo, n, _ in pairs} | {(n, fr, n, "b") for _, _, n, fr in pairs})
    bounded = F.broadcast if len(wanted) <= BROADCAST_ROWS else (lambda x: x)  # counted: the fields that came or went
    small = bounded(spark.createDataFrame(wanted, "file string, field string, now string, side string"))
    names = bounded(spark.createDataFrame([(f,) for f in sorted({w[0] for w in wanted})], "_file string"))
    here = df.join(names, F.col(file_field) == F.col("_file"), "left_semi")
    long = explode_records(here, payload, file_field, record_key).join(small, ["file", "field"])
    return long.filter(~F.is_variant_null("val")).select("now", "side", "field", "rec", F.try_variant_get("val", "$", "string").alias("raw"))


def rename_evidence(values: DataFrame) -> dict[tuple[str, str, str], tuple[float, str]]:
    """How well the content of each (file, lost field, new field) agrees, from 0 to 1, and by which test."""
    key = ["now", "lost", "fresh"]
    once = values.filter(F.col("rec").isNotNull()).groupBy("now", "rec", "side", "field").agg(F.min("raw").alias("raw")).select("now", "rec", "side", "field", canonical(F.col("raw")).alias("value"))
    entries = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("field", "value")))
    met = once.groupBy("now", "rec").agg(entries("a").alias("old"), entries("b").alias("new"))  # at most the fields that came or went
    cells = met.select("now", F.explode("old").alias("o"), "new").select("now", "o", F.explode("new").alias("n"))
    cells = cells.groupBy("now", F.col("o.field").alias("lost"), F.col("n.field").alias("fresh"), F.col("o.value").alias("a"), F.col("n.value").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(cells, "rename-cells")
    agree = cells.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(*key, F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*key, F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*key, "v"]).groupBy(*key).agg(F.sum(F.col("na") * F.col("nb")).alias("by_chance"))
    scores: dict[tuple[str, str, str], tuple[float, str]] = {}
    for r in agree.join(chance, key, "left").collect():
        observed, expected = r["same"] / r["n"], (r["by_chance"] or 0) / r["n"] ** 2
        if r["n"] * (1 - expected) >= MATCHES_LEAST:
            scores[(r["now"], r["lost"], r["fresh"])] = (max(0.0, (observed - expected) / (1 - expected)) - KAPPA_LEAST + OVERLAP_LEAST, "same records")
    return scores


def distribution_overlap(values: DataFrame, missing: list[tuple[str, str, str]]) -> dict[tuple[str, str, str], tuple[float, str]]:
    """The overlap of the values' and shapes' distributions of (file, lost, new), for pairs that records cannot decide."""
    spark = values.sparkSession
    values = values.groupBy("now", "side", "field", "raw").agg(F.count(F.lit(1)).alias("n")).withColumn("value", canonical(F.col("raw")))
    shape = F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), "[a-z]+", "a")
    # texts draw few distinct values at random, so shapes count as the floor and equal values as the ceiling
    drawn = values.select("now", "side", "field", "n", F.explode(F.array(F.struct(F.lit("v").alias("part"), F.col("value").alias("v")), F.struct(F.lit("s").alias("part"), shape.alias("v")))).alias("e"))
    counts = drawn.groupBy("now", "side", "field", "e.part", "e.v").agg(F.sum("n").alias("n"))
    total = counts.groupBy("now", "side", "field", "part").agg(F.sum("n").alias("total"))
    shares = counts.join(total, ["now", "side", "field", "part"]).select("now", "side", "field", "part", "v", (F.col("n") / F.col("total")).alias("share"))
    pairs = spark.createDataFrame(missing, "now string, lost string, fresh string")
    old = shares.filter("side = 'a'").select("now", F.col("field").alias("lost"), "part", "v", F.col("share").alias("sa")).join(pairs, ["now", "lost"])
    new = shares.filter("side = 'b'").select("now", F.col("field").alias("fresh"), "part", "v", F.col("share").alias("sb"))
    met = old.join(new, ["now", "fresh", "part", "v"]).groupBy("now", "lost", "fresh").agg((F.sum(F.least("sa", "sb")) / 2).alias("score"))  # two parts
    return {(r["now"], r["lost"], r["fresh"]): (r["score"], "distributions") for r in met.collect()}


def schema_changes(schemas: list[FileSchema], scores: dict[tuple[str, str, str], tuple[float, str]]) -> list[tuple]:
    """Ordered change rows (REPORT_SCHEMA) between consecutive epochs."""
    report: list[tuple] = []
    for before, now in zip(schemas, schemas[1:]):
        lost, fresh = set(before.fields) - set(now.fields), set(now.fields) - set(before.fields)
        ranked = sorted(((*scores.get((now.name, lo, fr), (0.0, "")), lo, fr) for lo in lost for fr in fresh), key=lambda x: (-x[0], x[2], x[3]))
        renamed: dict[str, tuple[str, str]] = {}
        for score, test, lo, fr in ranked:
            if score >= OVERLAP_LEAST and fr not in renamed and lo not in {x for x, _ in renamed.values()}:
                renamed[fr] = (lo, test)
        origin = lambda name: renamed[name][0] if name in renamed else name
        rows = [("renamed" if fr in renamed else "added", fr, *renamed.get(fr, ("", None))) for fr in fresh]
        rows += [("removed", lo, "", None) for lo in lost - {x for x, _ in renamed.values()}]
        for name, f in now.fields.items():
            old = before.fields.get(origin(name))
            if old is not None and old.kind and f.kind and old.kind != f.kind:
                rows.append(("type_changed", name, "", None))
        for position, (kind, name, old_name, test) in enumerate(sorted(rows, key=lambda r: r[:3]), 1):
            source = before.fields.get(origin(name) if kind == "type_changed" else old_name or name)
            target = now.fields.get(name)
            report.append((now.name, now.seq, position, kind, name, old_name, source.kind if source else None, target.kind if target else None, test))
    return report


def unified_columns(schemas: list[FileSchema], report: list[tuple]) -> dict[str, tuple[str, list[tuple[int, str]]]]:
    """Column -> (type, [(epoch, name in that epoch)]): rename chains joined under their first name, types under the lattice."""
    current: dict[str, str] = {}
    renames = {(r[0], r[4]): r[5] for r in report if r[3] == "renamed"}
    taken: set[str] = set()
    members: dict[str, list[tuple[int, str]]] = defaultdict(list)
    kinds: dict[str, list[FieldSchema]] = defaultdict(list)
    known: dict[str, str] = {}
    for s in schemas:
        fresh: dict[str, str] = {}
        for name, f in s.fields.items():
            origin = renames.get((s.name, name))
            column = current.get(origin) if origin else current.get(name)
            if column is None:
                column = known.get(name, name)  # a field that comes back takes up its old column
                if column in taken and column in fresh.values():
                    column = name
                number = 2
                while any(c != column and c.lower() == column.lower() for c in taken) or column in fresh.values():
                    column, number = f"{name}_{number}", number + 1  # names that differ by case only are told apart
            fresh[name] = known[name] = column
            taken.add(column)
            members[column].append((s.epoch, name))
            kinds[column].append(f)
        current = fresh
    out = {}
    for column, fields in kinds.items():
        joined = None
        for f in fields:
            joined = join_types(joined, f.kind)
        real = [f for f in fields if f.kind]
        if joined == TEXT and any(f.kind != TEXT for f in real):
            if all(f.flag_text for f in real):
                joined = FLAG
            elif all(f.numeric_text for f in real):
                joined = DECIMAL if any(f.fractional for f in real) else WHOLE
        out[column] = (joined or TEXT, members[column])
    return out


def unified_table(df: DataFrame, epochs: DataFrame, payload: str, file_field: str, keep: list[str], columns: dict[str, tuple[str, list[tuple[int, str]]]]) -> DataFrame:
    """Every record in one consistent set of columns; nothing is exploded, each record reads its epoch's own names.

    ``epochs`` has a row per file; the expression grows with the changes of names.
    """
    placed = df.join(epochs.select(F.col("file").alias("_file"), F.col("epoch").alias("_epoch")), F.col(file_field).eqNullSafe(F.col("_file")), "left").withColumn("_v", F.try_parse_json(F.col(payload)))
    out = []
    for column, (kind, members) in sorted(columns.items()):
        by_name: dict[str, list[int]] = defaultdict(list)
        for epoch, name in members:
            by_name[name].append(epoch)
        raw = F.lit(None).cast("string")
        for name, own in sorted(by_name.items()):
            raw = F.when(_within(F.col("_epoch"), sorted(own)), F.try_variant_get("_v", f"$['{name}']", "string")).otherwise(raw)
        if kind in (WHOLE, DECIMAL):
            value = number_of(raw)
            value = value.cast("bigint") if kind == WHOLE else value
        elif kind == FLAG:
            value = canonical(raw).try_cast("int") == 1
        else:
            value = raw
        out.append(value.alias(column if column.lower() not in {k.lower() for k in keep} else f"payload_{column}"))
    return placed.select(*[F.col(k) for k in keep], *out)


def _within(epoch: Column, own: list[int]) -> Column:
    """Whether an epoch is one of these, as ranges."""
    ranges: list[list[int]] = []
    for e in own:
        if ranges and ranges[-1][1] == e - 1:
            ranges[-1][1] = e
        else:
            ranges.append([e, e])
    return reduce(lambda a, b: a | b, [epoch.between(a, b) for a, b in ranges])


def feed_drift(df: DataFrame, files: DataFrame, payload: str = "payload", file_field: str = "source_file", record_key: str = "cmplid") -> tuple[DataFrame, list[FileSchema], list[tuple]]:
    """(files with their epochs, epochs' schemas in order, change report) of a feed; ``files`` has (file, load_seq)."""
    fields = materialize(file_fields(df, payload, file_field), "drift-fields")
    epochs = materialize(file_epochs(fields, files), "drift-epochs")
    schemas = epoch_schemas(fields, epochs)
    pairs = []
    for before, now in zip(schemas, schemas[1:]):
        lost, fresh = sorted(set(before.fields) - set(now.fields)), sorted(set(now.fields) - set(before.fields))
        pairs += [(now.before, lo, now.name, fr) for lo in lost for fr in fresh]
    scores: dict[tuple[str, str, str], tuple[float, str]] = {}
    if pairs:
        values = materialize(candidate_values(df, payload, file_field, record_key, pairs), "drift-values")
        scores = rename_evidence(values)
        missing = sorted({(n, lo, fr) for _, lo, n, fr in pairs} - set(scores))
        if missing:
            scores |= distribution_overlap(values, missing)
    return epochs, schemas, schema_changes(schemas, scores)
