"""Sources: archives of delimited text without header, read in parallel with provenance; integrity manifests; table loading."""

from __future__ import annotations

import hashlib
import re
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = ("\t", "|", ",")
SAMPLE_CHARS = 8000
TABULAR = (".txt", ".csv", ".tsv")


def find_archives(folder: str, terms: list[str]) -> list[Path]:
    """Zip files whose name holds any term, case aside, sorted."""
    return sorted(p for p in Path(folder).glob("*.zip") if any(t.lower() in p.name.lower() for t in terms))


def extract_archive(archive: str | Path, target: str | Path, overwrite: bool = False) -> list[Path]:
    """Unpacks an archive; members that would leave the target are an error, files that exist stay unless told otherwise."""
    root = Path(target).resolve()
    root.mkdir(parents=True, exist_ok=True)
    out = set()
    with zipfile.ZipFile(archive) as bundle:
        for member in bundle.infolist():
            if member.is_dir():
                continue
            place = (root / member.filename).resolve()
            if not place.is_relative_to(root):
                raise ValueError(f"member outside the target: {member.filename}")
            if overwrite or not place.exists():
                place.parent.mkdir(parents=True, exist_ok=True)
                with bundle.open(member) as source, place.open("wb") as sink:
                    while chunk := source.read(1 << 20):
                        sink.write(chunk)
            out.add(place)
    return sorted(out)


def tabular_files(paths: list[Path]) -> list[Path]:
    return [p for p in paths if p.suffix.lower() in TABULAR]


def detect_delimiter(path: str | Path) -> str:
    """The delimiter most frequent in the first line with text, else in the sample, else tab; ties in the order tab, pipe, comma."""
    with open(path, encoding="latin-1", newline="") as source:
        sample = source.read(SAMPLE_CHARS)
    line = next((x for x in sample.splitlines() if x.strip()), "")
    for text in (line, sample):
        counts = {d: text.count(d) for d in DELIMITERS}
        if max(counts.values()):
            return max(DELIMITERS, key=lambda d: counts[d])
    return DELIMITERS[0]


def detect_encoding(path: str | Path) -> str:
    """utf-8 if the whole file decodes, else latin-1."""
    try:
        with open(path, encoding="utf-8") as source:
            while source.read(1 << 20):
                pass
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def read_delimited(spark: SparkSession, path: str, columns: list[str], delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """All-string rows of a headerless file. Rows with too many fields are skipped, short rows are padded with null.

    One extra column makes every row but those with one surplus field a "corrupt" one whose text is kept, and the delimiters
    outside quoted fields tell short rows from long ones, whether or not the surplus fields are empty.
    """
    sep = delimiter or detect_delimiter(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_surplus", "_record"]])
    raw = (
        spark.read.schema(schema).option("sep", sep).option("encoding", encoding or detect_encoding(path)).option("header", "false")
        .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record").option("columnPruning", "false").csv(path)
    )
    mark = re.escape(sep)
    bare = F.regexp_replace("_record", f'(^|{mark})"(?:[^"]|"")*"', "$1")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    # no null test on the record itself: the reader would apply it before the record is filled in
    kept = (F.coalesce(fields, F.lit(len(columns) + 1)) <= len(columns)) & (F.coalesce("_surplus", F.lit("")) == "")
    return raw.filter(kept).drop("_surplus", "_record")


def with_provenance(df: DataFrame, archive: str, file: str) -> DataFrame:
    return df.withColumns({"source_zip": F.lit(archive), "source_file": F.lit(file)})


def ingest_archives(spark: SparkSession, archives: list[Path], work: str, columns: list[str]) -> tuple[DataFrame, list[dict]]:
    """All tabular members of all archives in one table, and a manifest row per file. Raises if nothing is there."""
    frames, manifest = [], []
    for archive in archives:
        members = tabular_files(extract_archive(archive, Path(work) / archive.stem))
        for member in members:
            sep = detect_delimiter(member)
            frames.append(with_provenance(read_delimited(spark, str(member), columns, sep), archive.name, member.name))
            manifest.append({"source_zip": archive.name, "source_file": member.name, "delimiter": sep, "bytes": member.stat().st_size})
    if not frames:
        raise ValueError("no archive with a table was found")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), manifest


def resolve_input(stem: str, explicit: str | None = None) -> str:
    """The explicit path, else ``<stem>.parquet``, else ``<stem>.csv``."""
    for p in [explicit] if explicit else [f"{stem}.parquet", f"{stem}.csv"]:
        if Path(p).exists():
            return p
    raise FileNotFoundError(explicit or stem)


def load_frame(spark: SparkSession, path: str) -> DataFrame:
    """Parquet typed, CSV with header as strings, JSON by its own schema."""
    if path.endswith(".csv"):
        return spark.read.option("header", "true").option("inferSchema", "false").option("escape", '"').option("multiLine", "true").csv(path)
    return spark.read.json(path) if path.endswith(".json") else spark.read.parquet(path)


def light_typing(df: DataFrame, date_hints: tuple[str, ...] = ("date", "received", "incident")) -> DataFrame:
    """Trim, blank to null, dates by column name where any value parses, model years to numbers."""
    from caseloom.functions.columns import blank_to_null, to_date, to_int

    strings = [c for c, t in df.dtypes if t == "string"]
    out = df.withColumns({c: blank_to_null(F.col(c)) for c in strings})
    hinted = [c for c in strings if any(h in c.lower() for h in date_hints)]
    if hinted:
        some = out.agg(*[F.count(to_date(F.col(c))).alias(c) for c in hinted]).first()
        out = out.withColumns({c: to_date(F.col(c)) for c in hinted if some[c]})
    return out.withColumns({c: to_int(F.col(c)) for c in strings if c.lower() in ("model_year", "modelyear")})


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, sha256) of every file, hashed on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("sha256"))


def integrity(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed against a manifest (file_name, sha256)."""
    a, b = manifest.withColumnRenamed("sha256", "expected"), actual.withColumnRenamed("sha256", "found")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("found") != F.col("expected"), "changed")
    return a.join(b, "file_name", "full").withColumn("state", state).filter("state IS NOT NULL")


def sha256_of(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as source:
        while chunk := source.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()
