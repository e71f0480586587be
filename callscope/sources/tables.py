"""Manifest, feature tables, the canonical table and the trust registry, with their contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from callscope.operators import order

KEY = ["call_id", "side", "utt_num"]
FILE, TRANSCRIPT = "Utterance File Name", "Transcript"
_FILE_RE = r"^\d{3,}/sw(\d{4,})([AB])-U(\d{4,})\.wav$"
FAMILIES = ("volume", "interactional", "tannen", "prosody", "meta")
LEVELS = {"validated": ("Trusted",), "provisional": ("Trusted", "WIP"), "all": ("Trusted", "WIP", "Deprecated")}


def format_key(call: Column, side: Column, utt: Column) -> Column:
    """The file name that identifies an utterance."""
    return F.format_string("%03d/sw%04d%s-U%04d.wav", F.floor(call / 10).cast("long"), call.cast("long"), side, utt.cast("long"))


def parse_key(key: Column) -> dict[str, Column]:
    """call_id, side, utt_num, side_key of a file name; nulls if it is none."""
    part = lambda i: F.nullif(F.regexp_extract(key, _FILE_RE, i), F.lit(""))
    return {"call_id": part(1).try_cast("long"), "side": part(2), "utt_num": part(3).try_cast("long"), "side_key": F.concat(F.lit("sw"), part(1), part(2))}


def build_manifest(utterances: DataFrame) -> DataFrame:
    return utterances.select(format_key(F.col("call_id"), F.col("side"), F.col("utt_num")).alias(FILE), F.col("text").alias(TRANSCRIPT))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file; another header is an error."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if df.columns != [FILE, TRANSCRIPT]:
        raise ValueError(f"not a manifest: columns {df.columns}")
    return df


def pending_units(units: DataFrame, manifest: DataFrame) -> DataFrame:
    """Units (call_id, side) that the manifest doesn't hold yet."""
    k = parse_key(F.col(f"`{FILE}`"))
    return units.join(manifest.select(k["call_id"].alias("call_id"), k["side"].alias("side")).distinct(), ["call_id", "side"], "left_anti")


def select_units(units: DataFrame, calls: DataFrame | None = None, sides: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Distinct (call_id, side) units of the given calls and sides, in order, the first `limit`."""
    out = units.select("call_id", "side").dropDuplicates()
    if calls is not None:
        out = out.join(calls.select("call_id"), "call_id", "left_semi")
    if sides is not None:
        out = out.where(F.col("side").isin(*sides))
    return out.orderBy("call_id", "side").limit(limit) if limit is not None else out


def write_feature(manifest: DataFrame, feature: DataFrame, path: str, key: list[str] = KEY) -> None:
    """One row per manifest row, null where the feature has none."""
    manifest.select(*key).join(feature, key, "left").write.mode("overwrite").parquet(path)


def build_table(manifest: DataFrame, features: dict[str, DataFrame], key: list[str] = KEY) -> DataFrame:
    """The manifest with all feature tables' columns. Each table must have each manifest key once, no other, and new columns.

    Manifest and tables are one union, dealt out and grouped by key once: the groups hold each input's columns and how many rows it
    has, so that the contract is checked on the very rows that are returned and each table is worked out once. A breach names the table.
    """
    have = set(manifest.columns)
    for name, df in features.items():
        missing = [k for k in key if k not in df.columns]
        if missing:
            raise ValueError(f"{name}: no key column {missing}")
        twice = (set(df.columns) - set(key)) & have
        if twice:
            raise ValueError(f"{name}: columns already there: {sorted(twice)}")
        if len(df.columns) == len(key):
            raise ValueError(f"{name}: no value column")
        have |= set(df.columns)
    grouped, of = _united({"manifest": manifest, **features}, key)
    n = grouped.agg(*[x for i in range(len(of)) for x in (F.count_if(F.col("n_")[i] > 1).alias(f"twice{i}"), F.count_if((F.col("n_")[i] == 0) & (F.col("n_")[0] > 0)).alias(f"lost{i}"), F.count_if((F.col("n_")[i] > 0) & (F.col("n_")[0] == 0)).alias(f"extra{i}"))]).first()
    for i, name in enumerate(of):
        if n[f"twice{i}"]:
            raise ValueError(f"{name}: {n[f'twice{i}']} keys occur more than once")
        if n[f"lost{i}"] or n[f"extra{i}"]:
            raise ValueError(f"{name}: {n[f'lost{i}']} manifest rows are missing, {n[f'extra{i}']} rows are extra")
    return grouped.select(*manifest.columns, *[f"`{c}`" for df in features.values() for c in df.columns if c not in key])


def union_rows(manifest: DataFrame, features: dict[str, DataFrame], key: list[str] = KEY) -> DataFrame:
    """The manifest's keys with all tables' columns, null where a table has no row: one union and grouping; a key twice is one row."""
    grouped, _ = _united({"manifest": manifest, **features}, key, settle=False)
    return grouped.where("n_[0] > 0").drop("n_")


def _united(tables: dict[str, DataFrame], key: list[str], settle: bool = True) -> tuple[DataFrame, list[str]]:
    """(a row for each key: n_, the rows of each table, and all tables' value columns; the tables' names), worked out once."""
    own = [[c for c in df.columns if c not in key] for df in tables.values()]
    kinds = [StructType([StructField(c, df.schema[c].dataType) for c in columns]) for df, columns in zip(tables.values(), own)]
    sides = []
    for i, df in enumerate(tables.values()):
        rows = [(F.struct(*[F.col(f"`{c}`") for c in own[j]]) if i == j else F.lit(None).cast(kinds[j])).alias(f"of{j}_") for j in range(len(own)) if own[j]]
        sides.append(df.select(*key, F.array(*[F.lit(int(i == j)) for j in range(len(tables))]).alias("of_"), *rows))
    all_rows = reduce(DataFrame.unionByName, sides).repartition(*key)  # dealt first: each table has a key once, so grouping before would sort for nothing
    n = F.array(*[F.sum(F.col("of_")[i]) for i in range(len(tables))])
    met = all_rows.groupBy(*key).agg(n.alias("n_"), *[F.first(f"of{j}_", ignorenulls=True).alias(f"of{j}_") for j in range(len(own)) if own[j]])  # a table's columns as one
    values = dict.fromkeys(c for columns in own for c in columns)
    grouped = met.select(*key, "n_", *[F.coalesce(*[F.col(f"of{j}_")[c] for j in range(len(own)) if c in own[j]]).alias(c) for c in values])
    return order.settled(grouped) if settle else grouped, list(tables)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(position, column, extractor, family, status, note) from a document whose sections are tables; status is the section."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("position", "line"))
    heading = F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 1000)))
    cells = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    rows = filled(lines, heading, "status", "position").where(F.col("line").startswith("|")).withColumn("c", cells).where((F.size("c") >= 6) & ~F.get("c", F.lit(1)).rlike(r"^(-+|:?-+:?|Column)$"))
    clean = lambda i: F.replace(F.get("c", F.lit(i)), F.lit("`"), F.lit(""))
    return rows.select("position", clean(1).alias("column"), clean(2).alias("extractor"), clean(3).alias("family"), F.regexp_extract("status", r"^(\w+)", 1).alias("status"), F.get("c", F.lit(4)).alias("note"))


def filled(rows: DataFrame, value: Column, name: str, at: str, *by: str) -> DataFrame:
    """Adds name: the last value that isn't null up to each row, in each group; without groups the rows are those of one document."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(at)))


def check_registry(registry: DataFrame) -> DataFrame:
    """The registry itself; an empty one, an unknown family or a column twice is an error."""
    n = registry.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("family").isin(*FAMILIES)).alias("bad")).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") > 1).alias("twice"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    for problem, found in (("no columns", not n["all"]), ("columns registered twice", n["twice"]), ("unknown families", n["bad"])):
        if found:
            raise ValueError(f"registry: {problem}")
    return registry


def validate_registry(columns: DataFrame, registry: DataFrame) -> DataFrame:
    """(column, problem): columns present but not registered, and registered but absent."""
    here, known = columns.select("column"), registry.select("column")
    return here.exceptAll(known).select("column", F.lit("unregistered").alias("problem")).unionByName(known.exceptAll(here).select("column", F.lit("missing").alias("problem")))


def selected_columns(registry: DataFrame, include: str = "validated", family: str | None = None) -> list[str]:
    """Registered columns at or above a trust floor, in document order."""
    if include not in LEVELS:
        raise ValueError(f"include must be one of {sorted(LEVELS)}")
    r = registry.where(F.col("status").isin(*LEVELS[include]))
    r = r.where(F.col("family") == family) if family else r
    return [x["column"] for x in r.orderBy("position").select("column").collect()]  # a row a feature


def load_features(table: DataFrame, registry: DataFrame, include: str = "validated", family: str | None = None, with_meta: bool = True, key: list[str] = KEY) -> DataFrame:
    """The chosen columns only, so that a Parquet scan reads no others."""
    chosen = [c for c in selected_columns(registry, include, family) if c in table.columns]
    return table.select(*(key if with_meta else []), *[f"`{c}`" for c in chosen])


def assert_fresh(spark: SparkSession, table: str, inputs: list[str]) -> None:
    """Fails if any input file is newer than the table."""
    def newest(path: str):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.max("modificationTime")).first()[0]

    built = newest(table)
    stale = [p for p in inputs if newest(p) > built]
    if stale:
        raise ValueError(f"{table} is older than {stale}")


def verify_durations(manifest: DataFrame, audio: DataFrame, utterances: DataFrame, n: int | None, seed: int, tolerance: float = 0.005) -> DataFrame:
    """(key, reason) for a seeded sample of n manifest rows (None: all, without a sort) whose audio length disagrees with the transcript, or can't be told."""
    k = parse_key(F.col(f"`{FILE}`"))
    some = manifest if n is None else manifest.orderBy(F.xxhash64(F.lit(seed), f"`{FILE}`"), f"`{FILE}`").limit(n)
    sample = some.select(F.col(f"`{FILE}`").alias("file"), k["call_id"].alias("call_id"), k["side"].alias("side"), k["utt_num"].alias("utt_num"))
    j = sample.join(audio.select("file", "seconds"), "file", "left").join(utterances.select(*KEY, F.round(F.col("end") - F.col("start"), 6).alias("expected")), KEY, "left")
    reason = F.when(F.col("call_id").isNull(), "bad key").when(F.col("seconds").isNull(), "no audio").when(F.col("expected").isNull(), "no transcript line").when(F.round(F.abs(F.col("seconds") - F.col("expected")), 6) > tolerance, "duration differs")
    return j.select("file", reason.alias("reason"))


def merge_features(table: DataFrame, feature: DataFrame, managed: list[str], key: list[str] = KEY) -> DataFrame:
    """Replaces the managed columns by the feature table's: running it again changes nothing."""
    return table.drop(*managed).join(feature.select(*key, *managed), key, "left")


def union_columns(table: DataFrame, *sets: list[str], key: list[str] = KEY) -> DataFrame:
    """One select of several feature sets; a shared column counts once."""
    return table.select(*key, *dict.fromkeys(c for s in sets for c in s))


def dashboard(registry: DataFrame) -> DataFrame:
    """(family, status, n) with totals."""
    return registry.cube("family", "status").agg(F.count(F.lit(1)).alias("n"))


def write_scores(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").option("header", "true").format(kind).save(path)
