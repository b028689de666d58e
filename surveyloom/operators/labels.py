"""Code <-> label maps: building them from data, reading, writing, looking up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.functions.cells import is_code

LabelMap = dict[str, dict[str, str]]


def variable_dictionary(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """(name, simplab), one row per name.

    With ``order_col`` the row that comes last wins. Without it rows have no
    order, so two different labels for one name are an error.
    """
    if order_col is not None:
        return df.groupBy("name").agg(F.max_by("simplab", order_col).alias("simplab"))
    clash = F.raise_error(F.concat(F.lit("different labels for variable "), F.col("name")))
    return (
        df.groupBy("name")
        .agg(F.min("simplab").alias("_low"), F.max("simplab").alias("_high"))
        .select(
            "name",
            F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low"))
            .otherwise(clash)
            .alias("simplab"),
        )
    )


def dictionary_of(df: DataFrame) -> dict[str, str]:
    """The dictionary on the driver, one entry per variable of the schema."""
    return {row["name"]: row["simplab"] for row in df.select("name", "simplab").collect()}


def code_label_join(
    num: DataFrame, text: DataFrame, targets: list[str], id_col: str = fv.ID_COLUMN
) -> DataFrame:
    """(id, feature, code, label): the coded and the spelled-out cell side by side."""
    codes = num.select(id_col, *[F.col(t).cast("string").alias(f"{t}_code") for t in targets])
    labels = text.select(id_col, *[F.col(t).cast("string").alias(f"{t}_label") for t in targets])
    cells = [
        F.struct(
            F.lit(t).alias("feature"),
            F.col(f"{t}_code").alias("code"),
            F.col(f"{t}_label").alias("label"),
        )
        for t in targets
    ]
    return (
        codes.join(labels, id_col)
        .select(id_col, F.explode(F.array(*cells)).alias("_cell"))
        .select(id_col, "_cell.*")
    )


def label_map(
    cells: DataFrame, id_col: str = fv.ID_COLUMN, include_missing: bool = False
) -> DataFrame:
    """(feature, code, label, first_id): the label of the lowest id wins."""
    wanted = cells.where(F.col("code").isNotNull())
    if not include_missing:
        wanted = wanted.where(is_code(F.col("code")))
    return wanted.groupBy("feature", "code").agg(
        F.min_by("label", id_col).alias("label"), F.min(id_col).alias("first_id")
    )


def reverse_label_map(labels: DataFrame) -> DataFrame:
    """(feature, label, code): of codes that share a label the one first seen last wins."""
    return labels.groupBy("feature", "label").agg(
        F.max_by("code", F.struct("first_id", "code")).alias("code")
    )


def feature_domains(labels: DataFrame) -> DataFrame:
    """(feature, domain): the legal codes of each target in ascending order."""
    return labels.groupBy("feature").agg(
        F.sort_array(F.collect_set(F.col("code").cast("int"))).alias("domain")
    )


def labels_of(labels: DataFrame) -> LabelMap:
    """feature -> code -> label on the driver, in the order codes were first seen.

    The table has one row per legal answer of a target, the same size as the
    JSON file it may come from.
    """
    result: LabelMap = {}
    order = ["feature"] + (["first_id"] if "first_id" in labels.columns else []) + ["code"]
    for row in labels.orderBy(*order).collect():
        result.setdefault(row["feature"], {})[row["code"]] = row["label"]
    return result


def reverse_of(labels: LabelMap) -> dict[str, dict[str, str]]:
    """feature -> label -> code; of codes that share a label the last one wins."""
    return {f: {label: code for code, label in codes.items()} for f, codes in labels.items()}


def code_map_json(
    labels: DataFrame, key: str = "code", value: str = "label"
) -> DataFrame:
    """(feature, entries): each feature's map as one JSON object, sorted by key."""
    pairs = F.sort_array(F.collect_list(F.struct(key, value)))
    return labels.groupBy("feature").agg(F.to_json(F.map_from_entries(pairs)).alias("entries"))


def code_map_text(labels: DataFrame, key: str = "code", value: str = "label") -> DataFrame:
    """The whole nested map as a single JSON line, for use as a config file."""
    pairs = F.sort_array(F.collect_list(F.struct(key, value)))
    by_feature = labels.groupBy("feature").agg(F.map_from_entries(pairs).alias("codes"))
    features = F.sort_array(F.collect_list(F.struct("feature", F.map_entries("codes").alias("codes"))))
    nested = F.map_from_entries(
        F.transform(features, lambda f: F.struct(f.feature, F.map_from_entries(f.codes)))
    )
    return by_feature.agg(F.to_json(nested).alias("value"))


def code_map_lines(labels: DataFrame, key: str = "code", value: str = "label") -> DataFrame:
    """(feature, value): one JSON line per feature, as ``{feature: {key: value}}``, for maps of any size.

    A line holds the legal answers of one feature; no row or task holds more than the
    lines that its part of the features needs. A null key or value is left out.
    """
    there = labels.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))
    line = F.to_json(F.create_map("feature", "_entries")).alias("value")
    return there.groupBy("feature").agg(entries.alias("_entries")).select("feature", line)


def code_map_rows(text: DataFrame) -> DataFrame:
    """(feature, code, label) from JSON maps in column ``value``: one nested map, or a line per feature."""
    nested = F.from_json("value", "map<string,map<string,string>>")
    return (
        text.select(F.explode(nested).alias("feature", "_codes"))
        .select("feature", F.explode("_codes").alias("code", "label"))
    )


def task_rows(text: DataFrame) -> DataFrame:
    """(feature, task_type, num_labels, range) from the nested JSON metadata."""
    nested = F.from_json(
        "value", "map<string,struct<task_type:string,num_labels:int,range:int>>"
    )
    return text.select(F.explode(nested).alias("feature", "_task")).select("feature", "_task.*")


def lookup(column: Column, mapping: dict[str, str], strict: bool = False) -> Column:
    """Map literal look-up; unknown keys give null, or an error when strict."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), column)
    if not strict:
        return found
    unknown = F.raise_error(
        F.concat(F.lit("no entry for "), F.coalesce(column.cast("string"), F.lit("null")))
    )
    return F.coalesce(found, unknown)


def label_to_code(
    df: DataFrame, columns: list[str], labels: LabelMap, strict: bool = False
) -> DataFrame:
    reverse = reverse_of(labels)
    return df.withColumns({c: lookup(F.col(c), reverse[c], strict) for c in columns})


def code_to_label(
    df: DataFrame, columns: list[str], labels: LabelMap, strict: bool = False
) -> DataFrame:
    return df.withColumns({c: lookup(F.col(c), labels[c], strict) for c in columns})


def encode_targets(df: DataFrame, targets: list[str], labels: LabelMap) -> DataFrame:
    """Add the whole-number copy ``{target}_num`` of each spelled-out target."""
    reverse = reverse_of(labels)
    return df.withColumns(
        {f"{t}_num": lookup(F.col(t), reverse[t], strict=True).cast("int") for t in targets}
    )


def encode_by_map(
    df: DataFrame, columns: list[str], entries: DataFrame, keys: list[str], key: str = "label", value: str = "code",
    salts: int = 16,
) -> DataFrame:
    """(keys, columns): every cell replaced by its entry of a (feature, key, value) table; null where there is none.

    Cells become rows, meet the table in a join and become columns again, so a table of
    any size serves, and none of it is on the driver. A frequent answer is dealt out over
    `salts` copies of its entry. Keys must be unique, as must (feature, key).
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias(key)) for c in columns])
    salt = F.pmod(F.xxhash64(*keys), F.lit(salts)).alias("_salt")
    asked = df.select(*keys, salt, F.explode(cells).alias("_cell")).select(*keys, "_salt", "_cell.*")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    known = entries.select("feature", key, value, copies)
    found = asked.join(known, ["feature", key, "_salt"], "left")
    return found.groupBy(*keys).pivot("feature", columns).agg(F.first(value, ignorenulls=True))


def domain_violations(
    df: DataFrame, targets: list[str], labels: LabelMap, mode: str = "text"
) -> DataFrame:
    """(target, rows) with a current value that has no legal code."""
    counts = [
        F.count_if(~F.coalesce(F.col(t).cast("string").isin(_legal(labels[t], mode)), F.lit(False)))
        for t in targets
    ]
    wide = df.agg(*[c.alias(t) for c, t in zip(counts, targets)])
    entries = [F.struct(F.lit(t).alias("target"), F.col(t).alias("rows")) for t in targets]
    return wide.select(F.explode(F.array(*entries)).alias("_r")).select("_r.*")


def _legal(codes: dict[str, str], mode: str) -> list[str]:
    return list(codes.values()) if mode == "text" else list(codes)


def label_frame(spark: SparkSession, labels: LabelMap) -> DataFrame:
    """A label map as (feature, code, label) rows."""
    rows = [(f, c, t) for f, codes in labels.items() for c, t in codes.items()]
    return spark.createDataFrame(rows, "feature string, code string, label string")
