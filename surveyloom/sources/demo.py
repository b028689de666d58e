"""A survey-shaped view of the order tables: each order is one respondent.

Ten coded variables with about a tenth of missing codes each, the same table
with spelled-out answers, a variable dictionary, and the matching settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.config import SurveyConfig
from surveyloom.operators.labels import LabelMap

VARIABLES = [
    "prio", "status", "seg", "region", "pricebin", "nation", "yr", "mon", "balbin", "pricegrp",
]
TARGETS = ["pricebin", "prio", "seg", "region", "status"]
FEATURES = ["nation", "yr", "mon", "balbin"]
MISSING = [".i", ".n", ".d", ".s"]
MISSING_TEXT = {".i": "iap", ".n": "no answer", ".d": "don't know", ".s": "skipped on web"}
LABELS: LabelMap = {
    "pricebin": {str(i): f"band {i:02d}" for i in range(1, 27)},
    "prio": {"1": "very urgent", "2": "urgent", "3": "normal", "4": "unspecified", "5": "low"},
    "seg": {"1": "automobile", "2": "building", "3": "furniture", "4": "household", "5": "machinery"},
    "region": {"1": "africa", "2": "america", "3": "asia", "4": "europe", "5": "middle east"},
    "status": {"1": "finished", "2": "open", "3": "pending"},
}
DICTIONARY = {
    "prio": "order priority", "status": "order status", "seg": "market segment",
    "region": "world region", "pricebin": "price band", "nation": "nation number",
    "yr": "order year", "mon": "order month", "balbin": "balance group",
}
CONFIG = SurveyConfig(
    targets=TARGETS,
    weight_cols=["wt"],
    near_duplicates={"pricebin": ["pricegrp"]},
    labels=LABELS,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# variable -> its code, over the joined order tables
CODES = {
    "prio": "substr(o_orderpriority, 1, 1)",
    "status": "case o_orderstatus when 'F' then '1' when 'O' then '2' else '3' end",
    "seg": "case c_mktsegment when 'AUTOMOBILE' then '1' when 'BUILDING' then '2' "
    "when 'FURNITURE' then '3' when 'HOUSEHOLD' then '4' else '5' end",
    "region": "r_regionkey + 1",
    "pricebin": "least(26, cast(floor(o_totalprice / 20000) as int) + 1)",
    "nation": "c_nationkey",
    "yr": "year(o_orderdate)",
    "mon": "month(o_orderdate)",
    "balbin": "cast(floor(c_acctbal / 1000) as int)",
    "pricegrp": "cast(floor(o_totalprice / 100000) as int)",
}


def _with_gaps(name: str) -> str:
    """One fortieth of the cells each becomes one of the missing codes."""
    gaps = ", ".join(f"'{m}'" for m in MISSING)
    draw = f"conv(substr(md5(concat('miss:{name}:', o_orderkey)), 1, 8), 16, 10)"
    return (
        f"coalesce(get(array({gaps}), cast(cast({draw} as bigint) % 40 as int)), "
        f"cast({CODES[name]} as string)) as {name}"
    )


PARTS_CONF = "surveyloom.survey.partitions"


def survey_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coded survey, dealt out over the cluster, into as many parts as the session's PARTS_CONF says, if it says so.

    A file with one row group is read by one task, which all later steps up to the
    next shuffle would share.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    parts = spark.conf.get(PARTS_CONF, None)
    orders = orders.repartition(int(parts), "o_orderkey") if parts else orders.repartition("o_orderkey")
    return (
        orders.join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .selectExpr(
            "o_orderkey as id",
            "cast(o_custkey % 3 + 1 as string) as wt",
            *[_with_gaps(name) for name in VARIABLES],
        )
    )


def spelled_out(num: DataFrame) -> DataFrame:
    """The text table: codes and missing codes replaced by their labels."""
    def text(name: str) -> str:
        entries = {**MISSING_TEXT, **LABELS.get(name, {})}
        cases = " ".join(f'when "{code}" then "{label}"' for code, label in entries.items())
        return f"case {name} {cases} else {name} end as {name}"

    return num.selectExpr(*[text(c) if c in VARIABLES else c for c in num.columns])


def survey_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled_out(survey_num(spark, sf_dir))
