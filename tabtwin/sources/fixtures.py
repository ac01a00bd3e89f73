"""Views over the driver's tables used by the registered queries.

``cohort`` turns orders x customer x nation x region into a 10-column table with the
same mix of column kinds as the reference's health table (numeric with planted
missingness, integer-typed numeric, binary, categorical with nulls, a rare binary
target). ``real_side`` / ``synth_side`` give a real table and a shifted stand-in for a
synthetic one. The view bodies are plain SQL so the DuckDB oracle uses the very same
text; the operators applied on top are DataFrame code.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tabtwin.spec import ColumnSpec, DPSpec, PlausibilityRule, RoleSpec, SplitSpec

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

COHORT_SQL = """
SELECT o_orderkey AS rid, o_totalprice AS amount,
  CASE WHEN o_orderkey % 25 = 7 THEN NULL ELSE c_acctbal END AS balance,
  CAST(year(o_orderdate)*12 + month(o_orderdate) AS INT) AS month_no,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS is_urgent,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_finished,
  CASE WHEN o_totalprice > 375000 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS target,
  c_mktsegment AS segment, r_name AS region,
  CASE WHEN o_orderkey % 33 = 5 THEN NULL ELSE o_orderpriority END AS priority
FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

REAL_SIDE_SQL = "SELECT * FROM cohort WHERE rid % 3 <> 0"

SYNTH_SIDE_SQL = """
SELECT rid, amount*1.05 AS amount,
  CASE WHEN rid % 50 = 9 THEN NULL ELSE balance END AS balance, month_no, is_urgent, is_finished,
  CASE WHEN rid % 7 = 0 THEN 1 - target ELSE target END AS target,
  CASE WHEN rid % 11 = 0 THEN 'MACHINERY' ELSE segment END AS segment, region, priority
FROM cohort WHERE rid % 3 = 0
"""

# Declared contract of the cohort view (the fixture's analogue of the reference config).
COHORT_COLUMNS = ColumnSpec(
    numeric=("amount", "balance", "month_no"),
    binary=("is_urgent", "is_finished", "target"),
    categorical=("segment", "region", "priority"),
)
COHORT_ROLES = RoleSpec(
    quasi_identifiers=("segment", "month_no", "region", "is_urgent"),
    secrets=("is_finished", "priority", "amount", "balance"),
    regression_secrets=("amount", "balance", "month_no"),
    target="target",
    key="rid",
)
COHORT_SPLIT = SplitSpec(train_size=0.8, test_size=0.2, stratify_col="target")
COHORT_SEED = 24
COHORT_NAMED_PAIRS = (("month_no", "target"), ("is_urgent", "target"), ("is_finished", "target"),
                      ("amount", "target"))
COHORT_PLAUSIBILITY = (
    PlausibilityRule("amount_non_positive", "amount <= 0", ("amount",)),
    PlausibilityRule("balance_out_of_range", "balance < -1000 OR balance > 10000", ("balance",)),
    PlausibilityRule("month_out_of_range", "month_no < 23880 OR month_no > 24060", ("month_no",)),
    PlausibilityRule("urgent_high_value", "is_urgent = 1 AND amount > 480000", ("is_urgent", "amount")),
    PlausibilityRule("finished_unknown_priority", "is_finished = 1 AND priority = '4-NOT SPECIFIED'",
                     ("is_finished", "priority")),
)
COHORT_DP = DPSpec(
    bounds={"amount": (0.0, 500000.0), "balance": (-1000.0, 10000.0), "month_no": (23880.0, 24060.0)},
    domains={
        "is_urgent": ["0", "1"], "is_finished": ["0", "1"], "target": ["0", "1"],
        "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
        "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    },
    bins=10,
    visit_order=("segment", "region", "month_no", "is_urgent", "priority", "amount", "is_finished",
                 "balance", "target"),
    nullable=("balance", "priority"),
)


def register_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """Register the driver's parquet tables as temp views (lazy; nothing is read yet)."""
    for name in names:
        spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).createOrReplaceTempView(name)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ("region", "nation", "customer", "orders"))
    df = spark.sql(COHORT_SQL)
    df.createOrReplaceTempView("cohort")
    return df


def real_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort(spark, sf_dir)
    return spark.sql(REAL_SIDE_SQL)


def synth_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort(spark, sf_dir)
    return spark.sql(SYNTH_SIDE_SQL)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cohort(spark, sf_dir)
    return spark.sql(REAL_SIDE_SQL), spark.sql(SYNTH_SIDE_SQL)


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stratified 80/20 split of ``real_side`` (seed 24), as the reference prepares its table."""
    from tabtwin.operators.split import stratified_split

    labelled = stratified_split(real_side(spark, sf_dir), COHORT_SPLIT, COHORT_SEED, key="rid")
    train = labelled.filter("split = 'train'").drop("split")
    test = labelled.filter("split = 'test'").drop("split")
    return train, test


# ---- DuckDB twins of the fixture views (oracle side) ---------------------------------

def oracle_prelude() -> str:
    """CTE text defining cohort / real_side / synth_side for an oracle statement."""
    return (f"WITH cohort AS ({COHORT_SQL}), real_side AS ({REAL_SIDE_SQL}), "
            f"synth_side AS ({SYNTH_SIDE_SQL})")


def oracle_split_ctes(seed: int = COHORT_SEED, train_size: float = 0.8) -> str:
    """CTEs ``labelled``, ``train``, ``test`` (stratified split of real_side) for DuckDB."""
    from tabtwin.functions.hashing import hash_uniform_sql

    u = hash_uniform_sql(seed, "split", "rid")
    return (
        f", ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {u}, rid) AS rk, "
        f"count(*) OVER (PARTITION BY target) AS n_stratum FROM real_side), "
        f"labelled AS (SELECT * EXCLUDE (rk, n_stratum), CASE WHEN rk <= floor(n_stratum * {train_size!r}::DOUBLE) "
        f"THEN 'train' ELSE 'test' END AS split FROM ranked), "
        f"train AS (SELECT * EXCLUDE (split) FROM labelled WHERE split = 'train'), "
        f"test AS (SELECT * EXCLUDE (split) FROM labelled WHERE split = 'test')"
    )
