"""DuckDB SQL twins of the registered queries (the correctness gate's oracle side).

Written by hand against the metric definitions, independent of the Spark code paths.
The fixture views come from the same SQL text as the Spark side (they are inputs).
Doubles are rounded to 6 dp, as in the Spark queries.
"""

from __future__ import annotations

from tabtwin.sources import fixtures as fx

ORACLES: dict[str, str] = {}

NUM = list(fx.COHORT_COLUMNS.continuous)
DISC = list(fx.COHORT_COLUMNS.discrete)
P20 = "[" + ", ".join(repr(i / 20) for i in range(21)) + "]"


def _union_long(table: str, cols: list[str], cast: str, side: str | None = None) -> str:
    side_sel = f", '{side}' AS side" if side else ""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS {cast}) AS value{side_sel} FROM {table}" for c in cols)


def _tagged_long(cols, cast):
    return f"({_union_long('real_side', cols, cast, 'r')} UNION ALL {_union_long('synth_side', cols, cast, 's')})"


SIDE_COUNTS = ("count(*) FILTER (WHERE side = 'r') AS cr, count(*) FILTER (WHERE side = 's') AS cs")

DIST_FROM_COUNTS = """SELECT column_name,
  0.5 * sum(abs(p - q)) AS tvd, sqrt(0.5 * sum(pow(sqrt(p) - sqrt(q), 2))) AS hellinger_distance
FROM (SELECT column_name, CAST(cr AS DOUBLE) / sum(cr) OVER (PARTITION BY column_name) AS p,
             CAST(cs AS DOUBLE) / sum(cs) OVER (PARTITION BY column_name) AS q FROM {src})
GROUP BY column_name"""


def univariate_ctes() -> str:
    return f"""{fx.oracle_prelude()},
num_long AS {_tagged_long(NUM, 'DOUBLE')},
disc_long AS {_tagged_long(DISC, 'VARCHAR')},
num_counts AS (SELECT column_name, value, {SIDE_COUNTS} FROM num_long GROUP BY column_name, value),
ks AS (SELECT column_name, max(abs(cum_r / nr - cum_s / ns)) AS ks_distance FROM (
   SELECT column_name, CAST(sum(cr) OVER (PARTITION BY column_name ORDER BY value) AS DOUBLE) AS cum_r,
          CAST(sum(cs) OVER (PARTITION BY column_name ORDER BY value) AS DOUBLE) AS cum_s,
          CAST(sum(cr) OVER (PARTITION BY column_name) AS DOUBLE) AS nr,
          CAST(sum(cs) OVER (PARTITION BY column_name) AS DOUBLE) AS ns
   FROM num_counts WHERE value IS NOT NULL) GROUP BY column_name),
edges AS (SELECT column_name, list_sort(list_distinct(quantile_cont(value, {P20}))) AS edges
          FROM num_long WHERE value IS NOT NULL GROUP BY column_name),
num_bins AS (SELECT l.column_name, l.side,
   CASE WHEN len(e.edges) >= 2 AND l.value IS NOT NULL AND l.value >= e.edges[1] AND l.value <= e.edges[len(e.edges)]
        THEN greatest(1, len(list_filter(e.edges, lambda x: x < l.value))) END AS bin
   FROM num_long l LEFT JOIN edges e ON l.column_name = e.column_name),
num_bin_counts AS (SELECT column_name, bin, {SIDE_COUNTS} FROM num_bins GROUP BY column_name, bin),
hell_num AS ({DIST_FROM_COUNTS.format(src='num_bin_counts')}),
disc_counts AS (SELECT column_name, value, {SIDE_COUNTS} FROM disc_long GROUP BY column_name, value),
disc AS ({DIST_FROM_COUNTS.format(src='disc_counts')})"""


ORACLES["univariate_fidelity"] = f"""{univariate_ctes()}
SELECT ks.column_name, 'numeric' AS kind, round(ks_distance, 6) AS ks_distance, CAST(NULL AS DOUBLE) AS tvd,
       round(h.hellinger_distance, 6) AS hellinger_distance FROM ks JOIN hell_num h ON ks.column_name = h.column_name
UNION ALL
SELECT column_name, 'discrete', CAST(NULL AS DOUBLE), round(tvd, 6), round(hellinger_distance, 6) FROM disc"""

ORACLES["ks_distance"] = f"{univariate_ctes()} SELECT column_name, round(ks_distance, 6) AS ks_distance FROM ks"
ORACLES["hellinger_numeric"] = (f"{univariate_ctes()} SELECT column_name, round(hellinger_distance, 6) "
                                f"AS hellinger_distance FROM hell_num")
ORACLES["hellinger_categorical"] = (f"{univariate_ctes()} SELECT column_name, round(hellinger_distance, 6) "
                                    f"AS hellinger_distance FROM disc")
ORACLES["total_variation"] = f"{univariate_ctes()} SELECT column_name, round(tvd, 6) AS tvd FROM disc"


# ---- sources, contracts, transforms, splits ------------------------------------------

from tabtwin.functions.hashing import hash_uniform_sql as _u  # noqa: E402

PRE = fx.oracle_prelude()
SPLIT = PRE + fx.oracle_split_ctes()
R6 = "round({0}, 6) AS {0}"
COHORT_COLS = ["rid", "amount", "balance", "month_no", "is_urgent", "is_finished", "target", "segment",
               "region", "priority"]


def _r(cols, doubles=("amount", "balance")):
    return ", ".join(R6.format(c) if c in doubles else c for c in cols)


ORACLES["load_table"] = f"{PRE} SELECT {_r(COHORT_COLS)} FROM real_side"
ORACLES["load_table_inferred"] = (
    f"{PRE} SELECT CAST(rid AS BIGINT) AS rid, round(amount, 6) AS amount, round(balance, 6) AS balance, "
    "CAST(month_no AS BIGINT) AS month_no, CAST(is_urgent AS BIGINT) AS is_urgent, "
    "CAST(is_finished AS BIGINT) AS is_finished, CAST(target AS BIGINT) AS target, segment, region, priority "
    "FROM synth_side")
ORACLES["upsert_result"] = f"""{PRE},
old AS (SELECT segment AS generator, avg(amount) AS mean_amount, count(*) AS n FROM cohort GROUP BY segment),
new AS (SELECT segment AS generator, avg(balance) AS mean_balance, count(*) AS n FROM cohort
        WHERE segment IN ('BUILDING', 'MACHINERY') GROUP BY segment)
SELECT generator, round(mean_amount, 6) AS mean_amount, n, CAST(NULL AS DOUBLE) AS mean_balance FROM old
WHERE generator NOT IN (SELECT generator FROM new)
UNION ALL SELECT generator, CAST(NULL AS DOUBLE), n, round(mean_balance, 6) FROM new"""



_cand = ("cand AS (SELECT rid, is_urgent + 1 AS is_urgent, is_finished, target, segment, "
         "CASE WHEN rid % 97 = 0 THEN 'ANTARCTICA' ELSE region END AS region, priority FROM synth_side)")
ORACLES["domain_subset"] = f"{PRE}, {_cand} " + " UNION ALL ".join(
    f"(SELECT DISTINCT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM cand WHERE {c} IS NOT NULL "
    f"EXCEPT SELECT DISTINCT '{c}', CAST({c} AS VARCHAR) FROM real_side)" for c in DISC)
ORACLES["strat_rate_check"] = f"""{SPLIT},
per AS (SELECT split, count(*) AS n, avg(CAST(target AS DOUBLE)) AS rate FROM labelled GROUP BY split),
ov AS (SELECT avg(CAST(target AS DOUBLE)) AS overall_rate FROM labelled)
SELECT split, n, round(rate, 6) AS rate, round(overall_rate, 6) AS overall_rate,
  round(abs(rate - overall_rate), 6) AS deviation, abs(rate - overall_rate) < 0.005 AS ok FROM per, ov"""
_u_ep = _u(24, "split", "rid")
ORACLES["empty_partition_check"] = f"""{PRE},
c AS (SELECT rid, concat_ws('/', segment, region, priority, CAST(month_no AS VARCHAR)) AS stratum FROM cohort),
r AS (SELECT stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_u_ep}, rid) AS rk,
             count(*) OVER (PARTITION BY stratum) AS n FROM c),
l AS (SELECT stratum, n, CASE WHEN rk <= floor(n * 0.9::DOUBLE) THEN 'train'
        WHEN rk <= floor(n * 0.9::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'test' ELSE 'val' END AS split FROM r),
s AS (SELECT stratum, n, count(*) FILTER (WHERE split = 'train') AS n_train,
        count(*) FILTER (WHERE split = 'test') AS n_test, count(*) FILTER (WHERE split = 'val') AS n_val
      FROM l GROUP BY stratum, n)
SELECT stratum, n, 'train' AS split FROM s WHERE n_train = 0
UNION ALL SELECT stratum, n, 'test' FROM s WHERE n_test = 0
UNION ALL SELECT stratum, n, 'val' FROM s WHERE n_val = 0"""
ORACLES["apply_decisions"] = (f"{PRE} SELECT {_r(COHORT_COLS)} FROM cohort "
                              "WHERE priority IS DISTINCT FROM '5-LOW'")
ORACLES["apply_types"] = (f"{PRE} SELECT rid, round(amount, 6) AS amount, round(balance, 6) AS balance, "
                          "round(CAST(month_no AS DOUBLE), 6) AS month_no, " +
                          ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in
                                    ["is_urgent", "is_finished", "target", "segment", "region", "priority"]) +
                          " FROM real_side")
ORACLES["restore_types"] = (
    f"{PRE} SELECT CAST(round_even(CAST(rid AS DOUBLE), 0) AS BIGINT) AS rid, round(amount * 2, 6) AS amount, "
    "round(balance, 6) AS balance, CAST(round_even(month_no + 0.5, 0) AS INTEGER) AS month_no, "
    "is_urgent, is_finished, CAST(round_even(target - 0.5, 0) AS INTEGER) AS target, segment, region, priority "
    "FROM synth_side")
ORACLES["missing_indicator"] = (f"{PRE} SELECT rid, CAST(balance IS NULL AS INTEGER) AS balance_missing, "
                                "CAST(priority IS NULL AS INTEGER) AS priority_missing FROM cohort")
_band_edges = [0, 100000, 200000, 300000, 400000, 500000]
ORACLES["band"] = f"{PRE} SELECT rid, CASE " + " ".join(
    f"WHEN amount > {lo} AND amount <= {hi} THEN '({lo}, {hi}]'" for lo, hi in zip(_band_edges, _band_edges[1:])
) + " END AS amount_band FROM cohort"


def _bin_sql(c, lo, hi, bins=10):
    w = (hi - lo) / bins
    edges = [lo + i * w for i in range(bins + 1)]
    edges[-1] = hi
    arr = "[" + ", ".join(repr(float(e)) + "::DOUBLE" for e in edges) + "]"
    return (f"CASE WHEN {c} IS NULL OR {c} < {float(lo)!r} OR {c} > {float(hi)!r} THEN NULL ELSE "
            f"greatest(1, len(list_filter({arr}, lambda e: e < {c}))) - 1 END")


def _mid_sql(code, lo, hi, bins=10):
    w = (hi - lo) / bins
    mids = [((lo + i * w) + (hi if i + 1 == bins else lo + (i + 1) * w)) / 2 for i in range(bins)]
    arr = "[" + ", ".join(repr(float(m)) + "::DOUBLE" for m in mids) + "]"
    k = f"TRY_CAST({code} AS INTEGER)"
    return f"CASE WHEN {k} >= 0 AND {k} < {bins} THEN {arr}[{k} + 1] END"


def _discretised_sql(src="real_side"):
    parts = []
    for c in COHORT_COLS:
        if c in fx.COHORT_DP.bounds:
            lo, hi = fx.COHORT_DP.bounds[c]
            parts.append(f"coalesce(CAST({_bin_sql(c, lo, hi)} AS VARCHAR), 'NA') AS {c}")
        else:
            parts.append(f"coalesce(CAST({c} AS VARCHAR), 'NA') AS {c}")
    return f"SELECT {', '.join(parts)} FROM {src}"


ORACLES["discretise"] = f"{PRE} {_discretised_sql()}"
ORACLES["undiscretise"] = f"{PRE}, coded AS ({_discretised_sql()}) SELECT " + ", ".join(
    (f"round({_mid_sql(c, *fx.COHORT_DP.bounds[c])}, 6) AS {c}" if c in fx.COHORT_DP.bounds else
     f"CASE WHEN {c} IN ('NA', '') THEN NULL ELSE {c} END AS {c}") for c in COHORT_COLS) + " FROM coded"
_holes = ", ".join("rid" if c == "rid" else f"CASE WHEN rid % 13 = 0 THEN NULL ELSE {c} END AS {c}"
                   for c in COHORT_COLS)


def _mode_sql(c, src="real_side"):
    return f"(SELECT {c} FROM {src} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


ORACLES["impute_from_reference"] = f"""{PRE}, holes AS (SELECT {_holes} FROM synth_side)
SELECT rid, round(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM real_side)), 6) AS amount,
  round(balance, 6) AS balance,
  coalesce(month_no, CAST(trunc((SELECT quantile_cont(month_no, 0.5) FROM real_side)) AS INTEGER)) AS month_no,
  coalesce(is_urgent, {_mode_sql('is_urgent')}) AS is_urgent,
  coalesce(is_finished, {_mode_sql('is_finished')}) AS is_finished,
  coalesce(target, {_mode_sql('target')}) AS target,
  coalesce(segment, {_mode_sql('segment')}) AS segment,
  coalesce(region, {_mode_sql('region')}) AS region, priority FROM holes"""
ORACLES["stratified_split"] = f"{SPLIT} SELECT rid, target, split FROM labelled"
_u7 = _u(7, "split", "rid")
ORACLES["stratified_split_val"] = f"""{PRE},
r AS (SELECT rid, segment, row_number() OVER (PARTITION BY segment ORDER BY {_u7}, rid) AS rk,
      count(*) OVER (PARTITION BY segment) AS n FROM cohort WHERE segment IS NOT NULL)
SELECT rid, segment, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN rk <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'test' ELSE 'val' END AS split FROM r"""
ORACLES["seeded_shuffle"] = (f"{PRE} SELECT rid, row_number() OVER (ORDER BY {_u(24, 'shuffle', 'rid')}, rid) "
                             "AS position FROM real_side")
ORACLES["stratified_holdout"] = f"""{PRE},
both_ AS (SELECT rid, 1 AS is_real FROM real_side UNION ALL SELECT rid, 0 FROM synth_side),
r AS (SELECT rid, is_real, row_number() OVER (PARTITION BY is_real ORDER BY {_u(24, 'holdout', 'rid')}, rid) AS rk,
      count(*) OVER (PARTITION BY is_real) AS n FROM both_)
SELECT rid, is_real, CASE WHEN rk <= floor(n * {1.0 - 0.3!r}::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r"""
ORACLES["bootstrap_sample"] = f"""{PRE},
donors AS (SELECT rid, amount, row_number() OVER (ORDER BY {_u(24, 'bootstrap#order', 'rid')}, rid) - 1 AS idx
           FROM real_side),
m AS (SELECT count(*) AS m FROM real_side),
draws AS (SELECT unnest(range(m)) AS draw_id, m FROM m)
SELECT draw_id, rid, round(amount, 6) AS amount FROM draws
JOIN donors ON donors.idx = CAST(floor({_u(24, 'bootstrap', 'draw_id')} * m) AS BIGINT)"""
ORACLES["attack_target_sample"] = (f"{PRE} SELECT rid, segment, round(amount, 6) AS amount FROM real_side "
                                   f"ORDER BY {_u(24, 'targets', 'rid')}, rid LIMIT 200")


# ---- profile ---------------------------------------------------------------------------

def _long(table, cols, cast, extra=""):
    return "(" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS {cast}) AS value{extra} FROM {table}" for c in cols) + ")"


ORACLES["value_counts"] = f"""{PRE}, c AS (SELECT column_name, value, count(*) AS count FROM {_long('cohort', DISC, 'VARCHAR')}
  GROUP BY column_name, value)
SELECT column_name, value, count, round(count / sum(count) OVER (PARTITION BY column_name), 6) AS proportion FROM c"""


def _describe(table, cols):
    return f"""SELECT column_name, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max
FROM {_long(table, cols, 'DOUBLE')} GROUP BY column_name"""


ORACLES["describe"] = f"{PRE} {_describe('cohort', NUM)}"
ORACLES["describe_lineitem"] = _describe("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
ORACLES["missing_profile"] = f"{PRE} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS count, "
    f"round(round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2), 6) AS percent FROM cohort"
    for c in COHORT_COLS) + ") WHERE count > 0"


def _grouped(value_expr, cols, name):
    return " UNION ALL ".join(
        f"SELECT '{g}' AS group_column, CAST({g} AS VARCHAR) AS group_value, count(*) AS n, "
        f"round(avg({value_expr}), 6) AS {name} FROM cohort WHERE {g} IS NOT NULL GROUP BY {g}" for g in cols)


ORACLES["group_missing_rate"] = f"{PRE} " + _grouped(
    "CAST(balance IS NULL AS DOUBLE)", ["target", "is_urgent", "is_finished", "segment", "priority"], "missing_rate")
ORACLES["group_target_rate"] = (f"{PRE}, g AS ({_grouped('CAST(target AS DOUBLE)', ['is_urgent', 'segment', 'region', 'priority'], 'target_rate')}) "
                                "SELECT g.*, (SELECT round(avg(CAST(target AS DOUBLE)), 6) FROM cohort) AS overall_rate FROM g")
ORACLES["class_balance"] = f"""{PRE} SELECT count(*) FILTER (WHERE target = 1) AS positives,
  count(*) FILTER (WHERE target = 0) AS negatives,
  round(count(*) FILTER (WHERE target = 1) * 100.0 / count(*), 6) AS percent_positive,
  round(CAST(count(*) FILTER (WHERE target = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE target = 1), 0), 6)
    AS imbalance_ratio FROM cohort"""
ORACLES["conditional_mean_shift"] = f"""{PRE} SELECT column_name, round(avg(value) FILTER (WHERE target = 1), 6) AS mean_positive,
  round(avg(value) FILTER (WHERE target = 0), 6) AS mean_negative,
  round(avg(value) FILTER (WHERE target = 1) - avg(value) FILTER (WHERE target = 0), 6) AS shift
FROM {_long('cohort', NUM, 'DOUBLE', ', target')} GROUP BY column_name"""
ORACLES["extremes"] = (f"{PRE} SELECT column_name, round(min(value), 6) AS min, round(max(value), 6) AS max "
                       f"FROM {_long('cohort', NUM, 'DOUBLE')} GROUP BY column_name")
ORACLES["histogram_table"] = f"""{PRE},
l AS (SELECT * FROM {_long('cohort', NUM, 'DOUBLE', ', target')} WHERE value IS NOT NULL),
rg AS (SELECT column_name, min(value) AS lo, max(value) AS hi FROM l GROUP BY column_name),
e AS (SELECT column_name, list_transform(range(11), lambda i: lo + i * ((hi - lo) / 10)) AS edges FROM rg),
b AS (SELECT l.column_name, l.target, edges,
        least(9, len(list_filter(edges[2:10], lambda x: x <= l.value))) AS bin FROM l JOIN e USING (column_name)),
c AS (SELECT column_name, target, bin, edges, count(*) AS count FROM b GROUP BY column_name, target, bin, edges)
SELECT column_name, target, bin, round(edges[bin + 1], 6) AS lo, round(edges[bin + 2], 6) AS hi, count,
  round(count / sum(count) OVER (PARTITION BY column_name, target) * 1.0, 6) AS share FROM c"""
ORACLES["kde_table"] = f"""{PRE},
l AS (SELECT column_name, value, side FROM (SELECT * FROM {_long('real_side', ['amount', 'balance', 'month_no'], 'DOUBLE', ", 'real' AS side")}
      UNION ALL SELECT * FROM {_long('synth_side', ['amount', 'balance', 'month_no'], 'DOUBLE', ", 'synthetic' AS side")})
      WHERE value IS NOT NULL),
st AS (SELECT column_name, side, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h,
       min(value) AS lo, max(value) AS hi FROM l GROUP BY column_name, side),
sp AS (SELECT column_name, min(lo) - 3.0 * max(h) AS g0, max(hi) + 3.0 * max(h) AS g1 FROM st WHERE h > 0 GROUP BY column_name),
g AS (SELECT column_name, unnest(range(200)) AS grid_index, g0, g1 FROM sp),
gx AS (SELECT column_name, grid_index, g0 + grid_index * ((g1 - g0) / 199) AS x, g1 - g0 AS span FROM g),
d AS (SELECT l.column_name, l.side, value, count(*) AS w FROM l GROUP BY ALL)
SELECT gx.column_name, st.side, gx.grid_index,
  round(sum(d.w * exp(-0.5 * ((gx.x - d.value) / st.h) * ((gx.x - d.value) / st.h))) / (st.n * st.h * sqrt(2 * pi()))
        * max(gx.span), 6) AS scaled_density
FROM gx JOIN st ON gx.column_name = st.column_name JOIN d ON d.column_name = st.column_name AND d.side = st.side
WHERE st.h > 0
GROUP BY gx.column_name, st.side, gx.grid_index, st.n, st.h"""


def _kanon(cols, src="cohort"):
    nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"""SELECT count(*) AS total_combinations, count(*) FILTER (WHERE count = 1) AS unique_combinations,
  count(*) FILTER (WHERE count <= 5) AS near_unique_combinations,
  coalesce(sum(count) FILTER (WHERE count <= 5), 0) AS rows_in_near_unique
FROM (SELECT {', '.join(cols)}, count(*) AS count FROM {src} WHERE {nn} GROUP BY ALL)"""


ORACLES["k_anonymity_profile"] = f"{PRE} " + _kanon(["segment", "region", "priority", "is_urgent"])
_bandsql = "CASE " + " ".join(f"WHEN amount > {lo} AND amount <= {hi} THEN '({lo}, {hi}]'"
                              for lo, hi in zip(_band_edges, _band_edges[1:])) + " END"
ORACLES["k_anonymity_quasi_identifiers"] = (f"{PRE}, c AS (SELECT *, {_bandsql} AS amount_band FROM cohort) " +
                                            _kanon(["segment", "region", "is_urgent", "month_no", "amount_band"], "c"))
ORACLES["rarest_combos"] = (f"{PRE} SELECT segment, region, priority, is_urgent, count(*) AS count FROM cohort "
                            "WHERE segment IS NOT NULL AND region IS NOT NULL AND priority IS NOT NULL AND is_urgent IS NOT NULL "
                            "GROUP BY ALL ORDER BY count, segment, region, priority, is_urgent LIMIT 10")
ORACLES["duplicate_rows"] = ("SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) "
                             "AS duplicate_rows")
_pc = NUM + ["is_urgent", "is_finished", "target"]
ORACLES["pearson_matrix"] = f"{PRE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN var_pop(CAST({a} AS DOUBLE)) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) > 0 "
    f"AND var_pop(CAST({b} AS DOUBLE)) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) > 0 "
    f"THEN round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) END AS r FROM cohort"
    for i, a in enumerate(_pc) for b in _pc[i + 1:])
ORACLES["head"] = f"{PRE} SELECT {_r(COHORT_COLS)} FROM cohort ORDER BY rid LIMIT 5"
ORACLES["schema_info"] = ("SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c}', {{nn_{c}}}, '{t}')" for i, (c, t) in enumerate(zip(COHORT_COLS, [
        "bigint", "double", "double", "int", "int", "int", "int", "string", "string", "string"]))) + ") t(position, column_name, non_null, dtype)")
ORACLES["schema_info"] = f"{PRE} " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, count({c}) AS non_null, '{t}' AS dtype FROM cohort"
    for i, (c, t) in enumerate(zip(COHORT_COLS, ["bigint", "double", "double", "int", "int", "int", "int", "string",
                                                 "string", "string"])))


# ---- association ------------------------------------------------------------------------

from tabtwin.operators.association import matrix_order as _mo  # noqa: E402
from tabtwin.operators.transform import upper_triangle as _ut  # noqa: E402

_NAMES = _mo(fx.COHORT_COLUMNS)
_CONT = set(fx.COHORT_COLUMNS.numeric)


def _pearson_sql(t, a, b):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return (f"SELECT '{a}' AS col_a, '{b}' AS col_b, 'pearson' AS kind, CASE WHEN count(*) FILTER (WHERE {both}) >= 2 "
            f"AND var_pop(CAST({a} AS DOUBLE)) FILTER (WHERE {both}) > 0 AND var_pop(CAST({b} AS DOUBLE)) FILTER (WHERE {both}) > 0 "
            f"THEN least(1.0, abs(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)))) ELSE 0.0 END AS value FROM {t}")


def _eta_sql(t, d, n, la, lb):
    p = f"(SELECT CAST({d} AS VARCHAR) AS level, CAST({n} AS DOUBLE) AS x FROM {t} WHERE {d} IS NOT NULL AND {n} IS NOT NULL)"
    return (f"SELECT '{la}' AS col_a, '{lb}' AS col_b, 'eta' AS kind, CASE WHEN k >= 2 AND sst > 0 "
            f"THEN least(1.0, sqrt(ssb / sst)) ELSE 0.0 END AS value FROM ("
            f"SELECT (SELECT count(DISTINCT level) FROM {p}) AS k, "
            f"(SELECT sum((x - gm) * (x - gm)) FROM {p}, (SELECT avg(x) AS gm FROM {p})) AS sst, "
            f"(SELECT sum(nk * (mk - gm) * (mk - gm)) FROM (SELECT level, count(*) AS nk, avg(x) AS mk FROM {p} GROUP BY level), "
            f"(SELECT avg(x) AS gm FROM {p})) AS ssb)")


def _cramer_sql(t, a, b, dropna=False):
    where = f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL" if dropna else ""
    cells = f"(SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM {t}{where} GROUP BY ALL)"
    m = (f"(SELECT a, b, o, o * o / (sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b)) AS tt FROM {cells})")
    r = "count(DISTINCT coalesce(a, '<null>'))"
    c = "count(DISTINCT coalesce(b, '<null>'))"
    return (f"SELECT '{a}' AS col_a, '{b}' AS col_b, 'cramers_v' AS kind, CASE WHEN {r} >= 2 AND {c} >= 2 THEN "
            f"least(1.0, sqrt(greatest(0.0, sum(tt) - 1) / (least({r}, {c}) - 1))) ELSE 0.0 END AS value FROM {m}")


def _pairs_sql(t):
    parts = []
    for a, b in _ut(_NAMES):
        if a in _CONT and b in _CONT:
            parts.append(_pearson_sql(t, a, b))
        elif a in _CONT or b in _CONT:
            d, n = (b, a) if a in _CONT else (a, b)
            parts.append(_eta_sql(t, d, n, a, b))
        else:
            parts.append(_cramer_sql(t, a, b))
    return "(" + " UNION ALL ".join(parts) + ")"


def _round_value(inner):
    return f"SELECT col_a, col_b, kind, round(value, 6) AS value FROM {inner}"


_PP = [p for p in _ut(_NAMES) if p[0] in _CONT and p[1] in _CONT]
_DN = [p for p in _ut(_NAMES) if (p[0] in _CONT) != (p[1] in _CONT)]
_DD = [p for p in _ut(_NAMES) if p[0] not in _CONT and p[1] not in _CONT]
ORACLES["abs_pearson"] = f"{PRE} " + _round_value("(" + " UNION ALL ".join(_pearson_sql("real_side", a, b) for a, b in _PP) + ")")
ORACLES["correlation_ratio"] = f"{PRE} " + _round_value(
    "(" + " UNION ALL ".join(_eta_sql("real_side", b, a, b, a) for a, b in _DN) + ")")
ORACLES["cramers_v"] = f"{PRE} " + _round_value("(" + " UNION ALL ".join(_cramer_sql("real_side", a, b) for a, b in _DD) + ")")
ORACLES["pairwise_association"] = f"{PRE} " + _round_value(_pairs_sql("synth_side"))
_diag = " UNION ALL ".join(f"SELECT '{c}', '{c}', 'diagonal', 1.0" for c in _NAMES)
ORACLES["association_matrix"] = f"""{PRE}, up AS {_pairs_sql('real_side')}
SELECT col_a, col_b, kind, round(value, 6) AS value FROM up
UNION ALL SELECT col_b, col_a, kind, round(value, 6) FROM up
UNION ALL {_diag}"""
_cmp = f"""{PRE}, r AS {_pairs_sql('real_side')}, s AS {_pairs_sql('synth_side')},
cmp AS (SELECT r.col_a, r.col_b, r.kind, r.value AS real, s.value AS synthetic, abs(r.value - s.value) AS abs_diff
        FROM r JOIN s ON r.col_a = s.col_a AND r.col_b = s.col_b)"""
_named = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, '{a}~{b}' AS pair" for a, b in fx.COHORT_NAMED_PAIRS)
ORACLES["named_pair_checks"] = (f"{_cmp}, w AS ({_named}) SELECT pair, round(real, 6) AS real, round(synthetic, 6) AS synthetic, "
                                "round(abs_diff, 6) AS abs_diff FROM cmp JOIN w ON (col_a = x AND col_b = y) OR (col_a = y AND col_b = x)")
ORACLES["association_mae"] = f"{_cmp} SELECT round(avg(abs_diff), 6) AS mean_association_abs_diff FROM cmp"
ORACLES["association_diff"] = (f"{_cmp} SELECT col_a, col_b, round(abs_diff, 6) AS abs_diff FROM cmp "
                               "UNION ALL SELECT col_b, col_a, round(abs_diff, 6) FROM cmp UNION ALL " +
                               " UNION ALL ".join(f"SELECT '{c}', '{c}', 0.0" for c in _NAMES))
_cv_cols = list(fx.COHORT_COLUMNS.categorical) + ["is_urgent", "target"]
ORACLES["cramers_v_matrix"] = f"{PRE} " + _round_value(
    "(WITH half AS (" + " UNION ALL ".join(_cramer_sql("cohort", a, b, dropna=True) for a, b in _ut(_cv_cols)) + ") "
    "SELECT col_a, col_b, kind, value FROM half UNION ALL SELECT col_b, col_a, kind, value FROM half UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', '{c}', 'cramers_v', 1.0" for c in _cv_cols) + ")")
_allc = fx.COHORT_COLUMNS.all_columns
_miss = (" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (SELECT avg(CAST({c} IS NULL AS DOUBLE)) FROM real_side) AS real_na_rate, "
    f"(SELECT avg(CAST({c} IS NULL AS DOUBLE)) FROM synth_side) AS synthetic_na_rate" for c in _allc))
ORACLES["missingness_comparison"] = (f"{PRE} SELECT column_name, round(real_na_rate, 6) AS real_na_rate, "
                                     f"round(synthetic_na_rate, 6) AS synthetic_na_rate, "
                                     f"round(abs(real_na_rate - synthetic_na_rate), 6) AS abs_diff FROM ({_miss})")
ORACLES["plausibility_checks"] = f"{PRE} " + " UNION ALL ".join(
    f"SELECT '{r.name}' AS rule, count(*) FILTER (WHERE coalesce({r.predicate}, false)) AS violations FROM synth_side"
    for r in fx.COHORT_PLAUSIBILITY)
ORACLES["fidelity_row"] = f"""{univariate_ctes()},
uni AS (SELECT avg(ks_distance) AS mean_ks_distance, avg(tvd) AS mean_tvd, avg(h) AS mean_hellinger_distance FROM (
  SELECT ks.ks_distance, NULL AS tvd, hn.hellinger_distance AS h FROM ks JOIN hell_num hn ON ks.column_name = hn.column_name
  UNION ALL SELECT NULL, tvd, hellinger_distance FROM disc)),
r AS {_pairs_sql('real_side')}, s AS {_pairs_sql('synth_side')},
cmp AS (SELECT r.col_a, r.col_b, abs(r.value - s.value) AS abs_diff FROM r JOIN s ON r.col_a = s.col_a AND r.col_b = s.col_b),
w AS ({_named}),
miss AS ({_miss}),
pl AS ({" UNION ALL ".join(f"SELECT count(*) FILTER (WHERE coalesce({r.predicate}, false)) AS v FROM synth_side" for r in fx.COHORT_PLAUSIBILITY)})
SELECT 'synth_side' AS generator, round(mean_ks_distance, 6) AS mean_ks_distance, round(mean_tvd, 6) AS mean_tvd,
  round(mean_hellinger_distance, 6) AS mean_hellinger_distance,
  (SELECT round(avg(abs_diff), 6) FROM cmp) AS mean_association_abs_diff,
  (SELECT round(max(abs_diff), 6) FROM cmp JOIN w ON (col_a = x AND col_b = y) OR (col_a = y AND col_b = x)) AS named_max_abs_diff,
  (SELECT round(avg(abs(real_na_rate - synthetic_na_rate)), 6) FROM miss) AS missingness_mae,
  (SELECT sum(v) FROM pl) AS n_implausible
FROM uni"""

# ---- scoring ------------------------------------------------------------------------------

_ST = f"{PRE}, st AS (SELECT rid, target AS label, round(amount / 500000.0, 2) AS score, segment FROM cohort)"
ORACLES["roc_auc"] = f"""{_ST},
sc AS (SELECT segment, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
       FROM st WHERE score IS NOT NULL GROUP BY segment, score),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY segment ORDER BY score) AS cneg FROM sc)
SELECT segment, round(CAST(sum(pos * (cneg - neg + neg * 0.5)) AS DOUBLE) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc
FROM cu GROUP BY segment"""
ORACLES["average_precision"] = f"""{_ST},
sc AS (SELECT segment, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
       FROM st WHERE score IS NOT NULL GROUP BY segment, score),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY segment ORDER BY score DESC) AS cpos,
              sum(neg) OVER (PARTITION BY segment ORDER BY score DESC) AS cneg FROM sc)
SELECT segment, round(sum(pos * (CAST(cpos AS DOUBLE) / (cpos + cneg))) / nullif(sum(pos), 0), 6) AS average_precision
FROM cu GROUP BY segment"""
ORACLES["f1_positive"] = f"""{_ST},
c AS (SELECT segment, count(*) FILTER (WHERE label = 1 AND score >= 0.75) AS tp,
      count(*) FILTER (WHERE label <> 1 AND score >= 0.75) AS fp, count(*) FILTER (WHERE label = 1 AND NOT (score >= 0.75)) AS fn
      FROM st GROUP BY segment)
SELECT segment, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM c"""
ORACLES["pr_auc_baseline"] = f"{_ST} SELECT round(avg(CAST(label AS DOUBLE)), 6) AS pr_auc_baseline FROM st"


# ---- L2 generator -------------------------------------------------------------------------

from tabtwin.functions.hashing import hash_gaussian_sql as _g  # noqa: E402


def _l2_sql():
    seed = fx.COHORT_SEED
    ctes = [f"ids AS (SELECT unnest(range((SELECT count(*) FROM train))) AS id)"]
    sel = ["CAST(ids.id AS BIGINT) AS rid"]
    joins = []
    for c in fx.COHORT_COLUMNS.discrete:
        ctes.append(f"f_{c} AS (SELECT {c} AS value, count(*) AS cnt FROM train GROUP BY {c}), "
                    f"c_{c} AS (SELECT value, sum(cnt) OVER (ORDER BY value NULLS FIRST) AS cum, "
                    f"sum(cnt) OVER () AS total FROM f_{c}), "
                    f"d_{c} AS (SELECT id, CAST(floor({_u(seed, 'l2:' + c, 'id')} * (SELECT max(total) FROM c_{c})) AS BIGINT) AS k FROM ids), "
                    f"s_{c} AS (SELECT d.id, c.value AS {c} FROM d_{c} d JOIN c_{c} c ON c.cum - (c.cum - coalesce("
                    f"(SELECT max(c2.cum) FROM c_{c} c2 WHERE c2.cum < c.cum), 0)) <= d.k + (c.cum - coalesce("
                    f"(SELECT max(c2.cum) FROM c_{c} c2 WHERE c2.cum < c.cum), 0)) - 1 + 1 AND d.k < c.cum AND "
                    f"d.k >= coalesce((SELECT max(c2.cum) FROM c_{c} c2 WHERE c2.cum < c.cum), 0))")
        joins.append(f"JOIN s_{c} ON s_{c}.id = ids.id")
        sel.append(f"s_{c}.{c}")
    for c in fx.COHORT_COLUMNS.continuous:
        is_int = c == "month_no"
        ctes.append(
            f"st_{c} AS (SELECT count(*) AS nrows, count({c}) AS m, stddev_samp(CAST({c} AS DOUBLE)) AS sd FROM train), "
            f"dn_{c} AS (SELECT CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY {_u(seed, 'l2:' + c + '#order', 'rid')}, rid) - 1 AS idx "
            f"FROM train WHERE {c} IS NOT NULL), "
            f"s_{c} AS (SELECT ids.id, CASE WHEN {_u(seed, 'l2:' + c + '#null', 'ids.id')} < CAST(nrows - m AS DOUBLE) / nrows THEN NULL "
            f"ELSE v + (sd * pow(m, -0.2)) * {_g(seed, 'l2:' + c + '#noise', 'ids.id')} END AS {c} "
            f"FROM ids, st_{c} JOIN dn_{c} ON dn_{c}.idx = CAST(floor({_u(seed, 'l2:' + c, 'ids.id')} * m) AS BIGINT))")
        joins.append(f"JOIN s_{c} ON s_{c}.id = ids.id")
        sel.append(f"CAST(round_even(s_{c}.{c}, 0) AS INTEGER) AS {c}" if is_int else f"round(s_{c}.{c}, 6) AS {c}")
    return f"{SPLIT}, " + ", ".join(ctes) + " SELECT " + ", ".join(sel) + " FROM ids " + " ".join(joins)


_L2 = _l2_sql()
ORACLES["generate_l2"] = _L2
ORACLES["synth_numeric_l2"] = f"SELECT rid, {', '.join(fx.COHORT_COLUMNS.continuous)} FROM ({_L2})"
ORACLES["synth_categorical_l2"] = f"SELECT rid, {', '.join(fx.COHORT_COLUMNS.discrete)} FROM ({_L2})"


# ---- kNN, DCR, membership -------------------------------------------------------------------

_ALL9 = fx.COHORT_COLUMNS.continuous + fx.COHORT_COLUMNS.discrete


def _dist_sql(q, r, cols=None, ranges_cte="rg"):
    cols = cols or _ALL9
    terms = []
    for c in cols:
        if c in fx.COHORT_COLUMNS.numeric:
            num = (f"CASE WHEN {q}.{c} IS NULL AND {r}.{c} IS NULL THEN 0.0 WHEN {q}.{c} IS NULL OR {r}.{c} IS NULL THEN 1.0 "
                   f"WHEN {ranges_cte}.{c} > 0 THEN least(1.0, abs(CAST({q}.{c} AS DOUBLE) - CAST({r}.{c} AS DOUBLE)) / {ranges_cte}.{c}) "
                   f"WHEN {q}.{c} = {r}.{c} THEN 0.0 ELSE 1.0 END")
        else:
            num = f"CASE WHEN {q}.{c} IS NOT DISTINCT FROM {r}.{c} THEN 0.0 ELSE 1.0 END"
        terms.append(num)
    return "((" + " + ".join(terms) + f") / {len(cols)})"


_RG = ("rg AS (SELECT " + ", ".join(f"CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE) AS {c}"
                                    for c in fx.COHORT_COLUMNS.continuous) + " FROM train)")


def _nn1(query_cte, ref_cte, qkey="rid"):
    """CTE body: (qid, rid, distance) nearest ref row per query (ties: smallest rid)."""
    return (f"(SELECT qid, min(rid) AS rid, min(distance) AS distance FROM ("
            f"SELECT qid, rid, distance, min(distance) OVER (PARTITION BY qid) AS md FROM ("
            f"SELECT q.{qkey} AS qid, r.rid AS rid, {_dist_sql('q', 'r')} AS distance FROM {query_cte} q, {ref_cte} r, rg)) "
            f"WHERE distance = md GROUP BY qid)")


ORACLES["nearest_record"] = f"{SPLIT}, {_RG} SELECT qid, rid, round(distance, 6) AS distance FROM {_nn1('synth_side', 'train')}"
_tg = f"tg AS (SELECT * FROM train ORDER BY {_u(24, 'link#main', 'rid')}, rid LIMIT 200)"
ORACLES["nearest_records_k10"] = f"""{SPLIT}, {_RG}, {_tg}
SELECT qid, rid, round(distance, 6) AS distance, rank FROM (
  SELECT q.rid AS qid, r.rid AS rid, {_dist_sql('q', 'r')} AS distance,
         row_number() OVER (PARTITION BY q.rid ORDER BY {_dist_sql('q', 'r')}, r.rid) AS rank
  FROM tg q, synth_side r, rg) WHERE rank <= 10"""
ORACLES["dcr_overfitting_protection"] = f"""{SPLIT}, {_RG},
dt AS {_nn1('synth_side', 'train')}, dh AS {_nn1('synth_side', 'test')},
sh AS (SELECT avg(CAST(dt.distance < dh.distance AS DOUBLE)) AS share FROM dt JOIN dh ON dt.qid = dh.qid)
SELECT round(share, 6) AS share_closer_to_train, round(least(1.0, 2.0 * (1.0 - share)), 6) AS dcr_overfitting_protection FROM sh"""


def _random_sql(n_expr, seed=24):
    sel = ["id AS rid"]
    for c in fx.COHORT_COLUMNS.continuous:
        sel.append(f"(SELECT CAST(min({c}) AS DOUBLE) FROM train) + {_u(seed, 'random:' + c, 'id')} * "
                   f"((SELECT CAST(max({c}) AS DOUBLE) FROM train) - (SELECT CAST(min({c}) AS DOUBLE) FROM train)) AS {c}")
    for c in fx.COHORT_COLUMNS.discrete:
        lv = f"(SELECT list_sort(list(DISTINCT {c})) FROM train WHERE {c} IS NOT NULL)"
        sel.append(f"{lv}[CAST(floor({_u(seed, 'random:' + c, 'id')} * len({lv})) AS BIGINT) + 1] AS {c}")
    return f"(SELECT {', '.join(sel)} FROM (SELECT unnest(range({n_expr})) AS id))"


ORACLES["dcr_baseline_protection"] = f"""{SPLIT}, {_RG},
rnd AS {_random_sql('(SELECT count(*) FROM synth_side)')},
ds AS {_nn1('synth_side', 'train')}, dr AS {_nn1('rnd', 'train')},
m AS (SELECT (SELECT quantile_cont(distance, 0.5) FROM ds) AS ms, (SELECT quantile_cont(distance, 0.5) FROM dr) AS mr)
SELECT round(ms, 6) AS median_dcr_synthetic, round(mr, 6) AS median_dcr_random,
  round(CASE WHEN mr > 0 THEN least(1.0, ms / mr) END, 6) AS dcr_baseline_protection FROM m"""
ORACLES["membership_inference"] = f"""{SPLIT}, {_RG},
rec AS (SELECT rid * 2 AS qid, 1 AS label, * EXCLUDE (rid) FROM train UNION ALL SELECT rid * 2 + 1, 0, * EXCLUDE (rid) FROM test),
nn AS {_nn1('rec', 'synth_side', 'qid')},
sc AS (SELECT -nn.distance AS score, rec.label FROM rec JOIN nn ON rec.qid = nn.qid),
g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM sc GROUP BY score),
cu AS (SELECT *, sum(neg) OVER (ORDER BY score) AS cneg FROM g)
SELECT round(CAST(sum(pos * (cneg - neg + neg * 0.5)) AS DOUBLE) / (sum(pos) * sum(neg)), 6) AS membership_auc FROM cu"""
_Z = 1.959964
_z2 = _Z * _Z


def _wil(s, n):
    return (f"((CAST({s} AS DOUBLE) + {_z2 / 2!r}) / (CAST({n} AS DOUBLE) + {_z2!r}))",
            f"({_Z!r} / (CAST({n} AS DOUBLE) + {_z2!r}) * sqrt(CAST({s} AS DOUBLE) * (CAST({n} AS DOUBLE) - {s}) / {n} + {_z2 / 4!r}))")


_a, _ea = _wil("attack_successes", "n_attacks")
_c, _ec = _wil("control_successes", "control_n")
_b, _ = _wil("baseline_successes", "n_attacks")
_v = f"(({_a} - {_c}) / (1.0 - {_c}))"
_e = f"sqrt(pow({_ea} / (1.0 - {_c}), 2) + pow({_ec} * ({_a} - 1.0) / pow(1.0 - {_c}, 2), 2))"
ORACLES["risk_with_ci"] = f"""{PRE},
counts AS (SELECT segment, count(*) AS n_attacks, count(*) FILTER (WHERE is_urgent = 1) AS attack_successes,
  count(*) AS control_n, count(*) FILTER (WHERE target = 1) AS control_successes,
  count(*) FILTER (WHERE is_finished = 1) AS baseline_successes FROM cohort GROUP BY segment)
SELECT segment, n_attacks, attack_successes, control_n, control_successes, baseline_successes,
  round({_a}, 6) AS attack_rate, round({_c}, 6) AS control_rate, round({_b}, 6) AS baseline_rate,
  round(least(1.0, greatest(0.0, {_v})), 6) AS risk, round(least(1.0, greatest(0.0, {_v} - {_e})), 6) AS ci_low,
  round(least(1.0, greatest(0.0, {_v} + {_e})), 6) AS ci_high, {_a} > {_b} AS reliable FROM counts"""


# ---- jobs and files ----------------------------------------------------------------------

ORACLES["prepare_job"] = f"""{PRE},
kept AS (SELECT * FROM cohort WHERE priority IS DISTINCT FROM '5-LOW'),
r AS (SELECT rid, target, row_number() OVER (PARTITION BY target ORDER BY {_u(24, 'split', 'rid')}, rid) AS rk,
      count(*) OVER (PARTITION BY target) AS n FROM kept)
SELECT CASE WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split, target, count(*) AS n
FROM r GROUP BY ALL"""
ORACLES["write_splits"] = f"{SPLIT} SELECT split, rid, true AS second_write_refused FROM labelled"

ORACLES["compat_report"] = f"""{PRE}
SELECT 'absent.csv' AS file_name, 'missing_file' AS problem, NULL AS column_name, 'file does not exist, skipped' AS detail
UNION ALL SELECT 'recoded.csv', 'missing_column', 'priority', NULL
UNION ALL SELECT DISTINCT 'recoded.csv', 'unexpected_value', 'is_urgent', CAST(is_urgent + 1 AS VARCHAR) FROM synth_side
  WHERE is_urgent + 1 NOT IN (SELECT is_urgent FROM synth_side)"""


# ---- DP generators -------------------------------------------------------------------------

_DP_ORDER = list(fx.COHORT_DP.visit_order)
_DP_PLAN = [_DP_ORDER[max(0, k - 2):k + 1] for k in range(len(_DP_ORDER))]


def _dp_codes(c: str) -> str:
    codes = [str(i) for i in range(10)] if c in fx.COHORT_DP.bounds else list(fx.COHORT_DP.domains[c])
    return "[" + ", ".join(f"'{v}'" for v in [*codes, *(["NA"] if c in fx.COHORT_DP.nullable else [])]) + "]"


def _dp_coded() -> str:
    parts = []
    for c in _DP_ORDER:
        if c in fx.COHORT_DP.bounds:
            lo, hi = fx.COHORT_DP.bounds[c]
            clipped = f"(CASE WHEN {c} IS NOT NULL THEN greatest({lo!r}::DOUBLE, least({hi!r}::DOUBLE, CAST({c} AS DOUBLE))) END)"
            parts.append(f"coalesce(CAST({_bin_sql(clipped, lo, hi)} AS VARCHAR), 'NA') AS {c}")
        else:
            parts.append(f"coalesce(CAST({c} AS VARCHAR), 'NA') AS {c}")
    return f"SELECT {', '.join(parts)} FROM train"


def _dp_noisy(epsilons: list[float], noise_seed: int = 1234) -> str:
    """CTEs coded, dom, eps and noisy (eps, mid, c0, c1, value, noisy): parents first, the child as value."""
    doms, counts = [], []
    for i, cols in enumerate(_DP_PLAN):
        cells = ["CAST(NULL AS VARCHAR)"] * (3 - len(cols)) + cols
        counts.append(f"SELECT {i} AS mid, {cells[0]} AS c0, {cells[1]} AS c1, {cells[2]} AS value, count(*) AS n FROM coded GROUP BY ALL")
        sides = ", ".join(f"(SELECT unnest({_dp_codes(c)}) AS {c})" for c in cols)
        doms.append(f"SELECT {i} AS mid, {cells[0]} AS c0, {cells[1]} AS c1, {cells[2]} AS value FROM {sides}")
    eps = ", ".join(f"('{e!r}', {e!r}::DOUBLE)" for e in epsilons)
    cell = "concat_ws(chr(1), d.c0, d.c1, d.value)"
    u = f"(CAST(('0x' || substr(md5('{noise_seed}|dp:' || eps.eps || '|' || d.mid || '|' || {cell}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"
    return f"""coded AS MATERIALIZED ({_dp_coded()}), cnt AS ({' UNION ALL '.join(counts)}), dom AS ({' UNION ALL '.join(doms)}),
eps AS (SELECT * FROM (VALUES {eps}) AS e(eps, e)),
noisy AS MATERIALIZED (SELECT eps, mid, c0, c1, value, greatest(0.0, n + (-({2.0 * len(_DP_PLAN)!r}::DOUBLE / e) * sign(u - 0.5) * ln(1.0 - 2.0 * abs(u - 0.5)))) AS noisy FROM (
  SELECT eps.eps, e, d.*, coalesce(n, 0) AS n, {u} AS u FROM eps, dom d LEFT JOIN cnt c ON c.mid = d.mid AND c.c0 IS NOT DISTINCT FROM d.c0
    AND c.c1 IS NOT DISTINCT FROM d.c1 AND c.value = d.value))"""


def _dp_tables(epsilons: list[float]) -> str:
    """CTEs that end in ``made`` (eps, rid, columns with types restored)."""
    ctes = [_dp_noisy(epsilons), "s_0 AS (SELECT eps, unnest(range((SELECT count(*) FROM train))) AS id FROM eps)"]
    run = lambda keys: (f"list(value ORDER BY value) AS vals, list(cum ORDER BY value) AS cums FROM (SELECT *, sum(noisy) OVER (PARTITION BY {keys} "  # noqa: E731
                        "ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum FROM")
    for i, cols in enumerate(_DP_PLAN):
        child, parents = cols[-1], cols[:-1]
        ctes.append(f"g_{i} AS MATERIALIZED (SELECT eps, c0, c1, {run('eps, c0, c1')} noisy WHERE mid = {i}) GROUP BY eps, c0, c1)")
        ctes.append(f"a_{i} AS MATERIALIZED (SELECT eps, {run('eps')} (SELECT eps, value, sum(noisy) AS noisy FROM noisy WHERE mid = {i} GROUP BY eps, value)) GROUP BY eps)")
        on = " AND ".join(["g.eps = s.eps", *[f"g.c{2 - len(parents) + j} = s.{p}" for j, p in enumerate(parents)]])
        u = f"(CAST(('0x' || substr(md5('24|dp-sample:' || s.eps || ':{child}|' || id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"
        pick = lambda t: f"{t}.vals[least(len({t}.vals), len(list_filter({t}.cums, lambda x: x <= {u} * {t}.cums[len({t}.cums)])) + 1)]"  # noqa: E731,B023
        ctes.append(f"s_{i + 1} AS MATERIALIZED (SELECT s.*, CASE WHEN g.cums[len(g.cums)] > 0 THEN {pick('g')} ELSE {pick('a')} END AS {child} "
                    f"FROM s_{i} s LEFT JOIN g_{i} g ON {on} JOIN a_{i} a ON a.eps = s.eps)")
    cols = ["CAST(id AS BIGINT) AS rid"]
    for c in COHORT_COLS[1:]:
        if c in fx.COHORT_DP.bounds:
            mid = _mid_sql(c, *fx.COHORT_DP.bounds[c])
            cols.append(f"CAST(round_even({mid}, 0) AS INTEGER) AS {c}" if c == "month_no" else f"{mid} AS {c}")
        else:
            code = f"CASE WHEN {c} = 'NA' THEN NULL ELSE {c} END"
            cols.append(f"CAST({code} AS INTEGER) AS {c}" if c in fx.COHORT_COLUMNS.binary else f"{code} AS {c}")
    ctes.append(f"made AS (SELECT eps, {', '.join(cols)} FROM s_{len(_DP_PLAN)})")
    return ", ".join(ctes)


ORACLES["dp_marginals"] = f"{SPLIT}, {_dp_noisy([3.0])} SELECT mid, concat_ws('|', c0, c1, value) AS cell, round(noisy, 6) AS noisy FROM noisy"
ORACLES["generate_dp"] = f"{SPLIT}, {_dp_tables([3.0])} SELECT {_r(COHORT_COLS)} FROM made"
ORACLES["dp_sweep"] = (f"{SPLIT}, {_dp_tables([0.5, 1.0, 3.0, 8.0])} SELECT CAST(eps AS DOUBLE) AS epsilon, count(*) AS n, round(avg(amount), 6) AS mean_amount "
                       "FROM made GROUP BY eps")

# ---- attacks -------------------------------------------------------------------------------

from oracle_attacks import attack_oracles  # noqa: E402

ORACLES.update(attack_oracles(SPLIT))

# ---- model features ----------------------------------------------------------------------------

_F_NUM = list(fx.COHORT_COLUMNS.numeric)
_F_BIN = [c for c in fx.COHORT_COLUMNS.binary if c != "target"]
_F_CAT = list(fx.COHORT_COLUMNS.categorical)


def _features_sql() -> str:
    mode = lambda c: f"(SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    filled = [f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM train)) AS f_{c}" for c in _F_NUM]
    filled += [f"CASE WHEN (SELECT count(*) - count({c}) FROM train) > 0 THEN [CAST({c} IS NULL AS DOUBLE)] ELSE [] END AS m_{c}" for c in _F_NUM]
    filled += [f"coalesce({c}, {mode(c)}) AS f_{c}" for c in _F_BIN + _F_CAT]
    filled += [f"(SELECT list_sort(list(DISTINCT {c})) FROM train WHERE {c} IS NOT NULL) AS l_{c}" for c in _F_CAT]
    parts = [f"[round(f_{c}, 6)]" for c in _F_NUM] + [f"m_{c}" for c in _F_NUM] + [f"[CAST(f_{c} AS DOUBLE)]" for c in _F_BIN]
    parts += [f"list_transform(l_{c}, lambda l: CAST(l = f_{c} AS DOUBLE))" for c in _F_CAT]
    rows = f"SELECT rid, {' || '.join(parts)} AS features FROM (SELECT rid, {', '.join(filled)} FROM test)"
    return f"SELECT rid, generate_subscripts(features, 1) - 1 AS place, unnest(features) AS value FROM ({rows})"


ORACLES["preprocess_features"] = f"{SPLIT} {_features_sql()}"
