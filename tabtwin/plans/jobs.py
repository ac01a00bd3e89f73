"""End-to-end jobs: prepare (load -> decisions -> split -> checks -> write) and evaluate
(fidelity + utility + privacy -> one result row -> keyed upsert)."""

from __future__ import annotations

import warnings
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtwin.operators.contract import validate_columns
from tabtwin.operators.split import stratified_split, validate_split
from tabtwin.operators.transform import apply_decisions
from tabtwin.session import cut_lineage, together
from tabtwin.sources.io import load_table, upsert_result_table, write_splits
from tabtwin.spec import ColumnSpec, PlausibilityRule, RoleSpec, SplitSpec


def prepare_job(spark: SparkSession, raw_path: str, dst_dir: str | None, split: SplitSpec, seed,
                drop_columns=("id",), exclude=None, key: str = "rid", types=None, fmt: str = "csv",
                key_source: str | None = None) -> DataFrame:
    """Load, apply the EDA decisions, split with exact per-stratum counts, check the split,
    write all splits (or none). Returns the labelled table (checkpointed once)."""
    raw = load_table(spark, raw_path, types, fmt)
    if key not in raw.columns:
        src = key_source or (drop_columns[0] if drop_columns else None)
        if src is None or src not in raw.columns:
            raise ValueError(f"a stable integer row key is needed: add '{key}' or name key_source")
        raw = raw.withColumn(key, F.col(src).cast("bigint"))
    data = apply_decisions(raw, tuple(c for c in drop_columns if c != key), exclude)
    labelled = cut_lineage(stratified_split(data, split, seed, key=key))
    validate_split(labelled, split)
    if dst_dir:
        write_splits(labelled, dst_dir, fmt=fmt)
    return labelled


def fidelity_metrics(real: DataFrame, synthetic: DataFrame, spec: ColumnSpec, named_pairs, rules,
                     seed, key: str = "rid", detection: bool = True) -> dict:
    from tabtwin.operators.association import association_mae, compare_associations, named_pair_checks
    from tabtwin.operators.models import detection_auc
    from tabtwin.operators.quality import missingness_comparison, missingness_mae, n_implausible, plausibility_checks
    from tabtwin.operators.univariate import univariate_fidelity, univariate_summary

    validate_columns(real, spec, ignore=(key,))
    validate_columns(synthetic, spec, ignore=(key,))
    def associations() -> dict:
        comp = cut_lineage(compare_associations(real, synthetic, spec))                        # a row per pair
        return {"mean_association_abs_diff": association_mae(comp).first()[0],
                "named_max_abs_diff": named_pair_checks(comp, named_pairs).agg(F.max("abs_diff")).first()[0]}

    parts = together(lambda: univariate_summary(univariate_fidelity(real, synthetic, spec)).first().asDict(), associations,
                     lambda: {"missingness_mae": missingness_mae(missingness_comparison(real, synthetic, spec.all_columns)).first()[0]},
                     lambda: {"detection_auc": detection_auc(real, synthetic, spec, seed, key).first()[0] if detection else None},
                     lambda: {"n_implausible": n_implausible(plausibility_checks(synthetic, rules)).first()[0]})
    out = {}
    for part in parts:
        out |= part
    return out


def privacy_metrics(train, test, synthetic, spec: ColumnSpec, roles: RoleSpec, seed, n_attacks: int = 200,
                    skip_attacks: bool = False, key: str = "rid") -> dict:
    from tabtwin.operators import attacks as at
    from tabtwin.operators import privacy as pv

    dcr = together(lambda: pv.dcr_overfitting_protection(train, test, synthetic, spec, key).first()["dcr_overfitting_protection"],
                   lambda: pv.dcr_baseline_protection(train, synthetic, spec, seed, key).first()["dcr_baseline_protection"])
    out = dict(zip(("dcr_overfitting_protection", "dcr_baseline_protection"), dcr))
    if skip_attacks:
        return out
    attacks = {f"singling_out_{mode}": partial(at.singling_out, mode=mode, n_attacks=n_attacks, seed=seed, key=key) for mode in ("univariate", "multivariate")}
    attacks["linkability"] = partial(at.linkability, aux_cols=at.role_halves(roles), n_attacks=n_attacks, seed=seed, key=key)
    if roles.secrets:
        attacks["inference"] = partial(at.inference_risks, secrets=at.role_secrets(roles), regression=roles.regression_secrets, n_attacks=n_attacks, seed=seed, key=key)
    def tried(name):
        try:
            return [r.asDict() for r in attacks[name](train, test, synthetic, spec).collect()], None      # one row, or one per secret
        except Exception as e:  # noqa: BLE001 - one failing attack must not end the evaluation; its reason is kept
            error = f"{type(e).__name__}: {e}"[:300]
            warnings.warn(f"attack {name} failed: {error}", stacklevel=2)
            return [], error

    risks = []
    for name, (got, error) in zip(attacks, together(*[partial(tried, name) for name in attacks])):
        if name == "inference":
            by_secret = {r["secret"]: r for r in got}
            for s in roles.secrets:
                r = by_secret.get(s, {"risk": None, "reliable": False})
                out.update({f"inference_{s}_risk": r["risk"], f"inference_{s}_reliable": r["reliable"], f"inference_{s}_error": error})
                risks.append(r["risk"])
        else:
            r = got[0] if got else {"reliable": False}
            out.update({f"{name}_{f}": r.get(f) for f in ("risk", "ci_low", "ci_high", "reliable")} | {f"{name}_error": error})
    vals = [v for v in risks if v is not None]
    out["inference_risk_mean"] = sum(vals) / len(vals) if vals else None
    out["inference_risk_max"] = max(vals) if vals else None
    return out


def evaluate_job(spark: SparkSession, train: DataFrame, test: DataFrame, synthetic: DataFrame, name: str,
                 spec: ColumnSpec, roles: RoleSpec, named_pairs, rules: tuple[PlausibilityRule, ...], seed,
                 n_attacks: int = 200, skip_privacy: bool = False, skip_attacks: bool = False,
                 results_path: str | None = None, key: str = "rid") -> DataFrame:
    """One result row per generator; upserted into a versioned results table if a path is given."""
    from tabtwin.operators.models import tstr_trtr

    tables = [df.cache() for df in (train, test, synthetic)]
    train, test, synthetic = tables
    try:
        row = {"generator": name}
        parts = [lambda: fidelity_metrics(train, synthetic, spec, named_pairs, rules, seed, key),
                 lambda: tstr_trtr(train, test, synthetic, spec, roles.target, seed).first().asDict()]
        if not skip_privacy:
            parts.append(lambda: privacy_metrics(train, test, synthetic, spec, roles, seed, n_attacks, skip_attacks, key))
        for part in together(*parts):
            row.update(part)
    finally:
        for df in tables:
            df.unpersist()
    names = list(row)
    df = spark.createDataFrame([tuple(row[k] for k in names)], _schema_for(row))
    if results_path:
        upsert_result_table(spark, results_path, df, "generator")
    return df


def _schema_for(row: dict) -> str:
    parts = []
    for k, v in row.items():
        t = "string" if isinstance(v, str) or k.endswith("_error") else "boolean" if isinstance(v, bool) else \
            "bigint" if isinstance(v, int) else "double"
        parts.append(f"`{k}` {t}")
    return ", ".join(parts)
