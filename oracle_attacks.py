"""DuckDB twins of the attack queries: plain all-pairs SQL over the fixture views, apart from the Spark code paths."""

from __future__ import annotations

from tabtwin.functions.hashing import hash_uniform_sql as uniform
from tabtwin.sources import fixtures as fx

SPEC, ROLES, SEED, N = fx.COHORT_COLUMNS, fx.COHORT_ROLES, fx.COHORT_SEED, 200
NUM, DISC, ALL = list(SPEC.continuous), list(SPEC.discrete), list(SPEC.all_columns)
Z = 1.959964
Z2 = Z * Z


def ranges(train: str) -> str:
    return ", ".join(f"(SELECT CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE) FROM {train}) AS {c}" for c in NUM)


def distance(q: str, r: str, cols: list[str], rg: str) -> str:
    terms = []
    for c in cols:
        if c in SPEC.numeric:
            terms.append(f"CASE WHEN {q}.{c} IS NULL AND {r}.{c} IS NULL THEN 0.0 WHEN {q}.{c} IS NULL OR {r}.{c} IS NULL THEN 1.0 "
                         f"WHEN {rg}.{c} > 0 THEN least(1.0, abs(CAST({q}.{c} AS DOUBLE) - CAST({r}.{c} AS DOUBLE)) / {rg}.{c}) "
                         f"WHEN {q}.{c} = {r}.{c} THEN 0.0 ELSE 1.0 END")
        else:
            terms.append(f"CASE WHEN {q}.{c} IS NOT DISTINCT FROM {r}.{c} THEN 0.0 ELSE 1.0 END")
    return "((" + " + ".join(terms) + f") / {len(cols)})"


def risk(src: str, names: list[str], baseline_n: str = "n_attacks") -> str:
    """``names`` of ``src`` and the risk columns, not rounded."""
    def wilson(s: str, n: str) -> tuple[str, str]:
        return (f"((CAST({s} AS DOUBLE) + {Z2 / 2!r}) / (CAST({n} AS DOUBLE) + {Z2!r}))",
                f"({Z!r} / (CAST({n} AS DOUBLE) + {Z2!r}) * sqrt(CAST({s} AS DOUBLE) * (CAST({n} AS DOUBLE) - {s}) / {n} + {Z2 / 4!r}))")

    (a, ea), (c, ec), (b, _) = wilson("attack_successes", "n_attacks"), wilson("control_successes", "control_n"), wilson("baseline_successes", baseline_n)
    v = f"(({a} - {c}) / (1.0 - {c}))"
    e = f"sqrt(pow({ea} / (1.0 - {c}), 2) + pow({ec} * ({a} - 1.0) / pow(1.0 - {c}, 2), 2))"
    clip = lambda x: f"least(1.0, greatest(0.0, {x}))"
    return (f"SELECT {', '.join(names)}, {a} AS attack_rate, {c} AS control_rate, {b} AS baseline_rate, {clip(v)} AS risk, "
            f"{clip(f'{v} - {e}')} AS ci_low, {clip(f'{v} + {e}')} AS ci_high, {a} > {b} AS reliable FROM {src}")


RATES = ["attack_rate", "control_rate", "baseline_rate", "risk", "ci_low", "ci_high"]


def rounded(src: str, names: list[str]) -> str:
    return f"SELECT {', '.join(names)}, {', '.join(f'round({c}, 6) AS {c}' for c in RATES)}, reliable FROM {src}"


# ---- singling out ---------------------------------------------------------------------------

def cells(table: str) -> str:
    num = [f"SELECT '{c}' AS column_name, CAST(NULL AS VARCHAR) AS value, CAST({c} AS DOUBLE) AS number, count(*) AS cnt, min(rid) AS least "
           f"FROM {table} GROUP BY CAST({c} AS DOUBLE)" for c in NUM]
    disc = [f"SELECT '{c}', CAST({c} AS VARCHAR), CAST(NULL AS DOUBLE), count(*), min(rid) FROM {table} GROUP BY CAST({c} AS VARCHAR)" for c in DISC]
    return "(" + " UNION ALL ".join(num + disc) + ")"


def univariate(p: str, table: str) -> str:
    """CTE ``p``: predicates from ``table``."""
    row = "pid, column_name, op, value, number"
    return f"""{p}_c AS MATERIALIZED {cells(table)},
{p}_e AS (SELECT column_name, min(number) AS lo, max(number) AS hi FROM {p}_c GROUP BY column_name),
{p}_s AS (SELECT c.*, lo, hi FROM {p}_c c JOIN {p}_e USING (column_name) WHERE cnt = 1),
{p}_o AS (SELECT *, CASE WHEN value IS NULL AND number IS NULL THEN 'is_null' ELSE 'eq' END AS op FROM {p}_s
  UNION ALL SELECT *, 'le' FROM {p}_s WHERE number = lo UNION ALL SELECT *, 'ge' FROM {p}_s WHERE number = hi),
{p} AS MATERIALIZED (SELECT {row} FROM (SELECT *, column_name || '|' || op || '|' || least AS pid FROM {p}_o) ORDER BY {uniform(SEED, 'so-uni', 'pid')}, pid LIMIT {N})"""


def univariate_wins(p: str, table: str) -> str:
    return f"""(SELECT count(*) FROM (SELECT pid FROM {p} p JOIN {cells(table)} t ON p.column_name = t.column_name AND CASE
  WHEN op = 'le' THEN t.number <= p.number WHEN op = 'ge' THEN t.number >= p.number
  ELSE t.value IS NOT DISTINCT FROM p.value AND t.number IS NOT DISTINCT FROM p.number END GROUP BY pid HAVING sum(t.cnt) = 1))"""


def _match(p: str, t: str) -> str:
    parts = [f"(NOT {p}.in_{c} OR {p}.{c} IS NOT DISTINCT FROM {t}.{c})" for c in DISC]
    parts += [f"(NOT {p}.in_{c} OR ({p}.{c} IS NULL AND {t}.{c} IS NULL) OR ({p}.{c} IS NOT NULL AND {t}.{c} IS NOT NULL AND "
              f"CASE WHEN {p}.ge_{c} THEN {t}.{c} >= {p}.{c} ELSE {t}.{c} <= {p}.{c} END))" for c in NUM]
    return " AND ".join(parts)


def multivariate(p: str, table: str) -> str:
    order = "[" + ", ".join(f"{{'u': {uniform(SEED, 'so-cols', 'rid', chr(39) + c + chr(39))}, 'i': {i}, 'c': '{c}'}}" for i, c in enumerate(ALL)) + "]"
    flags = ", ".join([f"list_contains(shape, '{c}') AS in_{c}" for c in ALL] +
                      [f"{c} > (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {table}) AS ge_{c}" for c in NUM])
    return f"""{p}_k AS MATERIALIZED (SELECT *, {flags} FROM (SELECT *, list_transform(list_sort({order})[1:3], lambda s: s.c) AS shape FROM {table})),
{p} AS MATERIALIZED (SELECT p.* FROM {p}_k p JOIN (SELECT p.rid FROM {p}_k p JOIN {table} t ON {_match('p', 't')} GROUP BY p.rid HAVING count(*) = 1) s ON p.rid = s.rid
  ORDER BY {uniform(SEED, 'so-multi', 'p.rid')}, p.rid LIMIT {N})"""


def multivariate_wins(p: str, table: str) -> str:
    return f"(SELECT count(*) FROM (SELECT p.rid FROM {p} p JOIN {table} t ON {_match('p', 't')} GROUP BY p.rid HAVING count(*) = 1))"


SINGLING = ["mode", "n_attacks", "attack_successes", "equal_size_successes", "control_n", "control_raw", "control_successes", "baseline_n", "baseline_successes"]


def random_rows(train: str, n: str) -> str:
    sel = ["id AS rid"]
    for c in NUM:
        lo, hi = f"(SELECT CAST(min({c}) AS DOUBLE) FROM {train})", f"(SELECT CAST(max({c}) AS DOUBLE) FROM {train})"
        sel.append(f"{lo} + {uniform(SEED, f'random:{c}', 'id')} * ({hi} - {lo}) AS {c}")
    for c in DISC:
        levels = f"(SELECT list_sort(list(DISTINCT {c})) FROM {train} WHERE {c} IS NOT NULL)"
        sel.append(f"{levels}[CAST(floor({uniform(SEED, f'random:{c}', 'id')} * len({levels})) AS BIGINT) + 1] AS {c}")
    return f"(SELECT {', '.join(sel)} FROM (SELECT unnest(range({n})) AS id))"


def singling_out(mode: str, train: str, holdout: str, synth: str, tag: str) -> str:
    """CTEs that end in ``<tag>`` with every column, not rounded."""
    make, wins = (univariate, univariate_wins) if mode == "univariate" else (multivariate, multivariate_wins)
    m, b = f"{tag}_m", f"{tag}_b"
    nt, nc = f"(SELECT count(*) FROM {train})", f"(SELECT count(*) FROM {holdout})"
    chance = lambda n: f"((1.0 - pow(1.0 - 1.0 / {nc}, {n}) * (1.0 + CAST({n} AS DOUBLE) / {nc})) / ({n} + 1.0))"
    return f"""{tag}_r AS MATERIALIZED {random_rows(train, f'(SELECT count(*) FROM {synth})')},
{tag}_q AS MATERIALIZED (SELECT * FROM {train} ORDER BY {uniform(SEED, 'so#train', 'rid')}, rid LIMIT {nc}),
{make(m, synth)}, {make(b, f'{tag}_r')},
{tag}_n AS (SELECT '{mode}' AS mode, (SELECT count(*) FROM {m}) AS n_attacks, {wins(m, train)} AS attack_successes, {wins(m, f'{tag}_q')} AS equal_size_successes,
  (SELECT count(*) FROM {m}) AS control_n, {wins(m, holdout)} AS control_raw, (SELECT count(*) FROM {b}) AS baseline_n, {wins(b, train)} AS baseline_successes),
{tag}_s AS (SELECT *, least(CAST(n_attacks AS DOUBLE), control_raw * CASE WHEN {nt} = {nc} THEN 1.0 ELSE {chance(nt)} / {chance(nc)} END) AS control_successes FROM {tag}_n),
{tag} AS ({risk(f'{tag}_s', SINGLING, 'baseline_n')})"""


# ---- linkability, inference -------------------------------------------------------------------

COUNTS = ["n_attacks", "attack_successes", "control_n", "control_successes", "baseline_successes"]


def _targets(table: str, tag: str) -> str:
    u = uniform(SEED, tag, "rid")
    return f"(SELECT *, row_number() OVER (ORDER BY {u}, rid) - 1 AS place FROM (SELECT * FROM {table} ORDER BY {u}, rid LIMIT {N}))"


def linkability(train: str, holdout: str, synth: str, tag: str) -> str:
    qi = list(ROLES.quasi_identifiers)
    halves = qi[:len(qi) // 2], qi[len(qi) // 2:]

    def near(targets: str, cols: list[str]) -> str:
        return (f"(SELECT qid, rid FROM (SELECT q.rid AS qid, r.rid AS rid, row_number() OVER (PARTITION BY q.rid ORDER BY {distance('q', 'r', cols, 'g')}, r.rid) AS k "
                f"FROM {targets} q, {synth} r, {tag}_g g) WHERE k <= 10)")

    def wins(targets: str) -> str:
        return f"(SELECT count(DISTINCT a.qid) FROM {near(targets, halves[0])} a JOIN {near(targets, halves[1])} b ON a.qid = b.qid AND a.rid = b.rid)"

    u = uniform(SEED, "link#baseline", "q.rid", "j", "side")
    draws = f"SELECT q.rid AS qid, side, floor({u} * (SELECT count(*) FROM {synth})) AS idx FROM {tag}_m q, (SELECT unnest(range(10)) AS j), (SELECT unnest(range(2)) AS side)"
    return f"""{tag}_g AS (SELECT {ranges(train)}), {tag}_m AS MATERIALIZED {_targets(train, 'link#main')}, {tag}_c AS MATERIALIZED {_targets(holdout, 'link#control')},
{tag}_s AS (SELECT (SELECT count(*) FROM {tag}_m) AS n_attacks, {wins(f'{tag}_m')} AS attack_successes, (SELECT count(*) FROM {tag}_c) AS control_n,
  {wins(f'{tag}_c')} AS control_successes,
  (SELECT count(DISTINCT qid) FROM (SELECT qid, idx FROM ({draws}) GROUP BY qid, idx HAVING count(DISTINCT side) = 2)) AS baseline_successes),
{tag} AS ({risk(f'{tag}_s', COUNTS)})"""


def inference(train: str, holdout: str, synth: str, tag: str) -> str:
    def near(targets: str, cols: list[str]) -> str:
        return (f"(SELECT qid, arg_min(rid, (d, rid)) AS rid FROM (SELECT q.rid AS qid, r.rid AS rid, {distance('q', 'r', cols, 'g')} AS d "
                f"FROM {targets} q, {synth} r, {tag}_g g) GROUP BY qid)")

    def correct(guess: str, truth: str, s: str) -> str:
        if s not in ROLES.regression_secrets:
            return f"({guess} IS NOT DISTINCT FROM {truth})"
        return f"coalesce(abs(CAST({guess} AS DOUBLE) - CAST({truth} AS DOUBLE)) <= 0.05::DOUBLE * abs(CAST({truth} AS DOUBLE)), {guess} IS NULL AND {truth} IS NULL)"

    rows = []
    for s in ROLES.secrets:
        cols = [c for c in ROLES.quasi_identifiers if c != s]
        wins = lambda t: (f"(SELECT count(*) FROM {t} t JOIN {near(t, cols)} n ON n.qid = t.rid JOIN {synth} y ON y.rid = n.rid "  # noqa: E731,B023
                          f"WHERE {correct(f'y.{s}', f't.{s}', s)})")  # noqa: B023
        drawn = _targets(synth, f"inf#baseline:{s}")
        base = (f"(SELECT count(*) FROM {tag}_m t JOIN {drawn} y ON y.place = t.place % (SELECT least({N}, count(*)) FROM {synth}) WHERE {correct(f'y.{s}', f't.{s}', s)})")
        rows.append(f"SELECT '{s}' AS secret, (SELECT count(*) FROM {tag}_m) AS n_attacks, {wins(f'{tag}_m')} AS attack_successes, "
                    f"(SELECT count(*) FROM {tag}_c) AS control_n, {wins(f'{tag}_c')} AS control_successes, {base} AS baseline_successes")
    return f"""{tag}_g AS (SELECT {ranges(train)}), {tag}_m AS MATERIALIZED {_targets(train, 'inf#main')}, {tag}_c AS MATERIALIZED {_targets(holdout, 'inf#control')},
{tag}_s AS ({' UNION ALL '.join(rows)}),
{tag} AS ({risk(f'{tag}_s', ['secret', *COUNTS])})"""


# ---- DCR and the gate ---------------------------------------------------------------------------

def dcr_risks(train: str, holdout: str, synth: str, tag: str) -> str:
    nearest = lambda q, r: (f"(SELECT q.rid AS qid, min({distance('q', 'r', NUM + DISC, 'g')}) AS d FROM {q} q, {r} r, {tag}_g g GROUP BY q.rid)")
    return f"""{tag}_g AS (SELECT {ranges(train)}), {tag}_r AS MATERIALIZED {random_rows(train, f'(SELECT count(*) FROM {synth})')},
{tag}_t AS MATERIALIZED {nearest(synth, train)}, {tag}_h AS MATERIALIZED {nearest(synth, holdout)}, {tag}_x AS MATERIALIZED {nearest(f'{tag}_r', train)},
{tag} AS (SELECT 1 - least(1.0, 2.0 * (1.0 - avg(CAST(t.d < h.d AS DOUBLE)))) AS dcr_overfitting_risk,
  (SELECT CASE WHEN quantile_cont(d, 0.5) > 0 THEN 1 - least(1.0, (SELECT quantile_cont(d, 0.5) FROM {tag}_t) / quantile_cont(d, 0.5)) END FROM {tag}_x) AS dcr_baseline_risk
  FROM {tag}_t t JOIN {tag}_h h USING (qid))"""


def risks(train: str, holdout: str, synth: str, tag: str) -> tuple[str, str]:
    """CTEs, and a (metric, value) select over them."""
    tables = (train, holdout, synth)
    ctes = ", ".join([singling_out("univariate", *tables, f"{tag}u"), singling_out("multivariate", *tables, f"{tag}v"), linkability(*tables, f"{tag}l"),
                      inference(*tables, f"{tag}i"), dcr_risks(*tables, f"{tag}d")])
    return ctes, (f"SELECT 'singling_out_univariate_risk' AS metric, risk AS value FROM {tag}u UNION ALL SELECT 'singling_out_multivariate_risk', risk FROM {tag}v "
                  f"UNION ALL SELECT 'linkability_risk', risk FROM {tag}l UNION ALL SELECT 'inference_' || secret || '_risk', risk FROM {tag}i "
                  f"UNION ALL SELECT 'dcr_overfitting_risk', dcr_overfitting_risk FROM {tag}d UNION ALL SELECT 'dcr_baseline_risk', dcr_baseline_risk FROM {tag}d")


def attack_oracles(split: str) -> dict[str, str]:
    """By query; ``split`` holds the CTEs of the fixtures with ``train`` and ``test``."""
    tables = ("train", "test", "synth_side")
    out = {}
    for mode in ("univariate", "multivariate"):
        cte = singling_out(mode, *tables, "so")
        names = [c if c != "control_successes" else "round(control_successes, 6) AS control_successes" for c in SINGLING]
        out[f"singling_out_{mode}"] = f"{split}, {cte} {rounded('so', names)}"
    out["linkability"] = f"{split}, {linkability(*tables, 'li')} {rounded('li', COUNTS)}"
    out["inference"] = f"{split}, {inference(*tables, 'inf')} {rounded('inf', ['secret', *COUNTS])}"
    out["inference_summary"] = (f"{split}, {inference(*tables, 'inf')} SELECT round(avg(risk), 6) AS inference_risk_mean, round(max(risk), 6) AS inference_risk_max FROM inf")
    halves = "hold_a AS MATERIALIZED (SELECT * FROM test WHERE rid % 2 = 0), hold_b AS MATERIALIZED (SELECT * FROM test WHERE rid % 2 = 1)"
    (main, m), (base, b) = risks(*tables, "m"), risks("train", "hold_b", "hold_a", "b")
    out["release_gate"] = f"""{split}, {halves}, {main}, {base}, mm AS ({m}), bb AS ({b}),
j AS (SELECT mm.metric, mm.value, bb.value AS baseline, coalesce(mm.value <= bb.value, false) AS passed FROM mm LEFT JOIN bb USING (metric))
SELECT metric, round(value, 6) AS value, round(baseline, 6) AS baseline, passed FROM j
UNION ALL SELECT '__release__', NULL, NULL, bool_and(passed) FROM j"""
    return out
