"""DuckDB SQL oracles for the registered queries.

Each oracle is an independent restatement in plain SQL over the driver tables
(pre-registered as views): the split as a global ``row_number``, the elastic
net as coordinate descent in a recursive CTE, metrics as textbook formulas.
"""

from __future__ import annotations

from vintner.operators.fit import ALPHA, L1_RATIO
from vintner.operators.split import SPLIT_SEED, TEST_FRACTION
from vintner.plans import fixtures as fx

DIGITS = 4
CD_SWEEPS = 500

BASKETS = """baskets AS (
  SELECT l_orderkey AS k, SUM(l_quantity) AS q, CAST(COUNT(*) AS DOUBLE) AS c,
         CAST(SUM(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100
           / CAST(COUNT(*) AS DOUBLE) AS d,
         CAST(SUM(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100000 AS y
  FROM lineitem GROUP BY l_orderkey)"""

FLAGGED = f"""flagged AS (
  SELECT *, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || CAST(k AS VARCHAR)), k)
            <= ceil({TEST_FRACTION} * count(*) OVER ()) AS is_test
  FROM baskets)"""

HASH_FLAGGED = f"""hflagged AS (
  SELECT *, substr(md5('{SPLIT_SEED}:' || CAST(k AS VARCHAR)), 1, 4)
            < '{format(int(round(TEST_FRACTION * 65536)), "04x")}' AS is_test
  FROM baskets)"""


def cd_ctes(src: str, feats: list[str], label: str, alpha: float = ALPHA,
            l1_ratio: float = L1_RATIO, sweeps: int = CD_SWEEPS, prefix: str = "") -> str:
    """CTEs ``{prefix}st`` (moments), ``{prefix}cd`` (descent) and
    ``{prefix}coef`` (one row: w0..w{p-1}, b) for the elastic net on ``src``."""
    p = len(feats)
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    st = ", ".join([f"avg({f}) AS m{i}" for i, f in enumerate(feats)] + [f"avg({label}) AS my"]
                   + [f"covar_pop({feats[i]}, {feats[j]}) AS c{i}_{j}"
                      for i in range(p) for j in range(p)]
                   + [f"covar_pop({f}, {label}) AS c{i}_y" for i, f in enumerate(feats)])
    ws = ", ".join(f"w{i}" for i in range(p))
    zeros = ", ".join("CAST(0.0 AS DOUBLE)" for _ in range(p))
    body = f"SELECT {prefix}cd.it, {ws}, {prefix}st.* FROM {prefix}cd, {prefix}st WHERE {prefix}cd.it < {sweeps}"
    for j in range(p):
        terms = [f"c{j}_{k} * n{k}" for k in range(j)] + [f"c{j}_{k} * w{k}" for k in range(j + 1, p)]
        rho = f"(c{j}_y" + "".join(f" - {t}" for t in terms) + ")"
        new = (f"CASE WHEN c{j}_{j} + {l2!r} <= 0 THEN 0.0 ELSE "
               f"sign({rho}) * greatest(abs({rho}) - {l1!r}, 0.0) / (c{j}_{j} + {l2!r}) END")
        body = f"SELECT *, {new} AS n{j} FROM ({body}) t{j}"
    ns = ", ".join(f"n{i}" for i in range(p))
    intercept = "my" + "".join(f" - m{i} * w{i}" for i in range(p))
    return f"""{prefix}st AS (SELECT {st} FROM {src}),
{prefix}cd(it, {ws}) AS (
  SELECT 0, {zeros}
  UNION ALL
  SELECT it + 1, {ns} FROM ({body}) tn),
{prefix}coef AS (SELECT {ws}, {intercept} AS b FROM {prefix}cd, {prefix}st WHERE it = {sweeps})"""


def coef_rows(feats: list[str], prefix: str = "", digits: int = DIGITS) -> str:
    parts = [f"SELECT '{f}' AS term, round(w{i}, {digits}) + 0.0 AS estimate FROM {prefix}coef"
             for i, f in enumerate(feats)]
    parts.append(f"SELECT '(intercept)' AS term, round(b, {digits}) + 0.0 AS estimate FROM {prefix}coef")
    return "\nUNION ALL\n".join(parts)


def prediction_sql(feats: list[str], rel: str = "") -> str:
    r = f"{rel}." if rel else ""
    return "coef.b" + "".join(f" + coef.w{i} * {r}{f}" for i, f in enumerate(feats))


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


SPLIT_FEATS = ["q", "c"]
ALL_FEATS = ["q", "c", "d"]
TRAIN_MODEL = cd_ctes("(SELECT * FROM flagged WHERE NOT is_test)", SPLIT_FEATS, "y")


# Fixed value: the first line of a run's printed summary.
REPORT_HEADER = "Elasticnet model (alpha=%f, l1_ratio=%f):"

# name -> expression, the same in Spark and in DuckDB
WIDE_FEATURES = {
    "quantity": "l_quantity",
    "discount": "l_discount * 100",
    "tax": "l_tax * 100",
    "line": "CAST(l_linenumber AS DOUBLE)",
    "accepted": "CASE WHEN l_returnflag = 'A' THEN 1.0E0 ELSE 0.0E0 END",
    "returned": "CASE WHEN l_returnflag = 'R' THEN 1.0E0 ELSE 0.0E0 END",
    "open_line": "CASE WHEN l_linestatus = 'O' THEN 1.0E0 ELSE 0.0E0 END",
    "part_size": "CAST(p_size AS DOUBLE)",
    "retail": "p_retailprice / 100",
    "order_total": "o_totalprice / 10000",
    "urgent": "CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0E0 ELSE 0.0E0 END",
    "finished": "CASE WHEN o_orderstatus = 'F' THEN 1.0E0 ELSE 0.0E0 END",
}
WIDE_LABEL = {"price": "l_extendedprice / 1000"}
WIDE = "wide AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in (WIDE_FEATURES | WIDE_LABEL).items()) + """
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def scored_cte(pred_digits: int) -> str:
    return f"""scored AS (
  SELECT round({prediction_sql(SPLIT_FEATS, 'b')}, {pred_digits}) AS prediction, b.k, b.q, b.c, b.d, b.y
  FROM baskets b, coef)"""


def scored_sql(pred_digits: int, select: str = "SELECT * FROM scored") -> str:
    return with_recursive(BASKETS, FLAGGED, TRAIN_MODEL, scored_cte(pred_digits)) + "\n" + select


def metrics_select(pred: str, label: str = "y") -> str:
    pred = f"({pred})"
    res = f"sum(({label} - {pred}) * ({label} - {pred}))"
    tot = f"(var_pop({label}) * count({label}))"
    return (f"count({label}) AS n, "
            f"round(sqrt(avg(({label} - {pred}) * ({label} - {pred}))), {DIGITS}) AS rmse, "
            f"round(avg(abs({label} - {pred})), {DIGITS}) AS mae, "
            f"round(CASE WHEN {tot} = 0 THEN CASE WHEN {res} = 0 THEN 1.0 ELSE 0.0 END "
            f"ELSE 1 - {res} / {tot} END, {DIGITS}) AS r2")


def metrics_report_sql() -> str:
    pred = "(" + prediction_sql(SPLIT_FEATS, "f") + ")"
    return (with_recursive(BASKETS, FLAGGED, TRAIN_MODEL) + f"""
, m AS (SELECT sqrt(avg((f.y - {pred}) * (f.y - {pred}))) AS rmse, avg(abs(f.y - {pred})) AS mae,
               1 - sum((f.y - {pred}) * (f.y - {pred})) / (var_pop(f.y) * count(f.y)) AS r2
        FROM flagged f, coef WHERE f.is_test)
SELECT 0 AS line_no, printf('{REPORT_HEADER}', {ALPHA!r}, {L1_RATIO!r}) AS line FROM m
UNION ALL SELECT 1, printf('  RMSE: %f', rmse) FROM m
UNION ALL SELECT 2, printf('  MAE: %f', mae) FROM m
UNION ALL SELECT 3, printf('  R2: %f', r2) FROM m""")


def segment_metrics_sql(segment_col: str) -> str:
    return (with_recursive(BASKETS, FLAGGED, TRAIN_MODEL) + f"""
, scored AS (SELECT {prediction_sql(SPLIT_FEATS, 'f')} AS prediction, f.y, o.{segment_col} AS segment
             FROM flagged f JOIN orders o ON o.o_orderkey = f.k, coef WHERE f.is_test)
SELECT segment, {metrics_select('prediction')} FROM scored GROUP BY segment""")


def job_log_sql() -> str:
    lcs = ["WHEN event_type = 'error' THEN CASE WHEN value >= "
           f"{fx.ERROR_VALUE_FAILED!r} THEN 'TERMINATED' ELSE 'INTERNAL_ERROR' END"]
    res = [f"WHEN event_type = 'error' THEN CASE WHEN value >= {fx.ERROR_VALUE_FAILED!r} THEN 'FAILED' END"]
    for name, (state, result) in fx.STATE_OF_EVENT.items():
        lcs.append(f"WHEN event_type = '{name}' THEN '{state}'")
        res.append(f"WHEN event_type = '{name}' THEN " + (f"'{result}'" if result else "NULL"))
    return f"""log AS (
  SELECT user_id AS run_id, ts, event_id AS seq,
         CASE {' '.join(lcs)} END AS life_cycle_state,
         CASE {' '.join(res)} END AS result_state,
         CASE WHEN event_type = 'error' THEN props END AS state_message
  FROM events)"""


def outcome_sql(strict: bool) -> str:
    bad = "(result_state IS NULL OR result_state <> 'SUCCESS')" if strict else "result_state = 'FAILED'"
    return (f"CASE WHEN life_cycle_state IN ('INTERNAL_ERROR', 'SKIPPED') THEN 'failed' "
            f"WHEN life_cycle_state = 'TERMINATED' AND {bad} THEN 'failed' "
            f"WHEN life_cycle_state = 'TERMINATED' THEN 'succeeded' ELSE 'pending' END")


REGISTRY = """registry AS (
  SELECT 'model-' || CAST(user_id AS VARCHAR) AS name,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS version,
         'None' AS stage, 'run-' || CAST(event_id AS VARCHAR) AS run_id, ts, value
  FROM events)"""

STAGED = f"""staged AS (
  SELECT name, version,
         CASE WHEN value >= {fx.PRODUCTION_VALUE!r} THEN 'Production'
              WHEN value >= {fx.STAGING_VALUE!r} THEN 'Staging' ELSE stage END AS stage,
         run_id, ts
  FROM registry)"""

RAW_FLOAT_COLS = [(raw.replace(" ", "_"), src) for raw, src in fx.RAW_LINE_COLUMNS]


def cast_and_clean_sql() -> str:
    cols = []
    for clean, src in RAW_FLOAT_COLS:
        if clean == fx.RAW_LABEL:
            cols.append(f"TRY_CAST(trunc(TRY_CAST({src} AS FLOAT)) AS INTEGER) AS {clean}")
        else:
            cols.append(f"TRY_CAST({src} AS FLOAT) AS {clean}")
    return f"SELECT {', '.join(cols)} FROM lineitem"


def bad_value_counts_sql() -> str:
    parts = [f"SELECT '{clean}' AS column_name, count(*) FILTER "
             f"(WHERE {src} IS NOT NULL AND TRY_CAST(CAST({src} AS VARCHAR) AS FLOAT) IS NULL) AS bad_values "
             f"FROM lineitem" for clean, src in RAW_FLOAT_COLS]
    return "\nUNION ALL\n".join(parts)


RUN_EXPERIMENTS = {"baskets-by-priority": "o_orderpriority", "baskets-by-status": "o_orderstatus"}


def run_log_tall_sql(where: str = "") -> str:
    ctes = [BASKETS, FLAGGED, TRAIN_MODEL]
    unions = []
    for exp, seg in RUN_EXPERIMENTS.items():
        ctes.append(f"""s_{seg} AS (
  SELECT {prediction_sql(SPLIT_FEATS, 'f')} AS prediction, f.y, o.{seg} AS segment
  FROM flagged f JOIN orders o ON o.o_orderkey = f.k, coef WHERE f.is_test)""")
        ctes.append(f"""m_{seg} AS (
  SELECT '{exp}' AS experiment, 'run-' || lower(replace(segment, ' ', '-')) AS run_id,
         {metrics_select('prediction')}
  FROM s_{seg} GROUP BY segment)""")
        for kind, key, val in ([("param", "alpha", repr(ALPHA)), ("param", "l1_ratio", repr(L1_RATIO))]
                               + [("metric", m, m) for m in ("rmse", "mae", "r2")]):
            unions.append(f"SELECT experiment, run_id, '{kind}' AS kind, '{key}' AS key, "
                          f"CAST({val} AS DOUBLE) AS value, TIMESTAMP '{fx.RUN_TS}' AS ts FROM m_{seg}")
    body = "\nUNION ALL\n".join(unions)
    return with_recursive(*ctes) + f"\nSELECT * FROM ({body}) t {where}"
