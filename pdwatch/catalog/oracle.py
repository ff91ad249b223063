"""SQL for the registered queries, written independently of the operators.

Each query is a `WITH` chain over the source tables. Rounding to even at four digits follows the
reports; everything else is compared at six digits.
"""

from __future__ import annotations

from pdwatch import config
from pdwatch.catalog.model import BASE, FOREST, MODEL_VERSION, PRIORITY_REGISTRY, RUN_DATE, TREES
from pdwatch.operators.metrics import REPORT_COLUMNS, REPORT_COUNTS
from pdwatch.schemas import FEATURE_RANGES, FEATURES

F_LIST = ", ".join(FEATURES)


def even(x: str) -> str:
    return f"(round_even(({x}) * 10000e0, 0) / 10000e0 + 0e0)"


def six(x: str) -> str:
    return f"(round({x}, 6) + 0e0)"


def fine(x: str, digits: int) -> str:
    return f"(round({x}, {digits}) + 0e0)"


def num(x: float) -> str:
    return {float("inf"): "CAST('inf' AS DOUBLE)", float("-inf"): "CAST('-inf' AS DOUBLE)"}.get(x, f"CAST({x!r} AS DOUBLE)")


def text(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"


def tree_sql(node: tuple | float) -> str:
    if not isinstance(node, tuple):
        return num(node)
    feature, threshold, left, right = node
    return f"CASE WHEN {feature} <= {num(threshold)} THEN {tree_sql(left)} ELSE {tree_sql(right)} END"


MARGIN = f"({num(BASE)} + " + " + ".join(tree_sql(t) for t in TREES) + ")"
FOREST_P = f"(1e0 / (1e0 + exp(-{MARGIN})))"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: str, body: str) -> None:
    CTES[name] = (tuple(deps.split()), body)


def chain(body: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in CTES[name][0]:
                visit(dep)
            ordered.append(name)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body


cte(
    "lines",
    "",
    """SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS debt,
 CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS discounts, CAST(count(*) AS DOUBLE) AS accounts
 FROM lineitem GROUP BY l_orderkey""",
)
cte(
    "featured",
    "lines",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS application_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
 o_orderstatus <> 'O' AS matured,
 20000e0 + 15e0 * (c_acctbal + 1000e0) AS income,
 CAST(300 + (o_orderkey * 7919 + o_custkey * 104729) % 551 AS DOUBLE) AS fico,
 o_totalprice AS loan_amount, CAST(18 + (c_custkey * 31) % 63 AS DOUBLE) AS age, coalesce(debt, 0e0) AS debt,
 CAST((c_custkey * 17) % 41 AS DOUBLE) AS employment, greatest(c_acctbal, 0e0) AS balance,
 coalesce(round(discounts / accounts * 10e0, 6), 0e0) AS utilization, coalesce(accounts, 0e0) AS accounts,
 CAST((o_custkey * 13) % 31 AS DOUBLE) AS history
 FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lines ON o_orderkey = l_orderkey""",
)
cte(
    "scored",
    "featured",
    """SELECT *, round(1e0 / (1e0 + exp(-(-1e0 - 0.008e0 * (fico - 575e0) + 2e0 * (utilization - 0.5e0)
 + 0.000003e0 * (loan_amount - 250000e0) - 0.03e0 * (history - 15e0)))), 6) AS p FROM featured""",
)
cte(
    "apps",
    "scored",
    """SELECT *, CASE WHEN CAST((o_orderkey * 2654435761) % 1000003 AS DOUBLE) / 1000003e0 < p THEN 1 ELSE 0 END AS y FROM scored""",
)
cte("matched", "apps", "SELECT application_id, p, y, strftime(ts, '%Y') AS segment FROM apps WHERE matured")
cte("reference", "apps", "SELECT * FROM apps WHERE ts < TIMESTAMP '1998-01-01'")
cte(
    "production",
    "apps",
    "SELECT * FROM apps WHERE ts >= TIMESTAMP '1998-01-01'",
)
cte(
    "feed",
    "",
    """SELECT CAST(user_id AS VARCHAR) AS application_id, value / 50e0 AS p, event_type,
 CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 0 WHEN 'click' THEN 2 END AS y FROM events""",
)


# Metrics


def distribution(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT {k}p, pos, neg, sum(pos) OVER ({part} ORDER BY p DESC) AS cp, sum(neg) OVER ({part} ORDER BY p DESC) AS cn,
 sum(pos) OVER ({part}) AS np, sum(neg) OVER ({part}) AS nn
 FROM (SELECT {k}p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM {source} GROUP BY {k}p)"""


cte("dist", "matched", distribution("matched"))
cte("dist_segment", "matched", distribution("matched", "segment"))


def ranked(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}sum(CAST(neg AS DOUBLE) * CAST(cp - pos AS DOUBLE) + 0.5e0 * pos * neg) / (CAST(max(np) AS DOUBLE) * max(nn)) AS auc,
 greatest(0e0, max(CAST(cp AS DOUBLE) / np - CAST(cn AS DOUBLE) / nn)) AS ks FROM {source}{group}"""


cte("ranked", "dist", ranked("dist"))
cte("ranked_segment", "dist_segment", ranked("dist_segment", "segment"))


def base_metrics(keys: str = "", source: str = "matched") -> str:
    k, group = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    eps = "2.220446049250313e-16"
    clipped = f"greatest({eps}, least(1e0 - {eps}, p))"
    return f"""SELECT {k}count(*) AS record_count, CAST(sum(y) AS BIGINT) AS default_count, CAST(sum(1 - y) AS BIGINT) AS non_default_count,
 avg(CAST(y AS DOUBLE)) AS bad_rate, avg(p) AS average_predicted_pd, stddev_pop(p) AS prediction_standard_deviation,
 min(p) AS minimum_predicted_pd, max(p) AS maximum_predicted_pd,
 avg((p - y) * (p - y)) AS brier_score,
 avg(-(y * ln({clipped}) + (1 - y) * ln(1e0 - {clipped}))) AS log_loss,
 abs(avg(p) - avg(CAST(y AS DOUBLE))) AS calibration_error,
 count(*) FILTER (p >= 0.5 AND y = 1) AS true_positive, count(*) FILTER (p >= 0.5 AND y = 0) AS false_positive,
 count(*) FILTER (p < 0.5 AND y = 0) AS true_negative, count(*) FILTER (p < 0.5 AND y = 1) AS false_negative
 FROM {source}{group}"""


cte("sums", "matched", base_metrics())
cte("sums_segment", "matched", base_metrics("segment"))

RATIOS = """ (tp + tn) / (tp + fp + tn + fn) AS accuracy,
 (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy,
 coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
 coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
 1 - coalesce(tn / nullif(tn + fp, 0), 0) AS false_positive_rate,
 1 - coalesce(tp / nullif(tp + fn, 0), 0) AS false_negative_rate,
 (tp + fp) / (tp + fp + tn + fn) AS predicted_positive_rate"""
COUNTS = """SELECT *, CAST(true_positive AS DOUBLE) AS tp, CAST(false_positive AS DOUBLE) AS fp,
 CAST(true_negative AS DOUBLE) AS tn, CAST(false_negative AS DOUBLE) AS fn FROM """
cte("ratios", "sums ranked", f"SELECT *, 2 * auc - 1 AS gini, 0.5e0 AS classification_threshold,{RATIOS} FROM ({COUNTS} sums CROSS JOIN ranked)")
cte(
    "ratios_segment",
    "sums_segment ranked_segment",
    f"SELECT *, 2 * auc - 1 AS gini, 0.5e0 AS classification_threshold,{RATIOS} FROM ({COUNTS} sums_segment JOIN ranked_segment USING (segment))",
)
REPORT = ", ".join(
    f'"{c}"' if c in REPORT_COUNTS else f'{even(chr(34) + c + chr(34))} AS "{c}"' for c in REPORT_COLUMNS
)
cte("report", "ratios", f"SELECT {REPORT} FROM ratios")
cte("report_segment", "ratios_segment", f"SELECT segment, {REPORT} FROM ratios_segment")

cte(
    "ranged",
    "apps",
    """SELECT p, y, segment FROM apps JOIN (VALUES ('first year', '1995-01', '1995-12'), ('turn', '1995-07', '1997-06'),
 ('all', '0000-01', '9999-12')) AS r(segment, first, last) ON strftime(ts, '%Y-%m') BETWEEN first AND last WHERE matured""",
)
cte("dist_range", "ranged", distribution("ranged", "segment"))
cte("ranked_range", "dist_range", ranked("dist_range", "segment"))
cte("sums_range", "ranged", base_metrics("segment", "ranged"))
cte(
    "ratios_range",
    "sums_range ranked_range",
    f"SELECT *, 2 * auc - 1 AS gini, 0.5e0 AS classification_threshold,{RATIOS} FROM ({COUNTS} sums_range JOIN ranked_range USING (segment))",
)


def long_form(source: str, names, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{metric}' AS metric_name, CAST(\"{column}\" AS DOUBLE) AS value, '{unit}' AS unit FROM {source}"
        for column, metric, unit in names
    )


# Calibration: exact band edges over ranks.


def banding(bands: int, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    using = f" USING ({keys})" if keys else " ON true"
    below = " + ".join(f"CASE WHEN edges[{i}] < r THEN 1 ELSE 0 END" for i in range(1, bands + 2))
    return f"""SELECT m.*, CAST(greatest(1, {below}) AS INTEGER) AS band
 FROM (SELECT *, row_number() OVER ({part} ORDER BY p, application_id) AS r, count(*) OVER ({part}) AS n FROM matched) m
 JOIN (SELECT {k}list(edge ORDER BY k) AS edges FROM (SELECT *, CASE WHEN lo >= n - 1 THEN CAST(n AS DOUBLE) WHEN v - lo < 0.5e0 THEN lo + 1e0 + (v - lo)
   ELSE lo + 2e0 - (1e0 - (v - lo)) END AS edge
  FROM (SELECT *, floor(v) AS lo FROM (SELECT *, CASE WHEN k = q THEN 1e0 ELSE k * (1e0 / q) END * 100e0 / 100e0 * (n - 1) AS v
   FROM (SELECT {k}count(*) AS n, least({bands}, count(*)) AS q, unnest(range(0, {bands} + 1)) AS k FROM matched {f"GROUP BY {keys}" if keys else ""}) WHERE k <= q)))
  {f"GROUP BY {keys}" if keys else ""}) e{using}"""


def banded_table(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}CAST(band AS BIGINT) AS calibration_band, record_count, default_count, {even('low')} AS minimum_predicted_pd,
 {even('high')} AS maximum_predicted_pd, {even('ap')} AS average_predicted_pd, {even('ar')} AS actual_default_rate,
 {even('CAST(record_count AS DOUBLE) / n')} AS population_percentage, {even('ap - ar')} AS calibration_gap,
 {even('abs(ap - ar)')} AS absolute_calibration_gap
 FROM (SELECT {k}band, count(*) AS record_count, CAST(sum(y) AS BIGINT) AS default_count, min(p) AS low, max(p) AS high,
  avg(p) AS ap, avg(CAST(y AS DOUBLE)) AS ar, max(n) AS n FROM {source} GROUP BY {k}band)"""


cte("banded", "matched", banding(10))
cte("banded_segment", "matched", banding(5, "segment"))
cte("bands", "banded", banded_table("banded"))
cte("bands_segment", "banded_segment", banded_table("banded_segment", "segment"))
cte(
    "band_errors",
    "bands",
    """SELECT sum(population_percentage * absolute_calibration_gap) AS expected_calibration_error,
 max(absolute_calibration_gap) AS maximum_calibration_error FROM bands""",
)


# Drift

for population in ("reference", "production"):
    cte(
        f"long_{population}",
        population,
        f"SELECT feature, x FROM (SELECT {F_LIST} FROM {population}) UNPIVOT (x FOR feature IN ({F_LIST}))",
    )
    cte(f"long_score_{population}", population, f"SELECT 'predicted_probability' AS feature, p AS x FROM {population}")


def psi_ctes(result: str, long: str) -> None:
    """Equal-width bins over both populations, their shares, and the index per feature."""
    cte(
        f"{result}_range",
        f"{long}_reference {long}_production",
        f"""SELECT feature, min(x) AS lo, max(x) AS hi FROM (SELECT * FROM {long}_reference UNION ALL SELECT * FROM {long}_production) GROUP BY feature""",
    )
    cte(
        f"{result}_edges",
        f"{result}_range",
        f"SELECT feature, i, CASE WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10e0) END AS edge FROM {result}_range, range(0, 11) AS t(i)",
    )
    cte(
        f"{result}_bins",
        f"{result}_edges",
        f"SELECT a.feature, a.i AS bin, a.edge AS lower_edge, b.edge AS upper_edge FROM {result}_edges a JOIN {result}_edges b ON a.feature = b.feature AND b.i = a.i + 1",
    )
    for side in ("reference", "production"):
        cte(
            f"{result}_share_{side}",
            f"{result}_bins {long}_{side}",
            f"""SELECT b.feature, bin, CASE WHEN count(x) = 0 THEN 0.0001e0 ELSE CAST(count(x) AS DOUBLE) / (SELECT count(*) FROM {side}) END AS share
 FROM {result}_bins b LEFT JOIN {long}_{side} v ON v.feature = b.feature AND x >= lower_edge AND (x < upper_edge OR (bin = 9 AND x <= upper_edge))
 GROUP BY b.feature, bin""",
        )
    cte(
        result,
        f"{result}_share_reference {result}_share_production",
        f"SELECT feature, sum((c.share - r.share) * ln(c.share / r.share)) AS psi FROM {result}_share_reference r JOIN {result}_share_production c USING (feature, bin) GROUP BY feature",
    )


cte(
    "monthly_long",
    "reference production",
    f"""SELECT side, segment, feature, x FROM (SELECT 0 AS side, strftime(ts, '%m') AS segment, {F_LIST} FROM reference
 UNION ALL SELECT 1, strftime(ts, '%m'), {F_LIST} FROM production) UNPIVOT (x FOR feature IN ({F_LIST}))""",
)
cte(
    "monthly_bins",
    "monthly_long",
    """SELECT segment, feature, bin, count(*) FILTER (side = 0) AS n_r, count(*) FILTER (side = 1) AS n_c
 FROM (SELECT *, len(list_filter(range(1, 10), lambda i: x >= lo + i * ((hi - lo) / 10e0))) AS bin
  FROM (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM monthly_long WINDOW w AS (PARTITION BY segment, feature)))
 GROUP BY segment, feature, bin""",
)
psi_ctes("psi", "long")
psi_ctes("score_psi", "long_score")
cte(
    "psi_status",
    "psi",
    f"SELECT feature, {even('psi')} AS psi, CASE WHEN psi < 0.1 THEN 'NORMAL' WHEN psi < 0.25 THEN 'WARNING' ELSE 'ALERT' END AS status FROM psi",
)


# Shapley impacts of the literal forest

PATHS = ", ".join(
    f"({i}, {num(leaf.value)}, {j}, '{f}', {num(lo)}, {num(hi)}, {len(leaf.box)})"
    for i, leaf in enumerate(FOREST.leaves)
    for j, (f, lo, hi) in enumerate(leaf.box)
)
cte("paths", "", f"SELECT * FROM (VALUES {PATHS}) AS t(leaf, leaf_value, j, feature, lo, hi, width)")
cte(
    "long_apps",
    "apps",
    f"SELECT application_id, ts, feature, x FROM (SELECT application_id, ts, {F_LIST} FROM apps) UNPIVOT (x FOR feature IN ({F_LIST}))",
)
def impact_ctes(prefix: str, long: str, rows: str) -> None:
    """Impacts of all applications of a long table against those of the reference time; `rows` counts the latter."""
    cte(
        f"{prefix}held",
        f"{long} paths",
        f"""SELECT application_id, ts, leaf, CAST(sum(CASE WHEN x > lo AND x <= hi THEN 1 << j ELSE 0 END) AS BIGINT) AS held
 FROM {long} JOIN paths USING (feature) GROUP BY application_id, ts, leaf""",
    )
    cte(
        f"{prefix}background_sets",
        f"{prefix}held {long} reference",
        f"""SELECT leaf, held AS z, CAST(count(*) AS DOUBLE) / ({rows}) AS share FROM {prefix}held
 WHERE ts < TIMESTAMP '1998-01-01' GROUP BY leaf, held""",
    )
    cte(
        f"{prefix}set_pairs",
        f"{prefix}held {prefix}background_sets paths",
        f"""SELECT d.leaf, d.x, z, share, leaf_value, feature, j, bit_count(CAST(d.x & (full_set - z) AS BIGINT)) AS u, bit_count(CAST(z & (full_set - d.x) AS BIGINT)) AS w
 FROM (SELECT DISTINCT leaf, held AS x FROM {prefix}held) d JOIN {prefix}background_sets USING (leaf)
 JOIN (SELECT *, (1 << width) - 1 AS full_set FROM paths) USING (leaf) WHERE (d.x | z) = full_set""",
    )
    cte(
        f"{prefix}leaf_impacts",
        f"{prefix}set_pairs",
        f"""SELECT leaf, x, feature, sum(share * leaf_value * CASE
  WHEN (x >> j) & 1 = 1 AND (z >> j) & 1 = 0 THEN CAST(factorial(u - 1) * factorial(w) AS DOUBLE) / CAST(factorial(u + w) AS DOUBLE)
  WHEN (x >> j) & 1 = 0 AND (z >> j) & 1 = 1 THEN -CAST(factorial(u) * factorial(w - 1) AS DOUBLE) / CAST(factorial(u + w) AS DOUBLE)
  ELSE 0e0 END) AS phi FROM {prefix}set_pairs GROUP BY leaf, x, feature""",
    )
    cte(
        f"{prefix}phi",
        f"{prefix}held {prefix}leaf_impacts",
        f"""SELECT application_id, feature, sum(phi) AS phi FROM {prefix}held h JOIN {prefix}leaf_impacts l ON h.leaf = l.leaf AND h.held = l.x
 GROUP BY application_id, feature""",
    )


impact_ctes("", "long_apps", "SELECT count(*) FROM reference")
# Applications with gaps: no balance where the account is overdrawn, no debt with a single account, no employment yet.
cte("complete", "apps", "SELECT * FROM apps WHERE balance > 0 AND accounts > 1 AND employment > 0")
cte(
    "long_complete",
    "complete",
    f"SELECT application_id, ts, feature, x FROM (SELECT application_id, ts, {F_LIST} FROM complete) UNPIVOT (x FOR feature IN ({F_LIST}))",
)
impact_ctes("dirty_", "long_complete", "SELECT count(DISTINCT application_id) FROM long_complete WHERE ts < TIMESTAMP '1998-01-01'")
POSITIONS = ", ".join(f"('{f}', {i})" for i, f in enumerate(FEATURES))
cte("feature_order", "", f"SELECT * FROM (VALUES {POSITIONS}) AS t(feature, idx)")
cte(
    "shap",
    "long_apps phi feature_order",
    """SELECT l.application_id, l.feature, idx, l.x, coalesce(phi, 0e0) AS raw_impact, round(coalesce(phi, 0e0), 10) + 0e0 AS impact
 FROM long_apps l JOIN feature_order USING (feature) LEFT JOIN phi ON l.application_id = phi.application_id AND l.feature = phi.feature""",
)
cte("means", "long_reference", "SELECT feature, avg(x) AS mean FROM long_reference GROUP BY feature")
cte(
    "impacts",
    "shap means",
    """SELECT application_id, feature AS attribute_name, x AS attribute_value, mean AS average_attribute_value, impact AS attribute_impact,
 abs(impact) AS absolute_impact,
 CAST(row_number() OVER (PARTITION BY application_id ORDER BY impact DESC, idx) - 1 AS INTEGER) AS ranked_impact_positive,
 CAST(row_number() OVER (PARTITION BY application_id ORDER BY impact ASC, idx) - 1 AS INTEGER) AS ranked_impact_negative,
 CAST(row_number() OVER (PARTITION BY application_id ORDER BY abs(impact) DESC, idx) - 1 AS INTEGER) AS ranked_impact_absolute,
 CASE WHEN impact > 0 THEN 'more' WHEN impact < 0 THEN 'less' ELSE 'neutral' END AS risk_vs_typical,
 CASE WHEN x > mean THEN 'more' WHEN x < mean THEN 'less' ELSE 'equal' END AS value_vs_typical
 FROM shap JOIN means USING (feature)""",
)
IMPACT_OUT = f"""application_id, attribute_name, {six('attribute_value')} AS attribute_value,
 {fine('average_attribute_value', 8)} AS average_attribute_value, {six('attribute_impact')} AS attribute_impact,
 {six('absolute_impact')} AS absolute_impact, ranked_impact_positive, ranked_impact_negative, ranked_impact_absolute,
 risk_vs_typical, value_vs_typical"""

ENTRIES = ", ".join(
    "("
    + ", ".join(
        [
            text(n),
            text(e.display_name),
            text(e.reason_code),
            text(e.adverse_reason),
            text(e.favorable_reason),
            str(e.compliance_review_required).lower(),
            str(e.business_priority),
        ]
    )
    + ")"
    for n, e in PRIORITY_REGISTRY.items()
)
cte(
    "registry",
    "",
    f"""SELECT * FROM (VALUES {ENTRIES}) AS t(attribute_name, display_name, reason_code, adverse_reason, favorable_reason,
 compliance_review_required, business_priority)""",
)
cte("enriched", "impacts registry", "SELECT * FROM impacts LEFT JOIN registry USING (attribute_name)")


def reason_cte(name: str, where: str, order: str, limit: int | None = None) -> None:
    keep = f" WHERE reason_rank <= {limit}" if limit else ""
    cte(
        name,
        "enriched",
        f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY application_id ORDER BY {order}) AS INTEGER) AS reason_rank
 FROM enriched WHERE {where}){keep}""",
    )


reason_cte("adverse", "attribute_impact > 0", "ranked_impact_positive")
reason_cte("favorable", "attribute_impact < 0", "ranked_impact_negative")
reason_cte("either", "absolute_impact >= 0.05", "ranked_impact_absolute")
reason_cte("top2", "attribute_impact > 0", "ranked_impact_positive", 2)
reason_cte("top4", "attribute_impact > 0", "ranked_impact_positive", 4)
reason_cte("priority4", "attribute_impact > 0", "business_priority, absolute_impact DESC, ranked_impact_absolute", 4)
reason_cte("absolute3", "true", "absolute_impact DESC, ranked_impact_absolute", 3)
REASON_OUT = f"application_id, reason_rank, attribute_name, {six('attribute_impact')} AS attribute_impact, reason_code, compliance_review_required"
cte("forest", "apps", f"SELECT application_id, ts, {FOREST_P} AS fp, {MARGIN} AS margin FROM apps")
cte(
    "explanations",
    "forest top4",
    f"""SELECT f.application_id, ts, fp, CASE WHEN fp >= 0.5 THEN 'decline' ELSE 'approve' END AS decision,
 count(attribute_name) AS n, coalesce(string_agg(attribute_name, ',' ORDER BY reason_rank), '') AS reasons,
 count(*) FILTER (compliance_review_required) AS flags
 FROM forest f LEFT JOIN top4 r ON f.application_id = r.application_id GROUP BY f.application_id, ts, fp""",
)
EXPLAIN_OUT = f"""application_id, {six('fp')} AS default_probability, decision, '4' AS requested_top_n, CAST(n AS INTEGER) AS total_adverse_factors,
 reasons, 10 AS contribution_count, '0,1,2,3,4,5,6,7,8,9' AS contribution_ranks, flags > 0 AS compliance_review_required, CAST(flags AS INTEGER) AS flag_count"""


# Events

cte(
    "prediction_events",
    "apps",
    """SELECT ts, 'PredictionCount' AS metric_name, 1e0 AS value, 'Count' AS unit FROM apps
 UNION ALL SELECT ts, 'DefaultProbability', p, 'None' FROM apps
 UNION ALL SELECT ts, 'HighRiskPredictionCount', 1e0, 'Count' FROM apps WHERE p >= 0.75""",
)
cte(
    "error_events",
    "",
    "SELECT CAST(ts AS TIMESTAMP) AS ts, 'PredictionErrorCount' AS metric_name, 1e0 AS value, 'Count' AS unit FROM events WHERE event_type = 'error'",
)
cte(
    "closed_hours",
    "error_events",
    """SELECT * FROM (SELECT time_bucket(INTERVAL '3600 seconds', ts) AS window_start, sum(value) AS total FROM error_events GROUP BY 1)
 WHERE window_start + INTERVAL '3600 seconds' <= (SELECT max(ts) FROM error_events) - INTERVAL '10 minutes'""",
)
cte(
    "request_events",
    "error_events",
    "SELECT CAST(ts AS TIMESTAMP) AS ts, 'PredictionCount' AS metric_name, 1e0 AS value, 'Count' AS unit FROM events UNION ALL SELECT * FROM error_events",
)


cte(
    "stream",
    "prediction_events request_events psi_status",
    f"""SELECT * FROM prediction_events UNION ALL SELECT * FROM request_events
 UNION ALL SELECT TIMESTAMP '{RUN_DATE}', 'FeaturePSI_' || feature, psi, 'None' FROM psi_status""",
)


def series(source: str, metric: str, period: int, statistic: str, prefix: bool = False) -> str:
    match = f"starts_with(metric_name, '{metric}')" if prefix else f"metric_name = '{metric}'"
    value = "sum(value)" if statistic == "Sum" else "avg(value)"
    return f"""SELECT metric_name, CAST({period} AS BIGINT) AS period_seconds, '{statistic}' AS statistic,
 time_bucket(INTERVAL '{period} seconds', ts) AS window_start, (round({value}, 12) + 0e0) AS metric_value FROM {source} WHERE {match} GROUP BY ALL"""


def alarm(source: str, name: str, metric: str, period: int, limit: float) -> str:
    return f"""SELECT '{name}' AS alarm, '{metric}' AS metric_name, CAST({period} AS BIGINT) AS period_seconds,
 time_bucket(INTERVAL '{period} seconds', ts) AS window_start, {six('sum(value)')} AS metric_value, {num(limit)} AS threshold,
 sum(value) >= {num(limit)} AS breached FROM {source} WHERE metric_name = '{metric}' GROUP BY ALL"""


# Quality


def rules(dataset: str | None, source: str, *checks: tuple[str, str]) -> str:
    label = f"'{dataset}' AS dataset, " if dataset else ""
    return " UNION ALL ".join(
        f"SELECT {label}{i} AS rule_order, '{rule}' AS rule, CAST(({expression}) AS BIGINT) AS violations FROM {source}"
        for i, (rule, expression) in enumerate(checks, 1)
    )


NOT_EMPTY = ("not_empty", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END")
KEYED = (
    NOT_EMPTY,
    ("id_not_null", "count(*) FILTER (application_id IS NULL)"),
    ("id_unique", "count(application_id) - count(DISTINCT application_id)"),
)
P_RULES = (
    ("probability_not_null", "count(*) FILTER (p IS NULL OR isnan(p))"),
    ("probability_in_range", "count(*) FILTER (p < 0 OR p > 1)"),
)
Y_RULES = (
    ("actual_not_null", "count(*) FILTER (y IS NULL)"),
    ("actual_binary", "count(*) FILTER (y NOT IN (0, 1))"),
)
BOTH = (("both_classes_present", "CASE WHEN count(*) FILTER (y = 0) > 0 AND count(*) FILTER (y = 1) > 0 THEN 0 ELSE 1 END"),)


def broken(feature: str, low: float, inclusive: bool, high: float | None) -> str:
    bad = f"{feature} {'<' if inclusive else '<='} {num(low)}"
    return f"CASE WHEN {bad}{f' OR {feature} > {num(high)}' if high is not None else ''} THEN '{feature}_range' END"


LENDER = {"fico": (580.0, True, 850.0), "income": (60000.0, True, None), "utilization": (0.0, True, 0.6)}
VIOLATED = f"concat_ws(',', {', '.join(broken(r[0], *LENDER.get(r[0], r[1:])) for r in FEATURE_RANGES)})"

SUMMARY_AVERAGES = ", ".join(f"{six(f'avg({f})')} AS avg_{f}" for f in ("fico", "income", "loan_amount", "utilization"))
BUCKET = "CASE WHEN p < 0.05 THEN 'low' WHEN p < 0.10 THEN 'medium' WHEN p < 0.20 THEN 'high' ELSE 'very_high' END"
SAMPLE = f"""SELECT {{columns}} FROM (SELECT * FROM reference ORDER BY md5(application_id || '|42'), application_id LIMIT 500)"""
SIX_FEATURES = ", ".join(f"{six(f)} AS {f}" for f in FEATURES)
BATCH_NAMES = config.MONITORING_METRICS[:15] + tuple(m for m in config.PERFORMANCE_METRICS if m[1] != "AveragePredictedPD")
DATED = "SELECT application_id, p AS predicted_probability, strftime(date_trunc('month', ts), '%Y-%m-%d') AS dt FROM apps"

ORACLE: dict[str, str] = {
    "latest_partition": chain(f"SELECT * FROM ({DATED}) WHERE dt = (SELECT max(dt) FROM ({DATED}))", "apps"),
    "scan_partition": chain(f"SELECT * FROM ({DATED}) WHERE dt = '1998-01-01'", "apps"),
    "scan_csv": chain("SELECT * FROM bands", "bands"),
    "sink_metrics": chain(
        f"SELECT feature, psi, status, (SELECT count(*) FROM production) AS sample_size, '{RUN_DATE}' AS run_date FROM psi_status",
        "psi_status",
        "production",
    ),
    "sink_explanations": chain(f"SELECT {EXPLAIN_OUT} FROM explanations", "explanations"),
    "report_path": chain(
        f"""SELECT 'monitoring/reports/model_version={MODEL_VERSION}/dt=' || strftime(date_trunc('month', ts), '%Y-%m-%d') AS report_path,
 count(*) AS record_count FROM apps GROUP BY 1""",
        "apps",
    ),
    "background_load": chain(SAMPLE.format(columns=SIX_FEATURES), "reference"),
    "bootstrap_sample": chain(
        f"""SELECT d.draw, r.* FROM
 (SELECT i AS draw, CAST('0x' || substr(md5(i || '|{config.BACKGROUND_SEED}'), 1, 15) AS BIGINT) % (SELECT count(*) FROM reference) + 1 AS n
  FROM range(500) t(i)) d
 JOIN (SELECT application_id, {SIX_FEATURES}, row_number() OVER (ORDER BY CAST(application_id AS VARCHAR)) AS n FROM reference) r0
 ON d.n = r0.n""".replace("r.*", "r0.* EXCLUDE (n)"),
        "reference",
    ),
    "background_sample": chain(SAMPLE.format(columns=f"application_id, {SIX_FEATURES}"), "reference"),
    "dq_feature_ranges": chain(
        f"""SELECT application_id, v = '' AS accepted, v AS violated_rules FROM (
 SELECT application_id, {VIOLATED} AS v FROM apps)""",
        "apps",
    ),
    "dq_predictions": chain(
        rules("predictions", "apps", *KEYED, *P_RULES) + " UNION ALL " + rules("events", "feed", *KEYED, *P_RULES), "apps", "feed"
    ),
    "dq_outcomes": chain(
        rules("outcomes", "matched", *KEYED, *Y_RULES) + " UNION ALL " + rules("events", "feed", *KEYED, *Y_RULES), "matched", "feed"
    ),
    "dq_performance": chain(
        rules("matched", "matched", NOT_EMPTY, *Y_RULES, *P_RULES, *BOTH)
        + " UNION ALL "
        + rules("events", "feed", NOT_EMPTY, *Y_RULES, *P_RULES, *BOTH),
        "matched",
        "feed",
    ),
    "dq_calibration": chain(
        rules("matched", "matched", NOT_EMPTY, *Y_RULES, *P_RULES)
        + " UNION ALL "
        + rules("events", "feed", NOT_EMPTY, *Y_RULES, *P_RULES),
        "matched",
        "feed",
    ),
    "dq_background": chain(
        rules(
            "reference",
            "reference",
            NOT_EMPTY,
            *[(f"{f}_not_null", f"count(*) FILTER ({f} IS NULL OR isnan({f}))") for f in sorted(FEATURES)],
        )
        + " UNION ALL "
        + rules(
            "unfilled",
            "(SELECT * FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)",
            NOT_EMPTY,
            *[(f"{c}_not_null", f"count(*) FILTER ({c} IS NULL)") for c in ("l_quantity", "o_totalprice")],
        ),
        "reference",
    ),
    "dq_identifiers": chain(
        rules("matched", "matched", NOT_EMPTY, ("identifiers_unique", "count(*) - count(DISTINCT application_id)"))
        + " UNION ALL "
        + rules("events", "feed", NOT_EMPTY, ("identifiers_unique", "count(*) - count(DISTINCT (application_id, event_type))")),
        "matched",
        "feed",
    ),
    "dq_impacts": chain(
        " UNION ALL ".join(
            rules(
                dataset,
                f"(SELECT * FROM impacts WHERE {condition})",
                NOT_EMPTY,
                ("impact_not_null", "count(*) FILTER (attribute_impact IS NULL)"),
                ("feature_known", f"count(*) FILTER (attribute_name NOT IN ({', '.join(map(text, FEATURES))}))"),
                ("feature_repeated", "count(*) - count(DISTINCT (application_id, attribute_name))"),
                ("feature_missing", "10 * count(DISTINCT application_id) - count(DISTINCT (application_id, attribute_name))"),
            )
            for dataset, condition in (("whole", "true"), ("raising", "attribute_impact > 0"))
        ),
        "impacts",
    ),
    "dq_scores": chain(
        rules("scored", "(SELECT fp AS p FROM forest)", *P_RULES) + " UNION ALL " + rules("events", "feed", *P_RULES),
        "forest",
        "feed",
    ),
    "min_sample_gate": chain(
        """SELECT 'performance' AS dataset, count(*) AS sample_size, CAST(100 AS BIGINT) AS minimum_samples, count(*) >= 100 AS sufficient FROM matched
 UNION ALL SELECT 'drift', count(*), 100, count(*) >= 100 FROM production
 UNION ALL SELECT 'day', count(*), 100, count(*) >= 100 FROM apps WHERE ts = TIMESTAMP '1998-01-01'""",
        "matched",
        "production",
    ),
    "predicted_class": chain("SELECT application_id, CAST(p >= 0.5 AS INTEGER) AS predicted_class FROM apps", "apps"),
    "decision": chain("SELECT application_id, CASE WHEN p >= 0.5 THEN 'decline' ELSE 'approve' END AS decision FROM apps", "apps"),
    "high_risk": chain("SELECT application_id, p >= 0.75 AS high_risk FROM apps", "apps"),
    "join_outcomes": chain("SELECT application_id, p AS predicted_probability, y AS actual_default FROM matched", "matched"),
    "observations": chain(f"SELECT application_id, ts AS observation_timestamp, {SIX_FEATURES} FROM apps", "apps"),
    "bad_rate": chain(f"SELECT {six('bad_rate')} AS bad_rate FROM sums", "sums"),
    "class_counts": chain("SELECT record_count, default_count, non_default_count FROM sums", "sums"),
    "pd_distribution": chain(
        "SELECT "
        + ", ".join(
            f"{six(c)} AS {c}"
            for c in ("average_predicted_pd", "prediction_standard_deviation", "minimum_predicted_pd", "maximum_predicted_pd")
        )
        + " FROM sums",
        "sums",
    ),
    "confusion_matrix": chain("SELECT true_positive, false_positive, true_negative, false_negative FROM sums", "sums"),
    "classification_metrics": chain(
        "SELECT "
        + ", ".join(
            f'{six(chr(34) + c + chr(34))} AS "{c}"'
            for c in (
                "accuracy",
                "balanced_accuracy",
                "precision",
                "recall",
                "specificity",
                "f1",
                "false_positive_rate",
                "false_negative_rate",
                "predicted_positive_rate",
            )
        )
        + " FROM ratios",
        "ratios",
    ),
    "brier_logloss": chain(f"SELECT {six('brier_score')} AS brier_score, {six('log_loss')} AS log_loss FROM sums", "sums"),
    "portfolio_calibration": chain(f"SELECT {six('calibration_error')} AS calibration_error FROM sums", "sums"),
    "auc_ks_gini": chain(f"SELECT {six('auc')} AS auc, {six('ks')} AS ks, {six('2 * auc - 1')} AS gini FROM ranked", "ranked"),
    "roc_points": chain(
        f"""SELECT {six('p')} AS threshold, {six('CAST(cn AS DOUBLE) / nn')} AS false_positive_rate,
 {six('CAST(cp AS DOUBLE) / np')} AS true_positive_rate FROM dist UNION ALL SELECT NULL, 0e0, 0e0""",
        "dist",
    ),
    "performance_report": chain("SELECT * FROM report", "report"),
    "performance_by_segment": chain("SELECT * FROM report_segment", "report_segment"),
    "report_with_metadata": chain(
        f"""SELECT *, '{RUN_DATE}' AS run_date, 'predictions' AS prediction_dataset, 'outcomes' AS outcome_dataset,
 record_count AS matched_sample_size, '{MODEL_VERSION}' AS model_version, 'model_performance' AS monitoring_type FROM report""",
        "report",
    ),
    "report_summary": chain(
        " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST(\"{c}\" AS DOUBLE) AS metric_value FROM report" for c in REPORT_COLUMNS),
        "report",
    ),
    "metric_status": chain(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, {m} AS value, {num(w)} AS warning_level, {num(a)} AS alert_level,
 CASE WHEN {m} {'<' if side == 'below' else '>='} {num(a)} THEN 'ALERT' WHEN {m} {'<' if side == 'below' else '>='} {num(w)} THEN 'WARNING' ELSE 'NORMAL' END AS status FROM report"""
            for m, side, w, a in config.STATUS_RULES
        ),
        "report",
    ),
    "calibration_bands": chain(
        "SELECT application_id, p AS predicted_probability, band AS calibration_band FROM banded", "banded"
    ),
    "calibration_table": chain("SELECT * FROM bands", "bands"),
    "calibration_by_segment": chain("SELECT * FROM bands_segment", "bands_segment"),
    "calibration_errors": chain(
        f"""SELECT {six('expected_calibration_error')} AS expected_calibration_error,
 {six('maximum_calibration_error')} AS maximum_calibration_error FROM band_errors""",
        "band_errors",
    ),
    "expected_vs_actual": chain(
        """SELECT calibration_band, 'average_predicted_pd' AS series, average_predicted_pd AS rate FROM bands
 UNION ALL SELECT calibration_band, 'actual_default_rate', actual_default_rate FROM bands""",
        "bands",
    ),
    "monitoring_tables": chain(
        " UNION ALL ".join(
            [f"SELECT '{c}' AS metric, CAST(\"{c}\" AS DOUBLE) AS metric_value FROM report" for c in REPORT_COLUMNS]
            + [
                f"SELECT '{c}' AS metric, {six(c)} AS metric_value FROM band_errors"
                for c in ("expected_calibration_error", "maximum_calibration_error")
            ]
        ),
        "report",
        "band_errors",
    ),
    "psi_single": chain(f"SELECT feature, {six('psi')} AS psi FROM psi WHERE feature = 'utilization'", "psi"),
    "performance_by_range": chain(f'SELECT segment AS "range", {REPORT} FROM ratios_range', "ratios_range"),
    "psi_against_profile": chain("SELECT * FROM psi_status", "psi_status"),
    "default_identifier": f"""SELECT CAST(row_number() OVER (ORDER BY ts NULLS FIRST, user_id NULLS FIRST, event_type NULLS FIRST, value NULLS FIRST) - 1 AS VARCHAR)
 AS application_id, ts, user_id, event_type, {six('value')} AS value FROM events""",
    "background_sample_large": chain(
        """SELECT application_id, fico FROM (SELECT *, row_number() OVER (ORDER BY md5(application_id || '|42'), application_id) AS n,
 count(*) OVER () AS total FROM reference) WHERE n <= greatest(1, total // 10)""",
        "reference",
    ),
    "stream_alarm_transitions": chain(
        """SELECT 'prediction_errors' AS alarm, changed_at, state FROM (
  SELECT window_start AS changed_at, 'ALARM' AS state FROM closed_hours b WHERE total >= 5
  AND NOT EXISTS (SELECT 1 FROM closed_hours c WHERE c.total >= 5 AND c.window_start = b.window_start - INTERVAL '1 hour')
  UNION ALL
  SELECT window_start + INTERVAL '1 hour', 'OK' FROM closed_hours b WHERE total >= 5
  AND NOT EXISTS (SELECT 1 FROM closed_hours c WHERE c.total >= 5 AND c.window_start = b.window_start + INTERVAL '1 hour')
  AND window_start < (SELECT max(window_start) FROM closed_hours))""",
        "closed_hours",
    ),
    "stream_join_outcomes": chain(
        """SELECT application_id, p AS predicted_probability, y AS actual_default,
 ts + to_days(CAST(CAST(application_id AS BIGINT) % 400 AS INTEGER)) AS labelled_at
 FROM apps WHERE matured AND CAST(application_id AS BIGINT) % 400 <= 300""",
        "apps",
    ),
    "psi_by_feature": chain("SELECT * FROM psi_status", "psi_status"),
    "psi_levels": f"""WITH long AS (
 SELECT feature, value, large FROM (
  SELECT l_quantity AS quantity, l_discount AS discount, l_quantity * l_extendedprice AS volume, l_quantity > 15 AS large
  FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_extendedprice IS NOT NULL
 ) UNPIVOT (value FOR feature IN (quantity, discount, volume))
), ranges AS (SELECT feature, min(value) AS low, max(value) AS high FROM long GROUP BY feature
), binned AS (
 SELECT feature, large, len(list_filter(range(1, 10), lambda i: value >= low + i * ((high - low) / 10))) AS bin
 FROM long JOIN ranges USING (feature)
), counts AS (
 SELECT feature, bin, count(*) AS r, count(*) FILTER (large) AS c FROM binned GROUP BY feature, bin
), shares AS (
 SELECT feature, CASE WHEN r = 0 THEN 0.0001e0 ELSE r / CAST(sum(r) OVER w AS DOUBLE) END AS r,
  CASE WHEN c = 0 THEN 0.0001e0 ELSE c / CAST(sum(c) OVER w AS DOUBLE) END AS c FROM counts WINDOW w AS (PARTITION BY feature)
), found AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM shares GROUP BY feature)
SELECT feature, {even('psi')} AS psi, CASE WHEN psi < 0.1e0 THEN 'NORMAL' WHEN psi < 0.25e0 THEN 'WARNING' ELSE 'ALERT' END AS status
FROM found""",
    "prediction_drift": chain(
        f"""SELECT 'prediction_drift' AS metric, {six('psi')} AS value, 0.1e0 AS alert_level,
 CASE WHEN psi >= 0.1 THEN 'ALERT' ELSE 'NORMAL' END AS status FROM score_psi""",
        "score_psi",
    ),
    "psi_by_segment": chain(
        f"""SELECT segment, feature, {six('psi')} AS psi FROM (SELECT segment, feature,
  CASE WHEN min(all_r) > 0 AND min(all_c) > 0 THEN sum((c - r) * ln(c / r)) END AS psi
  FROM (SELECT *, CASE WHEN n_r = 0 THEN 0.0001e0 ELSE n_r / CAST(all_r AS DOUBLE) END AS r,
   CASE WHEN n_c = 0 THEN 0.0001e0 ELSE n_c / CAST(all_c AS DOUBLE) END AS c
   FROM (SELECT *, sum(n_r) OVER w AS all_r, sum(n_c) OVER w AS all_c FROM monthly_bins WINDOW w AS (PARTITION BY segment, feature)))
  GROUP BY segment, feature)""",
        "monthly_bins",
    ),
    "summary_by_date": chain(
        f"""SELECT strftime(ts, '%Y-%m-%d') AS segment, count(*) AS prediction_count, {fine('avg(p)', 10)} AS avg_default_probability,
 {six('min(p)')} AS min_default_probability, {six('max(p)')} AS max_default_probability, count(*) FILTER ({BUCKET} = 'low') AS pd_low_count,
 count(*) FILTER ({BUCKET} = 'medium') AS pd_medium_count, count(*) FILTER ({BUCKET} = 'high') AS pd_high_count,
 count(*) FILTER ({BUCKET} = 'very_high') AS pd_very_high_count FROM apps GROUP BY 1""",
        "apps",
    ),
    "psi_report": chain(
        f"""SELECT *, '{RUN_DATE}' AS run_date, 'reference' AS reference_dataset, 'production' AS production_dataset,
 (SELECT count(*) FROM production) AS sample_size, '{MODEL_VERSION}' AS model_version FROM psi_status""",
        "psi_status",
        "production",
    ),
    "psi_metrics": chain("SELECT 'FeaturePSI_' || feature AS metric_name, psi AS value, 'None' AS unit FROM psi_status", "psi_status"),
    "production_summary": chain(
        f"""SELECT count(*) AS prediction_count, {six('avg(p)')} AS avg_default_probability, {six('min(p)')} AS min_default_probability,
 {six('max(p)')} AS max_default_probability, count(*) FILTER ({BUCKET} = 'low') AS pd_low_count,
 count(*) FILTER ({BUCKET} = 'medium') AS pd_medium_count, count(*) FILTER ({BUCKET} = 'high') AS pd_high_count,
 count(*) FILTER ({BUCKET} = 'very_high') AS pd_very_high_count, {SUMMARY_AVERAGES} FROM apps""",
        "apps",
    ),
    "pd_buckets": chain(f"SELECT {BUCKET} AS pd_bucket, count(*) AS prediction_count FROM apps GROUP BY 1", "apps"),
    "feature_averages": chain(f"SELECT {SUMMARY_AVERAGES} FROM apps", "apps"),
    "background_means": chain(
        "SELECT " + ", ".join(f"{fine(f'avg({f})', 8)} AS {f}" for f in FEATURES) + " FROM reference", "reference"
    ),
    "score_applications": chain(f"SELECT application_id, {six('fp')} AS default_probability FROM forest", "forest"),
    "custom_scorer": chain(f"SELECT application_id, {six('sqrt(p)')} AS default_probability FROM apps", "apps"),
    "shap_values": chain(
        f"SELECT application_id, feature AS attribute_name, {fine('raw_impact', 10)} AS attribute_impact FROM shap", "shap"
    ),
    "shap_dirty_features": chain(
        f"""SELECT a.application_id, f.feature AS attribute_name, {fine('CASE WHEN c.application_id IS NOT NULL THEN coalesce(phi, 0e0) END', 10)} AS attribute_impact
 FROM apps a CROSS JOIN feature_order f LEFT JOIN complete c ON a.application_id = c.application_id
 LEFT JOIN dirty_phi p ON a.application_id = p.application_id AND f.feature = p.feature""",
        "apps",
        "feature_order",
        "complete",
        "dirty_phi",
    ),
    "shap_additivity": chain(
        f"""SELECT application_id, {fine('total', 10)} AS impact_sum, {fine('margin - (SELECT avg(margin) FROM forest WHERE ts < TIMESTAMP ' + chr(39) + '1998-01-01' + chr(39) + ')', 10)} AS margin_gap
 FROM forest JOIN (SELECT application_id, sum(raw_impact) AS total FROM shap GROUP BY application_id) USING (application_id)""",
        "forest",
        "shap",
    ),
    "unpivot_features": chain(
        f"SELECT application_id, feature AS attribute_name, {six('x')} AS attribute_value FROM long_apps", "long_apps"
    ),
    "feature_impact": chain(f"SELECT {IMPACT_OUT} FROM impacts", "impacts"),
    "shap_impacts_joined": chain(f"SELECT {IMPACT_OUT} FROM impacts", "impacts"),
    "impact_ranks": chain(
        "SELECT application_id, attribute_name, ranked_impact_positive, ranked_impact_negative, ranked_impact_absolute FROM impacts",
        "impacts",
    ),
    "value_vs_typical": chain(
        f"""SELECT application_id, feature AS attribute_name, {fine('mean', 8)} AS average_attribute_value,
 CASE WHEN x > mean THEN 'more' WHEN x < mean THEN 'less' ELSE 'equal' END AS value_vs_typical FROM long_apps JOIN means USING (feature)""",
        "long_apps",
        "means",
    ),
    "risk_vs_typical": chain("SELECT application_id, attribute_name, risk_vs_typical FROM impacts", "impacts"),
    "registry_table": chain(
        f"""SELECT attribute_name AS feature_name, {fine('mean', 8)} AS typical_value, display_name, reason_code, adverse_reason,
 favorable_reason, compliance_review_required, business_priority FROM registry JOIN means ON attribute_name = feature""",
        "registry",
        "means",
    ),
    "registry_enrich": chain(
        """SELECT application_id, attribute_name, display_name, reason_code, adverse_reason, favorable_reason,
 compliance_review_required, business_priority FROM (SELECT application_id, feature AS attribute_name FROM long_apps) LEFT JOIN registry USING (attribute_name)""",
        "long_apps",
        "registry",
    ),
    "reasons_adverse": chain(f"SELECT {REASON_OUT} FROM adverse", "adverse"),
    "reasons_favorable": chain(f"SELECT {REASON_OUT} FROM favorable", "favorable"),
    "reasons_all": chain(f"SELECT {REASON_OUT} FROM either", "either"),
    "reasons_top_n": chain(f"SELECT {REASON_OUT} FROM top2", "top2"),
    "reasons_business_priority": chain(f"SELECT {REASON_OUT} FROM priority4", "priority4"),
    "reasons_absolute": chain(f"SELECT {REASON_OUT} FROM absolute3", "absolute3"),
    "reason_rank": chain("SELECT application_id, attribute_name, reason_rank FROM top4", "top4"),
    "explain_batch": chain(f"SELECT {EXPLAIN_OUT} FROM explanations", "explanations"),
    "explanation_records": chain(
        f"""SELECT e.application_id, decision, CAST(n AS INTEGER) AS total_adverse_factors, flags > 0 AS any_flag,
 reason_rank, attribute_name, {six('attribute_impact')} AS attribute_impact, adverse_reason
 FROM explanations e LEFT JOIN top4 r ON e.application_id = r.application_id""",
        "explanations",
        "top4",
    ),
    "compliance_flags": chain(
        """SELECT application_id, true AS any_flag, attribute_name, display_name, reason_code,
 'Feature contribution requires compliance review' AS message FROM enriched WHERE compliance_review_required""",
        "enriched",
    ),
    "metrics_long": chain(
        long_form("report", config.MONITORING_METRICS[:15])
        + " UNION ALL "
        + f"SELECT metric_name, {six('value')} AS value, unit FROM ({long_form('band_errors', config.MONITORING_METRICS[15:])})",
        "report",
        "band_errors",
    ),
    "report_metrics": chain(
        f"SELECT '{MODEL_VERSION}' AS model_version, * FROM ({long_form('report', config.PERFORMANCE_METRICS)})", "report"
    ),
    "metric_dimensions": chain(
        f"""SELECT metric_name, dimension, dimension_value FROM ({long_form('report', config.MONITORING_METRICS[:15])})
 CROSS JOIN (VALUES ('ModelVersion', '{MODEL_VERSION}'), ('Environment', 'development'), ('Portfolio', 'all')) AS d(dimension, dimension_value)""",
        "report",
    ),
    "metric_batches": chain(
        f"""SELECT segment, count(value) AS metric_count, CAST(ceil(count(value) / 20e0) AS BIGINT) AS request_count
 FROM ({long_form('report_segment', BATCH_NAMES, 'segment')}) GROUP BY segment""",
        "report_segment",
    ),
    "metric_events": chain(
        f"""SELECT ts, metric_name, {six('value')} AS value, unit FROM (
 SELECT * FROM prediction_events
 UNION ALL SELECT ts, 'ExplanationCount', 1e0, 'Count' FROM explanations
 UNION ALL SELECT ts, 'ExplanationComplianceReviewCount', 1e0, 'Count' FROM explanations WHERE flags > 0
 UNION ALL SELECT * FROM error_events
 UNION ALL SELECT ts, 'ExplanationErrorCount', value, unit FROM error_events)""",
        "prediction_events",
        "explanations",
        "error_events",
    ),
    "windowed_metrics": chain(
        " UNION ALL ".join(
            series("stream", m, period, stat, prefix=m == "FeaturePSI") for m, period, stat in config.DASHBOARD_SERIES
        ),
        "stream",
    ),
    "alarm_errors": chain(
        alarm("request_events", "prediction_errors", "PredictionErrorCount", 300, 5.0)
        + " UNION ALL "
        + alarm("request_events", "prediction_errors_hourly", "PredictionErrorCount", 3600, 5.0),
        "request_events",
    ),
    "alarm_high_risk": chain(
        alarm("prediction_events", "high_risk_spike", "HighRiskPredictionCount", 3600, 100.0)
        + " UNION ALL "
        + alarm("prediction_events", "high_risk_pair", "HighRiskPredictionCount", 3600, 2.0),
        "prediction_events",
    ),
    "train_gbt": chain(
        """SELECT count(*) FILTER (trains) AS training_count, CAST(sum(y) FILTER (trains) AS BIGINT) AS training_default_count,
 count(*) FILTER (NOT trains) AS test_count, CAST(sum(y) FILTER (NOT trains) AS BIGINT) AS test_default_count, true AS ranks_well
 FROM (SELECT y, CAST('0x' || substr(md5(application_id || '|42'), 1, 8) AS BIGINT) < 3435973836 AS trains FROM matched)""",
        "matched",
    ),
    "gbt_score": chain("SELECT application_id, true AS scores_agree FROM apps", "apps"),
    "gbt_shap_additivity": chain("SELECT application_id, true AS adds_up FROM apps", "apps"),
    "summary_job": chain(
        f"""SELECT count(*) AS prediction_count, {six('avg(p)')} AS avg_default_probability, {six('min(p)')} AS min_default_probability,
 {six('max(p)')} AS max_default_probability, count(*) FILTER ({BUCKET} = 'low') AS pd_low_count,
 count(*) FILTER ({BUCKET} = 'medium') AS pd_medium_count, count(*) FILTER ({BUCKET} = 'high') AS pd_high_count,
 count(*) FILTER ({BUCKET} = 'very_high') AS pd_very_high_count, {SUMMARY_AVERAGES},
 '{RUN_DATE}' AS run_date, '{MODEL_VERSION}' AS model_version
 FROM apps WHERE date_trunc('month', ts) = (SELECT max(date_trunc('month', ts)) FROM apps)""",
        "apps",
    ),
    "model_info": chain(
        f"""SELECT '{MODEL_VERSION}' AS model_version, 'pd_forest' AS model_name, 'tree ensemble' AS algorithm, '2001-12-31' AS training_date,
 '{",".join(FEATURES)}' AS features, record_count, auc FROM report""",
        "report",
    ),
    "stream_windowed_metrics": chain(
        f"""SELECT * FROM (SELECT window_start, window_start + INTERVAL '3600 seconds' AS window_end, metric_name,
  count(*) AS event_count, {six('sum(value)')} AS metric_sum, {six('avg(value)')} AS metric_average
  FROM (SELECT *, time_bucket(INTERVAL '3600 seconds', ts) AS window_start FROM error_events) GROUP BY window_start, metric_name)
 WHERE window_end <= (SELECT max(ts) FROM error_events) - INTERVAL '10 minutes'""",
        "error_events",
    ),
    "stream_alarms": chain(
        f"""SELECT 'prediction_errors' AS alarm, window_start, {six('total')} AS metric_value, 5e0 AS threshold, total >= 5e0 AS breached
 FROM (SELECT time_bucket(INTERVAL '3600 seconds', ts) AS window_start, sum(value) AS total FROM error_events GROUP BY 1)
 WHERE window_start + INTERVAL '3600 seconds' <= (SELECT max(ts) FROM error_events) - INTERVAL '10 minutes'""",
        "error_events",
    ),
    "stream_scores": chain(
        f"SELECT application_id, {six('fp')} AS default_probability, strftime(date_trunc('month', ts), '%Y-%m-%d') AS dt FROM forest",
        "forest",
    ),
}

# A job publishes what its report holds.
ORACLE["performance_job"] = ORACLE["report_metrics"]
ORACLE["drift_job"] = ORACLE["psi_metrics"]
