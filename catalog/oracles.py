"""SQL with the same meaning as the registered queries, for an independent engine on the same files."""

from __future__ import annotations

from catalog.inputs import (
    AUDIT_COLUMNS,
    AUDIT_CTE,
    BASE_CTE,
    DAY,
    MATRIX_VALUES,
    NATION_CTE,
    NUMBER,
    PREPARED_CTE,
    RFM_BASES,
    RFM_CTE,
    numeric_steps,
)
from clientele.functions import rules

ORACLES: dict[str, str] = {}


def r6(sql: str, name: str, digits: int = 6) -> str:
    return f'round({sql}, {digits}) + 0.0 AS "{name}"'


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------------------------------------------------- roll-up

RFM_OUT = ", ".join(
    ["customer_id", r6("recency_days", "recency_days"), "frequency", r6("monetary_value", "monetary_value"),
     r6("average_order_value", "average_order_value"), r6("customer_tenure_days", "customer_tenure_days")]
)
ORACLES["rfm_count_rows"] = f"WITH {RFM_CTE} SELECT {RFM_OUT} FROM rfm"


def orders_rollup(log: str, reference: str = f"(SELECT max(micros) FROM log) + {DAY}") -> str:
    return f"""
WITH log AS ({log}),
sums AS (SELECT customer_id, order_id, sum(amount) AS value, min(micros) AS lo, max(micros) AS hi FROM log GROUP BY 1, 2),
rfm AS (SELECT customer_id, round_even(({reference} - max(hi)) / {DAY}.0, 2) AS recency_days, count(*) AS frequency,
               sum(value) AS monetary_value, avg(value) AS average_order_value,
               round_even((max(hi) - min(lo)) / {DAY}.0, 2) AS customer_tenure_days FROM sums GROUP BY 1)
SELECT {RFM_OUT} FROM rfm"""


ORACLES["rfm_order_rollup"] = orders_rollup(
    "SELECT o_custkey AS customer_id, l_orderkey AS order_id, epoch_us(l_shipdate) AS micros, l_extendedprice AS amount "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)
ORACLES["rfm_event_purchases"] = orders_rollup(
    "SELECT user_id AS customer_id, event_id AS order_id, epoch_us(ts) AS micros, value AS amount FROM events "
    "WHERE event_type = 'purchase' AND value IS NOT NULL"
)
ORACLES["rfm_fixed_reference"] = orders_rollup(
    "SELECT o_custkey AS customer_id, o_orderkey AS order_id, epoch_us(o_orderdate) AS micros, o_totalprice AS amount FROM orders",
    "epoch_us(TIMESTAMP '2002-01-01 00:00:00')",
)

# ------------------------------------------------------------------------------------------------ coercion of values

ORACLES["numeric_coercion"] = f"""
WITH t AS (SELECT c_custkey, CASE c_mktsegment
    WHEN 'MACHINERY' THEN '  ' || CAST(c_acctbal AS VARCHAR) || ' '
    WHEN 'BUILDING' THEN CAST(c_acctbal AS VARCHAR) || 'd'
    WHEN 'FURNITURE' THEN CAST(c_acctbal AS VARCHAR) || 'e2'
    WHEN 'HOUSEHOLD' THEN '' ELSE 'inf' END AS raw FROM customer)
SELECT c_custkey, raw, {r6(f"CASE WHEN regexp_matches(raw, '{NUMBER}') THEN CAST(trim(raw) AS DOUBLE) END", "value")} FROM t"""
ORACLES["date_coercion"] = """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN epoch_us(o_orderdate) WHEN '2-HIGH' THEN epoch_us(o_orderdate)
    WHEN '3-MEDIUM' THEN epoch_us(o_orderdate) + 23400000000 END AS micros FROM orders"""
ORACLES["blank_and_missing"] = f"""
WITH {BASE_CTE}
SELECT coalesce(urgent_status, 'Missing') AS label,
       trim(coalesce(CASE WHEN market = 'BUILDING' THEN '   ' ELSE urgent_status END, '')) = '' AS blank,
       CASE WHEN active THEN 'True' ELSE 'False' END AS active, count(*) AS customers FROM base GROUP BY 1, 2, 3"""
ORACLES["complete_rows"] = f"""
WITH {BASE_CTE}, t AS (SELECT customer_id, urgent_value, {MATRIX_VALUES["balance_text"]} AS balance FROM base)
SELECT customer_id, {r6("urgent_value", "urgent_value")}, {r6("balance", "balance")} FROM t
WHERE urgent_value IS NOT NULL AND balance IS NOT NULL"""

# ------------------------------------------------------------------------------------------------------------- audit

ORACLES["table_overview"] = f"""
WITH {BASE_CTE}, t AS (SELECT nation, market, band, urgent_status, active FROM base),
d AS (SELECT DISTINCT * FROM t)
SELECT count(*) AS rows, 5 AS columns, CAST(count(*) - count(urgent_status) AS BIGINT) AS missing_cells,
       count(*) - (SELECT count(*) FROM d) AS duplicate_rows FROM t"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def hit(pattern: str) -> str:
    return f"regexp_matches(\"column\", {sql_text(pattern)}, 'i')"


def profile_cte() -> str:
    parts = []
    for ordinal, (name, kind) in enumerate(AUDIT_COLUMNS):
        quoted = f'"{name}"'
        if kind == "string":
            numeric = f"avg(CASE WHEN regexp_matches({quoted}, '{NUMBER}') THEN 1.0 WHEN {quoted} IS NOT NULL THEN 0.0 END)"
            mail = f"avg(CASE WHEN regexp_matches({quoted}, {sql_text(rules.EMAIL_VALUE_PATTERN)}) THEN 1.0 WHEN {quoted} IS NOT NULL THEN 0.0 END)"
        else:
            numeric, mail = "1.0", "0.0"
        parts.append(
            f"SELECT {ordinal} AS ordinal, '{name}' AS \"column\", '{kind}' AS type, count(*) AS n, "
            f"count(*) - count({quoted}) AS gaps, count(DISTINCT {quoted}) AS \"unique\", {numeric} AS numeric_share, "
            f"{mail} AS email_share FROM audit"
        )
    kinds = " ".join(f"WHEN {hit(p)} THEN '{k}'" for k, p in rules.DIRECT_IDENTIFIER_PATTERNS)
    return f"""{AUDIT_CTE},
counted AS ({union(parts)}),
profile AS (SELECT *, CASE {kinds} WHEN email_share > {rules.EMAIL_SHARE} THEN 'email' END AS pii,
    {hit(rules.SENSITIVE_PATTERN)} AS sensitive,
    {hit(rules.ID_PATTERN)} OR (type = 'string' AND "unique" = n AND {hit(rules.ID_HINT_PATTERN)}) AS likely_id,
    {hit(rules.DEMOGRAPHIC_PATTERN)} AS demographic, {hit(rules.RAW_DATE_PATTERN)} AS raw_date,
    {hit(rules.BEHAVIOUR_PATTERN)} AS behaviour, {hit(rules.PROFILE_PATTERN)} AS profile_like,
    type IN ('bigint', 'int', 'double') AS is_number, type = 'boolean' AS is_boolean FROM counted),
open_columns AS (SELECT * FROM profile WHERE pii IS NULL AND NOT sensitive AND NOT likely_id
    AND "column" NOT IN ('customer_id', '{rules.ALWAYS_BLOCKED}')),
usable AS (SELECT * FROM open_columns WHERE "unique" > 1 AND NOT raw_date
    AND (is_number OR is_boolean OR numeric_share >= {rules.NUMERIC_SHARE} OR "unique" <= {rules.FEW_LEVELS}))"""


PROFILE = profile_cte()
ORACLES["quality_report"] = f"""WITH {PROFILE}
SELECT ordinal, "column", type, round_even(100.0 * gaps / n, 1) + 0.0 AS "missing_%", "unique", "unique" <= 1 AS constant,
       coalesce(pii, CASE WHEN sensitive THEN 'sensitive' ELSE '' END) AS privacy_note, likely_id FROM profile"""
ORACLES["pii_columns"] = f'WITH {PROFILE} SELECT ordinal, "column", pii AS kind FROM profile WHERE pii IS NOT NULL'
ORACLES["sensitive_columns"] = f'WITH {PROFILE} SELECT ordinal, "column" FROM profile WHERE sensitive'
ORACLES["id_candidates"] = f'WITH {PROFILE} SELECT ordinal, "column" FROM profile WHERE likely_id'
ORACLES["default_bases"] = f"""WITH {PROFILE} SELECT ordinal, "column" FROM open_columns
WHERE (is_number OR is_boolean) AND "unique" > 1 AND NOT demographic ORDER BY ordinal LIMIT {rules.FIRST_BASES}"""
ORACLES["usable_bases"] = f'WITH {PROFILE} SELECT ordinal, "column" FROM usable'
ORACLES["suggested_bases"] = f"""WITH {PROFILE},
picked AS (
  SELECT 'auto' AS recipe, ordinal, "column" FROM usable WHERE behaviour OR (SELECT count(*) FROM usable WHERE behaviour) < 2
  UNION ALL SELECT 'behavior', ordinal, "column" FROM usable WHERE behaviour
  UNION ALL SELECT 'profile', ordinal, "column" FROM usable WHERE profile_like)
SELECT ordinal, "column", recipe FROM picked
QUALIFY row_number() OVER (PARTITION BY recipe ORDER BY ordinal) <= {rules.FIRST_BASES}"""
ORACLES["descriptor_suggestions"] = f"""WITH {PROFILE},
options AS (SELECT ordinal, "column" FROM profile WHERE pii IS NULL
    AND "column" NOT IN ('recency_days', 'order_frequency', 'annual_spend', 'customer_id', '{rules.ALWAYS_BLOCKED}')),
first_profile AS (SELECT ordinal FROM usable WHERE profile_like ORDER BY ordinal LIMIT {rules.FIRST_BASES}),
hits AS (SELECT ordinal FROM options WHERE ordinal IN (SELECT ordinal FROM first_profile) ORDER BY ordinal LIMIT {rules.FIRST_DESCRIPTORS})
SELECT ordinal, "column", ordinal IN (SELECT ordinal FROM hits) AS suggested FROM options"""
ORACLES["log_roles"] = """
SELECT 'customer_id' AS customer, 'order_date' AS purchase_date, 'customer_id' AS amount, 'order_id' AS order_id
WHERE (SELECT count(*) FROM orders) > 0"""


def contract(source: str, key: str, bases: list[str]) -> str:
    varying = " + ".join(f"CAST(count(DISTINCT {b}) > 1 AS INTEGER)" for b in bases)
    return f"""SELECT count(*) AS rows, count(*) FILTER (WHERE {key} IS NULL) AS blank_ids,
    (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {source} GROUP BY {key} HAVING count(*) > 1)) AS repeated_id_rows,
    {varying} AS varying_bases, '{source}' AS source FROM {source}"""


ORACLES["customer_contract"] = union(
    [contract("customer", "c_custkey", ["c_acctbal", "c_mktsegment"]), contract("orders", "o_custkey", ["o_totalprice"])]
)
CORRELATED = ["recency_days", "frequency", "monetary_value", "average_order_value", "customer_tenure_days", "urgent_value", "event_value"]
ORACLES["high_corr_pairs"] = (
    f"WITH {BASE_CTE}, pairs AS ("
    + union(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", abs(corr({a}, {b})) AS correlation FROM base"
        for i, a in enumerate(CORRELATED)
        for b in CORRELATED[i + 1 :]
    )
    + f') SELECT "left", "right", {r6("correlation", "correlation")} FROM pairs WHERE correlation >= 0.3'
)
ORACLES["binary_numeric"] = f"""
WITH {BASE_CTE}, t AS (
  SELECT 0 AS ordinal, 'frequency' AS "column", count(DISTINCT frequency) AS n FROM base
  UNION ALL SELECT 1, 'active_flag', count(DISTINCT active) FROM base
  UNION ALL SELECT 2, 'same', 1
  UNION ALL SELECT 3, 'urgent_value', count(DISTINCT urgent_value) FROM base)
SELECT ordinal, "column" FROM t WHERE n <= 2"""

# ------------------------------------------------------------------------------------------------------- preparation

TYPED = {
    "recency_days": "number", "nation": "text", "balance_text": "text", "active": "truth", "urgent_value": "number",
    "urgent_status": "text",
}
ORACLES["infer_types"] = f"WITH {BASE_CTE} " + union(
    "SELECT '{0}' AS \"column\", {1} AS kind, count({0}) AS present FROM base".format(
        name,
        {
            "number": "'numeric'",
            "truth": "'categorical'",
            "text": f"CASE WHEN avg(CASE WHEN regexp_matches({name}, '{NUMBER}') THEN 1.0 WHEN {name} IS NOT NULL THEN 0.0 END) >= 0.9 "
            "THEN 'numeric' ELSE 'categorical' END",
        }[kind],
    )
    for name, kind in TYPED.items()
)
AUDITED = {**MATRIX_VALUES, "event_value": "event_value"}
ORACLES["prep_missing_audit"] = (
    f"WITH {BASE_CTE}, t AS ("
    + union(
        f"SELECT '{n}' AS \"column\", count(*) AS rows, count(*) - count({n}) AS missing, count({n}) - count({v}) AS unreadable FROM base"
        for n, v in AUDITED.items()
    )
    + f') SELECT *, {r6("(missing + unreadable) / rows", "missing_share")}, (missing + unreadable) / rows > {rules.HEAVY_MISSING} AS heavy FROM t'
)
IMPUTED = {"urgent_value": "urgent_value", "balance_text": MATRIX_VALUES["balance_text"], "event_value": "event_value"}
ORACLES["prep_impute"] = (
    f"WITH {BASE_CTE}, raw AS (SELECT customer_id, "
    + ", ".join(f"{v} AS {n}" for n, v in IMPUTED.items())
    + " FROM base) SELECT customer_id AS id, "
    + ", ".join(r6(f"coalesce({n}, (SELECT median({n}) FROM raw))", n) for n in IMPUTED)
    + " FROM raw"
)
MATRIX = f"WITH {BASE_CTE},\n{numeric_steps(MATRIX_VALUES)}"
ORACLES["prep_steps"] = MATRIX + "\n" + union(
    f"SELECT '{n}' AS \"column\", (SELECT {n} FROM logs) AS logged, {r6(f'(SELECT median({n}) FROM raw)', 'median')}, "
    f"{r6(f'(SELECT quantile_cont({n}, 0.01) FROM imputed)', 'lower')}, {r6(f'(SELECT quantile_cont({n}, 0.99) FROM imputed)', 'upper')}, "
    f"{r6(f'avg({n})', 'mean')}, {r6(f'stddev_pop({n})', 'scale')} FROM logged"
    for n in MATRIX_VALUES
)
ORACLES["prep_standardize"] = f"WITH {PREPARED_CTE} SELECT id, " + ", ".join(
    r6(f"f{i}", n) for i, n in enumerate(RFM_BASES)
) + " FROM prepared"
LEVELS_CTE = (
    BASE_CTE
    + ", levels AS ("
    + union(
        f"SELECT '{n}' AS feature, {v} AS level, count(*) AS customers FROM base GROUP BY 2"
        for n, v in (
            ("nation", "nation"), ("urgent_status", "coalesce(urgent_status, 'Missing')"),
            ("active", "CASE WHEN active THEN 'True' ELSE 'False' END"), ("market", "market"),
        )
    )
    + ")"
)
ORACLES["level_counts"] = f"WITH {LEVELS_CTE} SELECT feature, level, customers FROM levels"
KEPT_CTE = f"""{LEVELS_CTE},
small AS (SELECT greatest(2, CAST(round_even((SELECT count(*) FROM base) * 0.01, 0) AS BIGINT)) AS least),
frequent AS (SELECT level, customers, row_number() OVER (ORDER BY customers DESC, level DESC) AS place,
                    count(*) OVER () AS many FROM levels, small WHERE feature = 'nation' AND customers >= least),
kept AS (SELECT level, customers FROM frequent WHERE many < 20 OR place <= 19)"""
ORACLES["prep_onehot_rare"] = f"""WITH {KEPT_CTE}
SELECT 'nation_' || level AS indicator, customers FROM kept
UNION ALL
SELECT 'nation_infrequent', CAST((SELECT count(*) FROM base) - (SELECT sum(customers) FROM kept) AS BIGINT)"""
ORACLES["prep_matrix"] = f"""WITH {KEPT_CTE},
{numeric_steps(MATRIX_VALUES)}
SELECT s.customer_id AS id, {", ".join(r6("s." + n, n) for n in MATRIX_VALUES)},
       0.5 + 0.0 AS nation_weight, CASE WHEN b.nation IN (SELECT level FROM kept) THEN 0.0 ELSE 0.5 END AS nation_infrequent,
       {", ".join(f"CASE WHEN coalesce(b.urgent_status, 'Missing') = '{v}' THEN 0.5 ELSE 0.0 END AS urgent_status_{v}" for v in ("F", "Missing", "O", "P"))},
       CASE WHEN b.active THEN 0.0 ELSE 0.5 END AS "active_False", CASE WHEN b.active THEN 0.5 ELSE 0.0 END AS "active_True"
FROM scaled s JOIN base b USING (customer_id)"""
ORACLES["many_levels_warning"] = f"""WITH {BASE_CTE}, t AS (
  SELECT 'nation' AS feature, count(DISTINCT nation) AS levels FROM base
  UNION ALL SELECT 'market', count(DISTINCT market) FROM base
  UNION ALL SELECT 'balance_text', count(DISTINCT balance_text) FROM base)
SELECT feature, levels, levels > 40 AS warn FROM t"""

# ------------------------------------------------------------------------------------------ diagnostics, given labels

GIVEN = ("market", "band", "active")


def sizes(label: str, source: str) -> str:
    return f"SELECT {label} AS label, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM {source} GROUP BY 1"


def balance(label: str, source: str) -> str:
    return f"""SELECT '{label}' AS labelling, CAST(sum(n) AS BIGINT) AS customers, count(*) AS segments,
    min(n) AS smallest_segment_customers, 100 * min(p) AS smallest, 100 * max(p) AS largest,
    -sum(p * ln(p + 1e-12)) / greatest(ln(count(*)), 1e-12) AS balance FROM ({sizes(label, source)})"""


ORACLES["segment_sizes"] = f"WITH {BASE_CTE} SELECT label AS market, n AS customers, {r6('p', 'share')} FROM ({sizes('market', 'base')})"
ORACLES["segment_balance"] = (
    f"WITH {BASE_CTE}, t AS ({union(balance(label, 'base') for label in ('market', 'band', 'nation'))}) "
    f"SELECT labelling, customers, segments, smallest_segment_customers, {r6('smallest', 'smallest_segment_%')}, "
    f"{r6('largest', 'largest_segment_%')}, {r6('balance', 'balance')} FROM t"
)


def scatter(label: str) -> str:
    """CTE parts for one labelling: centres, distances to the own centre, dispersion, spread."""
    gap = " + ".join(f"(f{i} - c{i}) ^ 2" for i in range(3))
    between = " + ".join(f"(c{i} - m{i}) ^ 2" for i in range(3))
    pair = " + ".join(f"(a.c{i} - b.c{i}) ^ 2" for i in range(3))
    means = ", ".join(f"avg(f{i}) AS c{i}" for i in range(3))
    return f"""
{label}_c AS (SELECT {label} AS label, count(*) AS n, {means} FROM prepared GROUP BY 1),
{label}_d AS (SELECT label, sqrt({gap}) AS d FROM prepared JOIN {label}_c ON label = {label}),
{label}_s AS (SELECT label, avg(d) AS s FROM {label}_d GROUP BY 1),
{label}_m AS (SELECT {", ".join(f"avg(f{i}) AS m{i}" for i in range(3))} FROM prepared),
{label}_b AS (SELECT sum(n * ({between})) AS b, count(*) AS k, sum(n) AS n FROM {label}_c, {label}_m),
{label}_w AS (SELECT sum(d * d) AS w FROM {label}_d),
{label}_t AS (SELECT a.label, max((x.s + y.s) / sqrt({pair})) AS worst FROM {label}_c a JOIN {label}_c b ON a.label <> b.label
              JOIN {label}_s x ON x.label = a.label JOIN {label}_s y ON y.label = b.label GROUP BY 1)"""


SCATTER = f"{PREPARED_CTE}," + ",".join(scatter(label) for label in GIVEN)
ORACLES["calinski_harabasz"] = f"WITH {SCATTER} " + union(
    f"SELECT '{label}' AS labelling, {r6('(b / (k - 1)) / (w / (n - k))', 'calinski_harabasz')} FROM {label}_b, {label}_w" for label in GIVEN
)
ORACLES["davies_bouldin"] = f"WITH {SCATTER} " + union(
    f"SELECT '{label}' AS labelling, {r6('avg(worst)', 'davies_bouldin')} FROM {label}_t" for label in GIVEN
)


def silhouette_ctes(labels, source: str, distance: str) -> str:
    """Sampled pairs once, then per labelling the mean distance of each row to each segment."""
    parts = [
        f"sampled AS (SELECT * FROM {source} ORDER BY md5(CAST(id AS VARCHAR) || '42'), id LIMIT 2000)",
        f"pairs AS (SELECT a.id AS i, b.id AS j, {', '.join(f'a.{x} AS own_{x}, b.{x} AS other_{x}' for x in labels)}, "
        f"{distance} AS d FROM sampled a CROSS JOIN sampled b)",
    ]
    for x in labels:
        parts.append(
            f"{x}_near AS (SELECT i, own_{x} AS own, other_{x} AS other, "
            f"sum(d) / CASE WHEN own_{x} = other_{x} THEN greatest(count(*) - 1, 1) ELSE count(*) END AS m, count(*) AS n FROM pairs GROUP BY 1, 2, 3)"
        )
        parts.append(
            f"{x}_sil AS (SELECT i, min(m) FILTER (WHERE own = other) AS a, min(n) FILTER (WHERE own = other) AS n, "
            f"min(m) FILTER (WHERE own <> other) AS b FROM {x}_near GROUP BY 1)"
        )
        parts.append(f"{x}_score AS (SELECT avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS s, count(*) AS sampled FROM {x}_sil)")
    return ",\n".join(parts)


PLANE = "sqrt(" + " + ".join(f"(a.f{i} - b.f{i}) ^ 2" for i in range(3)) + ")"
SILHOUETTE = silhouette_ctes(GIVEN, "prepared", PLANE)
ORACLES["silhouette_euclid"] = f"WITH {PREPARED_CTE},\n{SILHOUETTE}\n" + union(
    f"SELECT '{x}' AS labelling, {r6('s', 'silhouette')}, sampled FROM {x}_score" for x in GIVEN
)
ORACLES["embedding_label_separation"] = f"""
WITH vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
{silhouette_ctes(("label",), "vectors", "sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) ^ 2)))")},
flat AS (SELECT id, label, unnest(e) AS v, generate_subscripts(e, 1) AS axis FROM vectors),
centres AS (SELECT label, axis, avg(v) AS c FROM flat GROUP BY 1, 2),
counted AS (SELECT label, count(*) AS n FROM vectors GROUP BY 1),
middle AS (SELECT axis, avg(v) AS m FROM flat GROUP BY 1),
away AS (SELECT f.id, f.label, sqrt(sum((v - c) ^ 2)) AS d FROM flat f JOIN centres USING (label, axis) GROUP BY 1, 2),
spread AS (SELECT label, avg(d) AS s FROM away GROUP BY 1),
inner_sum AS (SELECT sum(d * d) AS w FROM away),
outer_sum AS (SELECT sum(n * (c - m) ^ 2) AS b FROM centres JOIN middle USING (axis) JOIN counted USING (label)),
shape AS (SELECT count(*) AS k, sum(n) AS n FROM counted),
ratio AS (SELECT x.label AS l, y.label AS r, sqrt(sum((x.c - y.c) ^ 2)) AS gap FROM centres x JOIN centres y ON x.axis = y.axis AND x.label <> y.label GROUP BY 1, 2),
worst AS (SELECT l, max((p.s + q.s) / gap) AS t FROM ratio JOIN spread p ON p.label = l JOIN spread q ON q.label = r GROUP BY 1)
SELECT (SELECT k FROM shape) AS segments, round((b / (k - 1)) / (w / (n - k)), 4) + 0.0 AS calinski_harabasz,
       (SELECT round(avg(t), 4) + 0.0 FROM worst) AS davies_bouldin, (SELECT round(s, 5) + 0.0 FROM label_score) AS silhouette
FROM outer_sum, inner_sum, shape"""


def ari(a: str, b: str, source: str) -> str:
    two = "sum(CAST(n AS DOUBLE) * (n - 1) / 2)"
    return f"""(SELECT CASE WHEN (x + y) / 2 - x * y / t = 0 THEN 1.0 ELSE (s - x * y / t) / ((x + y) / 2 - x * y / t) END FROM
    (SELECT {two} AS s FROM (SELECT count(*) AS n FROM {source} GROUP BY {a}, {b})),
    (SELECT {two} AS x FROM (SELECT count(*) AS n FROM {source} GROUP BY {a})),
    (SELECT {two} AS y FROM (SELECT count(*) AS n FROM {source} GROUP BY {b})),
    (SELECT {two} AS t FROM (SELECT count(*) AS n FROM {source})))"""


BASE = "base"
PAIRS = (("market", "band"), ("market", "nation"), ("active", "band"))
ORACLES["ari_pairs"] = f"WITH {BASE_CTE} " + union(
    f"SELECT '{a}|{b}' AS pair, {r6(ari(a, b, 'base'), 'ari', 8)}" for a, b in PAIRS
)
ORACLES["method_agreement"] = (
    f"WITH {BASE_CTE}, scored AS ({union(f'SELECT {sql_text(a)} AS a, {sql_text(b)} AS b, {ari(a, b, BASE)} AS ari' for a, b in PAIRS)}), "
    "both_ways AS (SELECT a AS algorithm_key, ari FROM scored UNION ALL SELECT b, ari FROM scored) "
    f"SELECT algorithm_key, 3 AS segments, {r6('avg(ari)', 'cross_method_agreement', 8)} FROM both_ways GROUP BY 1"
)

UNIT = "greatest(least({0}, 1), 0)".format
CANDIDATES = f"""{SCATTER},
{SILHOUETTE},
sized AS ({union(balance(label, "prepared") for label in GIVEN)}),
silhouettes AS ({union(f"SELECT '{x}' AS labelling, s AS silhouette FROM {x}_score" for x in GIVEN)}),
stable AS ({union(f"SELECT '{x}' AS labelling, {ari(x, 'band', 'prepared')} AS stability" for x in GIVEN)}),
bouldin AS ({union(f"SELECT '{x}' AS labelling, avg(worst) AS davies_bouldin FROM {x}_t" for x in GIVEN)}),
candidates AS (SELECT *, CASE labelling WHEN 'market' THEN 0 WHEN 'band' THEN 1 ELSE 2 END AS place,
    CASE WHEN labelling <> 'market' THEN stability END AS agreement, CASE labelling WHEN 'active' THEN 3 ELSE 6 END AS successes
    FROM sized JOIN silhouettes USING (labelling) JOIN stable USING (labelling) JOIN bouldin USING (labelling)),
parts AS (SELECT *, 0.35 * {UNIT("(silhouette + 0.05) / 0.55")} + 0.30 * {UNIT("stability")}
    + 0.15 * (0.45 * {UNIT("smallest / 8")} + 0.25 * {UNIT("balance")} + 0.30 * {UNIT("smallest_segment_customers / 30")})
    + 0.10 * {UNIT("1 - (segments - 2) / 10")} AS alone FROM candidates),
scored AS (SELECT *, CASE WHEN agreement IS NULL THEN 100 * alone / 0.9 ELSE 100 * (alone + 0.10 * {UNIT("agreement")}) END AS score FROM parts)"""
QUALITY = """CASE
    WHEN silhouette >= 0.45 AND stability >= 0.80 AND smallest / 100 >= 0.05 AND customers >= 300 AND smallest_segment_customers >= 30 AND repeats >= 4 AND successes >= 4 THEN 'Strong'
    WHEN silhouette >= 0.25 AND stability >= 0.65 AND smallest / 100 >= 0.03 AND customers >= 100 AND smallest_segment_customers >= 20 AND repeats >= 4 AND successes >= 4 THEN 'Promising'
    WHEN silhouette >= 0.12 AND stability >= 0.50 AND smallest / 100 >= 0.02 AND smallest_segment_customers >= 5 THEN 'Exploratory'
    ELSE 'Weak' END"""
RANKED = f"""{CANDIDATES},
judged AS (SELECT *, {QUALITY} AS quality FROM (SELECT *, 6 AS repeats FROM scored)),
flagged AS (SELECT *, row_number() OVER (ORDER BY (quality = 'Weak') ASC, score DESC, place) = 1 AS recommended FROM judged),
ranked AS (SELECT *, row_number() OVER (ORDER BY recommended DESC, score DESC, place) AS position FROM flagged)"""
ORACLES["evidence_score"] = f"""WITH {CANDIDATES}
SELECT labelling AS algorithm_key, {r6("score", "recommendation_score")},
       CASE WHEN agreement IS NULL THEN 'none; remaining weights rescaled' ELSE 'cross-method agreement' END AS agreement_component_source FROM scored"""
ORACLES["quality_labels"] = f"""WITH {BASE_CTE}, t AS (SELECT nation, count(*) AS smallest_segment_customers, avg(CAST(active AS DOUBLE)) AS silhouette,
    avg(CASE WHEN frequency >= 8 THEN 1.0 ELSE 0.0 END) AS stability, 100 * avg(CASE WHEN band = 'many' THEN 1.0 ELSE 0.0 END) AS smallest,
    10 * count(*) AS customers, max(frequency) AS repeats, min(frequency) AS successes FROM base GROUP BY 1)
SELECT nation, {QUALITY} AS quality FROM t"""
ORACLES["ranking"] = f"WITH {RANKED} SELECT labelling AS algorithm_key, segments, quality, recommended, position FROM ranked"
ORACLES["verdict"] = f"""WITH {RANKED}, lead AS (SELECT * FROM ranked WHERE position = 1)
SELECT CASE WHEN (SELECT bool_and(quality = 'Weak') FROM ranked) THEN 'no reliable segmentation'
            WHEN quality = 'Exploratory' THEN 'exploratory' ELSE 'supported' END AS outcome,
       upper(labelling) AS method, segments, quality FROM lead"""
ORACLES["score_curve"] = f"""WITH {RANKED}
SELECT upper(labelling) AS method, segments, recommended, quality, smallest_segment_customers, {r6("score", "recommendation_score")},
       {r6("silhouette", "silhouette")}, {r6("stability", "stability")}, 0.0 AS stability_std, {r6("agreement", "cross_method_agreement")},
       {r6("smallest", "smallest_segment_%")}, {r6("davies_bouldin", "davies_bouldin")} FROM ranked"""

# -------------------------------------------------------------------------------------- chosen solution, given labels

ORACLES["segment_naming"] = f"""WITH {BASE_CTE}, t AS (SELECT market, count(*) AS customers FROM base GROUP BY 1)
SELECT market, customers, 'Segment ' || CAST(row_number() OVER (ORDER BY customers DESC, market) AS VARCHAR) AS segment FROM t"""
CONFIDENCE = f"""{SCATTER},
reach AS (SELECT id, band, label, sqrt({" + ".join(f"(f{i} - c{i}) ^ 2" for i in range(3))}) AS d FROM prepared CROSS JOIN band_c),
near AS (SELECT id, band, min(d) FILTER (WHERE label = band) AS own, min(d) FILTER (WHERE label <> band) AS other FROM reach GROUP BY 1, 2),
sure AS (SELECT id, band, least(greatest(other / (own + other + 1e-12), 0), 1) AS confidence FROM near)"""
ORACLES["confidence_centroid"] = f"WITH {CONFIDENCE} SELECT id, band, {r6('confidence', 'confidence')} FROM sure"
ORACLES["confidence_summary"] = f"""WITH {CONFIDENCE}
SELECT {r6("median(confidence)", "median_confidence")}, {r6("avg(CASE WHEN confidence < 0.6 THEN 1.0 ELSE 0.0 END)", "share_below_60")},
       {r6("avg(CASE WHEN confidence < 0.7 THEN 1.0 ELSE 0.0 END)", "share_below_70")} FROM sure"""
ORACLES["centroid_distances"] = f"""WITH {SCATTER}
SELECT a.label AS segment, b.label AS other_segment, {r6("sqrt(" + " + ".join(f"(a.c{i} - b.c{i}) ^ 2" for i in range(3)) + ")", "distance")}
FROM market_c a CROSS JOIN market_c b"""

# --------------------------------------------------------------------------------------------- profiles, given labels

NUMERIC = ("recency_days", "frequency", "urgent_value", "average_order_value")
ROLE = "CASE WHEN feature IN ('recency_days', 'frequency', 'urgent_status', 'nation') THEN 'basis' ELSE 'descriptor' END"
NAMED = "CASE {0} WHEN 'few' THEN 'Occasional' WHEN 'many' THEN 'Regulars' ELSE {0} END".format
ORACLES["segment_summary"] = f"""WITH {BASE_CTE}
SELECT label AS segment, {NAMED("label")} AS name, n AS customers, {r6("round_even(100 * p, 1)", "share_%")} FROM ({sizes("band", "base")})"""
NUMERIC_CTE = (
    BASE_CTE
    + ", numbers AS ("
    + union(
        f"SELECT band AS segment, '{n}' AS feature, {i} AS feature_order, avg({n}) AS mean, median({n}) AS median, "
        f"(SELECT avg({n}) FROM base) AS overall_mean, (SELECT stddev_pop({n}) FROM base) AS overall_std FROM base GROUP BY 1"
        for i, n in enumerate(NUMERIC)
    )
    + f"""), numeric_profile AS (SELECT *, {ROLE} AS role,
    CASE WHEN abs(overall_mean) > 1e-12 THEN 100 * mean / overall_mean END AS index_100,
    CASE WHEN overall_std > 1e-12 THEN (mean - overall_mean) / overall_std ELSE 0 END AS z FROM numbers)"""
)
ORACLES["numeric_profile"] = f"""WITH {NUMERIC_CTE}
SELECT segment, role, feature, {r6("mean", "mean")}, {r6("median", "median")}, {r6("overall_mean", "overall_mean")},
       {r6("index_100", "index_100")}, {r6("z", "z_difference")} FROM numeric_profile"""
LABELS = (
    ("urgent_status", "coalesce(urgent_status, 'Missing')"), ("nation", "nation"), ("market", "market"),
    ("active", "CASE WHEN active THEN 'True' ELSE 'False' END"),
)
CATEGORICAL_CTE = (
    "cells AS ("
    + union(f"SELECT band AS segment, '{n}' AS feature, {i} AS feature_order, {v} AS level FROM base" for i, (n, v) in enumerate(LABELS))
    + f"""), cell_counts AS (SELECT segment, feature, feature_order, level, count(*) AS n FROM cells GROUP BY ALL),
totals AS (SELECT feature, feature_order, level, sum(n) AS total, row_number() OVER (PARTITION BY feature ORDER BY sum(n) DESC, level) AS level_order
           FROM cell_counts GROUP BY 1, 2, 3),
segments AS (SELECT band AS segment, count(*) AS size FROM base GROUP BY 1),
modes AS (SELECT segment, feature, level AS mode FROM cell_counts
          QUALIFY row_number() OVER (PARTITION BY segment, feature ORDER BY n DESC, level) = 1),
categorical_profile AS (SELECT s.segment, {ROLE.replace("feature", "t.feature")} AS role, t.feature, t.feature_order, t.level, t.level_order, t.level = m.mode AS is_segment_mode,
    100.0 * coalesce(c.n, 0) / s.size AS share, 100.0 * t.total / (SELECT count(*) FROM base) AS overall
    FROM totals t CROSS JOIN segments s LEFT JOIN cell_counts c ON c.segment = s.segment AND c.feature = t.feature AND c.level = t.level
    JOIN modes m ON m.segment = s.segment AND m.feature = t.feature WHERE t.level_order <= 20)"""
)
ORACLES["categorical_profile"] = f"""WITH {BASE_CTE}, {CATEGORICAL_CTE}
SELECT segment, role, feature, level, is_segment_mode, {r6("share", "segment_share_%")}, {r6("overall", "overall_share_%")},
       {r6("100 * share / overall", "index_100")} FROM categorical_profile"""
PHRASE = """CASE WHEN feature LIKE '%recency%' THEN CASE WHEN z > 0 THEN 'Lapsed' ELSE 'Recently active' END
    WHEN feature LIKE '%value%' THEN CASE WHEN z > 0 THEN 'High spend' ELSE 'Light spend' END
    WHEN feature LIKE '%frequency%' THEN CASE WHEN z > 0 THEN 'Frequent buyers' ELSE 'Occasional buyers' END END"""
ORACLES["trait_phrases"] = f"WITH {NUMERIC_CTE} SELECT segment, feature, {PHRASE} AS phrase FROM numeric_profile"
ORACLES["segment_cards"] = f"""WITH {NUMERIC_CTE}, {CATEGORICAL_CTE},
strong AS (SELECT segment, 0 AS kind, row_number() OVER (PARTITION BY segment ORDER BY abs(z) DESC, feature_order) AS place, {PHRASE} AS trait
           FROM numeric_profile WHERE role = 'basis' AND abs(z) >= 0.25),
first_levels AS (SELECT * FROM categorical_profile WHERE role = 'basis' AND share - overall >= 10
    QUALIFY row_number() OVER (PARTITION BY segment, feature ORDER BY share - overall DESC, feature_order, level_order) = 1),
common AS (SELECT segment, 1 AS kind, row_number() OVER (PARTITION BY segment ORDER BY share - overall DESC, feature_order, level_order) AS place,
           replace(feature, '_', ' ') || ': ' || level AS trait FROM first_levels),
traits AS (SELECT *, count(DISTINCT kind) OVER (PARTITION BY segment) AS kinds FROM
           (SELECT * FROM strong WHERE place <= 2 UNION ALL SELECT * FROM common WHERE place <= 2)),
named AS (SELECT segment, string_agg(trait, ' · ' ORDER BY kind, place) AS name FROM traits WHERE kinds = 1 OR place = 1 GROUP BY 1)
SELECT segment, coalesce(name, 'Broad middle') AS suggested_name FROM segments LEFT JOIN named USING (segment)"""
ORACLES["snake_profile"] = f"""WITH {NUMERIC_CTE}
SELECT segment, {NAMED("segment")} AS segment_name, feature, {r6("z", "z_difference")} FROM numeric_profile WHERE role = 'basis'"""
ORACLES["descriptor_notes"] = f"""WITH {NUMERIC_CTE}, {CATEGORICAL_CTE},
numeric_notes AS (SELECT segment, feature, abs(z) AS strength FROM numeric_profile WHERE role = 'descriptor'
    QUALIFY row_number() OVER (PARTITION BY segment ORDER BY abs(z) DESC, feature_order) = 1),
level_notes AS (SELECT segment, feature, level, share - overall AS strength FROM categorical_profile WHERE role = 'descriptor'
    QUALIFY row_number() OVER (PARTITION BY segment ORDER BY share - overall DESC, feature_order, level_order) = 1)
SELECT segment, 'numeric' AS kind, feature, CAST(NULL AS VARCHAR) AS level, {r6("strength", "strength")} FROM numeric_notes WHERE strength >= 0.25
UNION ALL SELECT segment, 'level', feature, level, {r6("strength", "strength")} FROM level_notes WHERE strength >= 10"""
ORACLES["anova"] = (
    f"WITH {BASE_CTE}, grouped AS ("
    + union(
        f"SELECT '{n}' AS variable, band, count({n}) AS n, avg({n}) AS m, var_pop({n}) * count({n}) AS w FROM base GROUP BY 2 HAVING count({n}) >= 2"
        for n in NUMERIC
    )
    + f"""), grand AS (SELECT variable, sum(n * m) / sum(n) AS g FROM grouped GROUP BY 1),
sums AS (SELECT variable, count(*) AS k, sum(n) AS n, sum(n * (m - g) ^ 2) AS b, sum(w) AS w FROM grouped JOIN grand USING (variable) GROUP BY 1)
SELECT variable, {r6("(b / (k - 1)) / (w / (n - k))", "f_value", 4)}, k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within,
       {r6("b / (b + w)", "eta_squared")} FROM sums WHERE k >= 2"""
)
ORACLES["segment_map"] = f"""WITH {CONFIDENCE}
SELECT id AS customer_segment, band AS segment, {NAMED("band")} AS segment_name, {r6("round_even(confidence, 4)", "membership_confidence")} FROM sure"""
ORACLES["edited_names"] = f"""WITH {BASE_CTE}, t AS (SELECT nation AS segment, max(urgent_status) AS status, min(market) AS market FROM base GROUP BY 1)
SELECT segment, CASE WHEN status = 'P' THEN lower(market) ELSE segment END AS name FROM t"""
ORACLES["map_sample"] = f"""WITH {BASE_CTE}
SELECT customer_id, {r6("recency_days", "recency_days")}, {r6("monetary_value", "monetary_value")}, band
FROM base ORDER BY md5(CAST(customer_id AS VARCHAR) || '42'), customer_id LIMIT 5000"""
ORACLES["box_stats"] = f"""WITH {BASE_CTE},
q AS (SELECT band, quantile_cont(recency_days, 0.25) AS q1, median(recency_days) AS med, quantile_cont(recency_days, 0.75) AS q3 FROM base GROUP BY 1),
t AS (SELECT band, q1, med, q3, recency_days AS v, recency_days BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM base JOIN q USING (band))
SELECT band AS segment, count(*) FILTER (WHERE NOT inside) AS outliers, {r6("q1", "q1")}, {r6("med", "median")}, {r6("q3", "q3")},
       {r6("min(v) FILTER (WHERE inside)", "lower_whisker")}, {r6("max(v) FILTER (WHERE inside)", "upper_whisker")} FROM t GROUP BY band, q1, med, q3"""

# ----------------------------------------------------------------------------------------------------------- exports

ORACLES["spreadsheet_safe"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(CASE lang WHEN 'en' THEN '  =1+1 ' || text WHEN 'fr' THEN chr(7) || '-' || text ELSE text END,
                  '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS cleaned FROM documents),
s AS (SELECT doc_id, CASE WHEN regexp_matches(cleaned, '^[ \t\r\n]*[=+\-@]') THEN '''' || cleaned ELSE cleaned END AS text FROM t)
SELECT doc_id, CAST(length(text) AS INTEGER) AS length, md5(text) AS digest FROM s"""
ORACLES["fingerprint"] = f"""WITH {BASE_CTE},
t AS (SELECT md5(concat_ws(chr(1), CAST(customer_id AS VARCHAR), CAST(frequency AS VARCHAR), market, coalesce(urgent_status, '␀'), balance_text)) AS d FROM base),
s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(d, 1, 8) AS BIGINT)) AS a, sum(CAST('0x' || substr(d, 9, 8) AS BIGINT)) AS b, min(d) AS lo, max(d) AS hi FROM t)
SELECT n AS customers, sha256(concat_ws('|', CAST(n AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR), lo, hi)) AS fingerprint FROM s"""

ORACLES["csv_round_trip"] = f"""WITH {BASE_CTE}
SELECT customer_id, frequency, {r6("recency_days", "recency_days")}, active, market, urgent_status, balance_text FROM base"""
ORACLES["json_round_trip"] = f"""
SELECT o_orderkey, {r6("o_totalprice", "o_totalprice")}, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority FROM orders"""
ORACLES["result_pack"] = f"""WITH {BASE_CTE}
SELECT 'Customer/segment map' AS "table", 'Customer-segment map' AS folder, count(*) AS rows FROM base
UNION ALL SELECT 'Customer:segment map', 'Customer-segment map_2', count(DISTINCT band) FROM base
UNION ALL SELECT 'Levels of all categorical columns of the pack', substr('Levels of all categorical columns of the pack', 1, 31),
    count(DISTINCT nation) + count(DISTINCT coalesce(urgent_status, 'Missing')) + count(DISTINCT active) FROM base"""
ORACLES["header_names"] = """
SELECT 4 * n_nationkey AS place, n_name AS header FROM nation
UNION ALL SELECT 4 * n_nationkey + 1, n_name || '__2' FROM nation
UNION ALL SELECT 4 * n_nationkey + 2, n_name || '__2__2' FROM nation
UNION ALL SELECT 4 * n_nationkey + 3, 'column_' || CAST(4 * n_nationkey + 4 AS VARCHAR) FROM nation"""

# -------------------------------------------------------------------------------------------- fits: promises to keep

for name in ("kmeans", "gmm", "ward", "spectral", "pca_map", "compare", "icicle"):
    ORACLES[f"{name}_violations"] = "SELECT CAST(0 AS BIGINT) AS violations"
ORACLES["anova_p_values"] = (
    # Five market segments give four degrees of freedom between, for which the F tail has a closed form.
    f"WITH {BASE_CTE}, grouped AS ("
    + union(
        f"SELECT '{n}' AS variable, market, count({n}) AS n, avg({n}) AS m, var_pop({n}) * count({n}) AS w FROM base GROUP BY 2 HAVING count({n}) >= 2"
        for n in NUMERIC
    )
    + f"""), grand AS (SELECT variable, sum(n * m) / sum(n) AS g FROM grouped GROUP BY 1),
sums AS (SELECT variable, sum(n) AS n, sum(n * (m - g) ^ 2) AS b, sum(w) AS w FROM grouped JOIN grand USING (variable) GROUP BY 1),
tail AS (SELECT variable, (n - 5) / 2.0 AS a, w / (w + b) AS x FROM sums)
SELECT variable, {r6("x ^ a * (1 + a * (1 - x))", "p_value")} FROM tail"""
)
ORACLES["json_list"] = f"""
SELECT p_partkey, p_type, {r6("p_retailprice", "a_price")}, 'p_type,p_partkey,a_price' AS key_order FROM part"""
ORACLES["json_named_lists"] = """
SELECT t AS "table", CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region, (VALUES ('again'), ('suppliers')) v(t)"""
ORACLES["json_one_record"] = """
SELECT count(*) AS orders, max(o_orderpriority) AS "last", min(o_orderkey) AS "first" FROM orders"""
ORACLES["json_columns"] = "SELECT CAST(s_suppkey AS BIGINT) AS key, s_name AS name FROM supplier"
ORACLES["csv_semicolon_multiline"] = f"""
SELECT c_custkey, 'said; "' || c_mktsegment || '"' || chr(10) || 'and left ' || c_name AS note, {r6("c_acctbal", "balance")} FROM customer"""
ORACLES["folder_of_tables"] = """
SELECT 'nation' AS "table", count(*) AS "rows", CAST((SELECT count(*) FROM (DESCRIBE nation)) AS BIGINT) AS "columns" FROM nation
UNION ALL SELECT 'supplier', count(*), 2 FROM supplier
UNION ALL SELECT 'customer', count(*), CAST((SELECT count(*) FROM (DESCRIBE customer)) AS BIGINT) FROM customer"""
ORACLES["date_formats"] = orders_rollup(
    "SELECT o_custkey AS customer_id, o_orderkey AS order_id, epoch_us(date_trunc('day', o_orderdate)) AS micros, o_totalprice AS amount FROM orders"
)


# -------------------------------------------------------------------------------------------------- exact small fits


def ward_steps(points: str, leaves: int) -> str:
    """CTEs ``p0`` ... (merges) and ``s0`` ... (groups after each): the cheapest pair over and over."""
    parts = [
        f"""s0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY f0, f1, f2) - 1 AS BIGINT) AS node, 1 AS n, f0, f1, f2, [id] AS ids,
            row_number() OVER (ORDER BY f0, f1, f2) AS first FROM {points})"""
    ]
    mean = ", ".join(f"(a.n * a.f{d} + b.n * b.f{d}) / (a.n + b.n) AS f{d}" for d in range(3))
    gap = " + ".join(f"(a.f{d} - b.f{d}) ^ 2" for d in range(3))
    for i in range(leaves - 1):
        parts.append(
            f"""p{i} AS MATERIALIZED (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, {mean}, list_concat(a.ids, b.ids) AS ids, least(a.first, b.first) AS first,
            a.n * b.n / (a.n + b.n) * ({gap}) AS cost FROM s{i} a JOIN s{i} b ON a.node < b.node ORDER BY cost LIMIT 1)"""
        )
        parts.append(
            f"""s{i + 1} AS MATERIALIZED (SELECT s.* FROM s{i} s, p{i} p WHERE s.node NOT IN (p.a, p.b)
            UNION ALL SELECT {leaves + i}, na + nb, f0, f1, f2, ids, first FROM p{i})"""
        )
    return ",\n".join(parts)


NATIONS = 25
WARD_CTE = f"WITH {NATION_CTE},\n{ward_steps('places', NATIONS)}"
MERGES = union(
    f"SELECT {i} AS step, a, b, na, nb, cost FROM p{i}" for i in range(NATIONS - 1)
)
ORACLES["nation_merges"] = f"""{WARD_CTE}, merges AS ({MERGES})
SELECT CAST(step AS INTEGER) AS step, CAST(a AS VARCHAR) AS "left", CAST(b AS VARCHAR) AS "right", CAST(na AS BIGINT) AS left_customers,
       CAST(nb AS BIGINT) AS right_customers, {r6("sqrt(2 * cost)", "height")}, CAST(na + nb AS BIGINT) AS customers FROM merges"""
ORACLES["nation_icicle"] = f"""{WARD_CTE}, merges AS (SELECT * FROM ({MERGES}) WHERE step >= {NATIONS - 1 - 7}),
nodes AS (SELECT {2 * NATIONS - 2} AS id, '' AS parent, na + nb AS n FROM merges WHERE step = {NATIONS - 2}
          UNION ALL SELECT a, CAST({NATIONS} + step AS VARCHAR), na FROM merges UNION ALL SELECT b, CAST({NATIONS} + step AS VARCHAR), nb FROM merges)
SELECT CAST(id AS VARCHAR) AS id, parent, CAST(n AS BIGINT) AS customers, {r6(f"100.0 * n / {NATIONS}", "share_%")},
       CAST(n AS VARCHAR) || ' customers · ' || CAST(CAST(round(100.0 * n / {NATIONS}) AS BIGINT) AS VARCHAR) || '%' AS label FROM nodes"""
ORACLES["nation_segments"] = f"""{WARD_CTE},
named AS (SELECT 'Segment ' || CAST(row_number() OVER (ORDER BY n DESC, first) AS VARCHAR) AS segment, unnest(ids) AS id FROM s{NATIONS - 4}),
held AS (SELECT segment, p.* FROM named JOIN places p USING (id)),
centres AS (SELECT segment, avg(f0) AS c0, avg(f1) AS c1, avg(f2) AS c2 FROM held GROUP BY 1),
away AS (SELECT h.id, h.segment, c.segment = h.segment AS own, sqrt((f0 - c0) ^ 2 + (f1 - c1) ^ 2 + (f2 - c2) ^ 2) AS d FROM held h, centres c)
SELECT CAST(id AS BIGINT) AS id, segment,
       {r6("min(d) FILTER (NOT own) / (min(d) FILTER (own) + min(d) FILTER (NOT own) + 1e-12)", "confidence")} FROM away GROUP BY 1, 2"""
# The best partition of a line is one into intervals: all pairs of cuts are tried, with costs from running sums.
ORACLES["kmeans_line"] = f"""WITH {BASE_CTE},
{numeric_steps({"average_order_value": "CAST(average_order_value AS DOUBLE)"})},
line AS MATERIALIZED (SELECT average_order_value AS x, row_number() OVER w AS i, sum(average_order_value) OVER w AS s, sum(average_order_value ^ 2) OVER w AS q
         FROM scaled WINDOW w AS (ORDER BY average_order_value, customer_id)),
ends AS (SELECT * FROM line WHERE i = (SELECT max(i) FROM line)),
best AS (SELECT a.i AS i, b.i AS j FROM line a, line b, ends e WHERE a.i < b.i AND b.i < e.i
         ORDER BY a.q - a.s ^ 2 / a.i + (b.q - a.q) - (b.s - a.s) ^ 2 / (b.i - a.i) + (e.q - b.q) - (e.s - b.s) ^ 2 / (e.i - b.i) LIMIT 1),
parts AS (SELECT x, CASE WHEN line.i <= best.i THEN 0 WHEN line.i <= best.j THEN 1 ELSE 2 END AS part FROM line, best),
sums AS (SELECT count(*) AS customers, min(x) AS low, max(x) AS high, var_pop(x) * count(*) AS cost FROM parts GROUP BY part)
SELECT 'Segment ' || CAST(row_number() OVER (ORDER BY customers DESC) AS VARCHAR) AS segment, customers, {r6("low", "low")}, {r6("high", "high")}, {r6("cost", "cost")} FROM sums"""
ORACLES["subsample_sizes"] = """
WITH drawn AS (SELECT count(*) AS n, least(count(*) - 1, CAST(round_even(0.8 * count(*), 0) AS BIGINT)) AS m FROM customer)
SELECT n AS customers, m AS drawn_0, m AS drawn_1, m AS drawn_2, true AS differ FROM drawn"""
ORACLES["rfm_merged_slices"] = ORACLES["rfm_order_rollup"]
