"""SQL equivalents of the registered queries, for an independent engine."""

from __future__ import annotations

from tidemark.functions.calendar import MONTH_LABELS, RATE_CAPS, UF_VALUES
from tidemark.operators.eda import WEEKDAYS
from tidemark.plans.rounds import ROUNDS
from tidemark.schema import APPLICATIONS, QUALITY_FLAGS, feature_columns

APPLICATIONS_CTE = """
WITH li AS (
  SELECT l_orderkey,
         CAST(COUNT(*) AS INT) AS n_items,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS n_r,
         CAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS INT) AS n_a,
         CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS INT) AS n_o,
         CAST(SUM(CAST(ROUND(l_discount * 100) AS INT)) AS INT) AS disc_pts,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS ext
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderpriority,
         c.c_mktsegment, c.c_acctbal, r.r_name,
         li.n_items, li.n_r, li.n_a, li.n_o, li.disc_pts, li.ext,
         CASE WHEN li.n_r >= 2 AND 2 * li.n_r > li.n_items THEN 1 ELSE 0 END AS dflt
  FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  JOIN li ON li.l_orderkey = o.o_orderkey),
applications AS (
SELECT o_orderkey AS id_solicitud,
       DATE '2024-01-01' + CAST(o_orderkey % 530 AS INT) AS fecha_solicitud,
       CAST(15 + (o_custkey * 37) % 92 AS INT) AS edad,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'independiente' WHEN 'FURNITURE' THEN 'informal'
            WHEN 'HOUSEHOLD' THEN 'jubilado' ELSE 'dependiente' END AS tipo_empleo,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE ROUND(c_acctbal * 1000) END AS ingreso_declarado,
       CASE WHEN c_mktsegment IN ('FURNITURE','HOUSEHOLD') THEN NULL
            ELSE CAST(o_custkey % 240 AS DOUBLE) END AS antiguedad_laboral_meses,
       r_name AS region,
       CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'digital'
            WHEN o_orderpriority = '5-LOW' THEN 'partner' ELSE 'sucursal' END AS canal,
       CAST((o_custkey * 13) % 120 AS INT) AS antiguedad_cliente_meses,
       CAST(GREATEST(300, 850 - 60 * n_r - o_orderkey % 197) AS INT) AS score_buro,
       ext AS deuda_sistema,
       n_items AS num_creditos_vigentes,
       CAST((30 * n_o) % 120 AS INT) AS peor_morosidad_12m,
       CAST(dflt * 5 + o_orderkey % 3 AS INT) AS num_contactos_ult_trimestre,
       n_a AS num_consultas_buro_3m,
       CAST(disc_pts * 10 AS DOUBLE) / n_items AS uso_linea_credito_pct,
       ROUND(o_totalprice * 20) AS monto_solicitado,
       CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 6 WHEN 1 THEN 12 WHEN 2 THEN 18
            WHEN 3 THEN 24 WHEN 4 THEN 36 ELSE 48 END AS plazo_meses,
       CAST(1800 + (o_orderkey * 31) % 2500 AS DOUBLE) / 100 AS tasa_interes_anual,
       CASE CAST(o_custkey % 7 AS INT) WHEN 0 THEN 'lunes' WHEN 1 THEN 'martes' WHEN 2 THEN 'miercoles'
            WHEN 3 THEN 'jueves' WHEN 4 THEN 'viernes' WHEN 5 THEN 'sabado' ELSE 'domingo' END AS dia_semana_solicitud,
       dflt AS default_12m
FROM base),
train AS (SELECT * FROM applications WHERE fecha_solicitud < DATE '2025-01-01'),
scored AS (SELECT *, CAST(LEAST(900, GREATEST(5, 850 - score_buro)) AS DOUBLE) / 1000 AS p_default
           FROM applications),
priced AS (
  SELECT *, monto_solicitado * 0.12 * (CAST(plazo_meses AS DOUBLE) / 12) * 0.5 AS ganancia_si_paga,
         monto_solicitado * 0.55 AS perdida_si_default FROM scored),
decided AS (
  SELECT *, ganancia_si_paga / NULLIF(ganancia_si_paga + perdida_si_default, 0) AS p_umbral,
         COALESCE(p_default < ganancia_si_paga / NULLIF(ganancia_si_paga + perdida_si_default, 0), FALSE) AS aprobar,
         CASE WHEN default_12m = 1 THEN -perdida_si_default ELSE ganancia_si_paga END AS valor_todo
  FROM priced)"""

LABELLED = "fecha_solicitud < DATE '2025-02-15'"
TEST = "fecha_solicitud >= DATE '2025-02-15'"
WINDOW_CASE = """CASE WHEN fecha_solicitud < DATE '2025-01-01' THEN 'train'
    WHEN fecha_solicitud < DATE '2025-02-15' THEN 'valid' ELSE 'test' END"""
NUMERIC = ["score_buro", "tasa_interes_anual", "num_consultas_buro_3m", "uso_linea_credito_pct",
           "edad", "deuda_sistema", "num_contactos_ult_trimestre", "ingreso_declarado", "antiguedad_laboral_meses",
           "antiguedad_cliente_meses", "num_creditos_vigentes", "peor_morosidad_12m",
           "monto_solicitado", "plazo_meses"]
CATEGORICAL = ["tipo_empleo", "region", "canal"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
EMPLOYMENT = ["dependiente", "independiente", "informal", "jubilado"]
CHANNELS = ["digital", "partner", "sucursal"]


def over(body: str, *ctes: str) -> str:
    return APPLICATIONS_CTE + "".join(f",\n{c}" for c in ctes) + "\n" + body


# --- shared pieces ----------------------------------------------------------

def _values(rows) -> str:
    return ", ".join("(DATE '%s', %s)" % (row[0], ", ".join(f"CAST({v!r} AS DOUBLE)" for v in row[1:]))
                     for row in rows)


_CAP_KNOTS = f"""caps AS (
  SELECT d AS d0, LEAD(d) OVER (ORDER BY d) AS d1,
         a AS a0, LEAD(a) OVER (ORDER BY d) AS a1, b AS b0, LEAD(b) OVER (ORDER BY d) AS b1,
         c AS c0, LEAD(c) OVER (ORDER BY d) AS c1
  FROM (VALUES {_values(RATE_CAPS)}) AS t(d, a, b, c))"""
_UF_KNOTS = f"""ufs AS (
  SELECT d AS d0, LEAD(d) OVER (ORDER BY d) AS d1, v AS v0, LEAD(v) OVER (ORDER BY d) AS v1
  FROM (VALUES {_values(UF_VALUES)}) AS t(d, v))"""


def _line(low: str, high: str, table: str, day: str) -> str:
    return (f"CASE WHEN {table}.d1 IS NULL THEN {table}.{low} ELSE ({table}.{high} - {table}.{low}) "
            f"/ ({table}.d1 - {table}.d0) * ({day} - {table}.d0) + {table}.{low} END")


def _capped(step: bool = False) -> list[str]:
    """CTEs ending in ``capped``: applications with ``uf`` and ``tope_tasa``."""
    first_cap, first_uf = RATE_CAPS[0][0], UF_VALUES[0][0]
    bands = [f"caps.{k}0" if step else _line(f"{k}0", f"{k}1", "caps", "cap_day") for k in "abc"]
    return [_CAP_KNOTS, _UF_KNOTS, f"""capped AS (
      SELECT s.*, CASE WHEN monto_solicitado / uf <= 50 THEN {bands[0]}
                       WHEN monto_solicitado / uf <= 200 THEN {bands[1]} ELSE {bands[2]} END AS tope_tasa
      FROM (SELECT x.*, {_line("v0", "v1", "ufs", "uf_day")} AS uf
            FROM (SELECT *, GREATEST(fecha_solicitud, DATE '{first_cap}') AS cap_day,
                         GREATEST(fecha_solicitud, DATE '{first_uf}') AS uf_day FROM applications) x
            JOIN ufs ON uf_day >= ufs.d0 AND (ufs.d1 IS NULL OR uf_day < ufs.d1)) s
      JOIN caps ON cap_day >= caps.d0 AND (caps.d1 IS NULL OR cap_day < caps.d1))"""]


def _certificates() -> list[str]:
    """CTEs ``banded``, the applications with their amount band, and ``certs``, the caps by band and validity."""
    rows = ", ".join(f"(DATE '{day}', {a}, {b}, {c})" for day, a, b, c in RATE_CAPS)
    return [*_capped(), """banded AS (SELECT id_solicitud, fecha_solicitud, CASE WHEN monto_solicitado / uf <= 50 THEN 'hasta_50'
        WHEN monto_solicitado / uf <= 200 THEN 'hasta_200' ELSE 'sobre_200' END AS banda FROM capped)""",
            f"""dated AS (SELECT UNNEST(['hasta_50', 'hasta_200', 'sobre_200']) AS banda, vigente_desde,
        CAST(UNNEST([a, b, c]) AS DOUBLE) AS tope FROM (VALUES {rows}) t(vigente_desde, a, b, c))""",
            """certs AS (SELECT *, LEAD(vigente_desde) OVER (PARTITION BY banda ORDER BY vigente_desde) AS vigente_hasta FROM dated)"""]


AGE_FILL = "(SELECT MEDIAN(edad) FROM train WHERE edad BETWEEN 18 AND 100)"
BAD_AGE = "(edad < 18 OR edad > 100)"


def _quantile(values: str, n: str, p: str) -> str:
    """Linear interpolation from the nearer end, in an ordered list."""
    position = f"({p} * ({n} - 1))"
    low = f"{values}[CAST(FLOOR({position}) AS BIGINT) + 1]"
    high = f"{values}[LEAST(CAST(FLOOR({position}) AS BIGINT) + 2, {n})]"
    part = f"({position} - FLOOR({position}))"
    return (f"CASE WHEN {part} >= 0.5 THEN {high} - ({high} - {low}) * (1.0 - {part}) "
            f"ELSE {low} + ({high} - {low}) * {part} END")


def _metrics(source: str, keys: str = "", name: str = "m") -> list[str]:
    """CTEs ending in ``name``: every metric of ``source(keys, p_default, default_12m)``."""
    group = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return [
        f"""{name}_scores AS (SELECT {group}p_default AS p, SUM(default_12m) AS pos, SUM(1 - default_12m) AS neg
            FROM {source} GROUP BY {group}p_default)""",
        f"""{name}_curve AS (SELECT *, CAST(SUM(pos) OVER ({part} ORDER BY p DESC) AS DOUBLE) AS cp,
            CAST(SUM(neg) OVER ({part} ORDER BY p DESC) AS DOUBLE) AS cn,
            CAST(SUM(pos) OVER ({part}) AS DOUBLE) AS tp, CAST(SUM(neg) OVER ({part}) AS DOUBLE) AS tn
            FROM {name}_scores)""",
        f"""{name} AS (SELECT {group}
            SUM(neg * (cp - pos / 2.0)) / (MAX(tp) * MAX(tn)) AS auc,
            2 * (SUM(neg * (cp - pos / 2.0)) / (MAX(tp) * MAX(tn))) - 1 AS gini,
            MAX(ABS(cp / tp - cn / tn)) AS ks,
            SUM(pos * cp / (cp + cn)) / MAX(tp) AS pr_auc,
            SUM(pos * (p - 1) * (p - 1) + neg * p * p) / CAST(SUM(pos + neg) AS DOUBLE) AS brier,
            CAST(SUM(pos + neg) AS BIGINT) AS n, CAST(SUM(pos) AS BIGINT) AS n_pos,
            CAST(SUM(pos) AS DOUBLE) / CAST(SUM(pos + neg) AS DOUBLE) AS default_rate
            FROM {name}_curve {f"GROUP BY {keys}" if keys else ""})""",
    ]


def _round(columns: dict[str, int], *plain: str) -> str:
    return ", ".join([*plain, *[f"ROUND({c}, {d}) AS {c}" for c, d in columns.items()]])


METRIC_COLUMNS = {c: 9 for c in ("auc", "gini", "ks", "pr_auc", "brier", "default_rate")}


def _deciles(source: str, name: str = "deciles") -> list[str]:
    """CTEs ending in ``name``: the decile table of ``source``."""
    edges = ", ".join(_quantile("v", "n", f"(CAST({i} AS DOUBLE) / 10)") for i in range(11))
    return [
        f"""{name}_edges AS (SELECT list_distinct([{edges}]) AS edges
            FROM (SELECT LIST(p_default ORDER BY p_default) AS v, COUNT(*) AS n FROM {source}))""",
        f"""{name} AS (SELECT CAST(GREATEST(1, (SELECT len(list_filter(edges, lambda e: e < s.p_default))
                     FROM {name}_edges)) AS INT) AS decile,
            COUNT(*) AS n, AVG(p_default) AS avg_pred, AVG(CAST(default_12m AS DOUBLE)) AS default_rate
            FROM {source} s GROUP BY 1)"""]


def _high(source: str, floor: bool = True) -> str:
    q = _quantile("v", "n", "CAST(0.995 AS DOUBLE)")
    body = f"LEAST(1.0, {q})"
    body = f"GREATEST({body}, 0.05)" if floor else body
    return f"(SELECT {body} FROM (SELECT LIST(p_default ORDER BY p_default) AS v, COUNT(*) AS n FROM {source}))"


def _hist(source: str, high: str, name: str = "hist") -> list[str]:
    """CTEs ending in ``name``: bin 1..30 and 31 for scores above, per class."""
    return [
        f"{name}_hi AS (SELECT CAST({high} AS DOUBLE) AS hi)",
        f"""{name}_guess AS (SELECT p_default AS p, default_12m AS y, hi, hi / CAST(30 AS DOUBLE) AS w,
            LEAST(CAST(FLOOR(p_default * CAST(30 AS DOUBLE) / hi) AS INT), 29) AS g
            FROM {source}, {name}_hi WHERE p_default >= 0)""",
        f"""{name}_low AS (SELECT *, g - CASE WHEN p < g * w THEN 1 ELSE 0 END AS l FROM {name}_guess)""",
        f"""{name}_bins AS (SELECT CASE WHEN p > hi THEN 31 ELSE 1 + l
              + CASE WHEN p >= (g + 1) * w AND g < 29 THEN 1 ELSE 0 END END AS bin, y FROM {name}_low)""",
        f"""{name} AS (SELECT CAST(i AS INT) AS bin, (i - 1) * (hi / CAST(30 AS DOUBLE)) AS edge_lo,
            CASE WHEN i <= 30 THEN i * (hi / CAST(30 AS DOUBLE)) END AS edge_hi,
            COUNT(y) AS n, COUNT(CASE WHEN y = 1 THEN 1 END) AS n_default,
            COUNT(CASE WHEN y = 0 THEN 1 END) AS n_no_default
            FROM {name}_hi CROSS JOIN range(1, 32) AS r(i) LEFT JOIN {name}_bins b ON b.bin = i GROUP BY i, hi)"""]


_PROXIES = """SELECT default_12m, 0 AS posicion, 'base' AS arquitectura, NULL AS ratio, FALSE AS balanceado, p_default
    FROM scored
  UNION ALL SELECT default_12m, 1, 'base', 0.5, TRUE, SQRT(p_default) FROM scored
  UNION ALL SELECT default_12m, 2, 'consultas', NULL, FALSE,
    LEAST(1.0, p_default + CAST(0.02 AS DOUBLE) * CAST(num_consultas_buro_3m AS DOUBLE)) FROM scored
  UNION ALL SELECT default_12m, 3, 'consultas', 0.5, FALSE,
    LEAST(1.0, p_default + CAST(0.02 AS DOUBLE) * CAST(num_consultas_buro_3m AS DOUBLE)
          + CAST(0.001 AS DOUBLE) * CAST(peor_morosidad_12m AS DOUBLE)) FROM scored"""
_CANDIDATES = [f"proxies AS ({_PROXIES})", *_metrics("proxies", "posicion, arquitectura, balanceado, ratio")]

_ROUND_WINDOWS = """SELECT 'ronda_1' AS ronda, DATE '2025-01-01' AS desde, DATE '2025-02-15' AS hasta
  UNION ALL SELECT 'ronda_2', DATE '2025-01-01', DATE '2025-02-15'
  UNION ALL SELECT 'ronda_3', DATE '2025-01-01', DATE '2025-02-15'
  UNION ALL SELECT 'ronda_4', DATE '2025-01-01', DATE '2025-02-15'
  UNION ALL SELECT 'ronda_5', DATE '2024-07-01', DATE '2025-01-01'
  UNION ALL SELECT 'ronda_6', DATE '2025-01-01', DATE '2025-02-15'"""
_BY_ROUND = f"""by_round AS (
  SELECT w.ronda, m.modelo, d.default_12m, d.ganancia_si_paga, d.perdida_si_default, d.p_umbral, d.valor_todo,
         CASE m.modelo WHEN 'base' THEN d.p_default ELSE
           LEAST(1.0, d.p_default + CAST(0.02 AS DOUBLE) * CAST(d.num_consultas_buro_3m AS DOUBLE)) END AS p_default
  FROM decided d JOIN ({_ROUND_WINDOWS}) w ON d.fecha_solicitud >= w.desde AND d.fecha_solicitud < w.hasta
  CROSS JOIN (SELECT 'base' AS modelo UNION ALL SELECT 'consultas') m)"""


def _policy(source: str, keys: str = "") -> str:
    group = f"{keys}, " if keys else ""
    return f"""SELECT {group}COUNT(*) AS n, COUNT(CASE WHEN aprobar THEN 1 END) AS n_aprob,
        AVG(CASE WHEN aprobar THEN 1.0 ELSE 0.0 END) AS pct_aprob,
        SUM(CASE WHEN aprobar THEN valor_todo ELSE 0.0 END) AS ganancia_politica,
        SUM(valor_todo) AS ganancia_aprobar_todo,
        SUM(CASE WHEN NOT aprobar AND default_12m = 1 THEN perdida_si_default ELSE 0.0 END) AS perdida_evitada
        FROM {source} {f"GROUP BY {keys}" if keys else ""}"""


def _gain_curve(source: str) -> str:
    return f"""SELECT CAST(i * 2 AS DOUBLE) / 100 AS threshold,
        SUM(CASE WHEN p_default < CAST(i * 2 AS DOUBLE) / 100 THEN valor_todo ELSE 0.0 END) AS gain,
        AVG(CASE WHEN p_default < CAST(i * 2 AS DOUBLE) / 100 THEN 1.0 ELSE 0.0 END) AS pct_approved
        FROM {source} CROSS JOIN range(1, 28) AS r(i) GROUP BY i"""


def _breakdown(source: str) -> str:
    return f"""SELECT aprobar, default_12m, COUNT(*) AS n,
        SUM(CASE WHEN default_12m = 1 THEN perdida_si_default ELSE ganancia_si_paga END) AS monto,
        CASE WHEN NOT aprobar AND default_12m = 1 THEN 'perdida_evitada' WHEN NOT aprobar THEN 'costo_oportunidad'
             WHEN default_12m = 1 THEN 'perdida_no_detectada' ELSE 'ganancia_capturada' END AS concepto
        FROM {source} GROUP BY aprobar, default_12m"""


def _expected(source: str) -> str:
    ev = "(1 - p_default) * ganancia_si_paga - p_default * perdida_si_default"
    return f"""SELECT COUNT(*) AS n_test, COUNT(CASE WHEN aprobar THEN 1 END) AS n_aprob_test,
        SUM(CASE WHEN aprobar THEN {ev} ELSE 0.0 END) AS ganancia_esperada_politica,
        SUM({ev}) AS ganancia_esperada_aprobar_todo FROM {source}"""


_THRESHOLDS = """SELECT plazo_meses, (1000000.0 * 0.12 * (CAST(plazo_meses AS DOUBLE) / 12) * 0.5)
    / (1000000.0 * 0.12 * (CAST(plazo_meses AS DOUBLE) / 12) * 0.5 + 1000000.0 * 0.55) AS p_umbral
    FROM (SELECT DISTINCT plazo_meses FROM applications)"""


def _melt(source: str, table: str, key: str, values: dict[str, int]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS tabla, {key} AS clave, '{v}' AS medida, ROUND(CAST({v} AS DOUBLE), {d}) AS valor "
        f"FROM {source}" for v, d in values.items())


# --- association ------------------------------------------------------------

def _stack(columns, kind, keep="default_12m", source="applications") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS {kind}) AS valor, {keep} FROM {source}" for c in columns)


def _numeric_bins(columns=NUMERIC) -> list[str]:
    edges = ", ".join(_quantile("v", "n", f"(CAST({i} AS DOUBLE) / 10)") for i in range(11))
    return [
        f"long_num AS ({_stack(columns, 'DOUBLE')})",
        f"""num_edges AS (SELECT variable, list_distinct([{edges}]) AS edges
            FROM (SELECT variable, LIST(valor ORDER BY valor) AS v, COUNT(*) AS n
                  FROM long_num WHERE valor IS NOT NULL GROUP BY variable))""",
        """num_bins AS (SELECT l.variable, CASE WHEN valor IS NULL THEN '0' ELSE
              CAST(GREATEST(1, len(list_filter(edges, lambda e: e < l.valor))) AS VARCHAR) END AS grupo, default_12m
            FROM long_num l JOIN num_edges e ON e.variable = l.variable)"""]


def _bins(numeric=(), categorical=()) -> list[str]:
    """CTEs ending in ``bins`` (variable, grupo, buenos, malos) and ``totals``."""
    sources = (["SELECT * FROM num_bins"] if numeric else []) + (
        ["SELECT variable, COALESCE(valor, 'nulo') AS grupo, default_12m FROM long_cat"] if categorical else [])
    return (_numeric_bins(numeric) if numeric else []) + (
        [f"long_cat AS ({_stack(categorical, 'VARCHAR')})"] if categorical else []) + [
        f"""bins AS (SELECT variable, grupo, CAST(COUNT(CASE WHEN default_12m = 0 THEN 1 END) AS DOUBLE) AS buenos,
            CAST(COUNT(CASE WHEN default_12m = 1 THEN 1 END) AS DOUBLE) AS malos
            FROM ({" UNION ALL ".join(sources)}) GROUP BY variable, grupo)""",
        """totals AS (SELECT variable, SUM(buenos) AS tb, SUM(malos) AS tm, COUNT(*) AS k FROM bins GROUP BY variable)""",
        """iv AS (SELECT b.variable, SUM(((buenos + 0.5) / (tb + 0.5 * k) - (malos + 0.5) / (tm + 0.5 * k))
              * LN(((buenos + 0.5) / (tb + 0.5 * k)) / ((malos + 0.5) / (tm + 0.5 * k)))) AS iv
            FROM bins b JOIN totals t ON t.variable = b.variable GROUP BY b.variable)""",
        """chi AS (SELECT b.variable, CAST(SUM(buenos + malos) AS BIGINT) AS n,
              SUM(POW(buenos - (buenos + malos) * tb / (tb + tm), 2) / ((buenos + malos) * tb / (tb + tm))
                + POW(malos - (buenos + malos) * tm / (tb + tm), 2) / ((buenos + malos) * tm / (tb + tm))) AS chi2,
              CAST(COUNT(*) - 1 AS BIGINT) AS gl
            FROM bins b JOIN totals t ON t.variable = b.variable GROUP BY b.variable)"""]


def _anova(source: str, group: str) -> list[str]:
    """CTEs ending in ``anova`` over ``source(variable, valor, group)``."""
    return [
        f"""groups AS (SELECT variable, {group} AS g, COUNT(*) AS n, AVG(valor) AS m,
            VAR_POP(valor) * COUNT(*) AS w FROM {source} WHERE valor IS NOT NULL GROUP BY variable, {group})""",
        "grand AS (SELECT variable, SUM(n * m) / SUM(n) AS m FROM groups GROUP BY variable)",
        """anova AS (SELECT g.variable, CAST(SUM(n) AS BIGINT) AS n, CAST(COUNT(*) - 1 AS BIGINT) AS gl_entre,
              CAST(SUM(n) - COUNT(*) AS BIGINT) AS gl_dentro,
              (SUM(n * POW(g.m - t.m, 2)) / (COUNT(*) - 1)) / (SUM(w) / (SUM(n) - COUNT(*))) AS f
            FROM groups g JOIN grand t ON t.variable = g.variable GROUP BY g.variable)"""]


def _pairs(columns) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def _correlations(columns, source="applications", column="{}") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, ROUND(CORR({column.format(a)}, {column.format(b)}), 9) AS r FROM {source}"
        for a, b in _pairs(columns))


def _null_profile() -> str:
    outside = {"edad": BAD_AGE, "ingreso_declarado": "ingreso_declarado <= 200000",
               "tasa_interes_anual": "tasa_interes_anual > tope_tasa"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, COUNT(*) AS n, COUNT(CASE WHEN {c} IS NULL THEN 1 END) AS n_nulos, "
        f"ROUND(CAST(COUNT(CASE WHEN {c} IS NULL THEN 1 END) AS DOUBLE) / COUNT(*), 9) AS pct_nulos, "
        f"COUNT(CASE WHEN {outside.get(c, 'FALSE')} THEN 1 END) AS n_fuera_rango FROM capped"
        for c in APPLICATIONS.names)


_KNN = ["ingreso_declarado", "antiguedad_laboral_meses", "edad", "score_buro", "monto_solicitado",
        "antiguedad_cliente_meses"]


def _knn_fill(target: str) -> str:
    """Mean of the ten nearest donors; equal distances in order of value."""
    shared = " + ".join(f"CASE WHEN r.{c} IS NULL OR d.{c} IS NULL THEN 0 ELSE 1 END" for c in _KNN)
    squares = " + ".join(f"COALESCE(POW(CAST(r.{c} AS DOUBLE) - CAST(d.{c} AS DOUBLE), 2), 0)" for c in _KNN)
    return f"""SELECT id, AVG(v) AS media FROM (
        SELECT r.id_solicitud AS id, d.{target} AS v, ROW_NUMBER() OVER (
            PARTITION BY r.id_solicitud ORDER BY ({squares}) * (6.0 / ({shared})), d.{target}) AS k
        FROM applications r JOIN applications d ON r.{target} IS NULL AND d.{target} IS NOT NULL)
        WHERE k <= 10 GROUP BY id"""


def _recipe(income: str, tenure: str, joins: str = "") -> str:
    return f"""SELECT a.id_solicitud, ROUND({income}, 6) AS ingreso_declarado,
        ROUND({tenure}, 6) AS antiguedad_laboral_meses,
        CASE WHEN a.ingreso_declarado IS NULL THEN 1 ELSE 0 END AS ingreso_declarado_isnull,
        CASE WHEN a.antiguedad_laboral_meses IS NULL THEN 1 ELSE 0 END AS antiguedad_laboral_meses_isnull
        FROM applications a {joins}"""


# --- features ---------------------------------------------------------------

_LABELS = {"tipo_empleo": EMPLOYMENT, "region": REGIONS, "canal": CHANNELS}
_FEATURES = ["flag_ingreso_declarado_nulo_original", "flag_antiguedad_laboral_nulo", "log_ingreso_declarado",
             "antiguedad_laboral_meses", "log_deuda_sistema", "log_monto_solicitado", "edad",
             "antiguedad_cliente_meses", "score_buro", "num_creditos_vigentes", "peor_morosidad_12m",
             "num_consultas_buro_3m", "uso_linea_credito_pct", "plazo_meses", "tasa_interes_anual", *QUALITY_FLAGS]


def _cleaned() -> list[str]:
    """CTEs ending in ``limpio``: applications with the three corrections."""
    return _capped() + [f"""limpio AS (
      SELECT * REPLACE (CASE WHEN {BAD_AGE} THEN {AGE_FILL} ELSE CAST(edad AS DOUBLE) END AS edad,
                        CASE WHEN ingreso_declarado <= 200000 THEN NULL ELSE ingreso_declarado END AS ingreso_declarado,
                        CASE WHEN tasa_interes_anual > tope_tasa THEN tope_tasa ELSE tasa_interes_anual END AS tasa_interes_anual),
             CASE WHEN {BAD_AGE} THEN 1 ELSE 0 END AS flag_edad_inconsistente,
             CASE WHEN ingreso_declarado <= 200000 THEN 1 ELSE 0 END AS flag_ingreso_inconsistente,
             CASE WHEN tasa_interes_anual > tope_tasa THEN 1 ELSE 0 END AS flag_tasa_corregida
      FROM capped)"""]


def _assembled() -> str:
    plain = _FEATURES[6:]
    slots = [("flag_ingreso_declarado_nulo_original", "CASE WHEN ingreso_declarado IS NULL THEN 1 ELSE 0 END"),
             ("flag_antiguedad_laboral_nulo", "CASE WHEN antiguedad_laboral_meses IS NULL THEN 1 ELSE 0 END"),
             ("log_ingreso_declarado", "LN(1 + COALESCE(ingreso_declarado, gm, om))"),
             ("antiguedad_laboral_meses", "COALESCE(antiguedad_laboral_meses, 0)"),
             ("log_deuda_sistema", "LN(1 + deuda_sistema)"), ("log_monto_solicitado", "LN(1 + monto_solicitado)"),
             *[(c, c) for c in plain],
             *[(f"{c}_{v}", f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END") for c, vs in _LABELS.items() for v in vs]]
    listed = ", ".join(f"{{'feature': '{n}', 'valor': CAST({e} AS DOUBLE)}}" for n, e in slots)
    return over("SELECT id_solicitud, s.feature AS feature, ROUND(s.valor, 6) AS valor FROM wide", *_cleaned(),
                "ajuste AS (SELECT * FROM limpio WHERE fecha_solicitud < DATE '2025-01-01')",
                "gms AS (SELECT tipo_empleo AS te, MEDIAN(ingreso_declarado) AS gm FROM ajuste GROUP BY tipo_empleo)",
                f"""wide AS (SELECT id_solicitud, UNNEST([{listed}]) AS s
                FROM limpio LEFT JOIN gms ON te = tipo_empleo
                CROSS JOIN (SELECT MEDIAN(ingreso_declarado) AS om FROM ajuste))""")


def _feature_names() -> str:
    fixed = " UNION ALL ".join(f"SELECT {i} AS grupo, '' AS label, '{n}' AS feature" for i, n in enumerate(_FEATURES))
    labels = " UNION ALL ".join(
        f"SELECT DISTINCT {100 + i} AS grupo, {c} AS label, '{c}_' || {c} AS feature FROM train"
        for i, c in enumerate(CATEGORICAL))
    return over(f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY grupo, label) - 1 AS INT) AS posicion, feature
        FROM ({fixed} UNION ALL {labels})""")


def _spearman(columns) -> str:
    ranks = ", ".join(
        f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS k_{c}" for c in columns)
    return over(_correlations(columns, "ranks", "k_{}"), f"complete AS (SELECT * FROM applications WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)})",
                f"ranks AS (SELECT {ranks} FROM complete)")


def _vif(columns) -> str:
    """Diagonal of the inverse correlation matrix, by sweeping out one column at a time."""
    k = range(len(columns))

    def at(i, j):
        return f"m{min(i, j)}_{max(i, j)}"
    upper = [(i, j) for i in k for j in k if i <= j]
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    steps = ["s0 AS (SELECT " + ", ".join(
        f"{'1.0::DOUBLE' if i == j else f'CORR({columns[i]}, {columns[j]})'} AS {at(i, j)}" for i, j in upper)
        + f" FROM applications WHERE {complete})"]
    for p in k:
        def swept(i, j):
            if i == p and j == p:
                return f"-1 / {at(p, p)}"
            if p in (i, j):
                return f"{at(i, j)} / {at(p, p)}"
            return f"{at(i, j)} - {at(i, p)} * {at(p, j)} / {at(p, p)}"
        steps.append(f"s{p + 1} AS MATERIALIZED (SELECT " + ", ".join(f"{swept(i, j)} AS {at(i, j)}" for i, j in upper) + f" FROM s{p})")
    return over(" UNION ALL ".join(f"SELECT '{c}' AS variable, ROUND(-{at(i, i)}, 6) AS vif FROM s{len(columns)}"
                                   for i, c in enumerate(columns)), *steps)


def _reports() -> str:
    valid = "etiquetadas AS (SELECT * FROM scored WHERE " + LABELLED + ")"
    fresh = "nuevas AS (SELECT * FROM scored WHERE " + TEST + ")"
    high = (f"GREATEST(0.05, {_quantile_of('etiquetadas')}, {_quantile_of('nuevas')})")
    return over(
        " UNION ALL ".join([
            _melt("deciles", "deciles_valid", "CAST(decile AS VARCHAR)", {"n": 9, "avg_pred": 9, "default_rate": 9}),
            _melt("hist", "hist_valid", "CAST(bin AS VARCHAR)", {"n_default": 9, "n_no_default": 9}),
            _melt("hist2", "hist_test", "CAST(bin AS VARCHAR)", {"n": 9})]),
        valid, fresh, *_deciles("etiquetadas"), *_hist("etiquetadas", high), *_hist("nuevas", high, "hist2"))


def _quantile_of(source: str) -> str:
    return (f"(SELECT {_quantile('v', 'n', 'CAST(0.995 AS DOUBLE)')} FROM "
            f"(SELECT LIST(p_default ORDER BY p_default) AS v, COUNT(*) AS n FROM {source}))")


def _policy_tables() -> str:
    return over(
        " UNION ALL ".join([
            _melt("pol", "politica_valid", "''", {
                "n": 2, "n_aprob": 2, "pct_aprob": 9, "ganancia_politica": 2, "ganancia_aprobar_todo": 2,
                "perdida_evitada": 2}),
            _melt("des", "desglose", "concepto", {"n": 2, "monto": 2}),
            _melt("cur", "curva", "printf('%.2f', threshold)", {"gain": 2, "pct_approved": 9}),
            _melt("umb", "umbral_por_plazo", "CAST(plazo_meses AS VARCHAR)", {"p_umbral": 9}),
            _melt("hist", "hist_p_valid", "CAST(bin AS VARCHAR)", {"n": 9}),
            _melt("esp", "politica_test", "''", {
                "n_test": 2, "n_aprob_test": 2, "ganancia_esperada_politica": 2, "ganancia_esperada_aprobar_todo": 2}),
            _melt("hist2", "hist_p_test", "CAST(bin AS VARCHAR)", {"n": 9})]),
        f"etiquetadas AS (SELECT * FROM decided WHERE {LABELLED})",
        f"nuevas AS (SELECT * FROM decided WHERE {TEST})",
        f"pol AS ({_policy('etiquetadas')})", f"des AS ({_breakdown('etiquetadas')})",
        f"cur AS ({_gain_curve('etiquetadas')})", f"umb AS ({_THRESHOLDS})",
        f"esp AS ({_expected('nuevas')})",
        *_hist("etiquetadas", _high("etiquetadas", floor=False)),
        *_hist("nuevas", _high("nuevas", floor=False), "hist2"))


_POLICY_OUTPUT = over("""SELECT id_solicitud, p_default, ROUND(p_umbral, 9) AS p_umbral,
    aprobar AS recomendacion_aprobar, monto_solicitado, plazo_meses FROM decided""")
_PI, _PT = "(SELECT AVG(CAST(default_12m AS DOUBLE)) FROM train)", "(CAST(0.5 AS DOUBLE) / 1.5)"


def build() -> dict[str, str]:
    months = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTH_LABELS, 1))
    weekdays = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(WEEKDAYS, 1))
    every = {c: 6 for c in ("media", "desviacion", "minimo", "q25", "mediana", "q75", "maximo")}
    quartiles = ", ".join(f"{_quantile('v', 'n', f'CAST({p} AS DOUBLE)')} AS {c}" for c, p in (
        ("minimo", 0), ("q25", 0.25), ("mediana", 0.5), ("q75", 0.75), ("maximo", 1)))
    return {
        # sources and sinks
        "applications_scan": over("SELECT * FROM applications"),
        "applications_csv": over("SELECT * FROM applications"),
        "scores_reload": over("SELECT ROUND(AVG(POW(p_default - default_12m, 2)), 9) AS brier FROM scored"),
        "policy_output": _POLICY_OUTPUT,
        "report_json": _reports(),
        # projection, filters, scalar functions
        "feature_projection": over("SELECT " + ", ".join(feature_columns()) + " FROM applications"),
        "exclude_features": over("""SELECT * EXCLUDE (num_contactos_ult_trimestre, dia_semana_solicitud,
            tasa_interes_anual) FROM applications"""),
        "temporal_split": over("""SELECT id_solicitud, fecha_solicitud, CASE WHEN fecha_solicitud < DATE '2025-01-01'
            THEN 'train' ELSE 'valid' END AS ventana FROM applications"""),
        "rolling_window_split": over("""SELECT id_solicitud, w.ventana FROM applications JOIN (
            SELECT 'ronda_5 train' AS ventana, DATE '2024-01-01' AS desde, DATE '2024-07-01' AS hasta
            UNION ALL SELECT 'ronda_5 valid', DATE '2024-07-01', DATE '2025-01-01'
            UNION ALL SELECT 'ronda_6 train', DATE '2024-07-01', DATE '2025-01-01'
            UNION ALL SELECT 'ronda_6 valid', DATE '2025-01-01', DATE '9999-01-01') w
            ON fecha_solicitud >= w.desde AND fecha_solicitud < w.hasta"""),
        "split_guard": over("SELECT CAST(MAX(YEAR(fecha_solicitud)) AS INT) AS ultimo_anio FROM train"),
        "mes_solicitud": over(f"SELECT id_solicitud, CASE MONTH(fecha_solicitud) {months} END AS mes_solicitud "
                              "FROM applications"),
        "log_transform": over("""SELECT id_solicitud, ROUND(LN(1 + ingreso_declarado), 9) AS log_ingreso_declarado,
            ROUND(LN(1 + deuda_sistema), 9) AS log_deuda_sistema,
            ROUND(LN(1 + monto_solicitado), 9) AS log_monto_solicitado FROM applications"""),
        "null_flags": over("""SELECT id_solicitud,
            CASE WHEN ingreso_declarado IS NULL THEN 1 ELSE 0 END AS flag_ingreso_declarado_nulo,
            CASE WHEN antiguedad_laboral_meses IS NULL THEN 1 ELSE 0 END AS flag_antiguedad_laboral_nulo
            FROM applications"""),
        # data quality
        "valid_age_median": over(f"SELECT CAST({AGE_FILL} AS DOUBLE) AS mediana"),
        "clean_age": over(f"""SELECT id_solicitud, CASE WHEN {BAD_AGE} THEN {AGE_FILL} ELSE CAST(edad AS DOUBLE) END AS edad,
            CASE WHEN {BAD_AGE} THEN 1 ELSE 0 END AS flag_edad_inconsistente FROM applications"""),
        "clean_income": over("""SELECT id_solicitud,
            CASE WHEN ingreso_declarado <= 200000 THEN NULL ELSE ingreso_declarado END AS ingreso_declarado,
            CASE WHEN ingreso_declarado <= 200000 THEN 1 ELSE 0 END AS flag_ingreso_inconsistente FROM applications"""),
        "uf_interpolate": over("SELECT id_solicitud, fecha_solicitud, ROUND(uf, 6) AS uf FROM capped", *_capped()),
        "rate_cap_lookup": over("SELECT id_solicitud, ROUND(tope_tasa, 6) AS tope_tasa FROM capped", *_capped()),
        "clean_rate": over("""SELECT id_solicitud, ROUND(CASE WHEN tasa_interes_anual > tope_tasa THEN tope_tasa
            ELSE tasa_interes_anual END, 6) AS tasa_interes_anual,
            CASE WHEN tasa_interes_anual > tope_tasa THEN 1 ELSE 0 END AS flag_tasa_corregida FROM capped""", *_capped()),
        "dq_summary": over(f"""SELECT {WINDOW_CASE} AS conjunto, COUNT(*) AS n,
            COUNT(CASE WHEN {BAD_AGE} THEN 1 END) AS n_edad_inconsistente,
            COUNT(CASE WHEN ingreso_declarado <= 200000 THEN 1 END) AS n_ingreso_inconsistente,
            COUNT(CASE WHEN tasa_interes_anual > tope_tasa THEN 1 END) AS n_tasa_corregida
            FROM capped GROUP BY 1""", *_capped()),
        "rate_cap_asof": over("SELECT id_solicitud, tope_tasa FROM capped", *_capped(step=True)),
        "rate_cap_in_force": over("""SELECT a.id_solicitud, a.banda, c.vigente_desde, c.tope AS tope_tasa FROM banded a
            ASOF LEFT JOIN certs c ON a.banda = c.banda AND a.fecha_solicitud >= c.vigente_desde""", *_certificates()),
        "rate_cap_validity": over("""SELECT a.id_solicitud, a.banda, c.vigente_desde, c.vigente_hasta, c.tope AS tope_tasa
            FROM banded a JOIN certs c ON a.banda = c.banda AND a.fecha_solicitud >= c.vigente_desde
            AND (c.vigente_hasta IS NULL OR a.fecha_solicitud < c.vigente_hasta)""", *_certificates()),
        "asof_join": """SELECT p.event_id, p.user_id, e.error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
            ASOF LEFT JOIN (SELECT user_id, ts, MAX(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY user_id, ts) e
            ON p.user_id = e.user_id AND p.ts >= e.ts""",
        "interval_join": """SELECT v.event_id, v.user_id, e.event_id AS error_id FROM events v JOIN events e
            ON e.event_type = 'error' AND v.user_id = e.user_id AND v.ts >= e.ts
            AND v.ts < e.ts + CAST(FLOOR(e.value * 600) AS BIGINT) * INTERVAL 1 SECOND""",
        # imputation
        "group_median_impute": over("""SELECT id_solicitud, COALESCE(ingreso_declarado, m,
            (SELECT MEDIAN(ingreso_declarado) FROM train)) AS ingreso_declarado
            FROM applications a LEFT JOIN (SELECT tipo_empleo AS te, MEDIAN(ingreso_declarado) AS m
            FROM train GROUP BY tipo_empleo) g ON g.te = a.tipo_empleo"""),
        "constant_impute": over("""SELECT id_solicitud, COALESCE(antiguedad_laboral_meses, 0)
            AS antiguedad_laboral_meses FROM applications"""),
        "impute_median_global": over(_recipe(
            "COALESCE(a.ingreso_declarado, (SELECT MEDIAN(ingreso_declarado) FROM applications))",
            "COALESCE(a.antiguedad_laboral_meses, (SELECT MEDIAN(antiguedad_laboral_meses) FROM applications))")),
        "impute_group_recipe": over(
            _recipe("COALESCE(f.v, (SELECT MEDIAN(v) FROM lleno))", "COALESCE(a.antiguedad_laboral_meses, 0)",
                    "JOIN lleno f ON f.id_solicitud = a.id_solicitud"),
            "gm AS (SELECT tipo_empleo AS te, MEDIAN(ingreso_declarado) AS m FROM applications GROUP BY tipo_empleo)",
            """lleno AS (SELECT id_solicitud, COALESCE(ingreso_declarado, m) AS v
               FROM applications LEFT JOIN gm ON te = tipo_empleo)"""),
        "impute_knn": over(_recipe(
            "COALESCE(a.ingreso_declarado, x.media)", "COALESCE(a.antiguedad_laboral_meses, y.media)",
            "LEFT JOIN knn_i x ON x.id = a.id_solicitud LEFT JOIN knn_t y ON y.id = a.id_solicitud"),
            f"knn_i AS ({_knn_fill(_KNN[0])})", f"knn_t AS ({_knn_fill(_KNN[1])})"),
        # encoding
        "one_hot": over("SELECT id_solicitud, " + ", ".join(
            f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, vs in _LABELS.items() for v in vs)
            + " FROM applications"),
        "assemble_features": _assembled(),
        "feature_names": _feature_names(),
        "scale_no_center": over("SELECT id_solicitud, " + ", ".join(
            f"ROUND({c} / COALESCE(NULLIF((SELECT STDDEV_POP({c}) FROM train), 0), 1), 9) AS {c}"
            for c in NUMERIC) + " FROM applications"),
        # balancing and calibration
        "class_weights": over("""SELECT n, n_pos, n - n_pos AS n_neg, ROUND(n / (2.0 * n_pos), 9) AS peso_pos,
            ROUND(n / (2.0 * (n - n_pos)), 9) AS peso_neg,
            ROUND(CAST(n - n_pos AS DOUBLE) / n_pos, 9) AS scale_pos_weight FROM (
            SELECT COUNT(*) AS n, COUNT(CASE WHEN default_12m = 1 THEN 1 END) AS n_pos FROM train)"""),
        "prior_correction": over(f"""SELECT id_solicitud, ROUND(p_default * {_PI} * (1 - {_PT})
            / (p_default * {_PI} * (1 - {_PT}) + (1 - p_default) * {_PT} * (1 - {_PI})), 9) AS p_corregida FROM scored"""),
        "hard_predict": over("SELECT id_solicitud, CASE WHEN p_default >= 0.5 THEN 1 ELSE 0 END AS prediccion FROM scored"),
        # selection
        "select_calibration_safe": over("""SELECT posicion, arquitectura, ROUND(auc, 9) AS auc, ROUND(brier, 9) AS brier
            FROM m WHERE NOT balanceado ORDER BY m.auc DESC, posicion LIMIT 1""", *_CANDIDATES),
        "select_brier_guard": over("""SELECT m.posicion, m.arquitectura, ROUND(m.auc, 9) AS auc, ROUND(m.brier, 9) AS brier
            FROM m JOIN m b ON b.arquitectura = m.arquitectura AND b.ratio IS NULL
            WHERE m.brier <= b.brier * 1.10 ORDER BY m.auc DESC, m.posicion LIMIT 1""", *_CANDIDATES),
        # metrics
        "auc_gini": over("SELECT ROUND(auc, 9) AS auc, ROUND(gini, 9) AS gini FROM m", *_metrics("scored")),
        "ks_stat": over("SELECT ROUND(ks, 9) AS ks FROM m", *_metrics("scored")),
        "pr_auc": over("SELECT ROUND(pr_auc, 9) AS pr_auc FROM m", *_metrics("scored")),
        "brier": over("SELECT ROUND(AVG(POW(p_default - default_12m, 2)), 9) AS brier FROM scored"),
        "eval_summary": over(f"SELECT {_round(METRIC_COLUMNS, 'n', 'n_pos')} FROM m", *_metrics("scored")),
        "decile_table": over(f"SELECT {_round({'avg_pred': 9, 'default_rate': 9}, 'decile', 'n')} FROM deciles",
                             *_deciles("scored")),
        "score_hist": over(f"SELECT {_round({'edge_lo': 9, 'edge_hi': 9}, 'bin', 'n')} FROM hist",
                           *_hist("scored", _high("scored"))),
        "score_hist_by_class": over(
            f"SELECT {_round({'edge_lo': 9, 'edge_hi': 9}, 'bin', 'n_default', 'n_no_default')} FROM hist",
            *_hist("scored", _high("scored"))),
        "common_hist_max": over(f"""SELECT ROUND(MAX(q), 9) AS max_comun FROM (
            SELECT {_quantile('v', 'n', 'CAST(0.995 AS DOUBLE)')} AS q FROM (
              SELECT LIST(p_default ORDER BY p_default) AS v, COUNT(*) AS n FROM scored GROUP BY {WINDOW_CASE}))"""),
        "policy_hist": over(f"SELECT {_round({'edge_lo': 9, 'edge_hi': 9}, 'bin', 'n')} FROM hist",
                            *_hist("scored", _high("scored", floor=False))),
        "round_comparison": over(f"SELECT {_round(METRIC_COLUMNS, 'ronda', 'modelo', 'n', 'n_pos')} FROM m",
                                 _BY_ROUND, *_metrics("by_round", "ronda, modelo")),
        # policy
        "add_economics": over("""SELECT id_solicitud, ROUND(ganancia_si_paga, 4) AS ganancia_si_paga,
            ROUND(perdida_si_default, 4) AS perdida_si_default, ROUND(p_umbral, 9) AS p_umbral FROM decided"""),
        "approve_decision": over("SELECT id_solicitud, aprobar FROM decided"),
        "realized_value": over("""SELECT id_solicitud, ROUND(CASE WHEN aprobar THEN valor_todo ELSE 0.0 END, 4)
            AS valor_politica, ROUND(valor_todo, 4) AS valor_aprobar_todo FROM decided"""),
        "value_breakdown": over("SELECT aprobar, default_12m, n, ROUND(monto, 2) AS monto, concepto FROM des",
                                f"des AS ({_breakdown('decided')})"),
        "gain_curve": over(f"SELECT {_round({'gain': 2, 'pct_approved': 9}, 'threshold')} FROM cur",
                           f"cur AS ({_gain_curve('decided')})"),
        "threshold_table": over(f"SELECT plazo_meses, ROUND(p_umbral, 9) AS p_umbral FROM ({_THRESHOLDS})"),
        "expected_value": over(
            f"SELECT {_round({'ganancia_esperada_politica': 2, 'ganancia_esperada_aprobar_todo': 2}, 'n_test', 'n_aprob_test')} FROM esp",
            f"nuevas AS (SELECT * FROM decided WHERE {TEST})", f"esp AS ({_expected('nuevas')})"),
        "policy_eval": over(
            f"SELECT {_round({'pct_aprob': 9, 'ganancia_politica': 2, 'ganancia_aprobar_todo': 2, 'perdida_evitada': 2}, 'n', 'n_aprob')} FROM pol",
            f"pol AS ({_policy('decided')})"),
        "policy_round_comparison": over(
            f"SELECT {_round({'pct_aprob': 6, 'ganancia_politica': 2, 'ganancia_aprobar_todo': 2, 'perdida_evitada': 2}, 'ronda', 'modelo', 'n', 'n_aprob')}, "
            "ROUND(ganancia_politica / NULLIF(ganancia_aprobar_todo, 0), 6) AS veces_aprobar_todo FROM pol",
            _BY_ROUND, "by_round2 AS (SELECT *, COALESCE(p_default < p_umbral, FALSE) AS aprobar FROM by_round)",
            f"pol AS ({_policy('by_round2', 'ronda, modelo')})"),
        # fitted models: most are checked by tests against a solver of their own
        "model_reload": over(f"SELECT id_solicitud, TRUE AS igual FROM applications WHERE {TEST}"),
        # exploration
        "null_profile": over(_null_profile(), *_capped()),
        "numeric_profile": over(
            f"SELECT {_round(every, 'variable', 'n')} FROM (SELECT variable, n, media, desviacion, {quartiles} FROM listed)",
            f"long_num AS ({_stack(NUMERIC, 'DOUBLE')})",
            """listed AS (SELECT variable, COUNT(valor) AS n, AVG(valor) AS media, STDDEV_SAMP(valor) AS desviacion,
               LIST(valor ORDER BY valor) AS v FROM long_num WHERE valor IS NOT NULL GROUP BY variable)"""),
        "structural_nulls": over("""SELECT tipo_empleo, COUNT(*) AS n,
            COUNT(CASE WHEN antiguedad_laboral_meses IS NULL THEN 1 END) AS n_nulos,
            ROUND(AVG(CASE WHEN antiguedad_laboral_meses IS NULL THEN 1.0 ELSE 0.0 END), 9) AS pct_nulos
            FROM applications GROUP BY tipo_empleo"""),
        "weekday_mismatch": over(f"""SELECT COUNT(*) AS n, COUNT(CASE WHEN d THEN 1 END) AS n_distinto,
            ROUND(AVG(CASE WHEN d THEN 1.0 ELSE 0.0 END), 9) AS pct_distinto FROM (
            SELECT dia_semana_solicitud <> CASE ISODOW(fecha_solicitud) {weekdays} END AS d FROM applications)"""),
        "pearson_corr": over(_correlations([*NUMERIC, "default_12m"])),
        "spearman_corr": _spearman(NUMERIC),
        "vif": _vif(NUMERIC),
        "information_value": over("SELECT variable, ROUND(iv, 6) AS iv FROM iv", *_bins(NUMERIC, CATEGORICAL)),
        "chi_square": over("SELECT variable, n, ROUND(chi2, 6) AS chi2, gl FROM chi",
                           *_bins((), [*CATEGORICAL, "dia_semana_solicitud"])),
        "cramers_v": over("SELECT variable, ROUND(SQRT(chi2 / n), 6) AS v_cramer FROM chi",
                          *_bins((), [*CATEGORICAL, "num_contactos_ult_trimestre"])),
        "anova_f": over("SELECT variable, n, gl_entre, gl_dentro, ROUND(f, 6) AS f FROM anova",
                        f"long_g AS ({_stack(NUMERIC, 'DOUBLE', 'tipo_empleo')})", *_anova("long_g", "tipo_empleo")),
        "levene_test": over("SELECT variable, n, gl_entre, gl_dentro, ROUND(f, 6) AS f FROM anova",
                            f"long_g AS ({_stack(NUMERIC, 'DOUBLE')})",
                            """meds AS (SELECT variable AS mv, default_12m AS mg, MEDIAN(valor) AS med
                               FROM long_g GROUP BY variable, default_12m)""",
                            """dist AS (SELECT variable, default_12m, ABS(valor - med) AS valor
                               FROM long_g JOIN meds ON mv = variable AND mg = default_12m)""",
                            *_anova("dist", "default_12m")),
        "breusch_pagan": over("""SELECT COUNT(*) AS n, ROUND(REGR_R2(e2, x), 9) AS r2,
            ROUND(COUNT(*) * REGR_R2(e2, x), 4) AS lm, CAST(1 AS BIGINT) AS gl FROM res""",
            """fit AS (SELECT REGR_SLOPE(default_12m, score_buro) AS b, AVG(score_buro) AS mx,
               AVG(default_12m) AS my FROM applications)""",
            """res AS (SELECT CAST(score_buro AS DOUBLE) AS x,
               POW(default_12m - my - b * (score_buro - mx), 2) AS e2 FROM applications CROSS JOIN fit)"""),
        "default_rate_by_month": over("""SELECT CAST(DATE_TRUNC('month', fecha_solicitud) AS DATE) AS mes, COUNT(*) AS n,
            ROUND(AVG(CAST(default_12m AS DOUBLE)), 9) AS tasa_observada, ROUND(AVG(p_default), 9) AS tasa_predicha
            FROM scored GROUP BY 1"""),
        "default_drift": over("""SELECT mes, n, ROUND(z, 6) AS z, ROUND(alza, 6) AS alza, ROUND(baja, 6) AS baja,
            CASE WHEN alza > 4 THEN 'alza' WHEN baja > 4 THEN 'baja' ELSE 'no' END AS deriva FROM sumas""",
            """meses AS (SELECT CAST(DATE_TRUNC('month', fecha_solicitud) AS DATE) AS mes, COUNT(*) AS n,
               COALESCE((SUM(CAST(default_12m AS DOUBLE)) - SUM(p_default)) / NULLIF(SQRT(SUM(p_default * (1 - p_default))), 0), 0) AS z
               FROM scored WHERE default_12m IS NOT NULL AND fecha_solicitud IS NOT NULL AND p_default IS NOT NULL GROUP BY 1)""",
            """caminos AS (SELECT *, SUM(z - 0.5::DOUBLE) OVER (ORDER BY mes) AS sube, SUM(-z - 0.5::DOUBLE) OVER (ORDER BY mes) AS cae
               FROM meses)""",
            """sumas AS (SELECT mes, n, z, sube - LEAST(0, MIN(sube) OVER (ORDER BY mes)) AS alza,
               cae - LEAST(0, MIN(cae) OVER (ORDER BY mes)) AS baja FROM caminos)"""),
        "leakage_screen": over(
            """SELECT iv.variable, ROUND(iv, 6) AS iv, ROUND(SQRT(chi2 / n), 6) AS v_cramer, ROUND(r, 6) AS r,
               CASE WHEN iv > 0.5 AND GREATEST(COALESCE(ABS(r), 0.0), SQRT(chi2 / n)) > 0.7 THEN 'fuga'
                    WHEN iv > 0.5 THEN 'revisar' ELSE 'ok' END AS veredicto
               FROM iv JOIN chi ON chi.variable = iv.variable LEFT JOIN cors ON cors.cv = iv.variable""",
            *_bins(NUMERIC, CATEGORICAL), "cors AS (" + " UNION ALL ".join(
                f"SELECT '{c}' AS cv, CORR({c}, default_12m) AS r FROM applications" for c in NUMERIC) + ")"),
        # jobs and streams
        "policy_tables": _policy_tables(),
        "report_tables": _reports(),
        "stream_score": _POLICY_OUTPUT,
        "stream_default_rate": over("""SELECT desde, CAST(desde + 30 AS DATE) AS hasta, COUNT(*) AS n,
            ROUND(AVG(CAST(default_12m AS DOUBLE)), 9) AS tasa_observada, ROUND(AVG(p_default), 9) AS tasa_predicha,
            ROUND(AVG(CASE WHEN aprobar THEN 1.0 ELSE 0.0 END), 9) AS pct_aprob FROM (
              SELECT *, DATE '1970-01-01' + CAST(30 * FLOOR((fecha_solicitud - DATE '1970-01-01') / 30.0) AS INT) AS desde
              FROM decided)
            GROUP BY desde"""),
        "stream_late_rows": over("""SELECT 'cerrada' AS estado, CAST((SELECT MIN(lote) FROM marcas m WHERE m.limite >= j.desde + 30) AS INT) AS lote,
            desde, CAST(desde + 30 AS DATE) AS hasta, COUNT(*) AS n, ROUND(AVG(CAST(default_12m AS DOUBLE)), 9) AS tasa_observada,
            ROUND(AVG(p_default), 9) AS tasa_predicha
            FROM juzgadas j WHERE NOT tarde AND desde + 30 <= (SELECT MAX(limite) FROM marcas) GROUP BY desde
            UNION ALL SELECT 'tarde', CAST(lote AS INT), desde, CAST(desde + 30 AS DATE), COUNT(*), NULL, NULL
            FROM juzgadas WHERE tarde GROUP BY lote, desde""",
            """llegadas AS (SELECT *, FLOOR((fecha_solicitud - DATE '2024-01-01' + CASE WHEN id_solicitud % 10 = 0 THEN 150
                ELSE id_solicitud % 20 END) / 90.0) AS llegada,
                CAST(DATE '1970-01-01' + CAST(30 * FLOOR((fecha_solicitud - DATE '1970-01-01') / 30.0) AS INT) AS DATE) AS desde FROM scored)""",
            """marcas AS (SELECT llegada, ROW_NUMBER() OVER (ORDER BY llegada) - 1 AS lote,
                MAX(MAX(fecha_solicitud)) OVER (ORDER BY llegada) - 30 AS limite FROM llegadas GROUP BY llegada)""",
            "antes AS (SELECT *, LAG(limite) OVER (ORDER BY lote) AS anterior FROM marcas)",
            """juzgadas AS (SELECT l.*, a.lote, COALESCE(desde + 30 <= anterior, FALSE) AS tarde
                FROM llegadas l JOIN antes a ON a.llegada = l.llegada)"""),
    }
