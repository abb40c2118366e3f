"""DuckDB SQL that states the expected result of the registered queries.

Each text names the sample tables it needs; `_sql` puts their definitions in front.
"""

from __future__ import annotations

from tallymill.registry import PARAMS as P
from tallymill.schemas import TABLES


def _known_or_not(key: str) -> str:
    return f"CAST(CASE WHEN {key} % 10 = 9 THEN {key} + 1000000 ELSE {key} END AS VARCHAR)"


_TABLES = {
    "dim_date": """SELECT CAST(d AS DATE) AS date, CAST(year(d) AS INT) AS year,
        CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month,
        CAST(weekofyear(d) AS INT) AS week_of_year, CAST(isodow(d) AS INT) AS day_of_week,
        CAST(day(d) AS INT) AS day
        FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) t(d)""",
    "dim_factory": """SELECT CAST(s_suppkey AS VARCHAR) AS factory_code, s_name AS factory_name,
        'Rep ' || CAST(s_nationkey AS VARCHAR) AS salesman, s_suppkey % 4 <> 0 AS is_active,
        s_suppkey % 3 = 0 AS has_onsite FROM supplier""",
    "dim_product": """SELECT p_partkey AS id,
        p_name || ' #' || CAST(p_partkey AS VARCHAR) AS product_name,
        p_type AS product_type, p_brand AS qc FROM part""",
    "fact_sales": f"""SELECT CAST(l_orderkey AS VARCHAR) AS order_code,
        {_known_or_not("l_suppkey")} AS factory_code, CAST(l_partkey AS VARCHAR) AS product_code,
        p_name || ' #' || CAST(l_partkey AS VARCHAR) AS product_name, p_brand AS qc,
        CAST(l_shipdate AS DATE) AS sales_date,
        '2301-' || l_orderkey || '-' || l_linenumber AS sales_code, l_quantity AS sales_quantity,
        'kg' AS unit, floor(l_quantity / 4) AS package_sales_quantity,
        CASE WHEN p_size < 25 THEN 'can' ELSE 'drum' END AS package_unit,
        'D' || l_suppkey % 7 AS department, 'Rep ' || l_suppkey % 25 AS salesman,
        'W' || l_returnflag AS warehouse_code, l_linestatus AS warehouse_type,
        CAST(CAST(l_shipdate AS DATE) + 1 AS VARCHAR) || ' 00:00:00' AS import_timestamp
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "fact_order": f"""SELECT CAST(o_orderkey AS VARCHAR) AS order_code,
        {_known_or_not("(o_custkey % (SELECT count(*) FROM supplier))")} AS factory_code,
        'F' || o_custkey % 5 AS factory_order_code, o_orderpriority AS tax_type,
        'D' || o_custkey % 7 AS department, 'Rep ' || o_custkey % 25 AS salesman,
        CAST(o_orderkey % 5 * 0.25 AS DOUBLE) AS deposit_rate,
        'Street ' || o_custkey AS delivery_address,
        CAST(p_partkey AS VARCHAR) AS product_code,
        p_name || ' #' || CAST(p_partkey AS VARCHAR) AS product_name, p_brand AS qc,
        o_orderstatus AS warehouse_type, CAST(o_orderdate AS DATE) AS order_date,
        CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 60 AS INT) AS estimated_delivery_date,
        CAST(o_orderdate AS DATE) + 30 AS original_estimated_delivery_date,
        floor(o_totalprice / 1000) AS order_quantity, floor(o_totalprice / 2000) AS delivered_quantity,
        'kg' AS unit, CASE WHEN p_size < 25 THEN 'can' ELSE 'drum' END AS package_unit,
        CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) || ' 00:00:00' AS import_timestamp,
        CAST(CAST(o_orderdate AS DATE) + 2 AS VARCHAR) || ' 00:00:00' AS import_wh_timestamp
        FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)""",
    "bridge_product_material": """SELECT
        p_name || ' #' || CAST(p_partkey AS VARCHAR) AS product_name,
        'material-' || CAST((p_partkey * 7 + k * 13) % 50 AS VARCHAR) AS material_name,
        CAST((k + 1) * 0.125 + (v - 1) * 0.5 AS DECIMAL(18,6)) AS ratio,
        CAST(v AS INT) AS version_number,
        CASE WHEN v = 1 THEN DATE '1995-01-01' ELSE DATE '1998-01-01' END AS effective_date,
        CASE WHEN v = 1 THEN DATE '1997-12-31' END AS end_date,
        v = 2 AS is_current FROM part, range(3) a(k), range(1, 3) b(v)""",
    "dim_material": """SELECT DISTINCT
        CAST(replace(material_name, 'material-', '') AS BIGINT) AS id, material_name AS name,
        CAST(NULL AS VARCHAR) AS qc, 'kg' AS unit FROM bridge_product_material""",
    "blueprint": f"""SELECT CAST(p_partkey AS VARCHAR) AS id, {_known_or_not("(p_partkey % 100)")} AS factory,
        p_name AS name, CASE WHEN p_size < 20 THEN 'PALLET' WHEN p_size < 35 THEN 'HANGING'
          ELSE 'ROLLER' END AS type,
        CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS description,
        CASE WHEN p_partkey % 50 = 7 THEN '/other/' ELSE '/app/media/blueprints/' END
          || p_partkey || '.svg' AS file_path,
        p_name || '.svg' AS filename, p_partkey * 10 AS file_size,
        DATE '2020-01-01' + CAST(p_partkey % 900 AS INT) AS made FROM part""",
    "dim_retailer": "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer",
}


def _sql(tables: str, body: str, **steps: str) -> str:
    """WITH the named sample tables and further steps, then the body."""
    parts = [f"{t} AS ({_TABLES[t]})" for t in tables.split()]
    parts += [f"{name} AS ({text})" for name, text in steps.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _days(span: object) -> str:
    return f"BETWEEN DATE '{span.start}' AND DATE '{span.end}'"


def _texts(codes: list[str]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


MAIN, TARGET = _days(P.main), _days(P.target)
EXCLUDED = _texts(P.excluded)


def _overall(year: int, days: tuple[int, int], months: tuple[int, int], target_year: int,
             target_month: int) -> str:
    """Every measure is a filtered sum over all facts tagged with their calendar parts."""
    def tagged(fact: str, day: str, quantity: str) -> str:
        return f"""SELECT year({day}) AS y, month({day}) AS m, factory_code AS f, {quantity} AS q
            FROM {fact} WHERE day({day}) BETWEEN {days[0]} AND {days[1]}"""

    def per_month(source: str) -> str:
        return f"""SELECT m, sum(q) AS every, sum(q) FILTER (WHERE f IN {EXCLUDED}) AS some
            FROM {source} WHERE y = {year} AND m BETWEEN {months[0]} AND {months[1]} GROUP BY m"""

    def target(source: str) -> str:
        return f"""SELECT coalesce(sum(q), 0) AS v FROM {source}
            WHERE y = {target_year} AND m = {target_month} AND f NOT IN {EXCLUDED}"""

    def share(value: str, goal: str) -> str:
        return f"CASE WHEN {goal} > 0 THEN {value} / {goal} ELSE 0.0 END"

    return _sql(
        "dim_date fact_sales fact_order",
        f"""SELECT month, sa AS sales_quantity, sx AS exclude_factory_sales_quantity,
              sa - sx AS remain_sales_quantity, oa AS order_quantity,
              ox AS exclude_factory_order_quantity, oa - ox AS remain_order_quantity,
              st AS sales_target_value, ot AS order_target_value,
              {share("(sa - sx)", "st")} AS sales_target_pct,
              {share("(oa - ox)", "ot")} AS order_target_pct
            FROM filled""",
        s=tagged("fact_sales", "sales_date", "sales_quantity"),
        o=tagged("fact_order", "order_date", "order_quantity"),
        sm=per_month("s"), om=per_month("o"),
        filled=f"""SELECT d.month, coalesce(sm.every, 0) AS sa, coalesce(sm.some, 0) AS sx,
              coalesce(om.every, 0) AS oa, coalesce(om.some, 0) AS ox,
              ({target("s")}) AS st, ({target("o")}) AS ot
            FROM (SELECT DISTINCT month FROM dim_date WHERE year = {year}
                  AND month BETWEEN {months[0]} AND {months[1]}
                  AND day BETWEEN {days[0]} AND {days[1]}) d
            LEFT JOIN sm ON sm.m = d.month LEFT JOIN om ON om.m = d.month""",
    )


def _breakdown_steps(year: int) -> dict[str, str]:
    return {
        "moves": f"""SELECT month(sales_date) AS month, factory_code, sales_quantity AS s, 0 AS o
              FROM fact_sales WHERE year(sales_date) = {year} AND factory_code IN {EXCLUDED}
            UNION ALL SELECT month(order_date), factory_code, 0, order_quantity
              FROM fact_order WHERE year(order_date) = {year} AND factory_code IN {EXCLUDED}""",
        "parts": """SELECT CAST(month AS INT) AS month, factory_code,
              (SELECT factory_name FROM dim_factory d WHERE d.factory_code = moves.factory_code)
                AS factory_name,
              sum(s) AS sales_quantity, sum(o) AS order_quantity
            FROM moves GROUP BY month, factory_code""",
    }


def _nested(year: int) -> str:
    return _sql(
        "dim_date dim_factory fact_sales fact_order",
        """SELECT d.month, coalesce((SELECT string_agg(concat_ws('|', factory_code,
              coalesce(factory_name, ''), CAST(sales_quantity AS BIGINT),
              CAST(order_quantity AS BIGINT)), ';' ORDER BY factory_code)
              FROM parts WHERE parts.month = d.month), '') AS factory_breakdown,
              coalesce((SELECT sum(sales_quantity) FROM parts WHERE parts.month = d.month), 0)
                AS exclude_factory_sales_quantity
            FROM (SELECT DISTINCT month FROM dim_date WHERE year = %d) d""" % year,
        **_breakdown_steps(year),
    )


def _factory_diff(kind: str, increase: bool) -> str:
    fact, day, qty = f"fact_{kind}", f"{kind}_date", f"{kind}_quantity"
    month_start = P.target.start.replace(day=1)
    sign = ">" if increase else "<"
    return _sql(
        "dim_factory fact_sales fact_order",
        f"""SELECT factory_code, factory_name, salesman, a AS {qty}, b AS {qty}_target,
              a - b AS quantity_diff, abs(a - b) AS quantity_diff_abs,
              CASE WHEN b = 0 THEN 1.0 ELSE (a - b) / b END AS quantity_diff_pct,
              w AS whole_month_{qty}, p AS planned_deliveries
            FROM dim_factory JOIN sums USING (factory_code)
            WHERE seen > 0 AND abs(a - b) >= {P.threshold} AND a - b {sign} 0""",
        rows=f"""SELECT factory_code, {day} AS d, {qty} AS q, 'moved' AS what FROM {fact}
            UNION ALL SELECT factory_code, estimated_delivery_date, order_quantity, 'planned'
            FROM fact_order""",
        sums=f"""SELECT factory_code,
              coalesce(sum(q) FILTER (WHERE what = 'moved' AND d {MAIN}), 0) AS a,
              coalesce(sum(q) FILTER (WHERE what = 'moved' AND d {TARGET}), 0) AS b,
              count(*) FILTER (WHERE what = 'moved' AND (d {MAIN} OR d {TARGET})) AS seen,
              coalesce(sum(q) FILTER (WHERE what = 'moved' AND d >= DATE '{month_start}'
                AND d <= last_day(DATE '{month_start}')), 0) AS w,
              coalesce(sum(q) FILTER (WHERE what = 'planned' AND d > DATE '{P.main.end}'
                AND d <= last_day(DATE '{P.main.end}')), 0) AS p
            FROM rows GROUP BY factory_code""",
    )


def _product_diff(kind: str, where: str = "TRUE") -> str:
    day, qty = f"{kind}_date", f"{kind}_quantity"
    return _sql(
        "fact_sales fact_order",
        f"""SELECT product_name, a AS {qty}, b AS {qty}_target, a - b AS quantity_diff,
            abs(a - b) AS quantity_diff_abs FROM sums""",
        sums=f"""SELECT product_name,
              sum(CASE WHEN {day} {MAIN} THEN {qty} ELSE 0 END) AS a,
              sum(CASE WHEN {day} {TARGET} THEN {qty} ELSE 0 END) AS b
            FROM fact_{kind} WHERE ({day} {MAIN} OR {day} {TARGET}) AND {where}
            GROUP BY product_name""",
    )


def _scheduled(where: str = "TRUE") -> str:
    return _sql(
        "fact_sales fact_order",
        f"""SELECT CAST(m AS INT) AS scheduled_month, sum(planned) AS scheduled_quantity,
              sum(sold) AS sales_quantity, sum(sold) / sum(planned) AS sales_pct
            FROM (SELECT month(estimated_delivery_date) AS m, order_quantity AS planned, 0 AS sold,
                    1 AS n FROM fact_order
                  WHERE year(estimated_delivery_date) = {P.year} AND {where}
                  UNION ALL SELECT month(sales_date), 0, sales_quantity, 0 FROM fact_sales
                  WHERE year(sales_date) = {P.year} AND {where})
            GROUP BY m HAVING sum(n) > 0""",
    )


def _overtime(fields: str, where: str = "TRUE") -> str:
    return _sql(
        "dim_date dim_factory fact_sales",
        f"""SELECT {fields}, sum(sales_quantity) AS sales_quantity
            FROM fact_sales JOIN dim_date ON date = sales_date
            WHERE year IN (1996, 1997) AND {where}
              AND factory_code IN (SELECT factory_code FROM dim_factory) GROUP BY {fields}""",
    )


def _bom(kind: str, groups: list[str], where: str = "TRUE") -> str:
    day, qty = f"{kind}_date", f"{kind}_quantity"
    keys = ", ".join(groups)

    def two_places(value: str) -> str:
        return f"CAST(round(CAST({value} AS DECIMAL(38,15)), 2) AS DOUBLE)"

    extra = ""
    if "product_name" in groups:
        extra = (f"{two_places(f'sum({qty})')} AS {qty}, "
                 "CAST(round(max(ratio), 4) AS DOUBLE) AS ratio, ")
    return _sql(
        f"dim_factory fact_{kind} bridge_product_material",
        f"""SELECT {keys}, {extra}
              {two_places(f"sum({qty} * CAST(ratio AS DOUBLE))")} AS material_quantity
            FROM fact_{kind} JOIN dim_factory USING (factory_code) JOIN
              (SELECT product_name, material_name, ratio FROM bridge_product_material
               WHERE is_current) USING (product_name)
            WHERE {day} {MAIN} AND {where} GROUP BY {keys}""",
    )


_MIX = {
    "mix": f"""SELECT f.factory_code, f.factory_name, p.product_type, p.product_name,
          CAST(month(s.sales_date) AS INT) AS month, sum(s.sales_quantity) AS sales_quantity,
          p.product_type IN {_texts(P.thinner)} AS thin
        FROM fact_sales s, dim_factory f, dim_product p
        WHERE s.factory_code = f.factory_code AND s.product_name = p.product_name
          AND year(s.sales_date) = {P.year}
          AND p.product_type IN {_texts(P.thinner + P.paint)} GROUP BY ALL""",
    "balance": """SELECT factory_code, factory_name, month,
          coalesce(sum(sales_quantity) FILTER (WHERE thin), 0) AS t,
          coalesce(sum(sales_quantity) FILTER (WHERE NOT thin), 0) AS p
        FROM mix GROUP BY ALL""",
    "summary": """SELECT factory_code, factory_name, month, t AS sales_thinner_quantity,
          p AS sales_paint_quantity,
          CASE WHEN t = 0 THEN '0:' || CAST(CAST(p AS BIGINT) AS VARCHAR)
            WHEN p = 0 THEN CAST(CAST(t AS BIGINT) AS VARCHAR) || ':0'
            ELSE CAST(CAST(round(CAST(t / p AS DECIMAL(38,15)), 1) AS DECIMAL(18,1)) AS VARCHAR)
              || ':1' END AS ratio
        FROM balance WHERE t <> 0 OR p <> 0""",
}


def _mix(body: str) -> str:
    return _sql("dim_factory dim_product fact_sales", body, **_MIX)


def _months_wide(value: str, empty: str) -> str:
    return ", ".join(
        f"coalesce(max({value}) FILTER (WHERE month = {m}), {empty}) AS \"{m}\""
        for m in range(1, 13)
    )


def _mix_pivot(value: str, empty: str) -> str:
    return _mix(f"""SELECT factory_code, factory_name, {_months_wide(value, empty)}
        FROM summary GROUP BY factory_code, factory_name""")


def _mix_detail(thin: str) -> str:
    return _mix(f"""SELECT factory_code, factory_name, product_type, product_name,
        {_months_wide("sales_quantity", "0")} FROM mix WHERE {thin} GROUP BY
        factory_code, factory_name, product_type, product_name""")


def _product_pivot(where: str = "TRUE") -> str:
    days, months, years = P.pivot_days, P.pivot_months, P.pivot_years
    labels = [f"{y}-{m:02d}" for y in years for m in months]
    cells = ", ".join(
        f"sum(CASE WHEN strftime(sales_date, '%Y-%m') = '{c}' THEN sales_quantity ELSE 0 END) "
        f"AS \"{c}\"" for c in labels)
    total = " + ".join(f'"{c}"' for c in labels)
    inside = f"day(sales_date) BETWEEN {days[0]} AND {days[1]}"
    year, month = P.selected
    return _sql(
        "dim_factory fact_sales fact_order",
        f"""SELECT base.*, coalesce((SELECT sum(sales_quantity) FROM fact_sales s
                WHERE s.factory_code = base.factory_code AND s.product_code = base.product_code
                AND {inside} AND year(sales_date) = {year} AND month(sales_date) = {month}), 0)
                AS selected_month_sales,
              coalesce((SELECT sum(order_quantity) FROM fact_order o
                WHERE o.factory_code = base.factory_code AND o.product_code = base.product_code
                AND estimated_delivery_date > make_date({year}, {month}, {days[1]})), 0)
                AS planned_deliveries,
              {total} AS total_sales,
              round_even(({total}) / {len(labels)} * 100, 0) / 100 AS avg_sales
            FROM base""",
        base=f"""SELECT product_code, product_name, factory_code, factory_name, {cells}
            FROM fact_sales JOIN dim_factory USING (factory_code)
            WHERE {inside} AND {where} AND year(sales_date) IN {tuple(years)}
              AND month(sales_date) IN {tuple(months)} GROUP BY ALL""",
    )


_KINDS = {"string": "VARCHAR", "date": "DATE", "double": "DOUBLE", "timestamp": "VARCHAR"}


def _all_columns(table: str, given: list[str], **values: str) -> str:
    """Every column of a stored table: given by the source, stated, or null."""
    def one(name: str, kind: str) -> str:
        if name in values:
            return f"{values[name]} AS {name}"
        return name if name in given else f"CAST(NULL AS {_KINDS[kind]}) AS {name}"

    return ", ".join(one(f.name, f.dataType.typeName()) for f in TABLES[table])


def _extract(kind: str, given: str) -> str:
    columns = _all_columns(f"fact_{kind}", given.split())
    return _sql(
        f"dim_factory fact_{kind}",
        f"""SELECT {columns}, factory_name FROM (SELECT f.*, factory_name
            FROM fact_{kind} f, dim_factory d
            WHERE f.factory_code = d.factory_code AND {kind}_date {MAIN})""",
    )


_CHANGE = _sql(
    "fact_sales fact_order",
    """SELECT y AS year, m AS month, s.every AS sales_quantity, s.every_change AS sales_pct_diff,
          s.rest AS remain_sales_quantity, s.rest_change AS remain_sales_pct_diff,
          o.every AS order_quantity, o.every_change AS order_pct_diff,
          o.rest AS remain_order_quantity, o.rest_change AS remain_order_pct_diff
        FROM changes s JOIN changes o USING (y, m) WHERE s.what = 'sales' AND o.what = 'order'
        ORDER BY y DESC, m DESC LIMIT 1""",
    sums=f"""SELECT what, CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS m, sum(q) AS every,
          sum(q) FILTER (WHERE f <> '{P.excluded[0]}') AS rest
        FROM (SELECT 'sales' AS what, sales_date AS d, factory_code AS f, sales_quantity AS q
                FROM fact_sales
              UNION ALL SELECT 'order', order_date, factory_code, order_quantity FROM fact_order)
        WHERE d {MAIN} OR d {TARGET} GROUP BY ALL""",
    changes="""SELECT *, coalesce(every / lag(every) OVER w, 1) - 1 AS every_change,
          coalesce(rest / lag(rest) OVER w, 1) - 1 AS rest_change
        FROM sums WINDOW w AS (PARTITION BY what ORDER BY y, m)""",
)

_SAME_MONTH = _sql(
    "dim_date fact_sales fact_order",
    f"""SELECT year, month,
          coalesce((SELECT sum(q) FROM pairs p WHERE p.same AND p.y = d.year AND p.m = d.month), 0)
            AS same_month_sales,
          coalesce((SELECT sum(q) FROM pairs p WHERE NOT p.same AND p.y = d.year
            AND p.m = d.month), 0) AS diff_month_sales,
          coalesce((SELECT sum(q) FROM pairs p WHERE p.y = d.year AND p.m = d.month), 0)
            AS total_sales,
          coalesce((SELECT sum(order_quantity) FROM fact_order WHERE (order_date {MAIN}
            OR order_date {TARGET}) AND year(order_date) = d.year
            AND month(order_date) = d.month), 0) AS total_order
        FROM (SELECT DISTINCT year, month FROM dim_date WHERE date {MAIN} OR date {TARGET}) d""",
    pairs=f"""SELECT year(sales_date) AS y, month(sales_date) AS m, sales_quantity AS q,
          date_trunc('month', sales_date) = date_trunc('month', order_date) AS same
        FROM fact_sales JOIN fact_order USING (order_code)
        WHERE sales_date {MAIN} OR sales_date {TARGET}""",
)


def report_sql() -> dict[str, str]:
    some = f"factory_code IN {_texts(P.some_factories)}"
    return {
        "max_sales_date": _sql("fact_sales", "SELECT strftime(max(sales_date), '%Y-%m-%d') "
                               "AS max_sales_date FROM fact_sales"),
        "overall": _overall(P.year, (1, 31), (1, 12), *P.overall_target),
        "overall_day_window": _overall(P.year, (10, 31), (2, 7), *P.overall_target),
        "overall_breakdown": _sql("dim_factory fact_sales fact_order", "SELECT * FROM parts",
                                  **_breakdown_steps(P.year)),
        "overall_nested": _nested(P.year),
        "overall_breakdown_order": _sql(
            "dim_factory fact_sales fact_order",
            """SELECT month, factory_code, CAST(row_number() OVER (ORDER BY month, factory_code) AS INT)
                AS place FROM parts""", **_breakdown_steps(P.year)),
        "thinner_pivot_order": _mix("""SELECT factory_code, CAST(row_number() OVER (ORDER BY
              coalesce(sum(sales_thinner_quantity + sales_paint_quantity) FILTER (WHERE month = 12), 0)
              DESC, factory_code) AS INT) AS place FROM summary GROUP BY factory_code"""),
        "factory_sales_range_diff_order": f"""SELECT factory_code, quantity_diff,
            CAST(row_number() OVER (ORDER BY quantity_diff, factory_code) AS INT) AS place
            FROM ({_factory_diff("sales", False)})""",
        "factory_sales_range_diff_rising": _factory_diff("sales", True),
        "factory_sales_range_diff_falling": _factory_diff("sales", False),
        "factory_order_range_diff_rising": _factory_diff("order", True),
        "factory_order_range_diff_falling": _factory_diff("order", False),
        "product_sales_range_diff": _product_diff("sales"),
        "product_sales_range_diff_factories": _product_diff("sales", some),
        "product_order_range_diff": _product_diff("order"),
        "product_order_range_diff_factories": _product_diff("order", some),
        "scheduled_and_actual_sales": _scheduled(),
        "scheduled_and_actual_sales_factory": _scheduled(f"factory_code = '{P.one_factory}'"),
        "sales_overtime_month": _overtime("month"),
        "sales_overtime_calendar": _overtime("year, quarter, week_of_year, day_of_week"),
        "sales_overtime_factory_days": _overtime("date, day", f"factory_code = '{P.one_factory}'"),
        "same_month_sales": _SAME_MONTH,
        "sales_order_pct_diff": _CHANGE,
        "thinner_paint_summary": _mix("SELECT * FROM summary"),
        "thinner_paint_detail": _mix("SELECT * EXCLUDE (thin) FROM mix"),
        "thinner_pivot": _mix_pivot("sales_thinner_quantity", "0"),
        "paint_pivot": _mix_pivot("sales_paint_quantity", "0"),
        "ratio_pivot": _mix_pivot("ratio", "'0'"),
        "thinner_detail_pivot": _mix_detail("thin"),
        "paint_detail_pivot": _mix_detail("NOT thin"),
        "fact_order_extract": _extract(
            "order", "order_code factory_code factory_order_code tax_type department salesman "
            "deposit_rate delivery_address product_code product_name qc warehouse_type order_date "
            "estimated_delivery_date original_estimated_delivery_date order_quantity "
            "delivered_quantity unit package_unit import_timestamp import_wh_timestamp"),
        "fact_sales_extract": _extract(
            "sales", "order_code factory_code product_code product_name qc sales_date sales_code "
            "sales_quantity unit package_sales_quantity package_unit department salesman "
            "warehouse_code warehouse_type import_timestamp"),
        "sales_bom": _bom("sales", ["material_name"]),
        "sales_bom_by_product": _bom("sales", ["product_name", "material_name"]),
        "sales_bom_by_factory": _bom("sales", ["factory_code", "factory_name", "material_name"],
                                     some),
        "order_bom": _bom("order", ["material_name"]),
        "order_bom_by_product_factory": _bom("order", ["product_name", "factory_code",
                                                       "material_name"]),
        "pivot_product_order": _product_pivot(),
        "pivot_product_order_factories": _product_pivot(some),
    }


def _order_rows(upload: int) -> str:
    """What staging should hold for each line of an order upload, from the source values."""
    when = {0: "TRUE", 1: "o_orderdate < DATE '1999-01-01'", 2: "o_orderdate >= DATE '1998-01-01'"}
    copies = "range(2)" if upload == 2 else "range(1)"
    added = "5 + 4 * copy" if upload == 2 else "0"
    return f"""SELECT CASE WHEN o_orderkey % 29 <> 0 THEN CAST(o_orderdate AS DATE) END AS order_date,
          CASE WHEN o_orderkey % 4 = 0 THEN '2202-' ELSE '2201-' END || o_orderkey || '-0001'
            AS order_code,
          CASE WHEN o_custkey % 10 = 3 THEN '30895.2' ELSE CAST(o_custkey AS VARCHAR) END
            AS factory_code,
          nullif(['ST-1', 'tn 7', 'BP', 'QT', 'st-qt', ''][o_orderkey % 6 + 1], '')
            AS factory_order_code,
          'P' || (o_orderkey % 500) AS product_code, 'Paint ' || (o_orderkey % 500) AS product_name,
          CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS qc,
          o_orderstatus AS warehouse_type,
          floor(o_totalprice / 1000) + {added} AS order_quantity,
          floor(o_totalprice / 2000) + {added} AS delivered_quantity,
          CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 + 30 AS INT) AS estimated_delivery_date,
          'Factory ' || o_custkey || ' in ' || year(o_orderdate) AS factory_name,
          'copy ' || copy AS note, '0001' AS numerical_order, 'A' AS path, copy,
          o_orderkey % 997 = 0 AS bad
        FROM orders, {copies} c(copy) WHERE {when[upload]}"""


def _sales_rows(upload: int) -> str:
    when = {0: "TRUE", 1: "l_shipdate < DATE '1999-01-01'", 2: "l_shipdate >= DATE '1998-01-01'"}
    return f"""SELECT CASE WHEN l_partkey % 101 <> 0 THEN CAST(l_shipdate AS DATE) END AS sales_date,
          ['2301-', '2302-', '2399-'][l_orderkey % 3 + 1] || l_orderkey || '-' || printf('%04d',
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_shipdate, l_quantity)) AS sales_code,
          CASE WHEN l_suppkey % 10 = 3 THEN '30895.2' ELSE CAST(l_suppkey AS VARCHAR) END
            AS factory_code,
          nullif(['ST', 'TN', 'BP', 'QT', ''][l_partkey % 5 + 1], '') AS factory_order_code,
          'P' || l_partkey AS product_code, 'Part ' || l_partkey AS product_name,
          CASE WHEN l_partkey % 17 <> 0 THEN l_linestatus END AS qc,
          'W' || l_returnflag AS warehouse_code, '2201-' || l_orderkey || '-0001' AS order_code,
          l_quantity AS sales_quantity, 'Supplier ' || l_suppkey AS factory_name,
          'Rep' AS salesman
        FROM lineitem WHERE l_orderkey % 499 <> 0 AND {when[upload]}"""


_ORDER_SPLIT = """CASE WHEN factory_code <> '30895.2' OR factory_order_code IS NULL THEN factory_code
    WHEN factory_order_code IN ('QT', 'st-qt') THEN '30895.4'
    WHEN factory_order_code = 'BP' THEN '30895.5'
    WHEN factory_order_code = 'tn 7' THEN '30895' ELSE '30895.1' END"""
_SALES_SPLIT = """CASE WHEN factory_code <> '30895.2' OR factory_order_code IS NULL THEN factory_code
    ELSE map {'ST': '30895.1', 'TN': '30895', 'BP': '30895.5', 'QT': '30895.4'}
      [factory_order_code] END"""

_ORDER_SHOWN = ("order_date, order_code, factory_code, factory_order_code, product_code, "
                "product_name, qc, warehouse_type, order_quantity, delivered_quantity, "
                "estimated_delivery_date")
_ORDER_STAGED = _ORDER_SHOWN + ", factory_name, note, numerical_order, path"
_SALES_SHOWN = ("sales_date, sales_code, factory_code, factory_order_code, product_code, "
                "product_name, qc, warehouse_code, order_code, sales_quantity")
_SALES_STAGED = _SALES_SHOWN + ", factory_name, salesman"

_FIRST, _SECOND = "'2024-01-01 06:30:00'", "'2024-02-01 06:30:00'"


def _with(body: str, **steps: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in steps.items()) + "\n" + body


def _order_collapsed(source: str) -> str:
    """Copy 0 of each order with the quantities of the last copy."""
    return f"""SELECT a.* REPLACE (b.order_quantity AS order_quantity,
          b.delivered_quantity AS delivered_quantity)
        FROM (SELECT * FROM {source} WHERE NOT bad AND copy = 0) a JOIN
          (SELECT order_code, order_quantity, delivered_quantity FROM {source}
           WHERE copy = (SELECT max(copy) FROM {source})) b USING (order_code)"""


_ORDER_UPLOADS = {
    "lines1": _order_rows(1), "lines2": _order_rows(2),
    "first": _order_collapsed("lines1"), "second": _order_collapsed("lines2"),
}


def _order_upserted(first: str, second: str, columns: str) -> str:
    """Kept, changed and new rows as three branches."""
    replaced = ("second.order_quantity AS order_quantity, "
                "second.delivered_quantity AS delivered_quantity")
    return f"""SELECT {columns}, change FROM (
          SELECT *, 'kept' AS change FROM {first} WHERE order_code NOT IN (SELECT order_code FROM {second})
          UNION ALL BY NAME
          SELECT {first}.* REPLACE ({replaced.replace("second.", second + ".")}), 'updated' AS change
            FROM {first} JOIN {second} USING (order_code)
          UNION ALL BY NAME
          SELECT *, 'inserted' AS change FROM {second}
            WHERE order_code NOT IN (SELECT order_code FROM {first}))"""


def _order_fact(source: str) -> str:
    return f"""SELECT * REPLACE ({_ORDER_SPLIT} AS factory_code) FROM {source}
        WHERE order_code LIKE '2201-%' AND qc IS NOT NULL"""


def _sales_fact(source: str) -> str:
    return f"""SELECT * REPLACE ({_SALES_SPLIT} AS factory_code) FROM {source}
        WHERE sales_code NOT LIKE '2399-%' AND qc IS NOT NULL"""


def load_sql() -> dict[str, str]:
    sales_uploads = {"first": _sales_rows(1), "second": _sales_rows(2)}
    any_code = "(SELECT sales_code FROM first)"
    return {
        "order_extract_clean": _with(
            "SELECT " + _all_columns("order_staging", _ORDER_STAGED.split(", "),
                                     import_timestamp=_FIRST)
            + " FROM lines WHERE NOT bad", lines=_order_rows(0)),
        "order_extract_rejects": _with(
            "SELECT order_code, 'bad_quantity' AS reject_reason FROM lines WHERE bad",
            lines=_order_rows(0)),
        "sales_extract_clean": _with(f"SELECT {_SALES_STAGED} FROM lines", lines=_sales_rows(0)),
        "order_staging_reupload": _with(
            f"""SELECT *, CASE WHEN change = 'kept' THEN {_FIRST} ELSE {_SECOND} END
                AS import_timestamp FROM done""",
            **_ORDER_UPLOADS, done=_order_upserted("first", "second", _ORDER_STAGED)),
        "sales_staging_reupload": _with(
            f"""SELECT {_SALES_STAGED}, 'kept' AS change, {_FIRST} AS import_timestamp FROM first
                UNION ALL SELECT {_SALES_STAGED}, 'inserted', {_SECOND} FROM second
                WHERE sales_code NOT IN {any_code}""", **sales_uploads),
        "staging_incremental_read": _with(
            f"""SELECT {_ORDER_SHOWN}, {_SECOND} AS import_timestamp FROM done
                WHERE change <> 'kept'""",
            **_ORDER_UPLOADS, done=_order_upserted("first", "second", _ORDER_STAGED)),
        "order_fact_load": _with("SELECT " + _all_columns(
            "fact_order", _ORDER_SHOWN.split(", "), import_timestamp=_FIRST,
            import_wh_timestamp=_FIRST) + " FROM fact", lines=_order_rows(0),
                                 good="SELECT * FROM lines WHERE NOT bad", fact=_order_fact("good")),
        "order_fact_rejects": _with(
            """SELECT order_code, CASE WHEN order_code LIKE '2202-%' THEN 'other_document'
                ELSE 'missing_qc' END AS reject_reason FROM lines
                WHERE NOT bad AND (order_code LIKE '2202-%' OR qc IS NULL)""", lines=_order_rows(0)),
        "sales_fact_load": _with("SELECT " + _all_columns(
            "fact_sales", [*_SALES_SHOWN.split(", "), "salesman"], import_timestamp=_FIRST,
            import_wh_timestamp=_FIRST) + " FROM fact", lines=_sales_rows(0),
                                 fact=_sales_fact("lines")),
        "sales_fact_rejects": _with(
            """SELECT sales_code, CASE WHEN sales_code LIKE '2399-%' THEN 'other_document'
                ELSE 'missing_qc' END AS reject_reason FROM lines
                WHERE sales_code LIKE '2399-%' OR qc IS NULL""", lines=_sales_rows(0)),
        "order_fact_reload": _with(
            f"""SELECT *, CASE WHEN change = 'inserted' THEN {_SECOND} ELSE {_FIRST} END
                  AS import_timestamp,
                CASE WHEN change = 'kept' THEN {_FIRST} ELSE {_SECOND} END AS import_wh_timestamp
                FROM done""",
            **_ORDER_UPLOADS, fact1=_order_fact("first"), fact2=_order_fact("second"),
            done=_order_upserted("fact1", "fact2", _ORDER_SHOWN)),
        "sales_fact_reload": _with(
            f"""SELECT a.* EXCLUDE (factory_name, salesman) REPLACE (
                  coalesce(b.sales_quantity, a.sales_quantity) AS sales_quantity),
                CASE WHEN b.sales_code IS NULL THEN 'kept' ELSE 'updated' END AS change,
                {_FIRST} AS import_timestamp,
                CASE WHEN b.sales_code IS NULL THEN {_FIRST} ELSE {_SECOND} END
                  AS import_wh_timestamp
                FROM fact1 a LEFT JOIN fact2 b ON a.sales_code = b.sales_code
                UNION ALL SELECT * EXCLUDE (factory_name, salesman), 'inserted', {_SECOND}, {_SECOND}
                FROM fact2 WHERE sales_code NOT IN (SELECT sales_code FROM fact1)""",
            **sales_uploads, fact1=_sales_fact("first"), fact2=_sales_fact("second")),
        "dim_factory_refresh": _sql(
            "dim_factory",
            """SELECT DISTINCT ON (factory_code) factory_code, factory_name,
                'Unassigned' AS salesman, TRUE AS is_active, FALSE AS has_onsite FROM lines
                WHERE NOT bad AND factory_code NOT IN (SELECT factory_code FROM dim_factory)
                ORDER BY factory_code, order_date DESC NULLS LAST, order_code DESC""",
            lines=_order_rows(0)),
        "dim_product_refresh": _sql(
            "dim_product",
            """SELECT DISTINCT product_name, CAST(NULL AS VARCHAR) AS product_type,
                CAST(NULL AS VARCHAR) AS qc FROM lines
                WHERE NOT bad AND product_name NOT IN (SELECT product_name FROM dim_product)""",
            lines=_order_rows(0)),
    }


# A correction sets every tenth order's quantity five higher; sales that are there stay.
_LANDED = _with(
    """SELECT 'refused' AS kind, 'short-0.csv column_count' AS code, CAST(NULL AS DOUBLE) AS quantity,
          CAST(NULL AS DATE) AS day FROM range(2)
        UNION ALL SELECT 'sales', sales_code, sales_quantity, sales_date FROM sales
        UNION ALL SELECT 'order', order_code,
          order_quantity + CASE WHEN order_code LIKE '%0-0001' THEN 5 ELSE 0 END, order_date
          FROM orders_made""",
    lines=_sales_rows(0), sales=_sales_fact("lines"), rows=_order_rows(0),
    good="SELECT * FROM rows WHERE NOT bad", orders_made=_order_fact("good"))


def run_sql() -> dict[str, str]:
    """Whole loads end where the set-based steps end; counts come from the source rows."""
    loads = load_sql()
    sales = {"first": _sales_rows(1), "second": _sales_rows(2)}
    added = "SELECT * FROM second WHERE sales_code NOT IN (SELECT sales_code FROM first)"
    orders = {**_ORDER_UPLOADS, "fact1": _order_fact("first"), "fact2": _order_fact("second")}
    fresh = "SELECT factory_code, factory_name, order_date, order_code FROM {}"
    return {
        "order_load": f"SELECT * EXCLUDE (change) FROM ({loads['order_fact_reload']})",
        "order_load_dimensions": _sql(
            "dim_factory",
            f"""SELECT * FROM dim_factory UNION ALL (
                SELECT factory_code, first(factory_name ORDER BY upload, order_date DESC NULLS LAST,
                  order_code DESC), 'Unassigned', TRUE, FALSE
                FROM (SELECT *, 1 AS upload FROM ({fresh.format("first")}) UNION ALL
                  SELECT *, 2 FROM ({fresh.format("second")}))
                WHERE factory_code NOT IN (SELECT factory_code FROM dim_factory)
                GROUP BY factory_code)""", **_ORDER_UPLOADS),
        "order_load_counts": _with(
            """SELECT CAST((SELECT count(*) FROM first) + (SELECT count(*) FROM second
                  WHERE order_code NOT IN (SELECT order_code FROM first)) AS BIGINT)
                  AS staging_inserted,
                (SELECT count(*) FROM second SEMI JOIN first USING (order_code)) AS staging_updated,
                (SELECT count(*) FROM lines2 WHERE NOT bad) - (SELECT count(*) FROM second)
                  AS staging_skipped,
                (SELECT count(*) FROM lines1 WHERE bad) + (SELECT count(*) FROM lines2 WHERE bad)
                  AS staging_rejected,
                (SELECT count(*) FROM lines1 WHERE NOT bad AND order_date IS NULL) + (SELECT count(*)
                  FROM lines2 WHERE NOT bad AND order_date IS NULL) AS staging_bad_dates,
                (SELECT count(*) FROM fact1) + (SELECT count(*) FROM fact2 ANTI JOIN fact1
                  USING (order_code)) AS fact_inserted,
                (SELECT count(*) FROM fact2 SEMI JOIN fact1 USING (order_code)) AS fact_updated,
                (SELECT count(*) FROM first) + (SELECT count(*) FROM second)
                  - (SELECT count(*) FROM fact1) - (SELECT count(*) FROM fact2) AS fact_rejected,
                (SELECT count(DISTINCT factory_code) FROM (FROM first UNION ALL BY NAME FROM second)
                  WHERE factory_code NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier))
                  AS factories_added,
                (SELECT count(DISTINCT product_name) FROM (FROM first UNION ALL BY NAME FROM second))
                  AS products_added""", **orders),
        "sales_load": _with(
            f"""SELECT {_SALES_SHOWN}, {_FIRST} AS import_timestamp FROM fact1
                UNION ALL SELECT {_SALES_SHOWN}, {_SECOND} FROM fact2""",
            **sales, added=added, fact1=_sales_fact("first"), fact2=_sales_fact("added")),
        "sales_load_counts": _with(
            """SELECT (SELECT count(*) FROM first) + (SELECT count(*) FROM added)
                  AS staging_inserted, CAST(0 AS BIGINT) AS staging_updated,
                (SELECT count(*) FROM second) - (SELECT count(*) FROM added) AS staging_skipped,
                (SELECT count(*) FROM lineitem WHERE l_orderkey % 499 = 0 AND l_shipdate <
                  DATE '1999-01-01') + (SELECT count(*) FROM lineitem WHERE l_orderkey % 499 = 0
                  AND l_shipdate >= DATE '1998-01-01') AS staging_rejected,
                (SELECT count(*) FROM first WHERE sales_date IS NULL) + (SELECT count(*) FROM second
                  WHERE sales_date IS NULL) AS staging_bad_dates,
                (SELECT count(*) FROM fact1) + (SELECT count(*) FROM fact2) AS fact_inserted,
                CAST(0 AS BIGINT) AS fact_updated,
                (SELECT count(*) FROM first) + (SELECT count(*) FROM added)
                  - (SELECT count(*) FROM fact1) - (SELECT count(*) FROM fact2) AS fact_rejected,
                CAST(0 AS BIGINT) AS factories_added, CAST(0 AS BIGINT) AS products_added""",
            **sales, added=added, fact1=_sales_fact("first"), fact2=_sales_fact("added")),
        "landing_refusals": """SELECT * FROM (VALUES ('empty.csv', 'empty_file'), ('notes-0.txt', 'wrong_suffix'),
                ('short-0.csv', 'column_count')) AS refused(file, reject_reason)
            UNION ALL SELECT 'rows read', CAST(count(*) AS VARCHAR) FROM lineitem""",
        "landed_sales_stream": _with(f"SELECT {_SALES_SHOWN} FROM fact", lines=_sales_rows(0),
                                     fact=_sales_fact("lines")),
        "landed_files_one_trigger": _LANDED,
        "landed_files_many_triggers": _LANDED,
    }


_FACTORY_ASKS = f"""SELECT s_suppkey * 2 + c AS seq, {_known_or_not("s_suppkey")} AS factory_code,
      CASE WHEN s_suppkey % 20 <> 9 OR c = 1 THEN 'New ' || s_suppkey || ' ' || c END AS factory_name,
      'Rep' AS salesman, s_suppkey % 2 = 0 AS is_active, FALSE AS has_onsite
    FROM supplier, range(2) r(c)"""
_FACTORY_INSERT = {
    "asks": _FACTORY_ASKS,
    "judged": """SELECT *, CASE WHEN factory_name IS NULL THEN 'invalid'
          WHEN factory_code IN (SELECT factory_code FROM dim_factory) OR seq > (
            SELECT min(seq) FROM asks b WHERE b.factory_code = asks.factory_code
            AND b.factory_name IS NOT NULL) THEN 'exists' ELSE 'created' END AS outcome FROM asks""",
}

_FACTORY_PATCH = {
    "p": f"""SELECT s_suppkey AS k, c, {_known_or_not("s_suppkey")} AS factory_code,
          CASE WHEN (s_suppkey + c) % 3 = 0 THEN s_suppkey % 2 = 0 END AS a,
          CASE WHEN (s_suppkey + c) % 4 = 0 THEN s_suppkey % 2 = 1 END AS o
        FROM supplier, range(2) r(c)""",
}

_RETAILER_INSERT = {
    "asks": """SELECT c_custkey AS seq, CASE c_custkey % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN ''
          WHEN 2 THEN 'SHOP ' || (c_custkey + 1) ELSE 'Shop ' || c_custkey END AS name FROM customer""",
    "judged": """SELECT seq, name, CASE WHEN name = '' THEN 'invalid'
          WHEN lower(name) IN (SELECT lower(name) FROM dim_retailer) OR row_number() OVER (
            PARTITION BY lower(name) ORDER BY seq) > 1 THEN 'exists' ELSE 'created' END AS outcome
        FROM asks""",
    "made": """SELECT seq, name, outcome, CASE WHEN outcome = 'created' THEN
          regexp_replace(md5('batch-1:' || lower(name)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$',
            '\\1-\\2-\\3-\\4-\\5') END AS id FROM judged""",
}

_RENAME = {
    "asks": """SELECT c_custkey * 2 + c AS seq,
          CASE WHEN c_custkey % 7 = 5 THEN 'x' ELSE '' END || c_custkey AS id,
          CASE c_custkey % 6 WHEN 0 THEN upper(c_name)
            WHEN 1 THEN 'customer#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0')
            WHEN 2 THEN '' WHEN 3 THEN 'Team ' || (c_custkey // 12)
            ELSE 'Store ' || c_custkey || ' ' || c END AS name
        FROM customer, range(2) r(c)""",
    "early": """SELECT a.*, CASE WHEN a.name = '' THEN 'invalid' WHEN d.id IS NULL THEN 'not_found'
          WHEN a.seq % 2 = 0 THEN 'superseded'
          WHEN EXISTS (FROM dim_retailer o WHERE lower(o.name) = lower(a.name) AND o.id <> a.id)
            THEN 'name_taken' ELSE 'updated' END AS so_far
        FROM asks a LEFT JOIN dim_retailer d USING (id)""",
    "judged": """SELECT seq, id, name, CASE WHEN so_far = 'updated' AND row_number() OVER (
          PARTITION BY lower(name), so_far ORDER BY seq) > 1 THEN 'name_taken' ELSE so_far END
          AS outcome FROM early""",
}

_BLUEPRINT_PATCH = {
    "asks": """SELECT p_partkey * 2 + c AS seq,
          CASE WHEN p_partkey % 8 = 7 THEN 'x' ELSE '' END || p_partkey AS id,
          CASE WHEN (p_partkey + c) % 3 = 0 THEN upper(p_name) END AS name,
          CASE (p_partkey + c) % 5 WHEN 0 THEN 'ROLLER' WHEN 1 THEN 'BELT' END AS type,
          CASE WHEN (p_partkey + c) % 4 = 0 THEN 'checked' END AS description
        FROM part, range(2) r(c)""",
    "judged": """SELECT *, CASE WHEN type = 'BELT' THEN 'invalid' WHEN id LIKE 'x%' THEN 'not_found'
          WHEN name IS NULL AND type IS NULL AND description IS NULL THEN 'empty'
          ELSE 'updated' END AS outcome FROM asks""",
}


def _latest(column: str) -> str:
    return (f"coalesce((SELECT last({column} ORDER BY seq) FROM judged j WHERE j.id = blueprint.id "
            f"AND outcome = 'updated' AND j.{column} IS NOT NULL), {column}) AS {column}")


_BLUEPRINT_INSERT = {
    "asks": f"""SELECT p_partkey AS seq, {_known_or_not("(p_partkey % 100)")} AS factory, p_name AS name,
          CASE WHEN p_partkey % 11 = 0 THEN 'BELT' ELSE 'HANGING' END AS type,
          p_brand AS description,
          p_name || CASE WHEN p_partkey % 13 = 0 THEN '.png' ELSE '.SVG' END AS filename,
          p_partkey * 100000 AS file_size FROM part""",
    "judged": """SELECT *, CASE WHEN type = 'BELT' THEN 'invalid_type'
          WHEN filename LIKE '%.png' THEN 'not_svg' WHEN seq % 17 = 0 THEN 'wrong_content_type'
          WHEN factory NOT IN (SELECT factory_code FROM dim_factory) THEN 'unknown_factory'
          WHEN file_size > 104857600 THEN 'too_large' ELSE 'created' END AS outcome FROM asks""",
    "made": """SELECT *, CASE WHEN outcome = 'created' THEN regexp_replace(md5('batch-1:' || seq),
          '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS id FROM judged""",
}


def dimension_sql() -> dict[str, str]:
    def paged(tables: str, source: str, order: str, number: int, size: int) -> str:
        return _sql(tables, f"""SELECT * EXCLUDE (rank) FROM (
              SELECT *, count(*) OVER () AS total_count, row_number() OVER (ORDER BY {order}) AS rank
              FROM ({source})) WHERE rank > {(number - 1) * size} AND rank <= {number * size}""")

    return {
        "factory_list": _sql("dim_factory", """SELECT * FROM dim_factory WHERE is_active AND (
            regexp_matches(factory_name, '.1') OR regexp_matches(factory_code, '.1'))"""),
        "factory_list_page": paged("dim_factory", "SELECT * FROM dim_factory WHERE NOT has_onsite",
                                   "factory_code", 2, 7),
        "product_list": _sql("dim_product", """SELECT * FROM dim_product WHERE
            product_type IN ('ECONOMY', 'PROMO') AND contains(lower(product_name), 'ring')"""),
        "product_list_page": paged("dim_product",
                                   "SELECT * FROM dim_product WHERE product_type = 'LARGE'", "id", 3, 50),
        "product_list_count": _sql("dim_product", """SELECT count(*) AS count FROM dim_product
            WHERE contains(product_name, 'bolt')"""),
        "material_list": _sql("bridge_product_material dim_material",
                              "SELECT * FROM dim_material WHERE name LIKE 'material-1%'"),
        "retailer_list": _sql("dim_retailer", """SELECT * FROM dim_retailer
            WHERE regexp_matches(name, '00.*7')"""),
        "retailer_list_page": paged("dim_retailer", "SELECT * FROM dim_retailer", "name", 2, 100),
        "formula_list": _sql("bridge_product_material", """SELECT * FROM bridge_product_material
            WHERE is_current AND material_name IN ('material-3', 'material-17')"""),
        "formula_list_after": _sql("bridge_product_material", """SELECT * FROM bridge_product_material
            WHERE (material_name, product_name, version_number) > ('material-17', 'm', 1)
            ORDER BY material_name, product_name, version_number LIMIT 40"""),
        "formula_list_page": paged("bridge_product_material", "SELECT * FROM bridge_product_material",
                                   "product_name, material_name, version_number", 4, 50),
        "blueprint_list": _sql("blueprint", """SELECT * EXCLUDE (made), CASE WHEN
            file_path LIKE '/app/media/%' THEN '/dw-media/' || substr(file_path, 12) END AS file_url
            FROM blueprint WHERE factory = '42'"""),
        "blueprint_list_all": _sql("blueprint", """SELECT id, factory, type, CASE WHEN
            CAST(id AS INT) % 50 <> 7 THEN '/dw-media/blueprints/' || id || '.svg' END AS file_url
            FROM blueprint"""),
        "factory_lookup": _sql("dim_factory", f"""SELECT code AS factory_code,
            factory_name, salesman, is_active, has_onsite, factory_name IS NOT NULL AS found
            FROM (SELECT {_known_or_not("s_suppkey")} AS code FROM supplier)
            LEFT JOIN dim_factory ON factory_code = code"""),
        "blueprint_lookup": _sql("blueprint", """SELECT asked.id, name, type, file_size, CASE WHEN
            file_path LIKE '/app/media/%' THEN '/dw-media/' || substr(file_path, 12) END AS file_url,
            blueprint.id IS NOT NULL AS found FROM (SELECT DISTINCT id FROM asks) asked
            LEFT JOIN blueprint ON blueprint.id = asked.id""", **_BLUEPRINT_PATCH),
        "factory_insert": _sql("dim_factory", """SELECT * FROM dim_factory UNION ALL BY NAME
            SELECT * EXCLUDE (seq, outcome) FROM judged WHERE outcome = 'created'""",
                               **_FACTORY_INSERT),
        "factory_insert_outcomes": _sql("dim_factory", "SELECT seq, factory_code, outcome FROM judged",
                                        **_FACTORY_INSERT),
        "factory_patch": _sql("dim_factory", """SELECT f.* REPLACE (
              coalesce(y.a, x.a, is_active) AS is_active, coalesce(y.o, x.o, has_onsite) AS has_onsite)
            FROM dim_factory f LEFT JOIN p x ON x.factory_code = f.factory_code AND x.c = 0
            LEFT JOIN p y ON y.factory_code = f.factory_code AND y.c = 1""", **_FACTORY_PATCH),
        "factory_patch_outcomes": _sql("dim_factory", """SELECT k * 2 + c AS seq, factory_code,
            CASE WHEN factory_code NOT IN (SELECT factory_code FROM dim_factory) THEN 'not_found'
              WHEN a IS NULL AND o IS NULL THEN 'empty' ELSE 'updated' END AS outcome FROM p""",
                                       **_FACTORY_PATCH),
        "retailer_insert": _sql("dim_retailer", """SELECT id, name FROM dim_retailer UNION ALL
            SELECT id, name FROM made WHERE outcome = 'created'""", **_RETAILER_INSERT),
        "retailer_insert_outcomes": _sql("dim_retailer", "SELECT seq, name, id, outcome FROM made",
                                         **_RETAILER_INSERT),
        "retailer_rename": _sql("dim_retailer", """SELECT id, coalesce((SELECT max(name) FROM judged j
            WHERE j.id = d.id AND outcome = 'updated'), name) AS name FROM dim_retailer d""", **_RENAME),
        "retailer_rename_outcomes": _sql("dim_retailer", "SELECT seq, id, outcome FROM judged",
                                         **_RENAME),
        "retailer_delete": _sql("dim_retailer",
                                "SELECT * FROM dim_retailer WHERE CAST(id AS BIGINT) % 2 = 1"),
        "retailer_delete_outcomes": """SELECT c_custkey * 2 + c AS seq,
            CAST(c_custkey * 2 AS VARCHAR) AS id, CASE WHEN c = 0 AND c_custkey * 2 <=
              (SELECT max(c_custkey) FROM customer) THEN 'deleted' ELSE 'not_found' END AS outcome
            FROM customer, range(2) r(c)""",
        "blueprint_patch": _sql("blueprint", f"""SELECT * EXCLUDE (made) REPLACE ({_latest("name")},
            {_latest("type")}, {_latest("description")}) FROM blueprint""", **_BLUEPRINT_PATCH),
        "blueprint_patch_outcomes": _sql("blueprint", "SELECT seq, id, outcome FROM judged",
                                         **_BLUEPRINT_PATCH),
        "blueprint_insert": _sql("blueprint dim_factory", """SELECT * EXCLUDE (made) FROM blueprint
            UNION ALL BY NAME SELECT id, factory, name, type, description,
              '/app/media/blueprints/' || id || '.SVG' AS file_path, filename, file_size
            FROM made WHERE outcome = 'created'""", **_BLUEPRINT_INSERT),
        "blueprint_insert_outcomes": _sql("dim_factory", "SELECT seq, factory, id, outcome FROM made",
                                          **_BLUEPRINT_INSERT),
    }


def all_sql() -> dict[str, str]:
    return {**report_sql(), **load_sql(), **dimension_sql(), **run_sql()}
