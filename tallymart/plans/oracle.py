"""The registered queries again, as plain SQL for DuckDB over the same tables."""

from __future__ import annotations

from tallymart import schema
from tallymart.operators.questions import REMEMBERED
from tallymart.operators.trend import RECENT_DAYS
from tallymart.plans import registry
from tallymart.plans.registry import END, START

# --- shared pieces -----------------------------------------------------------------------

SALES = """sales AS (
    SELECT l_orderkey AS order_id, CAST(o_orderdate AS DATE) AS date, l_suppkey AS store_id,
           l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS qty,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS payment
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

STORES = """stores AS (
    SELECT s_suppkey AS store_id, s_name AS store_name, r_name AS category, n_name AS district
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""

PRODUCTS = """products AS (
    SELECT p_partkey AS product_id, p_name AS product_name, p_type AS product_category,
           p_retailprice AS unit_price
    FROM part)"""

STAR = f"{SALES}, {STORES}, {PRODUCTS}"

RAW_SALES = r"""dirty AS (
    SELECT l_orderkey AS k,
        CASE WHEN l_orderkey % 23 = 0 THEN ' o' || l_orderkey ELSE 'O' || l_orderkey END AS order_id,
        CASE WHEN l_orderkey % 211 = 0 THEN 'n/a'
             WHEN l_orderkey % 7 = 1 THEN strftime(o_orderdate, '%Y/%m/%d')
             WHEN l_orderkey % 7 = 2 THEN strftime(o_orderdate, '%Y.%m.%d')
             WHEN l_orderkey % 7 = 3 THEN strftime(o_orderdate, '%d-%m-%Y')
             WHEN l_orderkey % 7 = 4 THEN strftime(o_orderdate, '%d/%m/%Y')
             WHEN l_orderkey % 7 = 5 THEN strftime(o_orderdate, '%d.%m.%Y')
             ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
        CASE WHEN l_orderkey % 173 = 0 THEN 'S999999'
             WHEN l_orderkey % 31 = 0 THEN 's' || l_suppkey ELSE 'S' || l_suppkey END AS store_id,
        CASE WHEN l_partkey % 97 = 0 THEN 'P999999' ELSE 'P' || l_partkey END AS product_id,
        CASE WHEN l_partkey % 59 = 0 THEN '0' WHEN l_partkey % 61 = 0 THEN 'x'
             ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty,
        CASE WHEN l_partkey % 53 = 0 THEN NULL
             WHEN l_partkey % 47 = 0 THEN '-' || a
             WHEN l_partkey % 43 = 0 THEN '¥' || a
             WHEN l_partkey % 41 = 0 THEN '￥' || a
             WHEN l_partkey % 37 = 0 THEN 'bad'
             WHEN l_partkey % 29 = 0 AND length(a) > 6
             THEN substr(a, 1, length(a) - 6) || ',' || substr(a, length(a) - 5)
             ELSE a END AS amount,
        o_orderpriority AS payment
    FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS a FROM lineitem)
    JOIN orders ON l_orderkey = o_orderkey),
raw_sales AS (
    SELECT order_id, date, store_id, product_id, qty, amount, payment FROM dirty
    UNION ALL
    SELECT order_id, date, store_id, product_id, qty, amount, payment FROM dirty WHERE k % 17 = 0
    UNION ALL
    SELECT 'o' || k, date, store_id, product_id, qty, amount, payment FROM dirty WHERE k % 19 = 0)"""

RAW_DIMS = f"""{STORES}, raw_stores AS (
    SELECT 'S' || store_id AS store_id, store_name, category, district FROM stores),
raw_products AS (
    SELECT 'P' || p_partkey AS product_id, p_name AS product_name, p_type AS product_category,
           CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS unit_price
    FROM part)"""

RAW = f"{RAW_SALES}, {RAW_DIMS}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def ident(x: str) -> str:
    return f"upper({strip(x)})"


def date_of(x: str) -> str:
    t = strip(x)
    dashed = f"translate({t}, '/.', '--')"

    year_first = " OR ".join(
        f"regexp_matches({t}, '^\\d{{4}}{s}\\d{{1,2}}{s}\\d{{1,2}}$')" for s in ("-", "/", "\\.")
    )
    day_first = " OR ".join(
        f"regexp_matches({t}, '^\\d{{1,2}}{s}\\d{{1,2}}{s}\\d{{4}}$')" for s in ("-", "/", "\\.")
    )
    return (
        f"CASE WHEN {year_first} THEN CAST(try_strptime({dashed}, '%Y-%m-%d') AS DATE) "
        f"WHEN {day_first} THEN CAST(try_strptime({dashed}, '%d-%m-%Y') AS DATE) END"
    )


def date_year_first(x: str) -> str:
    dashed = f"translate({strip(x)}, '/.', '--')"
    return (
        f"CASE WHEN regexp_matches({dashed}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') "
        f"THEN CAST(try_strptime({dashed}, '%Y-%m-%d') AS DATE) END"
    )


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(x: str, kind: str = "DOUBLE") -> str:
    t = strip(x)
    return f"CASE WHEN regexp_matches({t}, '{_NUMBER}') THEN TRY_CAST({t} AS {kind}) END"


def money_text(x: str) -> str:
    return strip(f"replace(replace(replace({x}, '¥', ''), '￥', ''), ',', '')")


def money(x: str) -> str:
    return number(money_text(x), "DECIMAL(18,2)")


UNCHECKED = f"""{RAW}, sales AS (
    SELECT {ident('order_id')} AS order_id, {date_of('date')} AS date,
           {ident('store_id')} AS store_id, {ident('product_id')} AS product_id,
           CAST({number('qty')} AS BIGINT) AS qty, {money('amount')} AS amount, payment
    FROM raw_sales),
products AS (SELECT * FROM raw_products)"""

JUDGED = f"""{RAW}, distinct_raw AS (
    SELECT order_id, date, store_id, product_id, qty, amount, payment, COUNT(*) AS copies
    FROM raw_sales GROUP BY ALL),
cells AS (
    SELECT *, {ident('order_id')} AS c_order_id, {date_of('date')} AS c_date,
           {ident('store_id')} AS c_store_id, {ident('product_id')} AS c_product_id,
           {number('qty')} AS n_qty, {money('amount')} AS c_amount
    FROM distinct_raw),
judged AS (
    SELECT *, CAST(trunc(n_qty) AS BIGINT) AS c_qty,
        CASE WHEN c_date IS NULL THEN 'invalid_date'
             WHEN n_qty IS NULL OR n_qty <= 0 THEN 'invalid_qty'
             WHEN c_amount IS NULL OR c_amount <= 0 THEN 'invalid_amount'
             WHEN c_store_id NOT IN (SELECT store_id FROM raw_stores) THEN 'invalid_store'
             WHEN c_product_id NOT IN (SELECT product_id FROM raw_products)
             THEN 'invalid_product' END AS reject_reason
    FROM cells),
cleaned AS (
    SELECT DISTINCT c_order_id AS order_id, c_date AS date, c_store_id AS store_id,
           c_product_id AS product_id, c_qty AS qty, c_amount AS amount, payment
    FROM judged WHERE reject_reason IS NULL)"""

MEASURES = """CAST(SUM(amount) AS DOUBLE) AS revenue, CAST(SUM(qty) AS BIGINT) AS qty,
    COUNT(DISTINCT order_id) AS order_count"""


def average(total: str = "SUM(amount)", orders: str = "COUNT(DISTINCT order_id)") -> str:
    c, n = f"CAST({total} * 100 AS HUGEINT)", f"NULLIF({orders}, 0)"
    return f"CAST(sign({c}) * ((2 * abs({c}) + {n}) // (2 * {n})) AS BIGINT) / 100"


IN_RANGE = f"date >= DATE '{START}' AND date <= DATE '{END}'"


def with_(pieces: str, query: str) -> str:
    return f"WITH {pieces}\n{query}"


# --- audit -------------------------------------------------------------------------------


def metric(source: str, table: str, section: str, column: str | None, name: str, value: str) -> str:
    col = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    tail = f" FROM {source}" if source else ""
    return (
        f"SELECT '{table}' AS table_name, '{section}' AS section, {col} AS column_name, "
        f"'{name}' AS metric, CAST({value} AS VARCHAR) AS value{tail}"
    )


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def basic(source: str, table: str, columns: list[str]) -> list[str]:
    out = [
        metric(source, table, "basic_info", None, "row_count", "COUNT(*)"),
        metric("", table, "basic_info", None, "column_count", str(len(columns))),
    ]
    for i, c in enumerate(columns):
        out.append(metric("", table, "basic_info", c, "position", str(i)))
        t = strip(c)
        out.append(
            metric(
                source, table, "basic_info", c, "dtype",
                f"CASE WHEN COUNT({c}) = 0 THEN 'float64' "
                f"WHEN bool_and(regexp_matches({t}, '^[+-]?\\d+$')) AND COUNT({c}) = COUNT(*) THEN 'int64' "
                f"WHEN bool_and(regexp_matches({t}, '{_NUMBER}')) THEN 'float64' ELSE 'str' END",
            )
        )
    return out


def missing(source: str, table: str, columns: list[str]) -> list[str]:
    out = []
    for c in columns:
        nulls = f"COUNT(*) FILTER ({c} IS NULL)"
        out.append(metric(source, table, "missing_values", c, "missing_count", nulls))
        rate = (
            f"CAST(CAST((2 * {nulls} * 1000000 + COUNT(*)) // (2 * COUNT(*)) AS DECIMAL(20,0))"
            " * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(28,6))"
        )
        out.append(metric(source, table, "missing_values", c, "missing_rate", rate))
    return out


def dup_rows(source: str, table: str, columns: list[str]) -> list[str]:
    grouped = f"(SELECT COUNT(*) AS n FROM {source} GROUP BY {', '.join(columns)})"
    return [
        metric(grouped, table, "duplicate_rows", None, "row_count",
               "COALESCE(SUM(n) FILTER (n > 1), 0)::BIGINT")
    ]


def dup_keys(source: str, table: str, key: str) -> list[str]:
    grouped = f"(SELECT COUNT(*) AS n FROM {source} GROUP BY {key})"
    return [
        metric(grouped, table, "primary_key", key, "duplicate_count",
               "COALESCE(SUM(n) FILTER (n > 1), 0)::BIGINT")
    ]


def order_ids() -> list[str]:
    per_id = "(SELECT order_id, COUNT(*) AS n FROM raw_sales GROUP BY order_id)"
    m = lambda name, value, source=per_id: metric(source, "sales", "order_id", "order_id", name, value)
    return [
        m("exists", "'true'", ""),
        m("total_rows", "SUM(n)::BIGINT"),
        m("unique_order_ids", "COUNT(order_id)"),
        m("duplicate_order_id_value_count", "COUNT(order_id) FILTER (n > 1)"),
        m("duplicate_order_id_row_count", "COALESCE(SUM(n) FILTER (n > 1), 0)::BIGINT"),
    ]


def dates() -> list[str]:
    parsed = f"(SELECT {strip('date')} AS t, date, {date_of('date')} AS d FROM raw_sales)"
    m = lambda name, value, source=parsed: metric(source, "sales", "dates", "date", name, value)
    return [
        m("exists", "'true'", ""),
        m("total_count", "COUNT(*)"),
        m("unparseable_count", "COUNT(*) FILTER (d IS NULL)"),
        m("separator_-", "COUNT(*) FILTER (contains(t, '-'))"),
        m("separator_/", "COUNT(*) FILTER (NOT contains(t, '-') AND contains(t, '/'))"),
        m("separator_.", "COUNT(*) FILTER (NOT contains(t, '-') AND NOT contains(t, '/') AND contains(t, '.'))"),
        m("separator_other", "COUNT(*) FILTER (NOT regexp_matches(t, '[-/.]'))"),
        m("min_date", "MIN(d)"),
        m("max_date", "MAX(d)"),
    ]


def qtys() -> list[str]:
    parsed = f"(SELECT qty, {number('qty')} AS v FROM raw_sales)"
    m = lambda name, value, source=parsed: metric(source, "sales", "qty", "qty", name, value)
    return [
        m("exists", "'true'", ""),
        m("missing_count", "COUNT(*) FILTER (qty IS NULL)"),
        m("non_numeric_count", "COUNT(*) FILTER (v IS NULL AND qty IS NOT NULL)"),
        m("less_or_equal_zero_count", "COUNT(*) FILTER (v <= 0)"),
    ]


def amounts() -> list[str]:
    parsed = f"(SELECT amount, {number(money_text('amount'))} AS v FROM raw_sales)"
    m = lambda name, value, source=parsed: metric(source, "sales", "amount", "amount", name, value)
    return [
        m("exists", "'true'", ""),
        m("missing_count", "COUNT(*) FILTER (amount IS NULL)"),
        m("currency_symbol_count", "COUNT(*) FILTER (regexp_matches(amount, '[¥￥]'))"),
        m("non_numeric_count", "COUNT(*) FILTER (v IS NULL AND amount IS NOT NULL)"),
        m("less_or_equal_zero_count", "COUNT(*) FILTER (v <= 0)"),
        m("negative_count", "COUNT(*) FILTER (v < 0)"),
        m("zero_count", "COUNT(*) FILTER (v = 0)"),
    ]


def foreign(key: str, dimension: str) -> list[str]:
    value = strip(f"COALESCE({key}, '')")
    bad = (
        f"(SELECT v, COUNT(*) AS n FROM (SELECT {value} AS v FROM raw_sales) "
        f"WHERE v NOT IN (SELECT {key} FROM {dimension}) GROUP BY v)"
    )
    m = lambda name, v, source: metric(source, "sales", "foreign_keys", key, name, v)
    return [
        m("exists", "'true'", ""),
        m("reference_column_exists", "'true'", ""),
        m("invalid_count", "COALESCE(SUM(n), 0)::BIGINT", bad),
        f"SELECT 'sales', 'foreign_keys', '{key}', 'invalid_value ' || v, CAST(n AS VARCHAR) FROM {bad}",
    ]


def dimension(source: str, table: str, columns: list[str], key: str) -> list[str]:
    return (
        basic(source, table, columns)
        + missing(source, table, columns)
        + dup_rows(source, table, columns)
        + dup_keys(source, table, key)
    )


_SALES_COLUMNS = schema.SALES_COLUMNS
_DIMS = dimension("raw_stores", "stores", schema.STORE_COLUMNS, "store_id") + dimension(
    "raw_products", "products", schema.PRODUCT_COLUMNS, "product_id"
)
_SALES_AUDIT = (
    basic("raw_sales", "sales", _SALES_COLUMNS)
    + missing("raw_sales", "sales", _SALES_COLUMNS)
    + dates()
    + qtys()
    + amounts()
    + dup_rows("raw_sales", "sales", _SALES_COLUMNS)
    + order_ids()
    + foreign("store_id", "raw_stores")
    + foreign("product_id", "raw_products")
)


def catalog(tables: dict[str, list[tuple[str, str]]]) -> str:
    parts = []
    for table, columns in tables.items():
        for i, (column, kind) in enumerate(columns):
            parts.append(
                f"SELECT '{table}' AS table_name, CAST({i} AS BIGINT) AS position, "
                f"'{column}' AS column_name, '{kind}' AS data_type, "
                f"COUNT({column}) AS filled_rows, COUNT(*) AS row_count FROM {table}"
            )
    return union(parts)


_SAMPLE_CATALOG = {
    "sales": [
        ("order_id", "bigint"), ("date", "date"), ("store_id", "bigint"), ("product_id", "bigint"),
        ("qty", "bigint"), ("amount", "decimal(18,2)"), ("payment", "string"),
    ],
    "stores": [
        ("store_id", "bigint"), ("store_name", "string"), ("category", "string"),
        ("district", "string"),
    ],
    "products": [
        ("product_id", "bigint"), ("product_name", "string"), ("product_category", "string"),
        ("unit_price", "double"),
    ],
}
_LOADED_CATALOG = {
    table: [
        (column, "string" if column.endswith("_id") else kind) for column, kind in columns
    ]
    for table, columns in _SAMPLE_CATALOG.items()
}

# --- constraints -------------------------------------------------------------------------


def constraint_rows() -> str:
    parts = []

    def add(table: str, rule: str, column: str, query: str) -> None:
        parts.append(
            f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{column}' AS column_name, "
            f"CAST(({query}) AS BIGINT) AS violations"
        )

    for column in ["order_id", "date", "store_id", "product_id", "qty", "amount"]:
        add("sales", "not_null", column, f"SELECT COUNT(*) FROM sales WHERE {column} IS NULL")
    for table, source, key, name in [
        ("stores", "raw_stores", "store_id", "store_name"),
        ("products", "raw_products", "product_id", "product_name"),
    ]:
        add(table, "not_null", name, f"SELECT COUNT(*) FROM {source} WHERE {name} IS NULL")
        add(table, "unique", key, f"SELECT COUNT({key}) - COUNT(DISTINCT {key}) FROM {source}")
        add(
            "sales", "reference", key,
            f"SELECT COUNT(*) FROM sales s LEFT JOIN {source} d ON s.{key} = d.{key} "
            f"WHERE d.{key} IS NULL AND s.{key} IS NOT NULL",
        )
    return union(parts)


# --- name resolution ---------------------------------------------------------------------


def resolution(typed: str, source: str, column: str, suffix: str = "", aliases: list[str] = ()) -> str:
    bare = (lambda x: f"replace({x}, '{suffix}', '')") if suffix else (lambda x: x)
    listed = ", ".join(f"'{a}'" for a in aliases) or "NULL"
    t, n = bare("target"), bare("lower(name)")
    return f"""WITH {STORES}, {PRODUCTS}, typed AS (SELECT DISTINCT input FROM ({typed})),
keyed AS (SELECT input, lower(trim(input)) AS target FROM typed WHERE length(input) > 0),
names AS (SELECT DISTINCT {column} AS name FROM {source} WHERE {column} IS NOT NULL),
candidates AS (
    SELECT input, name,
        CASE WHEN lower(name) = target THEN 1
             WHEN {t} IN ({listed}) AND {n} IN ({listed}) THEN 2
             WHEN contains({n}, {t}) OR contains({t}, {n}) THEN 3 END AS pass
    FROM keyed, names),
ranked AS (
    SELECT input, name,
           row_number() OVER (PARTITION BY input ORDER BY pass, length(name) DESC, name) AS r
    FROM candidates WHERE pass IS NOT NULL)
SELECT t.input, r.name AS resolved
FROM typed t LEFT JOIN ranked r ON t.input = r.input AND r.r = 1"""


def words(column: str, listed: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in listed) + ")"


def union_inputs(table: str, expressions: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {e} AS input FROM {table}" for e in expressions)


_Q = registry.QUESTION_WORDS
_BEVERAGE = f"{words('text', _Q['beverage_words'])} AND {words('text', _Q['ranking_words'])}"
_RANKING = f"(({_BEVERAGE}) OR {words('text', _Q['product_phrases'])})"
ASKED = "asked AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"

DAILY = f"""daily AS (
    SELECT date, CAST(SUM(amount) AS DOUBLE) AS revenue, COUNT(DISTINCT order_id) AS order_count,
           {average()} AS average_order_value
    FROM sales WHERE date IS NOT NULL GROUP BY date)"""


def verdict(daily: str) -> str:
    return f"""SELECT CASE WHEN days < 2 THEN 'insufficient' WHEN z > a THEN 'up'
            WHEN z < a THEN 'down' ELSE 'flat' END AS trend,
       CASE WHEN days >= 2 THEN a END AS first_value, CASE WHEN days >= 2 THEN z END AS last_value,
       CASE WHEN days >= 2
            THEN CAST(abs(CAST(z AS DECIMAL(18,2)) - CAST(a AS DECIMAL(18,2))) AS DOUBLE)
            END AS change,
       days
FROM (SELECT arg_min(average_order_value, date) AS a, arg_max(average_order_value, date) AS z,
             COUNT(*) AS days
      FROM {daily} WHERE average_order_value IS NOT NULL)"""


def ranking(keys: str, joins: str, where: str, order: str, limit: int) -> str:
    return with_(
        STAR,
        f"SELECT {keys}, {MEASURES} FROM sales {joins} WHERE {where} "
        f"GROUP BY {keys} ORDER BY {order} LIMIT {limit}",
    )


P_KEYS = "product_id, product_name, product_category"
P_JOIN = "JOIN products USING (product_id)"

# The name patterns below are what the registered queries' inputs resolve to by hand:
# the longest name that contains the input or is contained in it, first in name order.
LONGEST_BLUE = """(SELECT product_name FROM products WHERE contains(lower(product_name), 'blue')
    OR contains('blue', lower(product_name)) ORDER BY length(product_name) DESC, product_name LIMIT 1)"""
LONGEST_PLATE = """(SELECT product_name FROM products
    WHERE contains('hot plate, please', lower(product_name))
    OR contains(lower(product_name), 'hot plate, please')
    ORDER BY length(product_name) DESC, product_name LIMIT 1)"""

_AMOUNT_DOUBLE = "order_id, date, store_id, product_id, qty, CAST(amount AS DOUBLE) AS amount, payment"




def _literal(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


def _drawn(values: list, step: int) -> str:
    place = f"(conv_id * {step} + turn * {step + 2} + length(text)) % {len(values)} + 1"
    return f"([{', '.join(map(_literal, values))}])[CAST({place} AS BIGINT)]"


def _day(values: list, step: int) -> str:
    return f"CAST({_drawn([registry.TYPED_DATES[v] for v in values], step)} AS DATE)"


def _meant(field: str, table: str, column: str) -> str:
    """Typed names and the name each means: equal, else containing or contained; the longest, then the first."""
    return f"""{field}_meant AS (
    SELECT typed AS {field}, lower(name) AS meant FROM (
        SELECT typed, name, row_number() OVER (PARTITION BY typed ORDER BY
            CASE WHEN lower(name) = lower(trim(typed)) THEN 1 ELSE 2 END, length(name) DESC, name) AS r
        FROM (SELECT DISTINCT {field} AS typed FROM plan WHERE {field} <> '')
        JOIN (SELECT DISTINCT {column} AS name FROM {table})
            ON contains(lower(name), lower(trim(typed))) OR contains(lower(trim(typed)), lower(name)))
    WHERE r = 1)"""


def question_answers() -> str:
    fired = f"(({_RANKING}) OR ({words('text', _Q['aov_words'])}))"

    def unless(value: str) -> str:
        return f"CASE WHEN NOT {fired} THEN {value} END"

    dates = list(registry.TYPED_DATES)
    plan = f"""plan AS (SELECT conv_id, turn,
        CASE WHEN {_RANKING} THEN 'product_rank' WHEN {fired} THEN 'aov_trend' ELSE {_drawn(registry.TOOLS, 1)} END AS tool,
        CASE WHEN {fired} THEN FALSE ELSE coalesce({_drawn(['asc', 'desc', None], 2)}, '') = 'asc' END AS up,
        CASE WHEN {fired} THEN 1 ELSE greatest(1, length(text) % 9 - 1) END AS most,
        CASE WHEN {_BEVERAGE} THEN '{_Q['beverage_category']}' ELSE {unless(_drawn(registry.TYPED_CATEGORIES, 3))} END AS category,
        {unless(_drawn(registry.TYPED_PRODUCTS, 4))} AS product_name, {unless(_drawn(registry.TYPED_STORES, 5))} AS store_name,
        {unless(_day(dates, 6))} AS d1, {unless(_day(dates[::-1], 7))} AS d2
    FROM asked)"""
    asks = """asks AS (SELECT conv_id, turn, tool, up, most, d1, d2, c.meant AS category, p.meant AS product, s.meant AS store
    FROM plan LEFT JOIN category_meant c USING (category) LEFT JOIN product_name_meant p USING (product_name)
    LEFT JOIN store_name_meant s USING (store_name))"""
    sold = "asks a JOIN sales s ON (d1 IS NULL OR date >= d1) AND (d2 IS NULL OR date <= d2)"
    who = "conv_id, turn, tool"

    def placed(inner: str, order: str, limit: bool) -> str:
        made = f"SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY {order}) AS position FROM ({inner})"
        cut = " WHERE position <= CASE WHEN tool LIKE '%rank' OR tool = 'product_quantity' THEN most ELSE position END"
        return f"SELECT * EXCLUDE (up, most) FROM ({made}){cut}" if limit else made

    ranked = "CASE WHEN tool LIKE '%rank' THEN CASE WHEN up THEN revenue ELSE -revenue END END"
    products = placed(
        f"""SELECT {who}, up, most, product_id, CAST(product_id AS VARCHAR) AS entity_id, product_name AS entity_name,
            CASE WHEN tool <> 'product_orders' THEN product_category END AS category, {MEASURES}
        FROM {sold} JOIN products USING (product_id)
        WHERE (tool = 'product_rank' AND (a.category IS NULL OR a.category = lower(product_category)))
           OR (tool = 'product_quantity' AND (a.category IS NULL OR a.category = lower(product_category))
               AND (a.product IS NULL OR a.product = lower(product_name)))
           OR (tool IN ('product_revenue', 'product_orders') AND a.product = lower(product_name))
        GROUP BY ALL""",
        f"CASE WHEN tool = 'product_quantity' THEN CASE WHEN up THEN qty ELSE -qty END END, {ranked}, product_id", True,
    )
    categories = placed(
        f"""SELECT {who}, up, most, product_category AS category, {MEASURES} FROM {sold} JOIN products USING (product_id)
        WHERE tool = 'category_rank' OR (tool = 'category_revenue' AND a.category = lower(product_category)) GROUP BY ALL""",
        f"{ranked}, category", True,
    )
    stores = placed(
        f"""SELECT {who}, up, most, store_id, CAST(store_id AS VARCHAR) AS entity_id, store_name AS entity_name, {MEASURES}
        FROM {sold} JOIN stores USING (store_id)
        WHERE tool = 'store_rank' OR (tool = 'store_revenue' AND a.store = lower(store_name)) GROUP BY ALL""",
        f"{ranked}, store_id", True,
    )
    daily = placed(
        f"""SELECT {who}, CAST(date AS VARCHAR) AS period, {average()} AS average_order_value, {MEASURES}
        FROM {sold} WHERE tool IN ('daily_sales', 'aov_trend') GROUP BY ALL""",
        "period", False,
    )
    monthly = placed(
        f"""SELECT {who}, strftime(date, '%Y-%m') AS period, {average()} AS average_order_value, {MEASURES}
        FROM {sold} WHERE tool = 'monthly_sales' GROUP BY ALL""",
        "period", False,
    )
    of_name = placed(
        f"""SELECT {who}, CASE WHEN tool = 'product_daily_sales' THEN CAST(date AS VARCHAR) ELSE strftime(date, '%Y-%m') END AS period,
            product_name AS entity_name, {MEASURES}
        FROM {sold} JOIN products USING (product_id)
        WHERE tool IN ('product_daily_sales', 'product_monthly_sales') AND a.product = lower(product_name) GROUP BY ALL""",
        "period, entity_name", False,
    )
    summary = f"""SELECT {who}, 1 AS position, (SELECT count(*) FROM sales) AS sales_rows, (SELECT count(*) FROM stores) AS store_count,
        (SELECT count(*) FROM products) AS product_count, (SELECT min(date) FROM sales) AS min_date, (SELECT max(date) FROM sales) AS max_date
        FROM asks WHERE tool = 'dataset_summary'"""
    parts = [
        f"(SELECT * EXCLUDE (product_id) FROM ({products}))", f"({categories})", f"(SELECT * EXCLUDE (store_id) FROM ({stores}))",
        f"(SELECT * EXCLUDE (qty) FROM ({daily}))", f"({monthly})", f"({of_name})", f"({summary})",
    ]
    meant = ", ".join([
        _meant("category", "products", "product_category"), _meant("product_name", "products", "product_name"), _meant("store_name", "stores", "store_name")
    ])
    return with_(f"{STAR}, {ASKED}, {plan}, {meant}, {asks}", "\nUNION ALL BY NAME ".join(parts))


def sql_catalog() -> str:
    """Columns and filled cells of the loaded tables."""
    return with_(
        JUDGED,
        "SELECT * FROM ("
        + catalog(_LOADED_CATALOG)
        .replace("FROM sales", "FROM cleaned")
        .replace("FROM stores", "FROM raw_stores")
        .replace("FROM products", "FROM raw_products")
        + ")",
    )


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["question_answers"] = question_answers()
    sql["orders_in_ranges"] = with_(
        SALES,
        f"""SELECT p_partkey, r.payment, first, last, count(s.payment) AS row_count,
            CAST(SUM(qty) AS BIGINT) AS qty, CAST(SUM(amount) AS DOUBLE) AS revenue, COUNT(DISTINCT o_custkey) AS order_count
        FROM (SELECT p_partkey, list[CAST(p_partkey % len(list) + 1 AS BIGINT)] AS payment,
                CASE WHEN p_partkey % 29 <> 0 THEN day END AS first,
                CASE WHEN p_partkey % 31 <> 0 THEN day + CAST(p_size * 9 - 20 AS INT) END AS last
              FROM (SELECT *, DATE '1995-01-01' + CAST(p_partkey * 37 % 2400 AS INT) AS day FROM part),
                   (SELECT list_sort(list(DISTINCT o_orderpriority)) AS list FROM orders)) r
        LEFT JOIN (SELECT s.*, o_custkey FROM sales s JOIN orders ON o_orderkey = order_id) s
            ON s.payment = r.payment AND (first IS NULL OR date >= first) AND (last IS NULL OR date <= last)
        GROUP BY ALL""",
    )
    sql["date_loose"] = """SELECT CAST(o_orderkey % 8 AS BIGINT) AS way, CAST(o_orderdate AS DATE) AS order_date,
        CASE WHEN o_orderkey % 8 = 7 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS read,
        COUNT(*) AS row_count FROM orders GROUP BY ALL"""

    sql["src_csv"] = with_(
        RAW_SALES,
        "SELECT order_id, NULLIF(date, 'n/a') AS date, store_id, product_id, qty, amount, payment FROM raw_sales",
    )
    required = ["sales.order_id", "sales.date", "sales.store_id", "sales.product_id", "sales.qty", "sales.amount",
                "stores.store_id", "stores.store_name", "products.product_id", "products.product_name"]
    names = ", ".join(f"'{r}'" for r in required)
    sql["catalog_tables"] = "WITH listed AS (" + sql_catalog() + f""")
        SELECT *, table_name || '.' || column_name IN ({names}) AS required FROM listed"""
    sql["clean_roundtrip"] = with_(
        JUDGED, f"SELECT {_AMOUNT_DOUBLE}, strftime(date, '%Y-%m') AS month FROM cleaned"
    )
    sql["load_tables"] = sql_catalog()
    sql["catalog_columns"] = with_(STAR, catalog(_SAMPLE_CATALOG))

    sql["audit_basic"] = with_(RAW, union(basic("raw_sales", "sales", _SALES_COLUMNS)))
    sql["audit_missing"] = with_(RAW, union(missing("raw_sales", "sales", _SALES_COLUMNS)))
    sql["audit_dup_rows"] = with_(RAW, union(dup_rows("raw_sales", "sales", _SALES_COLUMNS)))
    sql["audit_pk_dups"] = with_(RAW, union(dup_keys("raw_sales", "sales", "order_id")))
    sql["audit_order_id"] = with_(RAW, union(order_ids()))
    sql["audit_dates"] = with_(RAW, union(dates()))
    sql["audit_fk_store"] = with_(RAW, union(foreign("store_id", "raw_stores")))
    sql["audit_fk_product"] = with_(RAW, union(foreign("product_id", "raw_products")))
    sql["audit_qty"] = with_(RAW, union(qtys()))
    sql["audit_amount"] = with_(RAW, union(amounts()))
    sql["audit_dims"] = with_(RAW, union(_DIMS))
    sql["audit_report"] = with_(RAW, union(_SALES_AUDIT + _DIMS))

    unknown = " UNION ALL ".join(
        f"""SELECT 'sales' AS table_name, '{k}' AS column_name, {strip(f"coalesce({k}, '')")} AS value, COUNT(*) AS row_count
        FROM raw_sales WHERE {strip(f"coalesce({k}, '')")} NOT IN (SELECT {k} FROM {t}) GROUP BY ALL"""
        for k, t in (("store_id", "raw_stores"), ("product_id", "raw_products"))
    )
    ranked = f"""SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY row_count DESC, value) AS rank FROM ({unknown})"""
    sql["audit_ranked_values"] = with_(RAW, ranked)
    sql["audit_document"] = with_(
        f"{RAW}, ranked AS ({ranked})",
        f"""SELECT COUNT(*) AS sales_rows, '{','.join(schema.SALES_COLUMNS)}' AS sales_columns, 'str' AS qty_dtype,
            CAST(round(COUNT(*) FILTER (WHERE amount IS NULL) / COUNT(*), 6) AS DOUBLE) AS amount_missing_rate,
            (SELECT CAST(SUM(n) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM raw_sales GROUP BY order_id, date, store_id, product_id, qty, amount, payment) WHERE n > 1) AS duplicate_rows,
            (SELECT CAST(SUM(n) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM raw_sales GROUP BY order_id) WHERE n > 1) AS order_rows,
            COUNT(*) FILTER (WHERE contains(date, '.')) AS dotted_dates, CAST(MAX({date_of('date')}) AS VARCHAR) AS max_date,
            (SELECT CAST(SUM(row_count) AS BIGINT) FROM ranked WHERE column_name = 'store_id') AS unknown_stores,
            (SELECT string_agg(value || ':' || row_count, ',' ORDER BY rank) FROM ranked WHERE column_name = 'store_id' AND rank <= 3)
                AS first_unknown_stores,
            COUNT(*) FILTER (WHERE {money('amount')} < 0) AS negative_amounts, 'store_id' AS stores_key, CAST(0 AS BIGINT) AS product_copies
        FROM raw_sales""",
    )
    sql["clean_dedup"] = with_(RAW_SALES, "SELECT DISTINCT * FROM raw_sales")
    for key, column, cleaned in [
        ("clean_ids", "order_id", ident("order_id")),
        ("clean_dates", "date", date_of("date")),
        ("clean_amounts", "amount", f"CAST({money('amount')} AS DOUBLE)"),
        ("date_year_first", "date", date_year_first("date")),
    ]:
        sql[key] = with_(
            RAW_SALES,
            f"SELECT {column} AS raw_value, COUNT(*) AS row_count, {cleaned} AS clean_value "
            f"FROM raw_sales GROUP BY {column}",
        )
    sql["clean_fk_semi"] = with_(
        UNCHECKED,
        f"SELECT {_AMOUNT_DOUBLE} FROM sales "
        "WHERE store_id IN (SELECT store_id FROM raw_stores) "
        "AND product_id IN (SELECT product_id FROM raw_products)",
    )
    sql["clean_stores"] = with_(
        RAW_DIMS, "SELECT store_id, store_name, category, district FROM raw_stores"
    )
    sql["clean_products"] = with_(
        RAW_DIMS,
        "SELECT product_id, product_name, product_category, CAST(unit_price AS DOUBLE) AS unit_price "
        "FROM raw_products UNION ALL "
        "SELECT 'N' || product_id, product_name, product_category, NULL FROM raw_products",
    )
    sql["source_first_stores"] = with_(
        RAW_DIMS,
        """SELECT store_id, store_name, category, district FROM (
            SELECT upper(trim(store_id)) AS store_id, store_name, category, district,
                row_number() OVER (PARTITION BY upper(trim(store_id)) ORDER BY md5(store_id || store_name)) AS r
            FROM (SELECT * FROM raw_stores UNION ALL
                  SELECT ' ' || lower(store_id), '~' || store_name, category, district FROM raw_stores)) WHERE r = 1""",
    )
    sql["source_first_products"] = with_(
        RAW_DIMS,
        """SELECT product_id, product_name, product_category, unit_price, source_row FROM (
            SELECT upper(product_id) AS product_id, product_name, product_category, TRY_CAST(unit_price AS DOUBLE) AS unit_price, source_row,
                row_number() OVER (PARTITION BY upper(product_id) ORDER BY source_row) AS r
            FROM (SELECT *, row_number() OVER (ORDER BY md5(product_id || product_name)) AS source_row
                  FROM (SELECT * FROM raw_products UNION ALL
                        SELECT lower(product_id), product_name, product_category, 'n/a' FROM raw_products))) WHERE r = 1""",
    )
    quoted = [f"'\"' || coalesce({c}, '') || '\"'" for c in schema.SALES_COLUMNS]
    dirty_lines = f"""{RAW_SALES}, lines AS (SELECT *, {" || ',' || ".join(quoted)} AS line, {" || ',' || ".join(quoted[:5])} AS short FROM raw_sales)"""
    sql["source_malformed"] = with_(
        dirty_lines,
        """SELECT source_record, reject_reason, COUNT(*) AS copies FROM (
            SELECT CASE WHEN length(line) % 50 = 7 THEN line || ',"x"' ELSE short END AS source_record,
                CASE WHEN length(line) % 50 = 7 THEN 'surplus_cells' ELSE 'missing_cells' END AS reject_reason
            FROM lines WHERE length(line) % 50 IN (7, 8)) GROUP BY ALL""",
    )
    fitting = "SELECT * REPLACE (NULLIF(date, 'n/a') AS date) FROM lines WHERE length(line) % 50 NOT IN (7, 8)"
    sql["source_malformed_audit"] = with_(
        f"{dirty_lines}, fitting AS ({fitting})",
        union([
            metric("lines", "sales", "malformed_rows", None, reason, f"COUNT(*) FILTER (WHERE length(line) % 50 = {k})")
            for reason, k in (("surplus_cells", 7), ("missing_cells", 8), ("unreadable", 50))
        ] + missing("fitting", "sales", schema.SALES_COLUMNS)),
    )
    sql["once_sales"] = with_(JUDGED, f"SELECT {_AMOUNT_DOUBLE}, strftime(date, '%Y-%m') AS month FROM cleaned")
    sql["sales_clean"] = with_(JUDGED, f"SELECT {_AMOUNT_DOUBLE} FROM cleaned")
    stages = ["invalid_date", "invalid_qty", "invalid_amount", "invalid_store", "invalid_product"]
    sql["clean_funnel"] = with_(
        JUDGED,
        "SELECT 'in' AS stage, COUNT(*) AS row_count FROM raw_sales UNION ALL "
        "SELECT 'raw_duplicates', (SELECT COUNT(*) FROM raw_sales) - COUNT(*) FROM distinct_raw UNION ALL "
        + " UNION ALL ".join(
            f"SELECT '{s}', COUNT(*) FROM judged WHERE reject_reason = '{s}'" for s in stages
        )
        + " UNION ALL SELECT 'final_duplicates', COUNT(*) - (SELECT COUNT(*) FROM cleaned) "
        "FROM judged WHERE reject_reason IS NULL UNION ALL SELECT 'out', COUNT(*) FROM cleaned",
    )
    sql["clean_rejects"] = with_(
        JUDGED,
        "SELECT order_id, date, store_id, product_id, qty, amount, payment, copies, reject_reason "
        "FROM judged WHERE reject_reason IS NOT NULL",
    )

    sql["once_funnel"], sql["once_rejects"] = sql["clean_funnel"], sql["clean_rejects"]
    sql["verify_constraints"] = with_(UNCHECKED, constraint_rows())
    sql["verify_counts"] = with_(
        JUDGED,
        "SELECT 'sales' AS table_name, COUNT(*) AS row_count FROM cleaned UNION ALL "
        "SELECT 'stores', COUNT(*) FROM raw_stores UNION ALL "
        "SELECT 'products', COUNT(*) FROM raw_products",
    )
    sql["verify_orphans"] = with_(
        UNCHECKED,
        "SELECT 'stores' AS dimension, COUNT(*) AS orphan_rows FROM sales s "
        "LEFT JOIN raw_stores d ON s.store_id = d.store_id WHERE d.store_id IS NULL UNION ALL "
        "SELECT 'products', COUNT(*) FROM sales s "
        "LEFT JOIN raw_products d ON s.product_id = d.product_id WHERE d.product_id IS NULL",
    )
    sql["surrogate_id"] = with_(
        SALES,
        "SELECT row_number() OVER (ORDER BY date, order_id, store_id, product_id, qty, amount, payment) "
        f"AS id, {_AMOUNT_DOUBLE} FROM sales",
    )

    totals = "SELECT date, COUNT(*) AS row_count, CAST(SUM(qty) AS BIGINT) AS qty FROM sales"
    sql["filter_date_lenient"] = with_(SALES, f"{totals} WHERE date >= DATE '1998-02-10' GROUP BY date")
    sql["filter_date_strict"] = with_(SALES, f"{totals} WHERE {IN_RANGE} GROUP BY date")

    sql["product_rank"] = ranking(
        P_KEYS, P_JOIN, f"lower(product_category) = 'promo' AND {IN_RANGE}",
        "revenue DESC, product_id", 20,
    )
    sql["product_quantity"] = ranking(
        P_KEYS, P_JOIN, f"lower(product_category) = 'economy' AND date <= DATE '{END}'",
        "qty ASC, product_id", 30,
    )
    sql["product_revenue"] = with_(
        STAR,
        f"SELECT {P_KEYS}, {MEASURES} FROM sales {P_JOIN} "
        f"WHERE lower(product_name) = 'small ring' AND date >= DATE '{START}' GROUP BY {P_KEYS}",
    )
    sql["product_orders"] = with_(
        STAR,
        f"SELECT product_id, product_name, {MEASURES} FROM sales {P_JOIN} "
        f"WHERE lower(product_name) = 'cold gizmo' AND {IN_RANGE} GROUP BY product_id, product_name",
    )
    sql["product_monthly_sales"] = with_(
        STAR,
        f"SELECT strftime(date, '%Y-%m') AS month, product_name, {MEASURES} FROM sales {P_JOIN} "
        f"WHERE lower(product_name) = lower({LONGEST_PLATE}) GROUP BY 1, 2",
    )
    sql["product_daily_sales"] = with_(
        STAR,
        f"SELECT date, product_name, {MEASURES} FROM sales {P_JOIN} "
        f"WHERE lower(product_name) = lower({LONGEST_BLUE}) AND {IN_RANGE} GROUP BY 1, 2",
    )
    sql["category_rank"] = with_(
        STAR,
        f"SELECT product_category AS category, {MEASURES} FROM sales {P_JOIN} "
        "GROUP BY 1",
    )
    sql["category_revenue"] = with_(
        STAR,
        f"SELECT product_category AS category, {MEASURES} FROM sales {P_JOIN} "
        f"WHERE lower(product_category) = 'large' AND {IN_RANGE} GROUP BY 1",
    )
    sql["store_rank"] = ranking(
        "store_id, store_name", "JOIN stores USING (store_id)", IN_RANGE, "revenue ASC, store_id", 25
    )
    sql["store_revenue"] = with_(
        STAR,
        f"SELECT store_id, store_name, {MEASURES} FROM sales JOIN stores USING (store_id) "
        "WHERE lower(store_name) = 'supplier#000000007' GROUP BY 1, 2",
    )
    sql["daily_sales"] = with_(f"{SALES}, {DAILY}", "SELECT * FROM daily")
    sql["aov_trend"] = with_(f"{SALES}, {DAILY}", f"SELECT * FROM daily WHERE {IN_RANGE}")
    sql["monthly_sales"] = with_(
        SALES,
        f"SELECT strftime(date, '%Y-%m') AS month, {MEASURES}, {average()} AS average_order_value "
        "FROM sales WHERE date IS NOT NULL GROUP BY 1",
    )
    sql["dataset_summary"] = with_(
        STAR,
        "SELECT COUNT(*) AS sales_rows, (SELECT COUNT(*) FROM stores) AS store_count, "
        "(SELECT COUNT(*) FROM products) AS product_count, MIN(date) AS min_date, "
        "MAX(date) AS max_date FROM sales",
    )
    sql["category_performance"] = with_(
        STAR,
        "SELECT product_category, CAST(SUM(amount) AS DOUBLE) AS total_sales, "
        "CAST(SUM(qty) AS BIGINT) AS total_qty, COUNT(DISTINCT order_id) AS total_orders "
        f"FROM sales {P_JOIN} GROUP BY 1",
    )
    sql["payment_sales"] = with_(SALES, f"SELECT payment, {MEASURES} FROM sales GROUP BY payment")

    sql["dash_meta"] = with_(
        RAW,
        "SELECT COUNT(*) AS sales_rows, (SELECT COUNT(*) FROM raw_stores) AS store_count, "
        "(SELECT COUNT(*) FROM raw_products) AS product_count, MIN(d) AS min_date, MAX(d) AS max_date "
        f"FROM (SELECT {date_year_first('date')} AS d FROM raw_sales)",
    )
    filled = (
        "COALESCE(CAST(SUM(amount) AS DOUBLE), 0) AS revenue, "
        "COALESCE(CAST(SUM(qty) AS BIGINT), 0) AS qty, COUNT(DISTINCT order_id) AS order_count"
    )
    filled_average = f"COALESCE({average('COALESCE(SUM(amount), 0)')}, 0) AS average_order_value"
    sql["dash_daily_sales"] = with_(
        UNCHECKED,
        "SELECT date, COALESCE(CAST(SUM(amount) AS DOUBLE), 0) AS revenue, "
        f"COUNT(DISTINCT order_id) AS order_count, {filled_average} "
        f"FROM sales WHERE {IN_RANGE} GROUP BY date",
    )
    sql["dash_top_products"] = with_(
        STAR,
        f"SELECT product_id, {filled}, product_name, product_category FROM sales "
        f"LEFT JOIN products USING (product_id) WHERE {IN_RANGE} "
        "GROUP BY product_id, product_name, product_category "
        "ORDER BY revenue DESC, product_id LIMIT 50",
    )
    layer = f"{JUDGED}, sales AS (SELECT * FROM cleaned), products AS (SELECT * FROM raw_products)"
    sql["layer_category_rank"] = with_(
        layer, f"SELECT product_category AS category, {MEASURES} FROM sales {P_JOIN} GROUP BY 1"
    )
    sql["layer_daily_sales"] = with_(
        f"{layer}, {DAILY}", f"SELECT * FROM daily WHERE {IN_RANGE}"
    )
    sql["layer_top_products"] = with_(
        layer,
        f"SELECT product_id, {filled}, product_name, product_category FROM sales "
        f"LEFT JOIN products USING (product_id) WHERE {IN_RANGE} "
        "GROUP BY product_id, product_name, product_category "
        "ORDER BY revenue DESC, product_id LIMIT 50",
    )
    sql["layer_store_sales"] = with_(
        layer,
        f"SELECT s.*, d.store_name, d.category, d.district FROM "
        f"(SELECT store_id, {filled}, {filled_average} FROM sales "
        f"WHERE {IN_RANGE} GROUP BY store_id) s LEFT JOIN raw_stores d ON s.store_id = d.store_id",
    )
    sql["dash_store_sales"] = with_(
        UNCHECKED,
        f"SELECT s.*, d.store_name, d.category, d.district FROM "
        f"(SELECT store_id, {filled}, {filled_average} FROM sales "
        f"WHERE {IN_RANGE} AND store_id IS NOT NULL GROUP BY store_id) s "
        "LEFT JOIN raw_stores d ON s.store_id = d.store_id",
    )
    sql["dash_category_sales"] = with_(
        UNCHECKED,
        f"SELECT COALESCE(product_category, 'Unknown') AS product_category, {filled} "
        "FROM sales LEFT JOIN products USING (product_id) GROUP BY 1",
    )
    sql["kpi_summary"] = with_(
        SALES,
        f"SELECT CAST(SUM(total) AS DOUBLE) AS revenue, CAST(SUM(n) AS BIGINT) AS order_count, "
        f"{average('SUM(total)', 'CAST(SUM(n) AS BIGINT)')} AS average_order_value, "
        f"(SELECT COUNT(DISTINCT order_id) FROM sales WHERE {IN_RANGE}) AS distinct_orders "
        "FROM (SELECT date, SUM(amount) AS total, COUNT(DISTINCT order_id) AS n FROM sales "
        f"WHERE {IN_RANGE} GROUP BY date)",
    )
    sql["category_share"] = with_(
        f"{STAR}, c AS (SELECT product_category, SUM(amount) AS total FROM sales {P_JOIN} "
        f"WHERE {IN_RANGE} GROUP BY 1), w AS (SELECT SUM(total) AS whole FROM c)",
        "SELECT product_category, CAST(total AS DOUBLE) AS revenue, "
        "CAST((2000 * CAST(total * 100 AS HUGEINT) + CAST(whole * 100 AS HUGEINT)) "
        "// (2 * CAST(whole * 100 AS HUGEINT)) AS BIGINT) / 10 AS share_percent FROM c, w",
    )
    sql["product_rank_position"] = with_(
        f"{STAR}, top AS (SELECT product_id, SUM(amount) AS total FROM sales WHERE {IN_RANGE} "
        "GROUP BY 1 ORDER BY total DESC, product_id LIMIT 100)",
        "SELECT row_number() OVER (ORDER BY total DESC, product_id) AS position, product_id, "
        "product_name, product_category, CAST(total AS DOUBLE) AS revenue "
        "FROM top LEFT JOIN products USING (product_id)",
    )
    sql["display_labels"] = with_(
        f"{UNCHECKED}, sold AS (SELECT product_id, COALESCE(SUM(amount), 0) AS total FROM sales "
        "WHERE product_id IS NOT NULL GROUP BY 1)",
        "SELECT product_id, COALESCE(NULLIF(product_name, ''), product_id) AS product_label, "
        "COALESCE(NULLIF(product_category, ''), '-') AS category_label, "
        "COALESCE(NULLIF(product_category, ''), '未知分类') AS legend_label, "
        "'¥' || format('{:,.2f}', CAST(total AS DOUBLE)) AS revenue_text "
        "FROM sold LEFT JOIN products USING (product_id)",
    )
    sql["format_money"] = with_(
        f"{SALES}, {DAILY}",
        "SELECT date, '¥' || format('{:,.2f}', revenue) AS revenue_text FROM daily",
    )

    sql["resolve_product"] = resolution(
        union_inputs(
            "part",
            [
                "upper(p_name)", "substr(p_name, 1, length(p_name) - 2)", "substr(p_name, 3, 4)",
                "'  my ' || p_name || ' order '", "p_brand", "''",
            ],
        ),
        "products", "product_name",
    )
    sql["resolve_category"] = resolution(
        union_inputs(
            "part",
            [
                "lower(p_type)", "p_type || ' goods'", "replace(p_type, 'ECONOMY', 'Budget goods')",
                "substr(p_type, 1, 3)", "'all ' || p_type || ' things'", "p_brand",
            ],
        ),
        "products", "product_category", registry.CATEGORY_SUFFIX, registry.CATEGORY_ALIASES,
    )
    sql["resolve_store"] = resolution(
        union_inputs(
            "supplier",
            [
                "upper(s_name)", "substr(s_name, 10, 8)", "substr(s_name, 15, 4)", "'at ' || s_name",
                "'nation ' || s_nationkey",
            ],
        ),
        "stores", "store_name",
    )

    sql["aov_trend_verdict"] = with_(
        f"{SALES}, {DAILY}, period AS (SELECT * FROM daily WHERE {IN_RANGE})", verdict("period")
    )
    sql["aov_trend_last_days"] = with_(
        f"{SALES}, {DAILY}, period AS (SELECT * FROM daily "
        f"WHERE date > (SELECT MAX(date) FROM sales) - {RECENT_DAYS})",
        verdict("period"),
    )
    first = "date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'"
    second = "date BETWEEN DATE '1997-06-01' AND DATE '1997-12-31'"

    def period(name: str, condition: str) -> str:
        return (
            f"{name} AS (SELECT CAST(SUM(amount) AS DOUBLE) AS {name}_revenue, "
            f"COUNT(DISTINCT order_id) AS {name}_order_count, {average()} AS {name}_aov "
            f"FROM sales WHERE {condition})"
        )

    sql["aov_period_compare"] = with_(
        f"{SALES}, {period('first', first)}, {period('second', second)}",
        "SELECT *, CASE WHEN second_aov > first_aov THEN 'up' WHEN second_aov < first_aov "
        "THEN 'down' WHEN second_aov = first_aov THEN 'flat' ELSE 'insufficient' END AS trend, "
        "CAST(abs(CAST(second_aov AS DECIMAL(18,2)) - CAST(first_aov AS DECIMAL(18,2))) AS DOUBLE) "
        "AS change FROM first, second",
    )
    sql["product_revenue_month"] = with_(
        STAR,
        f"SELECT {P_KEYS}, {MEASURES} FROM sales {P_JOIN} WHERE lower(product_name) = 'red widget' "
        f"AND strftime(date, '%Y-%m') = '1998-02' GROUP BY {P_KEYS}",
    )

    newest = "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)"
    sql["conv_last_n"] = with_(
        f"{ASKED}, kept AS (SELECT *, {newest} AS r FROM asked)",
        "SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position "
        "FROM kept WHERE r <= 2",
    )
    sql["conv_first_question"] = with_(
        f"{ASKED}, kept AS (SELECT *, {newest} AS r FROM asked)",
        "SELECT conv_id, arg_min(text, turn) AS first_question FROM kept "
        f"WHERE r <= {REMEMBERED} GROUP BY conv_id",
    )
    sql["conv_prev_question"] = with_(
        ASKED,
        "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous "
        "FROM asked",
    )
    sql["question_followup"] = with_(
        ASKED,
        f"SELECT conv_id, turn, CAST({words('text', registry.FOLLOW_UP_WORDS)} AS BIGINT) AS is_follow_up "
        "FROM asked",
    )
    fired = f"(({_RANKING}) OR ({words('text', _Q['aov_words'])}))"
    sql["question_route"] = with_(
        ASKED,
        f"""SELECT conv_id, turn,
            CASE WHEN {_RANKING} THEN 'product_rank'
                 WHEN {words('text', _Q['aov_words'])} THEN 'aov_trend'
                 WHEN length(text) % 3 = 0 THEN 'daily_sales' ELSE 'product_revenue' END AS tool,
            CASE WHEN {_RANKING} THEN 'desc' WHEN {fired} THEN NULL
                 WHEN length(text) % 3 = 0 THEN 'asc' END AS "order",
            CASE WHEN {_RANKING} THEN CAST(1 AS BIGINT) WHEN {fired} THEN NULL
                 ELSE CAST(length(text) % 7 AS BIGINT) END AS "limit",
            CASE WHEN {_BEVERAGE} THEN '{_Q['beverage_category']}' WHEN {fired} THEN NULL
                 ELSE substr(text, 1, 3) END AS category,
            CASE WHEN {fired} THEN NULL ELSE substr(text, 2, 5) END AS product_name,
            CASE WHEN {fired} THEN NULL ELSE 'user' END AS store_name,
            CASE WHEN {fired} THEN NULL WHEN length(text) % 3 = 0 THEN '{START}' END AS start_date,
            CASE WHEN {fired} THEN NULL WHEN length(text) % 3 <> 0 THEN '{END}' END AS end_date
        FROM asked""",
    )
    sql["adhoc_sql"] = with_(STAR, registry.ADHOC_SQL.strip().rstrip(";"))
    return sql
