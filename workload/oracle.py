"""SQL counterparts of the registered queries, for DuckDB.

Written apart from the operators and with constants of its own: all money is whole cents (HUGEINT), every division is
integer and rounds half away from zero once, and joins happen at line grain before any sum.
"""

from __future__ import annotations

from typing import NamedTuple


class Run(NamedTuple):
    year: int
    month: int
    settlement_type: str | None = None
    prorate_irregular: bool = True
    sac_mode: str = "semester"
    corrected: bool = False


JULY, APRIL = Run(1998, 7), Run(1998, 4)
SHIPBOARD_JULY = Run(1998, 7, "Emb")
TAX_RUNS = {
    "": JULY,
    "_annual_sac": Run(1998, 7, sac_mode="annual"),
    "_full_irregular": Run(1998, 7, prorate_irregular=False),
    "_full_irregular_annual_sac": Run(1998, 7, prorate_irregular=False, sac_mode="annual"),
    "_april": APRIL,
}

# Declaration codes of the general deductions, and how each is limited.
DEDUCTION_CODES = {
    1: "medical_insurance",
    2: "life_insurance",
    3: "donations",
    4: "mortgage_interest",
    5: "funeral_expenses",
    7: "medical_fees",
    8: "domestic_staff",
    9: "guarantee_societies",
    10: "travelling_sales",
    11: "mobility",
    21: "work_clothing",
    22: "rent_40",
    23: "mixed_insurance",
    24: "retirement_insurance",
    25: "mutual_funds",
    32: "education",
    33: "rent_10_tenant",
    34: "rent_10_landlord",
    99: "other_deductions",
}
AMOUNT_LIMITED = (2, 4, 5, 11, 23, 24)
ALLOWANCE_LIMITED = (8, 22, 32)
NET_GAIN_LIMITED = (1, 3, 7)
LEAVER_ONLY = (2, 7, 23, 24, 25)
NAMES = list(DEDUCTION_CODES.values())

# The derived sheets and declarations: limits and scale per unit of the month, dependants as kinship, percentage, one in.
AMOUNT_RATES = {2: "0.004", 4: "0.005", 5: "0.002", 11: "0.006", 23: "0.004", 24: "0.004"}
PERCENTAGES = {1: 5, 3: 5, 7: 5, 8: 40, 22: 40, 32: 40}
SCALE = (("0.0000", "0.00000", 5), ("0.0060", "0.00030", 9), ("0.0180", "0.00138", 15), ("0.0420", "0.00498", 27))
TOP = "999999999.99"
DEPENDANTS = ((1, 100, 2), (3, 100, 3), (30, 50, 5), (31, 100, 7), (32, 100, 11), (5, 100, 13))


def div(cents: str, n: int) -> str:
    return f"(sign({cents}) * ((2 * abs({cents}) + {n}) // {2 * n}))"


def money(cents: str, precision: int = 16) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(30,0)) * 0.01 AS DECIMAL({precision},2))"


def cents(amount: str) -> str:
    return f"CAST({amount} * 100 AS HUGEINT)"


def share(rate: str, precision: int = 10, times: str = "1") -> str:
    return f"CAST(unit * {rate} * CAST({times} AS DECIMAL(2,0)) AS DECIMAL({precision},2))"


def model(run: Run) -> str:
    """Common tables of every query; the period and the options are spelled out."""
    y, m = run.year, run.month
    kind = f"AND settlement_type = '{run.settlement_type}'" if run.settlement_type else ""
    final_type = 1 if m <= 6 else 2
    personal_cols = ("gni", "special", "spouse", "child", "disabled_child")

    def personal(kind_: int, rates: tuple[str, ...], times: str, where: str) -> str:
        cols = ", ".join(f"{share(r, 10, times)} AS {c}" for c, r in zip(personal_cols, rates))
        return f"SELECT period, {cols}, {kind_} AS type FROM units {where}"

    def scale(kind_: int, times: str, where: str) -> str:
        rows = []
        for i, (lower, fixed, rate) in enumerate(SCALE):
            upper = share(SCALE[i + 1][0], 10, times) if i + 1 < len(SCALE) else TOP
            rows.append(
                f"SELECT period, CAST({share(lower, 10, times)} AS DECIMAL(14,2)) AS lower, "
                f"CAST({upper} AS DECIMAL(14,2)) AS upper, {share(fixed, 10, times)} AS fixed, {rate} AS rate, "
                f"{share(lower, 10, times)} AS excess, {i + 1} AS pct_code, {kind_} AS type FROM units {where}"
            )
        return " UNION ALL ".join(rows)

    general = " UNION ALL ".join(
        f"SELECT year_start AS period, '{DEDUCTION_CODES[c]}' AS deduction, {c} AS code, "
        f"'{'A' if c in AMOUNT_RATES else 'P'}' AS type, "
        + (share(AMOUNT_RATES[c], 12) if c in AMOUNT_RATES else "CAST(NULL AS DECIMAL(12,2))")
        + f" AS cap, {PERCENTAGES.get(c, 'NULL')}::INT AS pct FROM year_unit"
        for c in sorted({**AMOUNT_RATES, **PERCENTAGES})
    )
    december = "WHERE month(period) = 12"
    in_sheet = f"month(period) = {m} OR (month(period) = 12 AND type = 1) OR type = 2"
    dependants = " UNION ALL ".join(
        f"SELECT plain_id AS tax_id, {k} AS kinship, {pct} AS pct, "
        f"CAST(1 + employee_id % 6 AS INT) AS month_from, CAST(6 + (employee_id + 3) % 7 AS INT) AS month_to "
        f"FROM filers WHERE employee_id % {every} = 0"
        for k, pct, every in DEPENDANTS
    )
    return f"""WITH
units AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(max(o_totalprice) AS DECIMAL(14,2)) AS unit
  FROM orders WHERE year(o_orderdate) = {y} GROUP BY 1),
year_unit AS (SELECT max(unit) AS unit, CAST('{y}-01-01' AS DATE) AS year_start FROM units),
caps AS (SELECT period, {share("0.25", 14)} AS cap, {share("0.04")} AS floor FROM units WHERE month(period) = {m}),
the_cap AS (SELECT cap, floor, {cents("cap")} AS cap_c, {cents("floor")} AS floor_c FROM caps),
personal AS (SELECT * FROM (
  {personal(0, ("0.0014", "0.0150", "0.0008", "0.0004", "0.0008"), "month(period)", "")}
  UNION ALL {personal(1, ("0.0080", "0.0900", "0.0048", "0.0024", "0.0048"), "1", december)}
  UNION ALL {personal(2, ("0.0170", "0.1840", "0.0096", "0.0048", "0.0096"), "1", december)}
  ) WHERE {in_sheet}),
brackets AS (SELECT * FROM (
  {scale(0, "month(period)", "")} UNION ALL {scale(1, "6", december)} UNION ALL {scale(2, "12", december)}
  ) WHERE {in_sheet}),
general AS ({general}),
month_allowance AS (
  SELECT {", ".join(f"{cents(c)} AS {c}_c" for c in personal_cols)} FROM personal
  WHERE month(period) = {m} AND type = 0),
headers AS (
  SELECT o_orderkey AS settlement_id, o_custkey AS employee_id, CAST(left(o_orderpriority, 1) AS INT) AS kind,
    CASE o_orderstatus WHEN 'F' THEN 'Emb' WHEN 'O' THEN 'Jor' ELSE 'Men' END AS settlement_type,
    CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month
  FROM orders),
raw_lines AS (
  SELECT l_orderkey AS settlement_id, l_partkey AS item_id, CAST(l_quantity AS DECIMAL(14,2)) AS quantity,
    'Item ' || l_partkey AS item_name, l_partkey % 20 AS slot, {cents("CAST(l_extendedprice AS DECIMAL(14,2))")} AS c
  FROM lineitem),
catalog AS (
  SELECT p_partkey AS catalog_item_id, p_name AS catalog_item_name,
    CASE WHEN p_partkey % 20 < 9 THEN 'remunerativo' WHEN p_partkey % 20 < 12 THEN 'no remunerativo'
      WHEN p_partkey % 20 < 18 THEN 'descuento' WHEN p_partkey % 20 = 18 THEN 'ganancias'
      ELSE 'plantilla' END AS category,
    CASE p_partkey % 20 WHEN 8 THEN 'sac' WHEN 12 THEN 'previsional' WHEN 13 THEN 'obra social'
      WHEN 14 THEN 'sindical' WHEN 15 THEN 'anticipo' WHEN 16 THEN 'embargo' WHEN 17 THEN 'descuento'
      ELSE 'n/a' END AS subcategory,
    CASE WHEN p_partkey % 20 < 6 THEN 'habitual' WHEN p_partkey % 20 IN (6, 7, 11) THEN 'no habitual'
      WHEN p_partkey % 20 = 8 THEN 'sac' WHEN p_partkey % 20 IN (9, 10) THEN 'exento'
      WHEN p_partkey % 20 = 12 THEN 'previsional' WHEN p_partkey % 20 = 13 THEN 'obra social'
      WHEN p_partkey % 20 = 14 THEN 'sindical' WHEN p_partkey % 20 = 18 THEN 'impuesto' END AS tax_class,
    CASE WHEN p_partkey % 20 < 9 THEN '1' ELSE '0' END AS r4r8, p_partkey % 20 < 9 AS r9
  FROM part WHERE p_size <> 50),
people AS (
  SELECT c_custkey AS employee_id, c_mktsegment AS surname, c_name AS name,
    '20-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') || '-' || (c_custkey % 10) AS tax_id,
    CASE WHEN c_custkey % 3 = 0 THEN make_date(1998, CAST(1 + c_custkey % 12 AS INT), 15) END AS end_date
  FROM customer),
lines AS (
  SELECT h.employee_id, h.settlement_id, h.kind, h.settlement_type, h.year, h.month, l.item_id, l.quantity,
    l.item_name, CASE WHEN l.slot < 12 OR l.slot = 19 THEN l.c ELSE 0 END AS earning_c,
    CASE WHEN l.slot BETWEEN 12 AND 18 THEN {div("l.c", 10)} ELSE 0 END AS deduction_c, k.*
  FROM raw_lines l JOIN headers h ON l.settlement_id = h.settlement_id
  LEFT JOIN catalog k ON l.item_id = k.catalog_item_id
  WHERE h.year = {y} AND h.month <= {m} {kind}),
pay AS (SELECT l.*, p.surname, p.name, p.tax_id FROM lines l JOIN people p USING (employee_id)),
job AS (
  SELECT c_custkey AS employee_id, c_nationkey AS nation, c_custkey % 200 AS plan FROM customer
  UNION ALL SELECT c_custkey, (c_nationkey + 1) % 25, c_custkey % 200 FROM customer WHERE c_acctbal > 9000
  UNION ALL SELECT c_custkey, c_nationkey, (c_custkey + 64) % 200 FROM customer
  WHERE c_acctbal > 6000 AND c_acctbal <= 9000),
profiles AS (
  SELECT DISTINCT j.employee_id, j.employee_id % 4 = 1 AS pensioner, n_name AS agreement, hp.p_name AS health_plan,
    up.p_name AS union_name, j.employee_id % 2 = 0 AS union_member, p.end_date
  FROM job j JOIN people p ON j.employee_id = p.employee_id
  LEFT JOIN part hp ON hp.p_partkey = j.plan
  LEFT JOIN part up ON up.p_partkey = (j.employee_id * 7) % 200 AND j.employee_id % 4 <> 0
  LEFT JOIN nation ON n_nationkey = j.nation),
filers AS (
  SELECT c_custkey AS employee_id, '20' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') || (c_custkey % 10) AS plain_id
  FROM customer WHERE c_acctbal > 0),
dependants AS ({dependants}),
declared AS (
  SELECT plain_id AS tax_id, code, (employee_id * 3701 + code * 10103) % 1000000 - 510000 AS amount_c
  FROM filers, (VALUES {", ".join(f"({c})" for c in DEDUCTION_CODES)}) codes(code)
  WHERE (employee_id * 3701 + code * 10103) % 1000000 > 510000),
priced AS (
  SELECT *, CASE WHEN {m} BETWEEN month_from AND month_to THEN 1 ELSE 0 END AS applies,
    CASE WHEN kinship = 1 THEN 'conyuge' WHEN kinship IN (3, 30) THEN 'hijo'
      WHEN kinship IN (31, 32) THEN 'hijo incapacitado' END AS kind,
    pct * CASE WHEN kinship = 1 THEN spouse_c WHEN kinship IN (3, 30) THEN child_c
      WHEN kinship IN (31, 32) THEN disabled_child_c END
      * CASE WHEN {m} BETWEEN month_from AND month_to THEN 1 ELSE 0 END AS amount_cc
  FROM dependants, month_allowance),
family AS (
  SELECT tax_id, {div("sum(amount_cc)", 100)} AS family_c FROM priced WHERE applies = 1 GROUP BY tax_id),
wide AS (
  SELECT tax_id, {", ".join(f"coalesce(sum(amount_c) FILTER (WHERE code = {c}), 0)::HUGEINT AS {n}_d" for c, n in DEDUCTION_CODES.items())}
  FROM declared GROUP BY tax_id),
allowed AS (
  SELECT CASE WHEN month(period) = {m} AND type = 0 THEN 'Activo' ELSE 'Baja' END AS status,
    {cents("gni")} AS gni_c, {cents("special")} AS special_c
  FROM personal WHERE (month(period) = {m} AND type = 0) OR (month(period) = 12 AND type = {final_type})),
scale AS (
  SELECT CASE WHEN month(period) = {m} AND type = 0 THEN 'Activo' ELSE 'Baja' END AS status,
    {cents("lower")} AS lower_c, {cents("upper")} AS upper_c, fixed, rate, excess, {cents("excess")} AS excess_c,
    {cents("fixed")} AS fixed_c
  FROM brackets WHERE (month(period) = {m} AND type = 0) OR (month(period) = 12 AND type = {final_type}))
"""


def total(amount: str, where: str) -> str:
    return f"CAST(coalesce(sum({amount}) FILTER (WHERE {where}), 0) AS HUGEINT)"


SUMMARY = {
    "taxable": ("earning_c", "category = 'remunerativo'"),
    "non_taxable": ("earning_c", "category = 'no remunerativo'"),
    "pension": ("deduction_c", "subcategory = 'previsional'"),
    "health": ("deduction_c", "subcategory = 'obra social'"),
    "union_dues": ("deduction_c", "subcategory = 'sindical'"),
    "advances": ("deduction_c", "subcategory = 'anticipo'"),
    "garnishments": ("deduction_c", "subcategory = 'embargo'"),
    "other": ("deduction_c", "subcategory = 'descuento'"),
    "income_tax": ("deduction_c", "tax_class = 'impuesto'"),
}
ADDED = ("taxable", "non_taxable")


def summary_cte(m: int) -> str:
    cols = ", ".join(f"{total(a, w)} AS {n}" for n, (a, w) in SUMMARY.items())
    net = " ".join(("+ " if n in ADDED else "- ") + n for n in SUMMARY)
    return f"""
, sums AS (SELECT tax_id, surname, name, {cols} FROM pay WHERE month = {m} GROUP BY employee_id, tax_id, surname, name),
summary AS (SELECT *, {net} AS net FROM sums)
"""


def summary_sql(run: Run) -> str:
    cols = ", ".join(f"{money(n)} AS {n}" for n in [*SUMMARY, "net"])
    return f"{model(run)}{summary_cte(run.month)} SELECT tax_id, surname, name, {cols} FROM summary"


def totals_sql(run: Run) -> str:
    cols = ", ".join(f"{money(f'sum({n})', 24)} AS {n}" for n in [*SUMMARY, "net"])
    return f"{model(run)}{summary_cte(run.month)} SELECT {cols} FROM summary"


def balance_sql(run: Run) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS ord, '{n}' AS concept, sum({n}) AS c, {1 if n in ADDED else -1} AS side FROM summary"
        for i, n in enumerate([*SUMMARY, "net"], start=1)
    )
    return f"""{model(run)}{summary_cte(run.month)}, concepts AS ({rows}),
running AS (SELECT *, sum(side * c) OVER (ORDER BY ord) AS run_c FROM concepts)
SELECT ord, concept, {money("c", 24)} AS amount, {money("run_c", 24)} AS running,
  CASE WHEN concept = 'net' THEN CASE WHEN run_c = 0 THEN 'match' ELSE 'difference' END END AS status
FROM running"""


# The base is kept in tenths of a cent: half of an odd cap.
def withholding_cte(m: int) -> str:
    return f"""
, month_sums AS (
  SELECT employee_id, tax_id, surname, name, pensioner, agreement, health_plan, union_name, union_member,
    {total("deduction_c", "subcategory = 'previsional'")} AS pension,
    {total("deduction_c", "subcategory = 'obra social'")} AS health,
    {total("deduction_c", "subcategory = 'sindical'")} AS union_dues,
    {total("earning_c", "category = 'remunerativo' AND subcategory <> 'sac'")} AS pay,
    {total("earning_c", "subcategory = 'sac'")} AS sac,
    {total("earning_c", "category = 'no remunerativo'")} AS non_taxable
  FROM pay JOIN profiles USING (employee_id) WHERE month = {m}
  GROUP BY employee_id, tax_id, surname, name, pensioner, agreement, health_plan, union_name, union_member),
based AS (
  SELECT *, 10 * greatest(least(pay, cap_c), floor_c) + least(10 * sac, 5 * cap_c) AS base_m FROM month_sums, the_cap),
control AS (
  SELECT * REPLACE (substring(health_plan, 1, 6) AS health_plan) FROM (SELECT DISTINCT tax_id, surname, name, base_m,
    {div("(base_m * CASE WHEN pensioner THEN 11 ELSE 14 END - pension * 1000)", 1000)} AS pension_ctrl,
    {div("(CASE WHEN base_m < 20 * floor_c THEN 20 * floor_c * 3 WHEN pensioner THEN 0 ELSE base_m * 3 END - health * 1000)", 1000)} AS health_ctrl,
    pension, health, union_dues, pay, sac, non_taxable, pensioner, agreement, health_plan, union_name, union_member
  FROM based))
"""


BASE_M = "CAST(CAST(base_m AS DECIMAL(30,0)) * 0.001 AS DECIMAL(17,3)) AS base"
MONTH_SUMS = ("pension", "health", "union_dues", "pay", "sac", "non_taxable")


def withholding_sql(run: Run, what: str) -> str:
    sums = ", ".join(f"{money(n)} AS {n}" for n in MONTH_SUMS)
    profile = "pensioner, agreement, health_plan, union_name, union_member"
    if what == "base":
        return f"{model(run)}{withholding_cte(run.month)} SELECT tax_id, surname, name, {sums}, {profile}, {BASE_M} FROM based"

    def status(col: str) -> str:
        return f"CASE WHEN {col} = 0 THEN 'match' WHEN {col} <= 10 THEN 'refund' ELSE 'difference' END"

    verdicts = f", {status('pension_ctrl')} AS pension_status, {status('health_ctrl')} AS health_status"
    return f"""{model(run)}{withholding_cte(run.month)} SELECT tax_id, surname, name, {BASE_M},
  {money("pension_ctrl", 10)} AS pension_ctrl, {money("health_ctrl", 10)} AS health_ctrl, {sums}, {profile}
  {verdicts if what == "status" else ""} FROM control"""


def reference_sql(run: Run) -> str:
    return f"""{model(run)} SELECT cap, floor,
  CAST(CAST(cap_c * 5 AS DECIMAL(30,0)) * 0.001 AS DECIMAL(17,3)) AS sac_cap,
  {money("floor_c * 2", 12)} AS health_minimum FROM the_cap"""


def base_cte(run: Run) -> str:
    m = run.month
    h1, h2 = "month <= 6", "month >= 7"
    if run.prorate_irregular:
        weighted = f"earning_c * (27720 // (13 - month)) * ({m} - month + 1)"
        irregular = [div(total(weighted, f"tax_class = 'no habitual' AND {h}"), 27720) for h in (h1, h2)]
    else:
        irregular = [total("earning_c", f"tax_class = 'no habitual' AND {h}") for h in (h1, h2)]
    if run.sac_mode == "annual" or m < 6:
        sac = [div(f"(regular_{h} + irregular_{h})", 12) for h in ("h1", "h2")]
    else:
        sac = ["paid_sac_h1", "paid_sac_h2"]
    return f"""
, year_sums AS (
  SELECT tax_id, surname, name, CASE WHEN month(end_date) = {m} THEN 'Baja' ELSE 'Activo' END AS status,
    {total("earning_c", f"tax_class = 'habitual' AND {h1}")} AS regular_h1,
    {total("earning_c", f"tax_class = 'habitual' AND {h2}")} AS regular_h2,
    {irregular[0]} AS irregular_h1, {irregular[1]} AS irregular_h2,
    {total("earning_c", "tax_class = 'exento'")} AS exempt,
    {total("earning_c", f"tax_class = 'sac' AND {h1}")} AS paid_sac_h1,
    {total("earning_c", f"tax_class = 'sac' AND {h2}")} AS paid_sac_h2,
    {total("deduction_c", "tax_class IN ('previsional', 'obra social', 'sindical')")} AS social_deductions,
    {total("deduction_c", "tax_class = 'impuesto'")} AS tax_withheld
  FROM pay JOIN profiles USING (employee_id) GROUP BY employee_id, tax_id, surname, name, end_date),
base AS (SELECT *, {sac[0]} AS sac_h1, {sac[1]} AS sac_h2 FROM year_sums)
"""


BASE_MONEY = (
    "regular_h1", "regular_h2", "irregular_h1", "irregular_h2", "exempt", "sac_h1", "sac_h2",
    "social_deductions", "tax_withheld",
)


def keys(m: int) -> str:
    return f"tax_id, surname, name, CAST({m} AS INT) AS month, status"


def base_sql(run: Run) -> str:
    cols = ", ".join(f"{money(n)} AS {n}" for n in BASE_MONEY)
    return f"{model(run)}{base_cte(run)} SELECT {keys(run.month)}, {cols} FROM base"


def match_sql(run: Run) -> str:
    cols = ", ".join(f"{money(n)} AS {n}" for n in BASE_MONEY)
    return f"""{model(run)}{base_cte(run)} SELECT {keys(run.month)}, {cols}, {money("gni_c", 10)} AS gni,
  {money("special_c", 10)} AS special FROM base LEFT JOIN allowed USING (status)"""


def gain_cte(run: Run) -> str:
    """Amounts declared end in _d (cents); limited ones in _u (hundredths of a cent)."""
    limits = {c: f"(SELECT {cents('cap')} FROM general WHERE code = {c})" for c in AMOUNT_LIMITED}
    joined = f"""
, joined AS (
  SELECT b.*, gni_c, special_c, coalesce(family_c, 0) AS family_c,
    {", ".join(f"{n}_d" for n in NAMES)}, {", ".join(f"{sql} AS limit_{c}" for c, sql in limits.items())},
    (SELECT gni_c FROM month_allowance) * 40 AS limit_allowance_u,
    regular_h1 + regular_h2 + irregular_h1 + irregular_h2 + sac_h1 + sac_h2 AS pay_total
  FROM base b LEFT JOIN allowed USING (status)
  LEFT JOIN family f ON f.tax_id = replace(b.tax_id, '-', '')
  LEFT JOIN wide w ON w.tax_id = replace(b.tax_id, '-', ''))
"""
    first, last = [], []
    for c, n in DEDUCTION_CODES.items():
        leaver = "CASE WHEN status = 'Baja' THEN 1 ELSE 0 END" if c in LEAVER_ONLY else "1"
        if c in NET_GAIN_LIMITED:
            last.append(f"100 * {leaver} * CASE WHEN {n}_d > limit_net THEN limit_net ELSE coalesce({n}_d, 0) END AS {n}_u")
        elif c in ALLOWANCE_LIMITED:
            first.append(f"least(100 * coalesce({n}_d, 0), limit_allowance_u) AS {n}_u")
        elif c in AMOUNT_LIMITED:
            first.append(f"100 * {leaver} * least(coalesce({n}_d, 0), limit_{c}) AS {n}_u")
        else:
            first.append(f"100 * {leaver} * coalesce({n}_d, 0) AS {n}_u")
    before = [DEDUCTION_CODES[c] for c in DEDUCTION_CODES if c not in NET_GAIN_LIMITED]
    if run.corrected:
        net_group = " + ".join(f"{n}_u" for n in before)
        group = " + ".join(f"{n}_u" for n in NAMES)
    else:
        net_group = f"100 * coalesce({' - '.join(f'{n}_d' for n in before)}, 0)"
        group = f"100 * coalesce({' - '.join(f'{n}_d' for n in NAMES)}, 0)"
    net = f"((pay_total - social_deductions) * 100 - ({net_group}))"
    return f"""{base_cte(run)}{joined}
, twelfths AS (SELECT *, {div("(gni_c + special_c + family_c)", 12)} AS twelfth_c, {", ".join(first)} FROM joined),
netted AS (SELECT *, {div(f"({net} * 5)", 10000)} AS limit_net FROM twelfths),
limited AS (SELECT *, {", ".join(last)} FROM netted),
gains AS (
  SELECT *, {div(f"((pay_total - gni_c - special_c - social_deductions - family_c - twelfth_c) * 100 - ({group}))", 100)} AS gain_c
  FROM limited),
gain AS (SELECT *, CASE WHEN gain_c < 0 THEN 0 ELSE gain_c END AS taxable_c FROM gains)
"""


def deduction_cols() -> str:
    cols = []
    for c, n in DEDUCTION_CODES.items():
        p, s = (16, 4) if c in ALLOWANCE_LIMITED else (16, 2)
        cols.append(f"CAST(CAST({n}_u AS DECIMAL(30,0)) * 0.0001 AS DECIMAL({p},{s})) AS {n}")
    return ", ".join(cols)


def gain_cols(m: int) -> str:
    cols = ", ".join(f"{money(n)} AS {n}" for n in (*BASE_MONEY, "pay_total"))
    return f"""{keys(m)}, {cols}, {money("gni_c", 10)} AS gni, {money("special_c", 10)} AS special,
  {money("family_c", 12)} AS dependants, {money("twelfth_c", 12)} AS twelfth, {deduction_cols()},
  {money("limit_net", 10)} AS net_gain_limit"""


def capped_sql(run: Run) -> str:
    before = [DEDUCTION_CODES[c] for c in DEDUCTION_CODES if c not in NET_GAIN_LIMITED]
    declared = ", ".join(f"{money(f'{n}_d', 14)} AS declared_{n}" for n in NAMES)
    for alias, names in (("group", NAMES), ("group_before_net_gain", before)):
        declared += f", {money(' - '.join(f'{n}_d' for n in names))} AS declared_{alias}"
    return f"{model(run)}{gain_cte(run)} SELECT {gain_cols(run.month)}, {declared} FROM gain"


def gain_sql(run: Run) -> str:
    return f"{model(run)}{gain_cte(run)} SELECT {gain_cols(run.month)}, {money('taxable_c')} AS taxable_gain FROM gain"


SCALE_JOIN = "LEFT JOIN scale s ON s.status = g.status AND taxable_c > lower_c AND taxable_c <= upper_c"


def tax_cte(run: Run) -> str:
    return f"""{gain_cte(run)}
, taxed AS (
  SELECT g.*, fixed, rate, excess, {div("((taxable_c - excess_c) * rate)", 100)} AS variable_c, fixed_c
  FROM gain g {SCALE_JOIN}),
due AS (SELECT *, coalesce(fixed_c + variable_c, 0) AS due_c FROM taxed)
"""


def tax_sql(run: Run) -> str:
    return f"""{model(run)}{tax_cte(run)} SELECT {gain_cols(run.month)}, {money("taxable_c")} AS taxable_gain,
  CAST(coalesce(fixed, 0) AS DECIMAL(10,2)) AS fixed, coalesce(rate, 0) AS rate,
  CAST(coalesce(excess, 0) AS DECIMAL(10,2)) AS excess, {money("coalesce(variable_c, 0)", 14)} AS variable,
  {money("due_c")} AS tax_due, {money("due_c - tax_withheld")} AS balance FROM due"""


def bracket_sql(run: Run) -> str:
    return f"""{model(run)}{gain_cte(run)} SELECT g.tax_id, g.status, {money("taxable_c")} AS taxable_gain,
  fixed, rate, excess FROM gain g {SCALE_JOIN}"""


def f931_cte(m: int) -> str:
    return f"""
, return_sums AS (
  SELECT tax_id, surname, name,
    {total("earning_c", f"month = {m} AND category = 'remunerativo' AND subcategory <> 'sac'")} AS pay_c,
    {total("earning_c", f"month = {m} AND category = 'remunerativo' AND subcategory = 'sac'")} AS sac_c,
    {total("earning_c", f"month = {m} AND r9")} AS flagged_c,
    {total("earning_c", f"month = {m} AND category = 'no remunerativo'")} AS non_taxable_c,
    {total("earning_c", f"month = {m}")} AS total_c
  FROM pay GROUP BY tax_id, surname, name),
bases AS (
  SELECT *, {div("(2 * least(pay_c, cap_c) + least(2 * sac_c, cap_c))", 2)} AS capped_c, pay_c + sac_c AS uncapped_c
  FROM return_sums, the_cap)
"""


def f931_sql(run: Run) -> str:
    capped, uncapped = money("capped_c"), money("uncapped_c")
    return f"""{model(run)}{f931_cte(run.month)} SELECT tax_id, surname, name, {capped} AS r1, {uncapped} AS r2,
  {uncapped} AS r3, {capped} AS r4, CAST(0 AS DECIMAL(2,2)) AS r6, CAST(0 AS DECIMAL(2,2)) AS r7,
  {uncapped} AS r8, {money("flagged_c")} AS r9, {money("uncapped_c - 700368")} AS r10,
  {money("non_taxable_c")} AS non_taxable, {money("total_c")} AS total FROM bases"""


LINE_COLS = f"""employee_id, surname, name, settlement_id, kind, item_id, quantity,
  {money("earning_c", 14)} AS earning, {money("deduction_c", 14)} AS deduction, item_name, month, tax_id"""
CATALOG_COLS = "catalog_item_id, catalog_item_name, category, subcategory, tax_class, r4r8, r9"


def exports_sql(run: Run) -> str:
    """Rows and the total of every amount, of each report of a run."""
    gains = (*BASE_MONEY, "pay_total", "gni", "special", "dependants", "twelfth", *NAMES, "net_gain_limit", "taxable_gain")
    reports = {
        "pay_summary": (summary_sql(run), (*SUMMARY, "net")),
        "totals_running_balance": (balance_sql(run), ("amount", "running")),
        "withholding_control": (withholding_sql(run, "status"), ("base", "pension_ctrl", "health_ctrl", *MONTH_SUMS)),
        "control_reference_values": (reference_sql(run), ("cap", "floor", "sac_cap", "health_minimum")),
        "income_tax_control": (tax_sql(run), (*gains, "fixed", "excess", "variable", "tax_due", "balance")),
        "f931_bases": (f931_sql(run), ("r1", "r2", "r3", "r4", "r6", "r7", "r8", "r9", "r10", "non_taxable", "total")),
    }
    parts = []
    for report, (sql, amounts) in reports.items():
        names = ", ".join(f"'{a}'" for a in amounts)
        totals = ", ".join(f"CAST(sum({a}) AS DECIMAL(30,4))" for a in amounts)
        parts.append(f"SELECT '{report}' AS report, count(*) AS n, [{names}] AS names, [{totals}] AS totals FROM ({sql})")
    return f"SELECT report, n, unnest(names) AS amount, unnest(totals) AS total FROM ({' UNION ALL '.join(parts)})"


def attributes_cte(run: Run) -> str:
    return f"""
, settled AS (
  SELECT DISTINCT h.employee_id FROM headers h JOIN lineitem ON l_orderkey = h.settlement_id WHERE h.year = {run.year}),
attributes AS (SELECT p.* FROM profiles p JOIN settled USING (employee_id))
"""


def oracle_sql() -> dict[str, str]:
    july = model(JULY)
    limit_cols = [f"(SELECT cap FROM general WHERE code = {c}) AS limit_{DEDUCTION_CODES[c]}" for c in AMOUNT_LIMITED]
    limit_cols += [
        f"CAST(CAST(gni_c * 40 AS DECIMAL(30,0)) * 0.0001 AS DECIMAL(16,4)) AS limit_{DEDUCTION_CODES[c]}"
        for c in ALLOWANCE_LIMITED
    ]
    allowance_cols = ", ".join(f"{money(f'{c}_c', 12)} AS {c}" for c in ("gni", "spouse", "child", "disabled_child"))
    wide_cols = ", ".join(f"{money(f'{n}_d', 14)} AS {n}" for n in NAMES)
    emb = SHIPBOARD_JULY.settlement_type
    rank = """CASE category WHEN 'remunerativo' THEN 1 WHEN 'no remunerativo' THEN 2 WHEN 'descuento' THEN 3
  WHEN 'ganancias' THEN 4 WHEN 'plantilla' THEN 5 ELSE 6 END AS category_rank"""
    items = "SELECT p_partkey AS item_id, p_name AS name FROM part"
    unknown = f"{items} WHERE p_partkey NOT IN (SELECT catalog_item_id FROM catalog)"
    plain = {
        "period_years": f"{july} SELECT DISTINCT year FROM headers WHERE settlement_type = '{emb}' ORDER BY year DESC LIMIT 5",
        "period_months": f"{july} SELECT DISTINCT month FROM headers WHERE settlement_type = '{emb}' AND year = 1998",
        "item_catalog": items,
        "contribution_caps": f"{july} SELECT period, cap, floor FROM caps",
        "item_parameters": f"""{july} SELECT catalog_item_id AS item_id, catalog_item_name AS name, category, subcategory,
  tax_class, r4r8, r9 FROM catalog""",
        "settlement_lines": f"{july} SELECT {LINE_COLS} FROM pay",
        "employee_attributes": f"{july}{attributes_cte(JULY)} SELECT * FROM attributes",
        "tax_brackets": f"{july} SELECT period, lower, upper, fixed, rate, excess, pct_code, type FROM brackets",
        "personal_deduction_params": f"{july} SELECT period, gni, special, spouse, child, disabled_child, type FROM personal",
        "general_deduction_params": f"{july} SELECT * FROM general",
        "f572_dependants": f"{july} SELECT * FROM dependants",
        "f572_deductions": f"{july} SELECT tax_id, code, {money('amount_c', 14)} AS amount FROM declared",
        "unparametrized_items": f"{july} {unknown}",
        "enriched_lines": f"{july} SELECT {LINE_COLS}, {CATALOG_COLS} FROM pay",
        "ordered_lines": f"{july} SELECT {LINE_COLS}, {CATALOG_COLS}, {rank} FROM pay",
        "deduction_limits": f"{july} SELECT {allowance_cols}, {', '.join(limit_cols)} FROM month_allowance",
        "dependant_deductions": f"""{july} SELECT tax_id, kinship, kind, applies, pct, month_from, month_to,
  CAST(CAST(amount_cc AS DECIMAL(30,0)) * 0.0001 AS DECIMAL(18,4)) AS amount FROM priced""",
        "dependant_totals": f"{july} SELECT tax_id, {money('family_c', 12)} AS amount FROM family",
        "general_deductions_wide": f"{july} SELECT tax_id, {wide_cols} FROM wide",
        "pay_summary": summary_sql(JULY),
        "pay_summary_totals": totals_sql(JULY),
        "totals_running_balance": balance_sql(JULY),
        "withholding_base": withholding_sql(JULY, "base"),
        "withholding_control": withholding_sql(JULY, "control"),
        "withholding_status": withholding_sql(JULY, "status"),
        "control_reference_values": reference_sql(JULY),
        "personal_deduction_match": match_sql(JULY),
        "capped_deductions": capped_sql(JULY),
        "taxable_net_gain": gain_sql(JULY),
        "f931_bases": f931_sql(JULY),
        "duplicate_attributes": f"""{july}{attributes_cte(JULY)} SELECT employee_id, count(*) AS n FROM attributes
  GROUP BY employee_id HAVING count(*) > 1""",
    }
    out = dict(plain)
    for suffix, run in TAX_RUNS.items():
        out[f"taxable_pay_base{suffix}"] = base_sql(run)
        out[f"income_tax_control{suffix}"] = tax_sql(run)
    out["income_tax_control_corrected"] = tax_sql(Run(1998, 7, corrected=True))
    out["pay_summary_shipboard"] = summary_sql(SHIPBOARD_JULY)
    out["withholding_control_april"] = withholding_sql(APRIL, "control")
    out["f931_bases_april"] = f931_sql(APRIL)
    out["ordered_control"] = withholding_sql(JULY, "control")
    out["bracket_match"] = bracket_sql(JULY)
    out["compact_lines"] = f"""{july} SELECT employee_id, settlement_type, year, month, category, subcategory, tax_class, r9,
  {money("sum(earning_c)", 24)} AS earning, {money("sum(deduction_c)", 24)} AS deduction FROM lines
  GROUP BY ALL"""
    out["pay_summary_from_compact"] = summary_sql(JULY)
    out["taxable_pay_base_landed"] = base_sql(JULY)
    each_month = [base_sql(Run(1998, month)) for month in range(1, 13)]
    out["taxable_pay_base_by_month"] = " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in each_month)
    out["settlement_lines_bucketed"] = plain["settlement_lines"]
    out["employee_attributes_indexed"] = plain["employee_attributes"]
    out["pay_summary_stored"] = summary_sql(JULY)
    out["withholding_control_stored"] = withholding_sql(JULY, "control")
    out["f931_bases_stored"] = f931_sql(JULY)
    out["f572_deductions_ingested"] = plain["f572_deductions"]
    out["income_tax_control_stored"] = tax_sql(JULY)
    out["report_exports"] = exports_sql(JULY)
    out["line_exports"] = f"""{july} SELECT year, month, count(*) AS n, {money("sum(earning_c)", 24)} AS earning,
  {money("sum(deduction_c)", 24)} AS deduction FROM pay GROUP BY year, month"""
    out["item_exports"] = f"""{july} SELECT *, 'items' AS export FROM ({items})
  UNION ALL SELECT *, 'unparametrized' AS export FROM ({unknown})"""
    return out
