"""Payroll tables and parameter sheets derived from the order tables by Spark.

Orders are settlements, line items their lines, parts the item catalogue and customers the employees. The
parameter sheets follow the largest order total of each month, so they are read from the data as well.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof import PayrollAudit, RunParams
from payproof.params import DEDUCTION_CODES

JULY = RunParams(year=1998, month=7)
APRIL = RunParams(year=1998, month=4)


# Columns of the driver's files that the payroll uses; given, so that no file is opened to plan a query.
FILES = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_size INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING",
}


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.schema(FILES[table]).parquet(f"{sf}/{table}.parquet")


def settlements(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").selectExpr(
        "o_orderkey AS settlement_id",
        "o_custkey AS employee_id",
        "CAST(left(o_orderpriority, 1) AS INT) AS kind",
        "CASE o_orderstatus WHEN 'F' THEN 'Emb' WHEN 'O' THEN 'Jor' ELSE 'Men' END AS settlement_type",
        "year(o_orderdate) AS year",
        "month(o_orderdate) AS month",
        "o_orderdate",
    )


def _of_year(df: DataFrame, p: RunParams) -> DataFrame:
    """The year as a date range too, which the Parquet scan can skip row groups by."""
    return df.where(
        f"o_orderdate >= TIMESTAMP_NTZ '{p.year}-01-01' AND o_orderdate < TIMESTAMP_NTZ '{p.year + 1}-01-01'"
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    # Prices have two decimals: whole cents, which are cheaper to turn into decimals than doubles are.
    amount = "CAST(CAST(floor(l_extendedprice * 100 + 0.5D) AS DECIMAL(16,0)) * 0.01 AS DECIMAL(14,2))"
    return _read(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS settlement_id",
        "l_partkey AS item_id",
        "CAST(l_quantity AS DECIMAL(14,2)) AS quantity",
        f"CASE WHEN l_partkey % 20 NOT BETWEEN 12 AND 18 THEN {amount} END AS earning",
        f"CASE WHEN l_partkey % 20 BETWEEN 12 AND 18 THEN CAST({amount} * 0.10 AS DECIMAL(14,2)) END AS deduction",
        "'Item ' || l_partkey AS item_name",
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "part").selectExpr("p_partkey AS item_id", "p_name AS name")


def item_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as catalogue parameters; those of the largest size have none."""
    slot = "p_partkey % 20"
    return (
        _read(spark, sf, "part")
        .where("p_size < 50")
        .selectExpr(
            "CAST(p_partkey AS STRING) AS item_id",
            "p_name AS name",
            f"CASE WHEN {slot} <= 8 THEN 'remunerativo' WHEN {slot} <= 11 THEN 'no remunerativo' "
            f"WHEN {slot} <= 17 THEN 'descuento' WHEN {slot} = 18 THEN 'ganancias' ELSE 'plantilla' END AS category",
            f"CASE {slot} WHEN 8 THEN 'sac' WHEN 12 THEN 'previsional' WHEN 13 THEN 'obra social' "
            "WHEN 14 THEN 'sindical' WHEN 15 THEN 'anticipo' WHEN 16 THEN 'embargo' WHEN 17 THEN 'descuento' "
            "END AS subcategory",
            f"CASE WHEN {slot} <= 5 THEN 'habitual' WHEN {slot} IN (6, 7, 11) THEN 'no habitual' "
            f"WHEN {slot} = 8 THEN 'sac' WHEN {slot} IN (9, 10) THEN 'exento' WHEN {slot} = 12 THEN 'previsional' "
            f"WHEN {slot} = 13 THEN 'obra social' WHEN {slot} = 14 THEN 'sindical' WHEN {slot} = 18 THEN 'impuesto' "
            "END AS tax_class",
            f"IF({slot} <= 8, '1', '0') AS r4r8",
            f"IF({slot} <= 8, 'true', 'false') AS r9",
        )
    )


def persons(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "customer").selectExpr(
        "c_custkey AS employee_id",
        "c_mktsegment AS surname",
        "c_name AS name",
        "CASE WHEN c_custkey % 3 = 0 THEN make_date(1998, CAST(1 + c_custkey % 12 AS INT), 15) END AS end_date",
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """A tax id and an identity card per employee."""
    padded = "lpad(CAST(c_custkey AS STRING), 12, '0')"
    return _read(spark, sf, "customer").selectExpr(
        "c_custkey AS employee_id",
        f"inline(array(struct(33 AS document_type, '20-' || {padded} || '-' || c_custkey % 10 AS number), "
        f"struct(1 AS document_type, {padded} AS number)))",
    )


def labour(spark: SparkSession, sf: str) -> DataFrame:
    """One row per employee; a second agreement for those with a high balance, a second health plan for some below.

    Some of these plans differ only after their sixth letter.
    """
    plans = "array(c_custkey % 200, (c_custkey + 64) % 200)"
    several = _read(spark, sf, "customer").selectExpr(
        "*", f"explode(IF(c_acctbal > 6000 AND c_acctbal <= 9000, {plans}, array(c_custkey % 200))) AS health_item_id"
    )
    return several.selectExpr(
        "c_custkey AS employee_id",
        "IF(c_custkey % 4 = 1, 2, 1) AS condition",
        "health_item_id",
        "CASE WHEN c_custkey % 4 != 0 THEN (c_custkey * 7) % 200 END AS union_item_id",
        "explode(IF(c_acctbal > 9000, array(c_nationkey, (c_nationkey + 1) % 25), array(c_nationkey))) AS agreement_id",
        "c_custkey % 2 = 0 AS union_member",
    )


def agreements(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "nation").selectExpr("n_nationkey AS agreement_id", "n_name AS name")


def month_units(spark: SparkSession, sf: str, p: RunParams) -> DataFrame:
    """The largest order total of each month of the year."""
    orders = _of_year(_read(spark, sf, "orders"), p)
    return orders.groupBy(F.expr("trunc(o_orderdate, 'month')").alias("period")).agg(
        F.expr("CAST(max(o_totalprice) AS DECIMAL(14,2))").alias("unit")
    )


def _share(rate: str, precision: int = 10, times: str = "1") -> str:
    """An amount of a sheet, as text like in the files users keep."""
    return f"CAST(CAST(unit * {rate} * CAST({times} AS DECIMAL(2,0)) AS DECIMAL({precision},2)) AS STRING)"


def _structs(rows: list[dict[str, str]]) -> str:
    return ", ".join("struct(" + ", ".join(f"{v} AS {k}" for k, v in row.items()) + ")" for row in rows)


def cap_sheet(spark: SparkSession, sf: str, p: RunParams) -> DataFrame:
    return month_units(spark, sf, p).selectExpr("period", f"{_share('0.25', 14)} AS cap", f"{_share('0.04')} AS floor")


def personal_sheet(spark: SparkSession, sf: str, p: RunParams) -> DataFrame:
    """Monthly rows grow with the month; December has two more rows, for leavers of each semester."""
    names = ("gni", "special", "spouse", "child", "disabled_child")

    def row(kind: int, rates: tuple[str, ...], times: str) -> dict[str, str]:
        return {**{n: _share(r, times=times) for n, r in zip(names, rates)}, "type": f"'{kind}'"}

    monthly = _structs([row(0, ("0.0014", "0.0150", "0.0008", "0.0004", "0.0008"), "month(period)")])
    final = _structs(
        [
            row(1, ("0.0080", "0.0900", "0.0048", "0.0024", "0.0048"), "1"),
            row(2, ("0.0170", "0.1840", "0.0096", "0.0048", "0.0096"), "1"),
        ]
    )
    return month_units(spark, sf, p).selectExpr(
        "period", f"inline(IF(month(period) = 12, array({monthly}, {final}), array({monthly})))"
    )


# Scale of the derived sheet per unit and month: lower edge, fixed amount, rate.
SCALE = (("0.0000", "0.00000", 5), ("0.0060", "0.00030", 9), ("0.0180", "0.00138", 15), ("0.0420", "0.00498", 27))
TOP = "999999999.99"


def bracket_sheet(spark: SparkSession, sf: str, p: RunParams) -> DataFrame:
    """Four brackets a month; December repeats them for leavers, with the June scale for the first semester."""

    def rows(kind: int, times: str) -> str:
        edges = [_share(lower, times=times) for lower, _, _ in SCALE] + [f"'{TOP}'"]
        return _structs(
            [
                {
                    "lower": edges[i],
                    "upper": edges[i + 1],
                    "fixed": _share(fixed, times=times),
                    "rate": f"'{rate}'",
                    "excess": edges[i],
                    "pct_code": f"'{i + 1}'",
                    "type": f"'{kind}'",
                }
                for i, (_, fixed, rate) in enumerate(SCALE)
            ]
        )

    monthly = rows(0, "month(period)")
    final = f"{rows(1, '6')}, {rows(2, '12')}"
    return month_units(spark, sf, p).selectExpr(
        "period", f"inline(IF(month(period) = 12, array({monthly}, {final}), array({monthly})))"
    )


# Yearly limits of the derived sheet per unit of the year, and the codes limited by a percentage.
AMOUNT_RATES = {2: "0.004", 4: "0.005", 5: "0.002", 11: "0.006", 23: "0.004", 24: "0.004"}
PERCENTAGES = {1: 5, 3: 5, 7: 5, 8: 40, 22: 40, 32: 40}


def general_sheet(spark: SparkSession, sf: str, p: RunParams) -> DataFrame:
    null = "CAST(NULL AS STRING)"
    rows = [
        {
            "deduction": f"'{DEDUCTION_CODES[code]}'",
            "code": f"'{code}'",
            "type": "'A'" if code in AMOUNT_RATES else "'P'",
            "cap": _share(AMOUNT_RATES[code], 12) if code in AMOUNT_RATES else null,
            "pct": f"'{PERCENTAGES[code]}'" if code in PERCENTAGES else null,
        }
        for code in sorted({**AMOUNT_RATES, **PERCENTAGES})
    ]
    year = month_units(spark, sf, p).agg(
        F.max("unit").alias("unit"), F.expr("trunc(min(period), 'year')").alias("period")
    )
    return year.selectExpr("period", f"inline(array({_structs(rows)}))")


# Dependants of the derived declarations: kinship, percentage, one employee in so many.
DEPENDANTS = ((1, 100, 2), (3, 100, 3), (30, 50, 5), (31, 100, 7), (32, 100, 11), (5, 100, 13))


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    """One XML document per employee whose account balance is positive.

    A document is some fifty times larger than the row it is written from, so the rows are spread over all
    cores first, as a folder of files would be.
    """

    def tag(name: str, value: str) -> str:
        return f"'<{name}>' || {value} || '</{name}>'"

    family = ", ".join(
        f"IF(c_custkey % {every} = 0, '<cargaFamilia><parentesco>{kinship}</parentesco>' || "
        + tag("mesDesde", "(1 + c_custkey % 6)")
        + " || "
        + tag("mesHasta", "(6 + (c_custkey + 3) % 7)")
        + f" || '<porcentajeDeduccion>{pct}</porcentajeDeduccion></cargaFamilia>', '')"
        for kinship, pct, every in DEPENDANTS
    )
    codes = ", ".join(str(code) for code in DEDUCTION_CODES)
    # What an employee declares under a code, in cents; nothing unless positive.
    cents = "(c_custkey * 3701 + code * 10103) % 1000000 - 510000"
    amount = f"CAST(CAST(CAST({cents} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(14,2)) AS STRING)"
    deduction = f"""'<deduccion tipo="' || code || '">' || {tag("montoTotal", amount)} || '</deduccion>'"""
    general = f"transform(array({codes}), code -> IF({cents} > 0, {deduction}, ''))"
    plain_id = "'20' || lpad(CAST(c_custkey AS STRING), 12, '0') || c_custkey % 10"
    xml = " || ".join(
        [
            "'<declaration><empleado>'",
            tag("cuit", plain_id),
            f"'</empleado><dependants>' || concat({family})",
            f"'</dependants><deductions>' || array_join({general}, '')",
            "'</deductions></declaration>'",
        ]
    )
    filed = _read(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    return filed.repartition(spark.sparkContext.defaultParallelism, "c_custkey").selectExpr(
        "'declaration-' || c_custkey AS file_path", f"{xml} AS xml"
    )


class DerivedTables:
    """The inputs of a run, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf: str, p: RunParams):
        self._spark, self._sf, self._params = spark, sf, p

    @cached_property
    def settlements(self) -> DataFrame:
        return _of_year(settlements(self._spark, self._sf), self._params)

    @cached_property
    def declarations(self) -> DataFrame:
        return declarations(self._spark, self._sf)

    def __getattr__(self, name: str) -> DataFrame:
        if name in PLAIN_TABLES:
            table = PLAIN_TABLES[name](self._spark, self._sf)
        elif name in SHEETS:
            table = SHEETS[name](self._spark, self._sf, self._params)
        else:
            raise AttributeError(name)
        setattr(self, name, table)
        return table


PLAIN_TABLES = {
    "lines": lines,
    "items": items,
    "persons": persons,
    "documents": documents,
    "labour": labour,
    "agreements": agreements,
    "item_sheet": item_sheet,
}
SHEETS = {
    "cap_sheet": cap_sheet,
    "bracket_sheet": bracket_sheet,
    "personal_sheet": personal_sheet,
    "general_sheet": general_sheet,
}


def audit(spark: SparkSession, sf: str, p: RunParams = JULY) -> PayrollAudit:
    return PayrollAudit(DerivedTables(spark, sf, p), p)
