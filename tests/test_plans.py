"""Shapes of the physical plans, and hot keys."""

import random
import re
from dataclasses import replace
from decimal import Decimal as D

import pytest
from payroll_rows import JULY, Payroll, by_employee

import __spark_entry__ as driver
from payproof import PayrollAudit, RunParams
from payproof.operators import income_tax
from workload import mapping
from workload import queries as workload_queries

PER_EMPLOYEE = ("pay_summary", "withholding_control", "f931_bases", "taxable_pay_base", "income_tax_control")
WRITING = (
    "report_exports", "line_exports", "item_exports", "taxable_pay_base_landed", "settlement_lines_bucketed",
    "employee_attributes_indexed", "pay_summary_stored", "withholding_control_stored", "f931_bases_stored",
    "f572_deductions_ingested", "income_tax_control_stored",
)


@pytest.fixture
def conf(spark):
    """Sets session options for one test."""
    before = {}

    def set_all(**options):
        for key, value in options.items():
            key = "spark.sql." + key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_all
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", [n for n in workload_queries.queries() if n not in WRITING])
def test_no_crossed_rows_and_no_python(spark, sf, name):
    text = plan(workload_queries.queries()[name](spark, sf))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "Scan ExistingRDD"):
        assert operator not in text


def test_scans_read_only_what_they_need(spark, sf):
    text = plan(mapping.audit(spark, sf).pay_summary)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_extendedprice:double>" in text
    orders = next(part for part in text.split("\n\n\n") if "orders.parquet" in part)
    assert "GreaterThanOrEqual(o_orderdate" in orders and "LessThan(o_orderdate" in orders


@pytest.mark.parametrize("name", PER_EMPLOYEE)
def test_lines_are_summed_before_they_are_shuffled_to_employees(spark, sf, conf, name):
    conf(autoBroadcastJoinThreshold="-1")
    text = plan(driver.queries()[name](spark, sf))
    exchanges = re.findall(r"Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]\s*\nArguments: hashpartitioning\(employee_id", text)
    with_amounts = [columns for columns in exchanges if "earning" in columns or "deduction#" in columns]
    assert exchanges and not with_amounts


def test_landed_lines_are_read_by_period(spark, sf, tmp_path):
    a = mapping.audit(spark, sf)
    a.land(str(tmp_path / "lines"))
    landed = a.on_landed(spark.read.parquet(str(tmp_path / "lines")))
    text = plan(landed.pay_summary)
    assert re.search(r"PartitionFilters: \[[^\n]*month[^\n]*= 7", text)
    assert "lineitem" not in text and "orders" not in text


HOT = 30_000


def hot_payroll():
    """A third of all lines in one settlement, another third on one employee, and one item on most lines."""
    rng = random.Random(7)
    p = Payroll()
    for key in range(1, 101):
        p.employee(key)
    pay = {key: D(0) for key in range(1, 101)}

    def items(key, n):
        rows = []
        for _ in range(n):
            amount = D(rng.randrange(1, 10_000)) / 100
            item = 1 if rng.random() < 0.7 else rng.choice((2, 4, 10))
            if item in (1, 2):
                pay[key] += amount
            rows.append((item, str(amount), None) if item != 10 else (item, None, str(amount)))
        return rows

    p.pay(1, 7, *items(1, HOT // 3))
    for _ in range(HOT // 300):
        p.pay(2, 7, *items(2, 100))
    for i in range(HOT // 3):
        key = 3 + i % 98
        p.pay(key, 7, *items(key, 1))
    return p, pay


def test_hot_settlement_and_employee(spark, conf):
    """Splits happen at run time, and every line is counted."""
    conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="32KB",
        adaptive__coalescePartitions__enabled="false",
    )
    p, pay = hot_payroll()
    # Several partitions, as skew is split along the tasks that wrote the shuffle.
    tables = p.tables(spark)
    df = PayrollAudit(replace(tables, lines=tables.lines.repartition(16)), JULY).pay_summary
    got = {key: row["taxable"] for key, row in by_employee(df).items()}
    assert got == {key: amount for key, amount in pay.items()}
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_labour_rows_and_documents(spark, conf):
    """One employee with a third of the labour rows and of the tax ids."""
    conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__forceOptimizeSkewedJoin="true",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="4KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="2KB",
        adaptive__coalescePartitions__enabled="false",
    )
    p = Payroll().employee(1, rows=40, tax_ids=30)
    for key in range(2, 82):
        p.employee(key)
    for key in range(1, 82):
        p.pay(key, 7, (1, "500.00", None))
    p.labour += p.labour[:40] * 5
    a = p.audit(spark)
    # Agreements 3 and up have no name, so the rows differ in two names and one null.
    control = a.withholding_control.collect()
    assert len(control) == 30 * 3 + 80 and {r.pay for r in control} == {D("500.00")}
    base = a.taxable_pay_base.collect()
    assert sorted(r.regular_h2 for r in base) == [D("500.00")] * 80 + [D("1500.00")] * 30


def test_controls_agree_on_compact_lines(spark):
    p, _ = hot_payroll()
    a = p.audit(spark)
    compact = a.on_pay_lines(a.compact_lines)
    for name in PER_EMPLOYEE:
        expected = sorted(map(str, getattr(a, name).collect()))
        assert sorted(map(str, getattr(compact, name).collect())) == expected


def test_brackets_are_found_without_interpreted_lambdas(spark, sf):
    a = mapping.audit(spark, sf)
    matched = income_tax.match_bracket(spark.createDataFrame([], a.taxable_net_gain.schema), a.tax_brackets, a.params)
    assert "lambda" not in plan(matched)


def test_a_large_sheet_is_refused(spark):
    from payproof.functions.bounds import with_sheet

    rows = spark.range(50)
    assert len(with_sheet(spark.range(1), "rows", rows, 50).first().rows) == 50
    with pytest.raises(Exception, match="more than 49 rows"):
        with_sheet(spark.range(1), "rows", rows, 49).collect()


def test_reports_are_built_without_a_job(spark):
    p = Payroll().employee(1)
    p.pay(1, 7, (1, "500.00", None))
    a = p.audit(spark)
    spark.sparkContext.setJobGroup("building", "building")
    try:
        text = plan(a.income_tax_control)
        assert a.f931_bases and a.withholding_control and a.pay_summary
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "status" not in "".join(re.findall(r"(?:Left|Right) keys[^\n]*", text))


def test_sums_need_ansi(spark, conf):
    conf(ansi__enabled="false")
    with pytest.raises(ValueError, match="ansi"):
        Payroll().employee(1).audit(spark)


def test_employee_properties(spark, sf):
    """What must hold for every employee, whatever the data."""
    a = mapping.audit(spark, sf)
    assert a.f931_bases.where("r1 > r2 OR r1 != r4 OR r2 != r8").count() == 0
    assert a.totals_running_balance.where("status = 'match'").count() == 1
    full = a.with_params(prorate_irregular=False).taxable_pay_base.select("tax_id", "irregular_h1", "irregular_h2")
    both = a.taxable_pay_base.join(full.toDF("tax_id", "full_h1", "full_h2"), "tax_id")
    assert both.where("irregular_h1 > full_h1 OR irregular_h2 > full_h2").count() == 0
    tax = a.income_tax_control.where("status = 'Activo'").orderBy("taxable_gain").collect()
    assert all(x.tax_due <= y.tax_due for x, y in zip(tax, tax[1:]))
    assert JULY.month == a.params.month


def test_an_unknown_settlement_type_is_refused():
    with pytest.raises(ValueError, match="settlement type"):
        RunParams(2024, 7, settlement_type="men")
