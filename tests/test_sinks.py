import os
from decimal import Decimal as D

import pytest
from payroll_rows import Payroll
from pyspark.sql import functions as F

from payproof import PayrollAudit
from payproof.plans.audit import published
from payproof.sinks import exports


@pytest.fixture(scope="module")
def audit(spark):
    p = Payroll().employee(1).employee(2)
    p.pay(1, 7, (1, "500.00", None), (10, None, "70.00"), (99, "1.00", None)).pay(2, 6, (1, "80.00", None))
    return p.audit(spark)


def test_exports(spark, audit, tmp_path):
    audit.export(str(tmp_path))
    items = spark.read.option("header", True).csv(str(tmp_path / "items"))
    assert items.columns == ["item_id", "name"] and items.count() == audit.item_catalog.count()
    missing = spark.read.option("header", True).csv(str(tmp_path / "unparametrized_items"))
    assert [tuple(r) for r in missing.collect()] == [("99", "Item name 99")]
    lines = spark.read.parquet(str(tmp_path / "lines"))
    assert sorted(os.listdir(tmp_path / "lines" / "year=2024")) == ["month=6", "month=7"]
    assert len(lines.columns) == 20 and lines.count() == 4


def test_a_run_writes_every_report(spark, audit, tmp_path):
    written = audit.run(str(tmp_path))
    rows = {name: spark.read.parquet(path).collect() for name, path in written.items()}
    assert {name: len(found) for name, found in rows.items()} == {
        "pay_summary": 1,
        "withholding_control": 1,
        "control_reference_values": 1,
        "income_tax_control": 2,
        "f931_bases": 2,
        "totals_running_balance": 10,
    }
    assert rows["pay_summary"][0].net == D("430.00")
    assert rows["totals_running_balance"][-1].status == "match"
    assert rows["withholding_control"][0].pension_status == "match"


def test_a_run_again_replaces_the_reports(spark, audit, tmp_path):
    path = str(tmp_path)
    first = audit.run(path)
    assert published(spark, path) == first
    second = audit.with_params(month=6).run(path)
    assert published(spark, path) == second and second.keys() == first.keys()
    assert spark.read.parquet(second["pay_summary"]).first().taxable == D("80.00")
    # Whoever still reads the first run is not disturbed.
    assert spark.read.parquet(first["pay_summary"]).count() == 1


def test_a_run_that_fails_leaves_the_published_reports_whole(spark, audit, tmp_path, monkeypatch):
    path = str(tmp_path)
    first = audit.run(path)
    reports = PayrollAudit.reports

    def third_raises(self):
        out = reports(self)
        name = list(out)[2]
        return out | {name: out[name].withColumn("cap", F.raise_error(F.lit("third report")).cast("decimal(14,2)"))}

    monkeypatch.setattr(PayrollAudit, "reports", third_raises)
    with pytest.raises(Exception, match="third report"):
        audit.with_params(month=6).run(path)
    assert published(spark, path) == first
    assert spark.read.parquet(first["pay_summary"]).first().net == D("430.00")
    assert len(list(tmp_path.glob("data/*"))) == 2  # the reports that were written before it are there, and not published


def test_several_attribute_rows_fail_a_run_that_says_so(spark, tmp_path):
    p = Payroll().employee(1).employee(2, rows=2).pay(1, 7, (1, "500.00", None)).pay(2, 6, (1, "80.00", None))
    a, path = p.audit(spark), str(tmp_path)
    assert a.run(path, most_attributes=2).keys() == published(spark, path).keys()
    first = published(spark, path)
    with pytest.raises(ValueError, match="employee 2 has 2 attribute rows"):
        a.run(path, most_attributes=1)
    assert published(spark, path) == first


def test_nothing_published_yet(spark, tmp_path):
    assert published(spark, str(tmp_path)) == {}


def test_reports_as_text(spark, audit, tmp_path):
    written = exports.write_reports({"summary": audit.pay_summary}, str(tmp_path), "csv")
    row = spark.read.option("header", True).csv(written["summary"]).first()
    assert row.taxable == "500.00" and row.tax_id == "20-00000001-0"


def test_landed_lines_serve_every_period(spark, audit, tmp_path):
    audit.land(str(tmp_path / "landed"))
    landed = audit.on_landed(spark.read.parquet(str(tmp_path / "landed")))
    for name in ("pay_summary", "employee_attributes", "enriched_lines", "f931_bases"):
        assert sorted(map(str, getattr(landed, name).collect())) == sorted(map(str, getattr(audit, name).collect()))
    june = landed.with_params(month=6)
    assert [r.taxable for r in june.pay_summary.collect()] == [D("80.00")]


def test_landing_a_month_leaves_the_others(spark, tmp_path):
    p = Payroll().employee(1)
    p.pay(1, 6, (1, "80.00", None)).pay(1, 7, (1, "500.00", None))
    first, path = p.audit(spark), str(tmp_path / "landed")
    first.land(path, 2024, 6)
    assert {r.month for r in spark.read.parquet(path).collect()} == {6}
    p.pay(1, 7, (1, "20.00", None)).pay(1, 6, (1, "1.00", None))
    p.audit(spark).land(path, 2024, 7)
    landed = spark.read.parquet(path)
    assert sorted((r.month, r.earning) for r in landed.collect()) == [(6, D("80.00")), (7, D("20.00")), (7, D("500.00"))]
