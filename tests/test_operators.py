"""Controls on hand-written payrolls."""

from dataclasses import replace
from decimal import ROUND_HALF_UP
from decimal import Decimal as D
from fractions import Fraction

import pytest
from payroll_rows import JULY, Payroll, by_employee, day

from payproof import RunParams
from payproof.operators import lines, summary, withholding


def cents(value: Fraction) -> D:
    """A fraction of money units, rounded half-up once."""
    whole = D(value.numerator * 1000000) / D(value.denominator) / 1000000
    return whole.quantize(D("0.01"), ROUND_HALF_UP)


# Lines


def test_items_without_parameters(spark):
    a = Payroll().audit(spark)
    assert [tuple(r) for r in a.unparametrized_items.collect()] == [(99, "Item name 99")]
    nothing = a.item_catalog.limit(0)
    assert lines.unparametrized_items(nothing, a.item_parameters).count() == 0
    known = a.item_catalog.join(a.item_parameters.select("item_id"), "item_id", "left_semi")
    assert known.count() + a.unparametrized_items.count() == a.item_catalog.count()


def test_lines_of_an_unknown_item_stay(spark):
    p = Payroll().employee(1).pay(1, 7, (99, "5.00", None), (1, "7.00", None))
    df = p.audit(spark).enriched_lines
    assert len(df.columns) == len(set(df.columns)) == 19
    got = {r.item_id: r for r in df.collect()}
    assert got[99].category is None and got[99].catalog_item_id is None
    assert got[1].catalog_item_name == "Salary" and got[1].item_name == "line 1"


def test_presentation_order(spark):
    p = Payroll().employee(2).employee(1)
    p.pay(2, 7, (16, None, "1.00"), (1, "1.00", None), (99, "1.00", None), (4, "1.00", None), (10, None, "1.00"))
    p.pay(1, 7, (1, "1.00", None)).pay(2, 6, (99, "1.00", None))
    got = [(r.month, r.employee_id, r.item_id) for r in p.audit(spark).ordered_lines.collect()]
    assert got == [(6, 2, 99), (7, 1, 1), (7, 2, 1), (7, 2, 4), (7, 2, 10), (7, 2, 16), (7, 2, 99)]


# Pay summary


def test_pay_summary_buckets_and_balance(spark):
    p = Payroll().employee(1).employee(2)
    p.pay(
        1, 7,
        (1, "100.00", None), (3, "50.00", None), (4, "7.00", None), (99, "1000.00", None), (10, None, "11.00"),
        (11, None, "3.00"), (12, None, "2.00"), (13, None, "4.00"), (14, None, "5.00"), (15, None, "6.00"),
        (16, None, "8.00"),
    )
    p.pay(1, 6, (1, "9999.00", None)).pay(2, 7, (2, "20.00", None))
    a = p.audit(spark)
    got = by_employee(a.pay_summary)
    assert got[1] == {
        "tax_id": "20-00000001-0", "surname": "Surname1", "name": "Name1", "taxable": D("150.00"),
        "non_taxable": D("7.00"), "pension": D("11.00"), "health": D("3.00"), "union_dues": D("2.00"),
        "advances": D("4.00"), "garnishments": D("5.00"), "other": D("6.00"), "income_tax": D("8.00"),
        "net": D("118.00"),
    }
    assert got[2]["net"] == D("20.00")
    balance = a.totals_running_balance.collect()
    assert [(r.ord, r.concept, r.amount, r.running) for r in balance][:3] == [
        (1, "taxable", D("170.00"), D("170.00")),
        (2, "non_taxable", D("7.00"), D("177.00")),
        (3, "pension", D("11.00"), D("166.00")),
    ]
    assert (balance[9].concept, balance[9].amount, balance[9].running) == ("net", D("138.00"), D("0.00"))
    assert [r.status for r in balance] == [None] * 9 + ["match"]


def test_a_wrong_net_shows_as_difference(spark):
    a = Payroll().employee(1).pay(1, 7, (1, "100.00", None)).audit(spark)
    wrong = a.pay_summary_totals.selectExpr("* except (net)", "net + 0.01 AS net")
    last = summary.totals_running_balance(wrong).collect()[-1]
    assert (last.running, last.status) == (D("-0.01"), "difference")


def test_two_tax_ids_count_once_each(spark):
    p = Payroll().employee(1, tax_ids=2).pay(1, 7, (1, "100.00", None))
    got = sorted((r.tax_id, r.taxable) for r in p.audit(spark).pay_summary.collect())
    assert got == [("20-00000001-0", D("100.00")), ("20-00000001-1", D("100.00"))]


# Withholding: cap 1000.01, floor 100.00


@pytest.mark.parametrize(
    ("pay", "sac", "base"),
    [
        ("100.00", "0", "100.000"),
        ("99.99", "0", "100.000"),
        ("1000.01", "0", "1000.010"),
        ("1000.02", "0", "1000.010"),
        ("1000.00", "500.00", "1500.000"),
        ("1000.00", "500.01", "1500.005"),
        ("0", "600.00", "600.005"),
    ],
)
def test_contribution_base(spark, pay, sac, base):
    p = Payroll().employee(1).pay(1, 7, (1, pay, None), (3, sac, None))
    assert p.audit(spark).withholding_base.first().base == D(base)


def test_sac_counts_whatever_its_category(spark):
    p = Payroll().employee(1).pay(1, 7, (1, "200.00", None), (6, "30.00", None))
    row = p.audit(spark).withholding_base.first()
    assert (row.pay, row.sac, row.non_taxable, row.base) == (D("200.00"), D("30.00"), D("30.00"), D("230.000"))


def test_withholding_by_condition(spark):
    p = Payroll()
    for key, condition in ((1, 1), (2, 2), (3, None)):
        p.employee(key, condition=condition).pay(key, 7, (1, "500.00", None), (10, None, "70.00"), (11, None, "15.00"))
    got = by_employee(p.audit(spark).withholding_status)
    assert {k: (r["pension_ctrl"], r["health_ctrl"]) for k, r in got.items()} == {
        1: (D("0.00"), D("0.00")),
        2: (D("-15.00"), D("-15.00")),
        3: (D("0.00"), D("0.00")),
    }
    assert got[2]["pension_status"] == "refund" and got[1]["health_status"] == "match"
    assert got[1]["health_plan"] == "Item n" and len(got[1]) == 19


def test_health_minimum_below_twice_the_floor(spark):
    p = Payroll()
    for key, pay, condition in ((1, "199.99", 1), (2, "200.00", 1), (3, "150.00", 2)):
        p.employee(key, condition=condition).pay(key, 7, (1, pay, None))
    got = by_employee(p.audit(spark).withholding_control)
    assert {k: r["health_ctrl"] for k, r in got.items()} == {1: D("6.00"), 2: D("6.00"), 3: D("6.00")}


def test_half_a_cent_rounds_up_once(spark):
    # Base 1500.005: 14 % is 210.0007, 3 % is 45.00015.
    p = Payroll().employee(1).pay(1, 7, (1, "1000.00", None), (3, "900.00", None), (10, None, "210.00"), (11, None, "45.01"))
    row = p.audit(spark).withholding_control.first()
    assert (row.pension_ctrl, row.health_ctrl) == (D("0.00"), D("-0.01"))


def test_control_status_thresholds(spark):
    values = ["0.00", "0.10", "0.11", "-0.01", "-5.00", None]
    df = spark.createDataFrame([(v, v) for v in values], "p string, h string").selectExpr(
        "CAST(p AS DECIMAL(10,2)) pension_ctrl", "CAST(h AS DECIMAL(10,2)) health_ctrl"
    )
    got = {r.pension_ctrl: r.pension_status for r in withholding.control_status(df).collect()}
    assert got == {
        D("0.00"): "match", D("0.10"): "refund", D("0.11"): "difference", D("-0.01"): "refund",
        D("-5.00"): "refund", None: None,
    }


def test_order_of_the_control(spark):
    rows = [("a", "0.00", "0.00"), ("b", "5.00", "0.00"), ("c", "5.00", "1.00"), ("d", "9.00", "2.00"), ("e", None, "0.00")]
    df = spark.createDataFrame([(n, "s", n, p, h) for n, p, h in rows], "tax_id string, surname string, name string, p string, h string")
    df = df.selectExpr("tax_id", "surname", "name", "CAST(p AS DECIMAL(10,2)) pension_ctrl", "CAST(h AS DECIMAL(10,2)) health_ctrl")
    assert [r.tax_id for r in withholding.order_control(df).collect()] == ["d", "c", "a", "e", "b"]


def test_two_labour_rows_give_two_controls(spark):
    p = Payroll().employee(1, rows=2).pay(1, 7, (1, "500.00", None))
    got = p.audit(spark).withholding_control.collect()
    assert sorted(r.agreement for r in got) == ["First", "Second"]
    assert {r.pay for r in got} == {D("500.00")}


def test_reference_values(spark):
    row = Payroll().audit(spark).control_reference_values.first()
    assert tuple(row) == (D("1000.01"), D("100.00"), D("500.005"), D("200.00"))


# Income tax: base


def irregular(month, until, amount):
    return Fraction(amount) / (13 - month) * (until - month + 1)


@pytest.mark.parametrize("until", [4, 5, 6, 7, 12])
def test_prorated_irregular_pay(spark, until):
    p = Payroll().employee(1)
    paid = {m: f"{100 + 7 * m}.01" for m in range(1, until + 1)}
    for month, amount in paid.items():
        p.pay(1, month, (2, amount, None), (2, "0.01", None))
    row = p.audit(spark, RunParams(2024, until)).taxable_pay_base.first()
    total = {1: Fraction(0), 2: Fraction(0)}
    for month, amount in paid.items():
        total[1 if month <= 6 else 2] += irregular(month, until, D(amount) + D("0.01"))
    assert row.irregular_h1 == cents(total[1])
    assert row.irregular_h2 == cents(total[2])


def test_thirds_are_summed_before_rounding(spark):
    # One cent paid in October is due to a third by October: three of them make a cent.
    p = Payroll().employee(1).pay(1, 10, (2, "0.01", None), (2, "0.01", None), (2, "0.01", None))
    assert p.audit(spark, RunParams(2024, 10)).taxable_pay_base.first().irregular_h2 == D("0.01")


def test_irregular_pay_in_full(spark):
    p = Payroll().employee(1).pay(1, 2, (2, "10.00", None)).pay(1, 7, (2, "5.00", None)).pay(1, 8, (2, "99.00", None))
    row = p.audit(spark, replace(JULY, prorate_irregular=False)).taxable_pay_base.first()
    assert (row.irregular_h1, row.irregular_h2) == (D("10.00"), D("5.00"))


@pytest.mark.parametrize(
    ("month", "mode", "expected"),
    [
        (4, "semester", ("10.01", "0.00")),
        (5, "semester", ("10.01", "0.00")),
        (6, "semester", ("30.00", "0.00")),
        (6, "annual", ("10.01", "0.00")),
        (7, "semester", ("30.00", "0.00")),
        (7, "annual", ("10.01", "5.00")),
    ],
)
def test_thirteenth_salary_modes(spark, month, mode, expected):
    p = Payroll().employee(1).pay(1, 1, (1, "120.06", None), (3, "30.00", None))
    if month >= 7:
        p.pay(1, 7, (1, "60.00", None))
    row = p.audit(spark, RunParams(2024, month, sac_mode=mode)).taxable_pay_base.first()
    assert (row.sac_h1, row.sac_h2) == tuple(D(v) for v in expected)


def test_classes_of_the_base(spark):
    p = Payroll().employee(1, end_date=day("2019-07-15"))
    p.pay(1, 3, (1, "100.00", None), (4, "9.00", None), (5, "1.00", None), (10, None, "3.00"), (11, None, "2.00"))
    p.pay(1, 7, (1, "50.00", None), (12, None, "1.00"), (13, None, "77.00"), (16, None, "4.00"))
    row = p.audit(spark).taxable_pay_base.first()
    assert (row.regular_h1, row.regular_h2, row.exempt) == (D("100.00"), D("50.00"), D("10.00"))
    assert (row.social_deductions, row.tax_withheld) == (D("6.00"), D("4.00"))
    # The year of the end date is not looked at.
    assert row.status == "Baja" and row.month == 7


@pytest.mark.parametrize(("end", "status"), [("2024-07-01", "Baja"), ("2024-08-01", "Activo"), (None, "Activo")])
def test_status(spark, end, status):
    p = Payroll().employee(1, end_date=end and day(end)).pay(1, 7, (1, "1.00", None))
    assert p.audit(spark).taxable_pay_base.first().status == status


def test_two_labour_rows_double_the_base(spark):
    p = Payroll().employee(1, rows=2).pay(1, 7, (1, "100.00", None), (2, "60.00", None))
    rows = p.audit(spark).taxable_pay_base.collect()
    assert [(r.regular_h2, r.irregular_h2) for r in rows] == [(D("200.00"), D("20.00"))]


# Income tax: deductions


def test_dependants_are_priced(spark):
    def dependant(kinship, pct, start, end):
        return (
            f"<cargaFamilia><parentesco>{kinship}</parentesco><mesDesde>{start}</mesDesde><mesHasta>{end}</mesHasta>"
            f"<porcentajeDeduccion>{pct}</porcentajeDeduccion></cargaFamilia>"
        )

    p = Payroll().employee(1)
    p.declaration(1, dependant(1, 100, 1, 12) + dependant(3, 50, 7, 12) + dependant(30, 100, 1, 7))
    p.declaration(1, dependant(31, 33, 1, 12) + dependant(32, 100, 8, 12) + dependant(5, 100, 1, 12))
    a = p.audit(spark)
    got = sorted((r.kinship, r.kind, r.applies, r.amount) for r in a.dependant_deductions.collect() if r.kind)
    assert got == [
        (1, "conyuge", 1, D("80.0000")),
        (3, "hijo", 1, D("20.0000")),
        (30, "hijo", 1, D("40.0000")),
        (31, "hijo incapacitado", 1, D("26.4000")),
        (32, "hijo incapacitado", 0, D("0.0000")),
    ]
    unclassified = a.dependant_deductions.where("kind IS NULL").first()
    assert unclassified.kinship == 5 and unclassified.amount is None
    assert a.dependant_totals.first().amount == D("166.40")


def test_deductions_side_by_side(spark):
    p = Payroll().deduct(1, c8="1.10", c99="3").deduct(1, c8="2.20", c77="50")
    row = p.audit(spark).general_deductions_wide.first()
    assert len(row) == 20
    assert (row.domestic_staff, row.other_deductions, row.donations) == (D("3.30"), D("3.00"), D("0.00"))


# Limits of July: 2, 23, 24 -> 20; 4 -> 25; 5 -> 10; 11 -> 30; 8, 22, 32 -> 40 % of 100.
DECLARED = {
    "c1": "30", "c2": "21", "c3": "5", "c4": "25.01", "c5": "9.99", "c7": "31", "c8": "40.01", "c9": "1", "c10": "2",
    "c11": "30", "c21": "3", "c22": "39.99", "c23": "20", "c24": "50", "c25": "7", "c32": "100", "c33": "4", "c34": "5",
    "c99": "6",
}


def test_limits_of_an_active_employee(spark):
    p = Payroll().employee(1).pay(1, 7, (1, "1000.00", None)).deduct(1, **DECLARED)
    row = p.audit(spark).taxable_net_gain.first()
    # 5 % of pay minus the other deductions as declared, whose group only subtracts its first term.
    group = D("21") - sum(D(DECLARED[c]) for c in DECLARED if c not in ("c1", "c2", "c3", "c7"))
    limit = ((D("1000") - group) * D("0.05")).quantize(D("0.01"), ROUND_HALF_UP)
    assert row.net_gain_limit == limit
    assert row.medical_insurance == D("30.00") and row.donations == D("5.00") and row.medical_fees == 0
    assert row.life_insurance == row.mixed_insurance == row.retirement_insurance == row.mutual_funds == 0
    assert (row.mortgage_interest, row.funeral_expenses, row.mobility) == (D("25.00"), D("9.99"), D("30.00"))
    assert (row.domestic_staff, row.rent_40, row.education) == (D("40"), D("39.99"), D("40"))
    assert (row.guarantee_societies, row.travelling_sales, row.work_clothing) == (D("1"), D("2"), D("3"))
    assert (row.rent_10_tenant, row.rent_10_landlord, row.other_deductions) == (D("4"), D("5"), D("6"))
    # Net gain: the whole group as declared is subtracted, so all but its first term add back.
    whole = D("30") - sum(D(v) for c, v in DECLARED.items() if c != "c1")
    expected = D("1000") - D("100") - D("500") - D("50") - whole
    assert row.taxable_gain == expected


def test_limits_of_a_leaver(spark):
    p = Payroll().employee(1, end_date=day("2024-07-31")).pay(1, 7, (1, "5000.00", None)).deduct(1, **DECLARED)
    row = p.audit(spark).taxable_net_gain.first()
    assert (row.life_insurance, row.mixed_insurance, row.retirement_insurance) == (D("20"), D("20"), D("20"))
    assert (row.mutual_funds, row.medical_fees) == (D("7"), D("31"))
    # December, type 2.
    assert (row.gni, row.special, row.twelfth) == (D("150.00"), D("700.00"), D("70.83"))


def test_corrected_reading(spark):
    p = Payroll().employee(1).pay(1, 7, (1, "1000.00", None)).deduct(1, **DECLARED)
    row = p.audit(spark, replace(JULY, corrected=True)).taxable_net_gain.first()
    before = sum(map(D, ["25", "9.99", "40", "1", "2", "30", "3", "39.99", "40", "4", "5", "6"]))
    limit = ((D("1000") - before) * D("0.05")).quantize(D("0.01"), ROUND_HALF_UP)
    assert row.net_gain_limit == limit
    assert row.taxable_gain == D("1000") - D("650") - before - min(D("30"), limit) - D("5")


def test_a_negative_net_gain_limit(spark):
    p = Payroll().employee(1).employee(2)
    for key in (1, 2):
        p.pay(key, 7, (4, "1.00", None), (10, None, "100.00"))
    p.deduct(1, c99="0")
    got = by_employee(p.audit(spark).taxable_net_gain)
    # Declared 0 is above the negative limit; not declared is 0.
    assert got[1]["net_gain_limit"] == got[2]["net_gain_limit"] == D("-5.00")
    assert (got[1]["donations"], got[2]["donations"]) == (D("-5.00"), D("0.00"))
    assert got[1]["taxable_gain"] == got[2]["taxable_gain"] == 0


# Income tax: due. Allowances of July are 100 + 500 + 50, so pay of 650 + g leaves a gain of g.


@pytest.mark.parametrize(
    ("gain", "fixed", "rate", "due"),
    [
        ("0.00", "0.00", 0, "0.00"),
        ("0.01", "0.00", 5, "0.00"),
        ("0.10", "0.00", 5, "0.01"),
        ("100.00", "0.00", 5, "5.00"),
        ("100.01", "5.00", 9, "5.00"),
        ("300.00", "5.00", 9, "23.00"),
        ("300.01", "23.00", 15, "23.00"),
        ("1000.00", "23.00", 15, "128.00"),
    ],
)
def test_brackets(spark, gain, fixed, rate, due):
    p = Payroll().employee(1).pay(1, 7, (1, str(D("650") + D(gain)), None), (16, None, "2.50"))
    row = p.audit(spark).income_tax_control.first()
    assert row.taxable_gain == D(gain)
    assert (row.fixed, row.rate, row.tax_due) == (D(fixed), rate, D(due))
    assert row.balance == D(due) - D("2.50")


def test_leavers_use_the_december_scale(spark):
    p = Payroll().employee(1, end_date=day("2024-07-01")).employee(2, end_date=day("2024-12-01")).employee(3)
    for key in (1, 2, 3):
        p.pay(key, 7, (1, "10000.00", None))
    july = by_employee(p.audit(spark).income_tax_control)
    assert (july[1]["rate"], july[2]["rate"]) == (30, 15)
    # In December all three row types belong to the month.
    december = by_employee(p.audit(spark, RunParams(2024, 12)).income_tax_control)
    assert {k: (r["rate"], r["gni"]) for k, r in december.items()} == {
        1: (10, D("200.00")), 2: (30, D("150.00")), 3: (10, D("200.00")),
    }


def test_first_semester_leaver(spark):
    p = Payroll().employee(1, end_date=day("2024-04-01")).pay(1, 4, (1, "1000.00", None))
    row = p.audit(spark, RunParams(2024, 4)).income_tax_control.first()
    assert (row.status, row.gni, row.special, row.rate) == ("Baja", D("60.00"), D("300.00"), 20)


def test_no_allowance_row_means_no_tax(spark):
    p = Payroll().employee(1, end_date=day("2024-07-01")).pay(1, 7, (1, "1000.00", None), (16, None, "9.00"))
    a = p.audit(spark)
    from payproof.operators import income_tax

    only_month = a.personal_deduction_params.where("type = 0")
    gain = income_tax.taxable_net_gain(
        a.taxable_pay_base, only_month, a.deduction_limits, a.declared_by_employee, a.params
    )
    row = income_tax.income_tax_control(gain, a.tax_brackets, a.params).first()
    assert row.gni is None and row.twelfth is None and row.taxable_gain is None
    assert (row.rate, row.tax_due, row.balance) == (0, D("0.00"), D("-9.00"))


def test_report_columns(spark):
    df = Payroll().employee(1).pay(1, 7, (1, "1.00", None)).audit(spark).income_tax_control
    assert df.columns[0] == "balance" and len(df.columns) == 46


def test_overflow_fails(spark):
    # 5 % of this pay does not fit the ten digits of the net-gain limit.
    p = Payroll().employee(1).pay(1, 7, (1, "9999999999.00", None))
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        p.audit(spark).income_tax_control.collect()


# Employer's return


def test_return_bases(spark):
    p = Payroll().employee(1).employee(2).employee(3)
    p.pay(1, 7, (1, "2000.00", None), (3, "600.00", None), (5, "10.00", None), (6, "40.00", None), (99, "1.00", None))
    p.pay(2, 3, (1, "500.00", None)).pay(3, 7, (1, "50.00", None))
    got = by_employee(p.audit(spark).f931_bases)
    # The odd cap: 1000.01 + 500.005 rounds up.
    assert (got[1]["r1"], got[1]["r4"]) == (D("1500.02"), D("1500.02"))
    assert got[1]["r2"] == got[1]["r3"] == got[1]["r8"] == D("2600.00")
    assert (got[1]["r9"], got[1]["non_taxable"], got[1]["total"]) == (D("2610.00"), D("40.00"), D("2651.00"))
    assert got[1]["r10"] == D("-4403.68")
    idle = got[2]
    assert idle["r1"] == idle["r2"] == idle["r9"] == idle["total"] == 0 and idle["r10"] == D("-7003.68")
    # No floor here, unlike the withholding base.
    assert got[3]["r1"] == D("50.00")
    assert len(idle) == 14


def test_return_allowance_is_a_parameter(spark):
    p = Payroll().employee(1).pay(1, 7, (1, "2000.00", None))
    assert p.audit(spark, replace(JULY, r10_allowance=D("1.50"))).f931_bases.first().r10 == D("1998.50")
