import os
from decimal import Decimal as D

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from payroll_rows import FIXTURES, JULY, Payroll

from payproof import RunParams, schemas
from payproof.sources import declarations, payroll, sheets, tables
from payproof.sources.database import from_database, from_sheets, lines_of_period, period_query


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_years_latest_five_first(spark):
    data = [(i, 1, 1, "Emb", y, 1) for i, y in enumerate((2018, 2019, 2020, 2021, 2022, 2023, 2023))]
    data.append((99, 1, 1, "Men", 2030, 1))
    df = spark.createDataFrame(data, schemas.SETTLEMENTS)
    years = payroll.period_years(df, RunParams(2023, 1, settlement_type="Emb"))
    assert [r.year for r in years.collect()] == [2023, 2022, 2021, 2020, 2019]


def test_months_ascending_of_the_year(spark):
    data = [(i, 1, 1, "Emb", y, m) for i, (y, m) in enumerate(((2023, 11), (2023, 2), (2023, 11), (2022, 5)))]
    df = spark.createDataFrame(data, schemas.SETTLEMENTS)
    months = payroll.period_months(df, RunParams(2023, 1, settlement_type="Emb"))
    assert [r.month for r in months.collect()] == [2, 11]


def test_settlement_lines_keep_the_period_and_the_tax_id(spark):
    p = Payroll().employee(1).employee(2)
    p.pay(1, 6, (1, "10.00", None)).pay(1, 8, (1, "20.00", None)).pay(1, 7, (10, None, "3.00"), year=2023)
    got = p.audit(spark).settlement_lines.collect()
    assert [(r.tax_id, r.earning, r.deduction, r.month) for r in got] == [
        ("20-00000001-0", D("10.00"), D("0.00"), 6)
    ]
    assert len(got[0]) == 12


def test_one_settlement_type_or_all(spark):
    p = Payroll().employee(1).pay(1, 7, (1, "1.00", None), kind="Emb").pay(1, 7, (1, "2.00", None), kind="Jor")
    assert p.audit(spark).period_lines.count() == 2
    assert p.audit(spark, RunParams(2024, 7, settlement_type="Jor")).period_lines.count() == 1


def frames():
    """A database of two settlement types whose settlements carry the same numbers."""
    out = {
        "LiquidacionItems": ([(1, "Salary")], "idLiquidacionItem int, Nombre string"),
        "DatosPersonales": (
            [(7, "Doe", "Jo", None), (8, "Roe", "Al", None)],
            "idDatoPersonal int, Apellido string, Nombres string, FechaBaja timestamp",
        ),
        "DatosPersonalesDocumentos": (
            [(7, 33, "20-7-1"), (8, 33, "20-8-1")],
            "idDatoPersonal int, idTipoDocumento int, NumeroDocumento string",
        ),
        "DatosPersonalesLaborales": (
            [(7, 2, 1, None, 5, True)],
            "idDatoPersonal int, idCodigoCondicion int, idObraSocial int, idSindicato int, idConvenioTipo int, "
            "SindEsAfiliado boolean",
        ),
        "MAE_ConveniosTipos": ([(5, "Deck")], "idConvenioTipo int, ConvenioTipo string"),
    }
    for kind, employee, pay in (("Emb", 7, 100.5), ("Men", 8, 20.25)):
        out[f"Liquidaciones{kind}"] = (
            [(1, employee, 3, 2024, 7, "x")],
            "idLiquidacion int, idDatoPersonal int, idLiquidacionTipo int, PeriodoAnio int, PeriodoMes int, Otro string",
        )
        out[f"Liquidaciones{kind}Detalle"] = (
            [(1, 1, 1.0, pay, None, "Salary")],
            "idLiquidacion int, idLiquidacionItem int, Cantidad double, Haber double, Dscto double, NombreItem string",
        )
    return out


def database(spark):
    tables_of = frames()
    return from_database(lambda name: spark.createDataFrame(*tables_of[name]), ("Emb", "Men"))


def test_a_period_is_joined_and_filtered_in_the_database(spark):
    for name, (data, schema) in frames().items():
        if name.endswith("Detalle"):
            data = [*data, (2, 1, 1.0, 9.0, None, "Salary")]
        elif name.startswith("Liquidaciones"):
            data = [*data, (2, 7, 3, 2023, 7, "x")]
        spark.createDataFrame(data, schema).createOrReplaceTempView(name)
    asked = []

    def query(text):
        asked.append(text)
        return spark.sql(f"SELECT * FROM {text}")

    got = lines_of_period(query, 2024, kinds=("Emb", "Men"))
    assert rows(got.select("settlement_type", "employee_id", "earning", "deduction")) == [
        ("Emb", 7, D("100.50"), D("0.00")),
        ("Men", 8, D("20.25"), D("0.00")),
    ]
    t = database(spark)
    assert got.dtypes == payroll.joined_lines(t["settlements"], t["lines"]).dtypes
    assert "LiquidacionesEmbDetalle d" in asked[0] and "PeriodoAnio = 2024" in asked[0] and asked[0].startswith("(SELECT")
    assert "PeriodoMes BETWEEN 1 AND 7" in period_query("Jor", 2024, (1, 7))


def test_settlement_types_number_their_own_settlements(spark):
    t = database(spark)
    both = payroll.period_lines(t["settlements"], t["lines"], RunParams(2024, 7))
    got = rows(both.select("settlement_type", "employee_id", "earning"))
    assert got == [("Emb", 7, D("100.50")), ("Men", 8, D("20.25"))]
    men = RunParams(2024, 7, settlement_type="Men")
    assert rows(payroll.settled_employees(t["settlements"], t["lines"], men)) == [(8,)]


def test_database_tables_take_the_types_of_the_model(spark):
    t = database(spark)
    assert dict(t["lines"].dtypes)["earning"] == "decimal(14,2)"
    assert dict(t["persons"].dtypes)["end_date"] == "date"
    profile = payroll.employee_profiles(t["labour"], t["persons"], t["items"], t["agreements"])
    assert rows(profile) == [(7, True, "Deck", "Salary", None, True, None)]


def test_sheets_with_their_own_headings(spark, tmp_path):
    files = {
        "items_liquidacion": "nombre,idLiquidacionItem,categoria,subcategoria,ganancias,r4r8,r9\nSalary,1,remunerativo,,habitual,,true",
        "bases_imponibles": "Minima,Periodo,Maxima\n100,2024-07-01,1000.01",
        "gan_art_94": "periodo,desde,hasta,suma_fija,coeficiente,excedente,codigo_porcentaje,tipo\n2024-07-01,0,10,1,5,0,1,0",
        "gan_deducciones_personales": "Periodo,GNI,Especial,Conyuge,Hijo,Hijo_Incapacitado,Tipo\n2024-07-01,1,2,3,4,5,0",
        "gan_deducciones_generales": "PERIODO,Deduccion,Codigo,Tipo,Tope,Porcentaje\n2024-01-01,x,2,A,20.5,",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text + "\n")
    got = from_sheets(lambda name: tables.read_headed(spark, str(tmp_path / f"{name}.csv")))
    assert rows(sheets.contribution_caps(got["cap_sheet"], JULY))[0][1:] == (D("1000.01"), D("100.00"))
    assert sheets.item_parameters(got["item_sheet"]).first().subcategory == "n/a"
    assert sheets.tax_brackets(got["bracket_sheet"], JULY).first().rate == 5
    assert sheets.personal_deduction_params(got["personal_sheet"], JULY).first().disabled_child == D("5.00")
    assert sheets.general_deduction_params(got["general_sheet"], JULY).first().cap == D("20.50")


def test_attributes_are_distinct_and_only_of_settled_employees(spark):
    p = Payroll().employee(1, condition=2).employee(2, condition=None, health=777, union=None).employee(3)
    p.labour.append(p.labour[0])
    p.pay(1, 1, (1, "1.00", None), (2, "1.00", None)).pay(2, 9, (1, "1.00", None))
    p.settlements.append((50, 3, 1, "Men", 2024, 1))  # a header without lines
    got = rows(p.audit(spark).employee_attributes.drop("end_date"))
    assert got == [
        (1, True, "First", "Item name 1", "Item name 2", True),
        (2, False, "First", None, None, True),
    ]


def test_duplicate_attributes(spark):
    p = Payroll().employee(1, rows=2).employee(2).pay(1, 1, (1, "1.00", None)).pay(2, 1, (1, "1.00", None))
    assert rows(p.audit(spark).duplicate_attributes) == [(1, 2)]


def test_item_sheet_is_typed(spark):
    params = Payroll().audit(spark).item_parameters
    got = {r.item_id: r for r in params.collect()}
    assert got[1].subcategory == "n/a" and got[1].r9 is True and got[10].r4r8 is None
    assert dict(params.dtypes)["r9"] == "boolean"


def test_final_rows_come_with_the_month(spark):
    a = Payroll().audit(spark)
    got = sorted((r.period.month, r.type) for r in a.personal_deduction_params.collect())
    assert got == [(7, 0), (12, 1), (12, 2)]
    assert sorted((r.period.month, r.type) for r in a.tax_brackets.collect()) == [
        (7, 0), (7, 0), (7, 0), (12, 1), (12, 2),
    ]
    assert a.general_deduction_params.count() == 7


def test_a_type_2_row_of_any_month_is_kept(spark):
    sheet = spark.createDataFrame([("2024-03-01", "2"), ("2024-03-01", "1"), ("2023-03-01", "2")], "period string, type string")
    sheet = sheet.selectExpr("CAST(period AS DATE) period", *(f"'0' AS {n}" for n in ("gni", "special", "spouse", "child", "disabled_child")), "type")
    assert [r.type for r in sheets.personal_deduction_params(sheet, JULY).collect()] == [2]


def test_deduction_limits(spark):
    got = Payroll().audit(spark).deduction_limits.collect()
    assert len(got) == 1
    assert got[0].gni == D("100.00") and got[0].limit_life_insurance == D("20.00")
    assert got[0].limit_rent_40 == got[0].limit_domestic_staff == got[0].limit_education == D("40.0000")


def test_december_limits_use_the_monthly_row(spark):
    assert Payroll().audit(spark, RunParams(2024, 12)).deduction_limits.first().gni == D("200.00")


def test_missing_limits_fail(spark):
    with pytest.raises(Exception, match="no value for this period"):
        Payroll().audit(spark, RunParams(2022, 7)).deduction_limits.collect()


def test_conflicting_limits_fail(spark):
    a = Payroll().audit(spark)
    sheet = a.tables.cap_sheet.selectExpr("period", "cap", "floor")
    doubled = sheet.unionAll(sheet.selectExpr("period", "'5.00'", "floor"))
    from payproof.operators.limits import single_cap

    with pytest.raises(Exception, match="several values"):
        single_cap(sheets.contribution_caps(doubled, JULY)).collect()
    same = sheet.unionAll(sheet)
    assert single_cap(sheets.contribution_caps(same, JULY)).first().cap == D("1000.01")


def test_malformed_sheet_fails(spark, tmp_path):
    path = tmp_path / "caps.csv"
    path.write_text("period,cap,floor\nnot a date,1,2\n")
    with pytest.raises(Exception):
        tables.read_sheet(spark, str(path), schemas.CAP_SHEET).collect()


@pytest.fixture
def folder(spark):
    return tables.read_declarations(spark, os.path.join(FIXTURES, "f572"))


def test_declared_dependants(folder):
    assert rows(declarations.f572_dependants(folder)) == [
        ("20000000071", 3, 50, 4, 12),
        ("20000000071", 5, 100, 1, 12),
        ("20000000093", 1, 100, 1, 6),
    ]


def test_declared_deductions(folder):
    assert rows(declarations.f572_deductions(folder)) == [
        ("20000000071", 8, D("0.44")),
        ("20000000071", 8, D("1234.56")),
        ("20000000071", 77, D("5.00")),
        ("20000000082", 1, D("10.00")),
    ]


@pytest.mark.parametrize(
    "xml",
    [
        '<d><empleado><cuit>1</cuit></empleado><deduccion tipo="1"></deduccion></d>',
        '<d><empleado><cuit>1</cuit></empleado><deduccion tipo="1"><montoTotal> </montoTotal></deduccion></d>',
        "<d><empleado><cuit>1</cuit></empleado><deduccion><montoTotal>1</montoTotal></deduccion></d>",
        '<d><empleado/><deduccion tipo="1"><montoTotal>1</montoTotal></deduccion></d>',
        '<d><empleado><cuit>1</cuit></empleado><deduccion tipo="1"/><deduccion tipo="2"><montoTotal>1</montoTotal></deduccion></d>',
        '<d><empleado><cuit>1</cuit></empleado><deduccion tipo="x"><montoTotal>1</montoTotal></deduccion></d>',
    ],
)
def test_incomplete_deduction_fails(spark, xml):
    df = spark.createDataFrame([("f", xml)], schemas.DECLARATIONS)
    with pytest.raises((PySparkException, Py4JJavaError), match="declaration without|CAST_INVALID_INPUT"):
        declarations.f572_deductions(df).collect()


def test_incomplete_dependant_fails(spark):
    xml = "<d><empleado><cuit>1</cuit></empleado><cargaFamilia><parentesco>1</parentesco></cargaFamilia></d>"
    df = spark.createDataFrame([("f", xml)], schemas.DECLARATIONS)
    with pytest.raises(Exception, match="declaration without"):
        declarations.f572_dependants(df).collect()


def test_a_file_of_several_declarations(spark, tmp_path):
    a, b = (
        f"<d>\n<empleado><cuit>{i}</cuit></empleado><deduccion tipo='2'><montoTotal>{i}</montoTotal></deduccion></d>"
        for i in (1, 2)
    )
    (tmp_path / "x.xml").write_text(f"\ufeff{a}{tables.SEPARATOR}\ufeff{b}", encoding="utf-8")
    assert rows(declarations.f572_deductions(tables.read_declarations(spark, str(tmp_path)))) == [
        ("1", 2, D("1.00")),
        ("2", 2, D("2.00")),
    ]


def test_declarations_round_trip(spark, tmp_path):
    """Files written from the derived declarations read back as the rows of the column."""
    from workload import mapping

    derived = mapping.declarations(spark, "/root/testdata/sf0.001")
    for i, row in enumerate(derived.collect()):
        (tmp_path / f"{i}.xml").write_text("\ufeff" + row.xml, encoding="utf-8")
    files = tables.read_declarations(spark, str(tmp_path))
    for parse in (declarations.f572_dependants, declarations.f572_deductions):
        assert rows(parse(files)) == rows(parse(derived))


@pytest.mark.parametrize(
    "xml",
    [
        "not xml",
        "<d><empleado><cuit>20-1</cuit></empleado><deduccion tipo='8'><montoTotal>1 & 2</montoTotal></deduccion></d>",
        "<d><empleado><cuit>20-1</cu",
    ],
)
def test_a_declaration_that_cannot_be_read_fails(spark, xml):
    df = spark.createDataFrame([(xml,)], "xml string")
    with pytest.raises((PySparkException, Py4JJavaError), match="empleado|MALFORMED|alformed"):
        declarations.f572_deductions(df).collect()


def test_an_empty_declaration_has_no_records(spark):
    assert declarations.f572_deductions(spark.createDataFrame([(" ",)], "xml string")).collect() == []
