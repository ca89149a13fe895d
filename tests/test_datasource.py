"""The database as a data source: conditions and ranges reach the database, an SQLite file that the test writes."""

import json
import sqlite3
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from payproof import RunParams
from payproof.sources import payroll
from payproof.sources.database import from_database, table_schema
from payproof.sources.datasource import KeyRange, PayrollReader, payroll_database, read_database, year_condition


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "payroll.sqlite")
    con = sqlite3.connect(path)
    for kind in ("Emb", "Jor", "Men"):
        con.execute(
            f'CREATE TABLE "Liquidaciones{kind}" (idLiquidacion, idDatoPersonal, idLiquidacionTipo, PeriodoAnio, PeriodoMes)'
        )
        con.execute(
            f'CREATE TABLE "Liquidaciones{kind}Detalle" (idLiquidacion, idLiquidacionItem, Cantidad, Haber, Dscto, NombreItem)'
        )
    headers = [(i, 1 + i % 5, 1, 2024, 1 + i % 12) for i in range(1, 101)]
    con.executemany('INSERT INTO "LiquidacionesMen" VALUES (?, ?, ?, ?, ?)', headers)
    # A header of another year that no reader can take: whoever reads it fails.
    con.execute("""INSERT INTO "LiquidacionesMen" VALUES (101, 'not a number', 1, 1999, 1)""")
    con.executemany(
        'INSERT INTO "LiquidacionesMenDetalle" VALUES (?, ?, ?, ?, ?, ?)',
        [(i, 1, 1.0, 10.25 * i, None, "Sueldo 'básico'") for i in range(1, 101)] + [(None, 1, 1, 1, None, None)],
    )
    con.execute('CREATE TABLE "LiquidacionItems" (idLiquidacionItem, Nombre)')
    con.execute('CREATE TABLE "DatosPersonales" (idDatoPersonal, Apellido, Nombres, FechaBaja)')
    con.execute("""INSERT INTO "DatosPersonales" VALUES (1, 'Doe', 'Jo', '2024-03-05 00:00:00'), (2, 'Roe', NULL, NULL)""")
    con.execute('CREATE TABLE "DatosPersonalesDocumentos" (idDatoPersonal, idTipoDocumento, NumeroDocumento)')
    con.execute(
        'CREATE TABLE "DatosPersonalesLaborales" (idDatoPersonal, idCodigoCondicion, idObraSocial, idSindicato, '
        "idConvenioTipo, SindEsAfiliado)"
    )
    con.execute('INSERT INTO "DatosPersonalesLaborales" VALUES (1, 2, 3, NULL, 4, 1)')
    con.execute('CREATE TABLE "MAE_ConveniosTipos" (idConvenioTipo, ConvenioTipo)')
    con.commit()
    con.close()
    return path


def reader(database, table="LiquidacionesMen", **options):
    given = {"connect": "sqlite3:connect", "arguments": json.dumps({"database": database}), "table": table}
    return PayrollReader(given | options, table_schema(table))


def test_every_query_is_limited_to_the_year():
    assert year_condition("LiquidacionesMen", 2024) == ('"PeriodoAnio" = ?', (2024,))
    assert year_condition("LiquidacionesEmbDetalle", 2024) == (
        '"idLiquidacion" IN (SELECT "idLiquidacion" FROM "LiquidacionesEmb" WHERE "PeriodoAnio" = ?)', (2024,)
    )
    assert year_condition("DatosPersonales", 2024) is None


def test_conditions_and_ranges_are_part_of_the_query(database):
    condition = json.dumps(('"PeriodoMes" >= ?', (11,)))
    r = reader(database, key="idLiquidacion", partitions="4", condition=condition)
    text, values = r.query(['"idLiquidacion"'], KeyRange(5, 9))
    assert text == (
        'SELECT "idLiquidacion" FROM "LiquidacionesMen" WHERE "PeriodoMes" >= ? AND "idLiquidacion" < ? AND "idLiquidacion" >= ?'
    )
    assert values == (11, 9, 5)
    assert "%s" in reader(database, key="idLiquidacion", paramstyle="format").query(["x"], KeyRange(None, 5))[0]
    ranges = r.partitions()
    # Bounds of the rows that pass: 10 to 95; the outer ranges are open.
    assert ranges == [KeyRange(None, 31), KeyRange(31, 53), KeyRange(53, 74), KeyRange(74, None)]
    found = [b.column(0).to_pylist() for part in ranges for b in r.read(part)]
    assert sorted(sum(found, [])) == [i for i in range(1, 101) if i % 12 >= 10] and len(found) == 4


def test_ranges_lose_no_row_and_few_keys_make_few_ranges(database):
    r = reader(database, "LiquidacionesMenDetalle", key="idLiquidacion", partitions="7")
    assert sum(b.num_rows for part in r.partitions() for b in r.read(part)) == 101
    few = reader(database, "DatosPersonalesLaborales", key="idDatoPersonal", partitions="9")
    assert few.partitions() == [KeyRange()]
    none = reader(database, "LiquidacionesJor", key="idLiquidacion", partitions="9")
    assert none.partitions() == [KeyRange()] and list(none.read(KeyRange())) == []


def test_a_period_is_filtered_in_the_database(spark, database):
    t = from_database(payroll_database(spark, "sqlite3:connect", {"database": database}, 2024, partitions=3))
    p = RunParams(2024, 2, settlement_type="Men")
    got = payroll.period_lines(t["settlements"], t["lines"], p).select("settlement_id", "earning", "deduction", "item_name").collect()
    assert sorted(map(tuple, got)) == [
        (i, D("10.25") * i, D("0.00"), "Sueldo 'básico'") for i in range(1, 101) if 1 + i % 12 <= 2
    ]
    assert t["settlements"].count() == 100 and t["lines"].count() == 100
    whole = from_database(payroll_database(spark, "sqlite3:connect", {"database": database}))
    assert whole["lines"].count() == 101
    with pytest.raises(Exception, match="not a number"):  # without the condition the source meets the row of the other year
        whole["settlements"].collect()


def test_types_of_the_model(spark, database):
    table = payroll_database(spark, "sqlite3:connect", {"database": database})
    t = from_database(table)
    assert sorted(map(str, t["persons"].collect())) == [
        "Row(employee_id=1, surname='Doe', name='Jo', end_date=datetime.date(2024, 3, 5))",
        "Row(employee_id=2, surname='Roe', name=None, end_date=None)",
    ]
    assert t["labour"].first().union_member is True
    assert t["agreements"].count() == 0 and t["lines"].where(F.col("settlement_id").isNull()).count() == 1
    assert t["lines"].where("item_id = 1").count() == 101 and t["lines"].count() == 101
    with pytest.raises(ValueError, match="no table"):
        table("Otra")
    with pytest.raises(Exception):
        read_database(spark, "absent", t["items"].schema, "sqlite3:connect", {"database": database}).collect()
