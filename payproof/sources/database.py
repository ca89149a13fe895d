"""The payroll database and its parameter sheets, renamed and typed to the model of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payproof import schemas
from payproof.functions.money import zero
from payproof.params import DAILY, MONTHLY, SHIPBOARD

# Tables and columns of the payroll database, by column of the model.
SETTLEMENT_TABLE = "Liquidaciones{kind}"
SETTLEMENT_COLUMNS = {
    "settlement_id": "idLiquidacion",
    "employee_id": "idDatoPersonal",
    "kind": "idLiquidacionTipo",
    "year": "PeriodoAnio",
    "month": "PeriodoMes",
}
LINE_TABLE = "Liquidaciones{kind}Detalle"
LINE_COLUMNS = {
    "settlement_id": "idLiquidacion",
    "item_id": "idLiquidacionItem",
    "quantity": "Cantidad",
    "earning": "Haber",
    "deduction": "Dscto",
    "item_name": "NombreItem",
}
ITEM_TABLE = "LiquidacionItems"
ITEM_COLUMNS = {"item_id": "idLiquidacionItem", "name": "Nombre"}
PERSON_TABLE = "DatosPersonales"
PERSON_COLUMNS = {
    "employee_id": "idDatoPersonal",
    "surname": "Apellido",
    "name": "Nombres",
    "end_date": "FechaBaja",
}
DOCUMENT_TABLE = "DatosPersonalesDocumentos"
DOCUMENT_COLUMNS = {
    "employee_id": "idDatoPersonal",
    "document_type": "idTipoDocumento",
    "number": "NumeroDocumento",
}
LABOUR_TABLE = "DatosPersonalesLaborales"
LABOUR_COLUMNS = {
    "employee_id": "idDatoPersonal",
    "condition": "idCodigoCondicion",
    "health_item_id": "idObraSocial",
    "union_item_id": "idSindicato",
    "agreement_id": "idConvenioTipo",
    "union_member": "SindEsAfiliado",
}
AGREEMENT_TABLE = "MAE_ConveniosTipos"
AGREEMENT_COLUMNS = {"agreement_id": "idConvenioTipo", "name": "ConvenioTipo"}

# Headings of the parameter sheets, by column of the model. Case does not matter.
ITEM_HEADINGS = {
    "item_id": "idLiquidacionItem",
    "name": "nombre",
    "category": "categoria",
    "subcategory": "subcategoria",
    "tax_class": "ganancias",
    "r4r8": "r4r8",
    "r9": "r9",
}
CAP_HEADINGS = {"period": "Periodo", "cap": "Maxima", "floor": "Minima"}
BRACKET_HEADINGS = {
    "period": "periodo",
    "lower": "desde",
    "upper": "hasta",
    "fixed": "suma_fija",
    "rate": "coeficiente",
    "excess": "excedente",
    "pct_code": "codigo_porcentaje",
    "type": "tipo",
}
PERSONAL_HEADINGS = {
    "period": "Periodo",
    "gni": "GNI",
    "special": "Especial",
    "spouse": "Conyuge",
    "child": "Hijo",
    "disabled_child": "Hijo_Incapacitado",
    "type": "Tipo",
}
GENERAL_HEADINGS = {
    "period": "Periodo",
    "deduction": "Deduccion",
    "code": "Codigo",
    "type": "Tipo",
    "cap": "Tope",
    "pct": "Porcentaje",
}

KINDS = (SHIPBOARD, DAILY, MONTHLY)

#: Columns of lines with their headers.
PERIOD_COLUMNS = (
    "employee_id", "settlement_id", "kind", "settlement_type", "year", "month",
    "item_id", "quantity", "earning", "deduction", "item_name",
)


#: The key that headers and lines are read in ranges of.
SETTLEMENT_KEY = "idLiquidacion"


def table_schema(table: str) -> T.StructType:
    """Columns and types of a table of the database, as ``read_database`` asks for them."""
    for pattern, columns, schema in (
        (LINE_TABLE, LINE_COLUMNS, schemas.LINES),
        (SETTLEMENT_TABLE, SETTLEMENT_COLUMNS, schemas.SETTLEMENTS),
        (ITEM_TABLE, ITEM_COLUMNS, schemas.ITEMS),
        (PERSON_TABLE, PERSON_COLUMNS, schemas.PERSONS),
        (DOCUMENT_TABLE, DOCUMENT_COLUMNS, schemas.DOCUMENTS),
        (LABOUR_TABLE, LABOUR_COLUMNS, schemas.LABOUR),
        (AGREEMENT_TABLE, AGREEMENT_COLUMNS, schemas.AGREEMENTS),
    ):
        if table in {pattern.format(kind=kind) for kind in KINDS}:
            return T.StructType([T.StructField(source, schema[name].dataType) for name, source in columns.items()])
    raise ValueError(f"no table {table!r} in the payroll database")


def renamed(df: DataFrame, columns: dict[str, str], schema: T.StructType) -> DataFrame:
    """``df`` with the model's names and types, taking only the columns of the model."""
    return df.select(
        *(F.col(f"`{source}`").cast(schema[name].dataType).alias(name) for name, source in columns.items())
    )


def from_database(table: Callable[[str], DataFrame], kinds: tuple[str, ...] = KINDS) -> dict[str, DataFrame]:
    """The payroll tables, by field of ``PayrollTables``.

    ``table`` reads one table of the database by name, for example through ``read_jdbc``. The database keeps
    one pair of settlement tables per settlement type, each with its own numbers; here they are one pair with
    the type as a column on both sides, which lines and headers are joined by as well.
    """

    def by_kind(pattern: str, columns: dict[str, str], schema: T.StructType) -> DataFrame:
        whole = None
        for kind in kinds:
            part = renamed(table(pattern.format(kind=kind)), columns, schema).withColumn(
                "settlement_type", F.lit(kind)
            )
            whole = part if whole is None else whole.unionByName(part)
        return whole

    return {
        "settlements": by_kind(SETTLEMENT_TABLE, SETTLEMENT_COLUMNS, schemas.SETTLEMENTS),
        "lines": by_kind(LINE_TABLE, LINE_COLUMNS, schemas.LINES),
        "items": renamed(table(ITEM_TABLE), ITEM_COLUMNS, schemas.ITEMS),
        "persons": renamed(table(PERSON_TABLE), PERSON_COLUMNS, schemas.PERSONS),
        "documents": renamed(table(DOCUMENT_TABLE), DOCUMENT_COLUMNS, schemas.DOCUMENTS),
        "labour": renamed(table(LABOUR_TABLE), LABOUR_COLUMNS, schemas.LABOUR),
        "agreements": renamed(table(AGREEMENT_TABLE), AGREEMENT_COLUMNS, schemas.AGREEMENTS),
    }


def period_query(kind: str, year: int, months: tuple[int, int] = (1, 12)) -> str:
    """A query, in parentheses as ``read_jdbc`` takes it for a table, for the lines of a period with their headers.

    The database joins and filters, so lines of other periods never leave it.
    """
    headers = ", ".join(f"h.{source} AS {name}" for name, source in SETTLEMENT_COLUMNS.items())
    details = ", ".join(f"d.{source} AS {name}" for name, source in LINE_COLUMNS.items() if name != "settlement_id")
    key, in_year, in_month = (SETTLEMENT_COLUMNS[name] for name in ("settlement_id", "year", "month"))
    first, last = map(int, months)
    return (
        f"(SELECT {headers}, {details}"
        f" FROM {SETTLEMENT_TABLE.format(kind=kind)} h"
        f" JOIN {LINE_TABLE.format(kind=kind)} d ON d.{LINE_COLUMNS['settlement_id']} = h.{key}"
        f" WHERE h.{in_year} = {int(year)} AND h.{in_month} BETWEEN {first} AND {last}) period_lines"
    )


def lines_of_period(
    query: Callable[[str], DataFrame], year: int, months: tuple[int, int] = (1, 12), kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """The lines of a period with their headers, for ``PayrollAudit.on_landed``.

    ``query`` reads a query in parentheses, for example through ``read_jdbc`` in ranges of ``settlement_id``.
    A run needs the whole year, as the attributes of employees look at all its months.
    """
    types = {f.name: f.dataType for schema in (schemas.SETTLEMENTS, schemas.LINES) for f in schema.fields}
    whole = None
    for kind in kinds:
        found = query(period_query(kind, year, months)).withColumn("settlement_type", F.lit(kind))
        part = found.select(*(F.col(name).cast(types[name]).alias(name) for name in PERIOD_COLUMNS))
        whole = part if whole is None else whole.unionByName(part)
    amounts = {name: F.coalesce(F.col(name).cast(schemas.money(14)), zero(14)) for name in ("earning", "deduction")}
    return whole.withColumns(amounts)


def from_sheets(sheet: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """The parameter sheets, by field of ``PayrollTables``. ``sheet`` reads one saved sheet by name, with its
    headings in any order, for example through ``read_headed``."""
    return {
        "item_sheet": renamed(sheet("items_liquidacion"), ITEM_HEADINGS, schemas.ITEM_SHEET),
        "cap_sheet": renamed(sheet("bases_imponibles"), CAP_HEADINGS, schemas.CAP_SHEET),
        "bracket_sheet": renamed(sheet("gan_art_94"), BRACKET_HEADINGS, schemas.BRACKET_SHEET),
        "personal_sheet": renamed(
            sheet("gan_deducciones_personales"), PERSONAL_HEADINGS, schemas.PERSONAL_SHEET
        ),
        "general_sheet": renamed(
            sheet("gan_deducciones_generales"), GENERAL_HEADINGS, schemas.GENERAL_SHEET
        ),
    }
