"""Employee tax declarations (XML): dependants and general deductions.

A declaration is read where it lies, one row per document, in one pass and without a shuffle. Elements are
cut out at any depth of the whole text, gathered under one root and parsed as XML. A required child that is
missing or empty fails the run, and so does a document that cannot be parsed or that names no employee, unless it is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _elements(tag: str, xml: str) -> Column:
    """The text of every ``tag`` element of the document."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?=[\s/>]).*?</{tag}\s*>"), F.lit(0))


def _required(value: Column, what: str) -> Column:
    """The text of a child that must be there.

    Never null, and known as such: a join on a column that may be null gets a filter inferred, which would
    parse the document a second time below the join.
    """
    text = F.coalesce(F.trim(value), F.lit(""))
    missing = F.raise_error(F.lit(f"declaration without {what}"))
    return F.coalesce(F.when(text == "", missing).otherwise(text), F.lit(""))


DEPENDANT, DEDUCTION = "cargaFamilia", "deduccion"
RECORDS = {
    DEPENDANT: ("parentesco", "porcentajeDeduccion", "mesDesde", "mesHasta"),
    DEDUCTION: ("_tipo", "montoTotal"),
}
# What is kept of a record: column, field, type.
DEPENDANT_COLUMNS = (
    ("kinship", "parentesco", "int"),
    ("pct", "porcentajeDeduccion", "int"),
    ("month_from", "mesDesde", "int"),
    ("month_to", "mesHasta", "int"),
)
DEDUCTION_COLUMNS = (("code", "_tipo", "int"), ("amount", "montoTotal", "decimal(14,2)"))


def _parsed(declarations: DataFrame, *tags: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``parsed``, with the employee and an array of the elements of each tag, all as text."""
    plain = declarations.select(*keep, "xml", F.regexp_replace("xml", r"(?s)<!--.*?-->", "").alias("plain"))
    named = F.get(_elements("empleado", "plain"), F.lit(0))
    nameless = F.raise_error(F.concat(F.lit("declaration without empleado: "), F.substring("xml", 1, 80)))
    employee = F.coalesce(named, F.when(F.trim(F.coalesce("xml", F.lit(""))) == "", F.lit("")).otherwise(nameless))
    elements = [F.array_join(_elements(tag, "plain"), "") for tag in tags]
    gathered = F.concat(F.lit("<root>"), employee, *elements, F.lit("</root>"))
    arrays = [f"{tag} array<struct<{', '.join(f'{field}: string' for field in RECORDS[tag])}>>" for tag in tags]
    schema = ", ".join(["empleado struct<cuit: string>", *arrays])
    return plain.select(*keep, F.from_xml(gathered, schema, {"mode": "FAILFAST"}).alias("parsed"))


def _exploded(parsed: DataFrame, records: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record, with the employee's tax id.

    ``explode_outer`` and a filter on its rows: of a plain ``explode`` the optimizer infers a filter on the
    parsed array, and moves it below, where every document would be parsed a second time.
    """
    return (
        parsed.select(*keep, F.col("parsed.empleado.cuit").alias("tax_id"), F.explode_outer(records).alias("record"))
        .where(F.col("record").isNotNull())
        .withColumn("tax_id", _required(F.col("tax_id"), "a tax id"))
    )


def _fields(record: Column, columns: tuple[tuple[str, str, str], ...]) -> list[Column]:
    return [_required(record[field], field).cast(kind).alias(name) for name, field, kind in columns]


def f572_dependants(declarations: DataFrame) -> DataFrame:
    records = _exploded(_parsed(declarations, DEPENDANT), f"parsed.{DEPENDANT}")
    return records.select("tax_id", *_fields(F.col("record"), DEPENDANT_COLUMNS))


def f572_deductions(declarations: DataFrame) -> DataFrame:
    records = _exploded(_parsed(declarations, DEDUCTION), f"parsed.{DEDUCTION}")
    return records.select("tax_id", *_fields(F.col("record"), DEDUCTION_COLUMNS))


def f572_entries(declarations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Dependants and deductions in one pass over the documents; the columns of the other kind are null.

    ``keep`` names columns of the documents that go with their entries.
    """

    def absent(columns: tuple[tuple[str, str, str], ...]) -> list[Column]:
        return [F.lit(None).cast(kind).alias(name) for name, _, kind in columns]

    dependants = F.transform(
        f"parsed.{DEPENDANT}", lambda r: F.struct(*_fields(r, DEPENDANT_COLUMNS), *absent(DEDUCTION_COLUMNS))
    )
    amounts = F.transform(
        f"parsed.{DEDUCTION}", lambda r: F.struct(*absent(DEPENDANT_COLUMNS), *_fields(r, DEDUCTION_COLUMNS))
    )
    both = F.flatten(F.array_compact(F.array(dependants, amounts)))
    parsed = _parsed(declarations, DEPENDANT, DEDUCTION, keep=keep)
    return _exploded(parsed, both, keep).select(*keep, "tax_id", "record.*")


def dependants_of(entries: DataFrame) -> DataFrame:
    """The dependants among entries."""
    return entries.where(F.col("kinship").isNotNull()).select("tax_id", *(name for name, _, _ in DEPENDANT_COLUMNS))


def deductions_of(entries: DataFrame) -> DataFrame:
    """The deductions among entries."""
    return entries.where(F.col("code").isNotNull()).select("tax_id", *(name for name, _, _ in DEDUCTION_COLUMNS))
