"""Schemas of every input table and sheet."""

from pyspark.sql import types as T


def money(precision: int = 14) -> T.DecimalType:
    return T.DecimalType(precision, 2)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


_long, _int, _str, _bool, _date = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.DateType()

SETTLEMENTS = _struct(
    settlement_id=_long, employee_id=_long, kind=_int, settlement_type=_str, year=_int, month=_int
)
LINES = _struct(
    settlement_id=_long, item_id=_long, quantity=money(), earning=money(), deduction=money(), item_name=_str
)
ITEMS = _struct(item_id=_long, name=_str)
PERSONS = _struct(employee_id=_long, surname=_str, name=_str, end_date=_date)
DOCUMENTS = _struct(employee_id=_long, document_type=_int, number=_str)
LABOUR = _struct(
    employee_id=_long,
    condition=_int,
    health_item_id=_long,
    union_item_id=_long,
    agreement_id=_int,
    union_member=_bool,
)
AGREEMENTS = _struct(agreement_id=_int, name=_str)

# The sheets are read as text and cast by their source operator, as users type them by hand.
ITEM_SHEET = _struct(
    item_id=_str, name=_str, category=_str, subcategory=_str, tax_class=_str, r4r8=_str, r9=_str
)
CAP_SHEET = _struct(period=_date, cap=_str, floor=_str)
BRACKET_SHEET = _struct(
    period=_date, lower=_str, upper=_str, fixed=_str, rate=_str, excess=_str, pct_code=_str, type=_str
)
PERSONAL_SHEET = _struct(
    period=_date, gni=_str, special=_str, spouse=_str, child=_str, disabled_child=_str, type=_str
)
GENERAL_SHEET = _struct(period=_date, deduction=_str, code=_str, type=_str, cap=_str, pct=_str)

DECLARATIONS = _struct(file_path=_str, xml=_str)
