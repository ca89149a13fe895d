"""Small payrolls written by hand."""

import datetime
import os
from decimal import Decimal

from payproof import PayrollAudit, PayrollTables, RunParams, schemas
from payproof.sources import tables

FIXTURES = os.path.join(os.path.dirname(__file__), "fixtures")
JULY = RunParams(2024, 7)


def money(value):
    return None if value is None else Decimal(value)


class Payroll:
    """Collects rows and turns them into tables; sheets come from the fixture files."""

    def __init__(self):
        self.settlements, self.lines, self.persons, self.documents = [], [], [], []
        self.labour, self.declared = [], []

    def employee(self, key, *, end_date=None, condition=1, rows=1, tax_ids=1, health=1, union=2, member=True):
        self.persons.append((key, f"Surname{key}", f"Name{key}", end_date))
        for i in range(tax_ids):
            self.documents.append((key, 33, f"20-{key:08d}-{i}"))
        self.documents.append((key, 1, f"{key}"))
        for i in range(rows):
            self.labour.append((key, condition, health, union, 1 + i, member))
        return self

    def pay(self, key, month, *items, year=2024, kind="Men"):
        """``items`` are (item, earning, deduction)."""
        number = len(self.settlements) + 1
        self.settlements.append((number, key, 1, kind, year, month))
        for item, earning, deduction in items:
            self.lines.append((number, item, Decimal("1.00"), money(earning), money(deduction), f"line {item}"))
        return self

    def declaration(self, key, xml, suffix="0"):
        self.declared.append(
            (f"f{len(self.declared)}", f"<d><empleado><cuit>20{key:08d}{suffix}</cuit></empleado>{xml}</d>")
        )
        return self

    def deduct(self, key, **by_code):
        xml = "".join(
            f'<deduccion tipo="{code[1:]}"><montoTotal>{amount}</montoTotal></deduccion>'
            for code, amount in by_code.items()
        )
        return self.declaration(key, xml)

    def tables(self, spark):
        def frame(rows, schema):
            return spark.createDataFrame(rows, schema)

        def sheet(name, schema):
            return tables.read_sheet(spark, os.path.join(FIXTURES, f"{name}.csv"), schema)

        items = [(i, f"Item name {i}") for i in [*range(1, 7), *range(10, 17), 99]]
        return PayrollTables(
            settlements=frame(self.settlements, schemas.SETTLEMENTS),
            lines=frame(self.lines, schemas.LINES),
            items=frame(items, schemas.ITEMS),
            persons=frame(self.persons, schemas.PERSONS),
            documents=frame(self.documents, schemas.DOCUMENTS),
            labour=frame(self.labour, schemas.LABOUR),
            agreements=frame([(1, "First"), (2, "Second")], schemas.AGREEMENTS),
            item_sheet=sheet("item_parameters", schemas.ITEM_SHEET),
            cap_sheet=sheet("contribution_caps", schemas.CAP_SHEET),
            bracket_sheet=sheet("tax_brackets", schemas.BRACKET_SHEET),
            personal_sheet=sheet("personal_deductions", schemas.PERSONAL_SHEET),
            general_sheet=sheet("general_deductions", schemas.GENERAL_SHEET),
            declarations=frame(self.declared, schemas.DECLARATIONS),
        )

    def audit(self, spark, params=JULY):
        return PayrollAudit(self.tables(spark), params)


def by_employee(df, name="name"):
    """Rows as dicts, by employee number."""
    return {int(row[name].removeprefix("Name")): row.asDict() for row in df.collect()}


def day(text):
    return datetime.date.fromisoformat(text)
