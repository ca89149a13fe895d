"""A whole audit: tables and sheets in, controls out, every step a lazy DataFrame."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from payproof.operators import (
    deductions,
    employer_return,
    income_tax,
    limits,
    lines,
    quality,
    summary,
    withholding,
)
from payproof.operators.employees import ROWS
from payproof.params import RunParams
from payproof.sinks import exports
from payproof.sources import declarations, payroll, sheets
from payproof.store.bucketed import Month
from payproof.store.manifest import Manifest
from payproof.store.payroll_store import PayrollStore


@dataclass(frozen=True)
class PayrollTables:
    """Inputs of a run. Sheets are the whole sheets; the run takes its period from them."""

    settlements: DataFrame
    lines: DataFrame
    items: DataFrame
    persons: DataFrame
    documents: DataFrame
    labour: DataFrame
    agreements: DataFrame
    item_sheet: DataFrame
    cap_sheet: DataFrame
    bracket_sheet: DataFrame
    personal_sheet: DataFrame
    general_sheet: DataFrame
    declarations: DataFrame


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """The directories of the reports of the last whole run below ``path``."""
    return Manifest(spark, path).entries()


class PayrollAudit:
    """The controls of one run over one set of tables."""

    def __init__(
        self,
        tables: PayrollTables,
        params: RunParams,
        landed: DataFrame | None = None,
        pay_lines: DataFrame | None = None,
        store: PayrollStore | None = None,
        entries: DataFrame | None = None,
    ):
        """``landed`` is a table written by ``land``, read in place of lines and headers. ``pay_lines`` is
        one written from ``compact_lines``, read in place of the classified lines. ``store`` has lines, sums and employees by
        month, read in place of lines and headers. ``entries`` are parsed declarations, read in place of the documents."""
        if tables.settlements.sparkSession.conf.get("spark.sql.ansi.enabled") != "true":
            raise ValueError("sums must raise on overflow: set spark.sql.ansi.enabled, see payproof.session")
        self.tables = tables
        self.params = params
        self._read = {"landed": landed, "pay_lines": pay_lines, "store": store, "entries": entries}
        self._landed, self._pay_lines, self._store, self._entries = landed, pay_lines, store, entries
        self._watch = None

    def with_params(self, **changes) -> PayrollAudit:
        return PayrollAudit(self.tables, replace(self.params, **changes), **self._read)

    def _on(self, **source) -> PayrollAudit:
        return PayrollAudit(self.tables, self.params, **self._read | source)

    def on_landed(self, landed: DataFrame) -> PayrollAudit:
        return self._on(landed=landed)

    def on_pay_lines(self, pay_lines: DataFrame) -> PayrollAudit:
        return self._on(pay_lines=pay_lines)

    def on_store(self, store: PayrollStore) -> PayrollAudit:
        return self._on(store=store)

    def on_entries(self, entries: DataFrame) -> PayrollAudit:
        return self._on(entries=entries)

    # Sources

    @cached_property
    def item_parameters(self) -> DataFrame:
        return sheets.item_parameters(self.tables.item_sheet)

    @cached_property
    def contribution_caps(self) -> DataFrame:
        return sheets.contribution_caps(self.tables.cap_sheet, self.params)

    @cached_property
    def tax_brackets(self) -> DataFrame:
        return sheets.tax_brackets(self.tables.bracket_sheet, self.params)

    @cached_property
    def personal_deduction_params(self) -> DataFrame:
        return sheets.personal_deduction_params(self.tables.personal_sheet, self.params)

    @cached_property
    def general_deduction_params(self) -> DataFrame:
        return sheets.general_deduction_params(self.tables.general_sheet, self.params)

    @property
    def _settlements(self) -> DataFrame:
        return self.tables.settlements if self._store is None else self._store.lines.settlements

    @cached_property
    def period_years(self) -> DataFrame:
        return payroll.period_years(self._settlements, self.params)

    @cached_property
    def period_months(self) -> DataFrame:
        return payroll.period_months(self._settlements, self.params)

    @cached_property
    def item_catalog(self) -> DataFrame:
        return payroll.item_catalog(self.tables.items)

    @cached_property
    def period_lines(self) -> DataFrame:
        if self._store is not None:
            return self._store.lines.period_lines(self.params)
        if self._landed is not None:
            return self._landed.where(payroll.to_date(self.params))
        return payroll.period_lines(self.tables.settlements, self.tables.lines, self.params)

    @cached_property
    def settlement_lines(self) -> DataFrame:
        return payroll.settlement_lines(self.period_lines, self.identities)

    @cached_property
    def employee_attributes(self) -> DataFrame:
        if self._store is not None:
            return self._store.attributes_of_settled(self.profiles, self.params)
        if self._landed is not None:
            of_year = payroll.of_type(self.params) & (F.col("year") == self.params.year)
            settled = self._landed.where(of_year).select("employee_id").distinct()
        else:
            settled = payroll.settled_employees(self.tables.settlements, self.tables.lines, self.params)
        return payroll.employee_attributes(self.profiles, settled)

    @cached_property
    def identities(self) -> DataFrame:
        return payroll.identities(self.tables.persons, self.tables.documents)

    @cached_property
    def profiles(self) -> DataFrame:
        """Attributes without the test for lines: the controls join them to employees that have lines."""
        t = self.tables
        return payroll.employee_profiles(t.labour, t.persons, t.items, t.agreements)

    @cached_property
    def f572_dependants(self) -> DataFrame:
        if self._entries is not None:
            return declarations.dependants_of(self._entries)
        return declarations.f572_dependants(self.tables.declarations)

    @cached_property
    def f572_deductions(self) -> DataFrame:
        if self._entries is not None:
            return declarations.deductions_of(self._entries)
        return declarations.f572_deductions(self.tables.declarations)

    # Lines

    @cached_property
    def unparametrized_items(self) -> DataFrame:
        return lines.unparametrized_items(self.tables.items, self.item_parameters)

    @cached_property
    def enriched_lines(self) -> DataFrame:
        return lines.classify(self.settlement_lines, self.item_parameters)

    @cached_property
    def ordered_lines(self) -> DataFrame:
        return lines.order_lines(self.enriched_lines)

    @cached_property
    def pay_lines(self) -> DataFrame:
        """What the controls read: classified lines, or their sums by month, without names and tax ids."""
        if self._pay_lines is not None:
            return self._pay_lines
        if self._store is not None:
            return lines.classify(self._store.sums(self.params), self.item_parameters)
        return lines.classify(self.period_lines, self.item_parameters)

    @property
    def _pay_lines_of_year(self) -> DataFrame:
        whole_year = self.with_params(month=12)
        return whole_year.pay_lines

    @cached_property
    def compact_lines(self) -> DataFrame:
        return lines.compact_lines(self.pay_lines, self.params)

    # Limits and declared deductions

    @cached_property
    def deduction_limits(self) -> DataFrame:
        return limits.deduction_limits(
            self.personal_deduction_params, self.general_deduction_params, self.params
        )

    @cached_property
    def dependant_deductions(self) -> DataFrame:
        allowances = limits.family_allowances(self.personal_deduction_params, self.params)
        return deductions.dependant_deductions(self.f572_dependants, allowances, self.params)

    @cached_property
    def dependant_totals(self) -> DataFrame:
        return deductions.dependant_totals(self.dependant_deductions)

    @cached_property
    def general_deductions_wide(self) -> DataFrame:
        return deductions.general_deductions_wide(self.f572_deductions)

    @cached_property
    def declared_by_employee(self) -> DataFrame:
        entries = self._entries
        if entries is None:
            entries = declarations.f572_entries(self.tables.declarations)
        allowances = limits.family_allowances(self.personal_deduction_params, self.params)
        return deductions.declared_by_employee(entries, allowances, self.params)

    # Pay summary

    @cached_property
    def pay_summary(self) -> DataFrame:
        return summary.pay_summary(self.pay_lines, self.identities, self.params)

    @cached_property
    def pay_summary_totals(self) -> DataFrame:
        return summary.pay_summary_totals(self.pay_summary)

    @cached_property
    def totals_running_balance(self) -> DataFrame:
        return summary.totals_running_balance(self.pay_summary_totals)

    # Withholding

    @cached_property
    def withholding_base(self) -> DataFrame:
        return withholding.withholding_base(
            self.pay_lines, self.identities, self.profiles, self.contribution_caps, self.params
        )

    @cached_property
    def withholding_control(self) -> DataFrame:
        return withholding.withholding_control(self.withholding_base, self.contribution_caps)

    @cached_property
    def withholding_status(self) -> DataFrame:
        return withholding.control_status(self.withholding_control)

    @cached_property
    def control_reference_values(self) -> DataFrame:
        return withholding.control_reference_values(self.contribution_caps)

    # Income tax

    @cached_property
    def taxable_pay_base(self) -> DataFrame:
        return income_tax.taxable_pay_base(
            self.pay_lines, self.identities, self.profiles, self.params, self._watch
        )

    @cached_property
    def taxable_pay_base_by_month(self) -> DataFrame:
        return income_tax.taxable_pay_base_by_month(
            self._pay_lines_of_year, self.identities, self.profiles, self.params
        )

    @cached_property
    def personal_deduction_match(self) -> DataFrame:
        return income_tax.match_personal_deductions(
            self.taxable_pay_base, self.personal_deduction_params, self.params
        )

    @cached_property
    def capped_deductions(self) -> DataFrame:
        return income_tax.deduction_columns(
            self.taxable_pay_base,
            self.personal_deduction_params,
            self.deduction_limits,
            self.declared_by_employee,
            self.params,
        )

    @cached_property
    def taxable_net_gain(self) -> DataFrame:
        return income_tax.taxable_net_gain(
            self.taxable_pay_base,
            self.personal_deduction_params,
            self.deduction_limits,
            self.declared_by_employee,
            self.params,
        )

    @cached_property
    def income_tax_control(self) -> DataFrame:
        return income_tax.income_tax_control(self.taxable_net_gain, self.tax_brackets, self.params)

    # Employer's return, checks

    @cached_property
    def f931_bases(self) -> DataFrame:
        return employer_return.f931_bases(
            self.pay_lines, self.identities, self.contribution_caps, self.params
        )

    @cached_property
    def duplicate_attributes(self) -> DataFrame:
        return quality.duplicate_attributes(self.employee_attributes)

    # Sinks

    def reports(self) -> dict[str, DataFrame]:
        """The reports of a run in presentation order, but for the totals of the pay summary."""
        by_name = ("surname", "name", "tax_id")
        return {
            "pay_summary": self.pay_summary.orderBy(*by_name),
            "withholding_control": withholding.order_control(self.withholding_status),
            "control_reference_values": self.control_reference_values,
            "income_tax_control": self.income_tax_control.orderBy(*by_name),
            "f931_bases": self.f931_bases,
        }

    def run(self, path: str, most_attributes: int | None = None) -> dict[str, str]:
        """Write all reports below ``path`` and return their directories.

        An employee with several attribute rows counts once for each (``duplicate_attributes`` lists them). With
        ``most_attributes`` a run that meets more rows of one employee fails; it sees them while it writes the income tax.

        The lines, or on a store the sums of the months, are read and summed once, into a table the reports share; the
        totals read the written summary. Each step stands on files, so a lost executor costs its tasks only. All go to a
        directory of their own, which one commit puts in place: readers (``published``) see the reports of one run, also
        while the next is at work or when it fails.
        """
        spark = self.tables.settlements.sparkSession
        manifest = Manifest(spark, path)
        folder = manifest.new_folder()
        pay_lines = posixpath.join(folder, "pay_lines")
        compact = self.compact_lines
        exports.write_lines(compact, pay_lines)
        shared = self.on_pay_lines(spark.read.schema(compact.schema).parquet(pay_lines))
        observed = Observation()
        shared._watch = quality.attribute_watch(observed)
        written = exports.write_reports(shared.reports(), folder)
        totals = summary.pay_summary_totals(spark.read.parquet(written["pay_summary"]))
        balance = {"totals_running_balance": summary.totals_running_balance(totals)}
        written |= exports.write_reports(balance, folder)
        most = observed.get["most"]
        if most_attributes is not None and most is not None and most[ROWS] > most_attributes:
            raise ValueError(f"employee {most['employee_id']} has {most[ROWS]} attribute rows, more than {most_attributes}")
        manifest.commit(written, removed=manifest.entries())
        return written

    def land(self, path: str, year: int | None = None, month: int | None = None) -> None:
        """Write the lines with their headers, for ``on_landed``: of one month, one year, or all periods.

        Months that are landed anew are replaced, all others stay as they are. A run on the landed table skips
        the files of other periods and needs no join to the headers.
        """
        headers = self.tables.settlements
        for column, value in (("year", year), ("month", month)):
            if value is not None:
                headers = headers.where(F.col(column) == value)
        lines_of = payroll.joined_lines(headers, self.tables.lines)
        exports.write_lines(lines_of, path, by_type=True, keep_others=True)

    def land_in(self, store: PayrollStore, months: Iterable[Month] | None = None) -> None:
        """Land some months in a store, or all. A run on it reads what was computed of each month when it was landed."""
        store.land(self.tables.settlements, self.tables.lines, months)

    def export(self, path: str) -> None:
        """Write the catalogue, the items without parameters, and the enriched lines."""
        exports.write_items(self.item_catalog, posixpath.join(path, "items"))
        exports.write_items(self.unparametrized_items, posixpath.join(path, "unparametrized_items"))
        exports.write_lines(
            self.enriched_lines.withColumn("year", F.lit(self.params.year)), posixpath.join(path, "lines")
        )
