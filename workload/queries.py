"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from payproof import PayrollAudit, RunParams
from payproof.operators import income_tax, withholding
from payproof.sinks import exports
from payproof.sources import payroll
from payproof.sources.tables import SEPARATOR
from payproof.store.declaration_store import DeclarationStore
from payproof.store.payroll_store import PayrollStore
from workload.mapping import APRIL, JULY, audit, settlements

#: Declarations of one file, some 8 MB.
FILE_DOCUMENTS = 10_000

SHIPBOARD_JULY = replace(JULY, settlement_type="Emb")

# Income-tax options: suffix of the query name, run.
TAX_RUNS = {
    "": JULY,
    "_annual_sac": replace(JULY, sac_mode="annual"),
    "_full_irregular": replace(JULY, prorate_irregular=False),
    "_full_irregular_annual_sac": replace(JULY, prorate_irregular=False, sac_mode="annual"),
    "_april": APRIL,
}

# Queries that read one property of the audit as it is.
PLAIN = {
    "period_months": SHIPBOARD_JULY,
    "item_catalog": JULY,
    "contribution_caps": JULY,
    "item_parameters": JULY,
    "settlement_lines": JULY,
    "employee_attributes": JULY,
    "tax_brackets": JULY,
    "personal_deduction_params": JULY,
    "general_deduction_params": JULY,
    "f572_dependants": JULY,
    "f572_deductions": JULY,
    "unparametrized_items": JULY,
    "enriched_lines": JULY,
    "ordered_lines": JULY,
    "deduction_limits": JULY,
    "dependant_deductions": JULY,
    "dependant_totals": JULY,
    "general_deductions_wide": JULY,
    "pay_summary": JULY,
    "pay_summary_totals": JULY,
    "totals_running_balance": JULY,
    "withholding_base": JULY,
    "withholding_control": JULY,
    "withholding_status": JULY,
    "control_reference_values": JULY,
    "personal_deduction_match": JULY,
    "capped_deductions": JULY,
    "taxable_net_gain": JULY,
    "f931_bases": JULY,
    "duplicate_attributes": JULY,
    "taxable_pay_base_by_month": JULY,
}


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; only a local session may do without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='payproof-')}/{uuid.uuid4().hex}"


def _plain(name: str, run: RunParams) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: getattr(audit(spark, sf, run), name)


def _period_years(spark: SparkSession, sf: str) -> DataFrame:
    return payroll.period_years(settlements(spark, sf), SHIPBOARD_JULY)


def _pay_summary_shipboard(spark: SparkSession, sf: str) -> DataFrame:
    return audit(spark, sf, SHIPBOARD_JULY).pay_summary


def _ordered_control(spark: SparkSession, sf: str) -> DataFrame:
    return withholding.order_control(audit(spark, sf).withholding_control)


def _bracket_match(spark: SparkSession, sf: str) -> DataFrame:
    a = audit(spark, sf)
    return income_tax.match_bracket(a.taxable_net_gain, a.tax_brackets, a.params).select(
        "tax_id", "status", "taxable_gain", "fixed", "rate", "excess"
    )


def _compact_lines(spark: SparkSession, sf: str) -> DataFrame:
    return audit(spark, sf).compact_lines


def _pay_summary_from_compact(spark: SparkSession, sf: str) -> DataFrame:
    a = audit(spark, sf)
    return a.on_pay_lines(a.compact_lines).pay_summary


def _landed_income_tax(spark: SparkSession, sf: str) -> DataFrame:
    """All lines landed, then the tax base from them: the period is picked by directory."""
    path = scratch_folder(spark)
    a = audit(spark, sf)
    exports.write_lines(payroll.joined_lines(settlements(spark, sf), a.tables.lines), path, by_type=True)
    return a.on_landed(spark.read.parquet(path)).taxable_pay_base


def _stored(spark: SparkSession, sf: str, run: RunParams = JULY) -> PayrollAudit:
    """An audit on a store of all months that the run's tables have."""
    a = audit(spark, sf, run)
    store = PayrollStore(spark, scratch_folder(spark), buckets=8)
    a.land_in(store)
    return a.on_store(store)


def _relanded(spark: SparkSession, sf: str) -> PayrollAudit:
    """The same after June and July were landed again: the sums of the other months are those of the first time."""
    a = audit(spark, sf)
    store = PayrollStore(spark, scratch_folder(spark), buckets=8)
    a.land_in(store)
    a.land_in(store, [(JULY.year, JULY.month - 1), (JULY.year, JULY.month)])
    return a.on_store(store)


def _ingested(spark: SparkSession, sf: str) -> DeclarationStore:
    """The declarations as files of up to ``FILE_DOCUMENTS`` documents, parsed into a store."""
    folder = scratch_folder(spark)
    documents = audit(spark, sf).tables.declarations
    documents.select("xml").write.option("maxRecordsPerFile", FILE_DOCUMENTS).option("lineSep", SEPARATOR).text(folder)
    store = DeclarationStore(spark, folder, scratch_folder(spark), pattern="*.txt")
    store.ingest()
    store.ingest()  # finds nothing new
    return store


def _f572_deductions_ingested(spark: SparkSession, sf: str) -> DataFrame:
    return audit(spark, sf).on_entries(_ingested(spark, sf).entries()).f572_deductions


def _income_tax_stored(spark: SparkSession, sf: str) -> DataFrame:
    """From sums by month and parsed declarations: neither lines nor documents are read again."""
    return _stored(spark, sf).on_entries(_ingested(spark, sf).entries()).income_tax_control


def _report_exports(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run written and read back: rows and the total of every amount, of each report."""
    written = audit(spark, sf).run(scratch_folder(spark))
    return reduce(DataFrame.unionAll, (_totals(spark, name, path) for name, path in written.items()))


def _totals(spark: SparkSession, report: str, path: str) -> DataFrame:
    """Rows and the total of every amount of a written report."""
    df = spark.read.parquet(path)
    amounts = [f.name for f in df.schema.fields if isinstance(f.dataType, DecimalType)]
    totals = F.array(
        *(F.struct(F.lit(a).alias("amount"), F.sum(a).cast("decimal(30,4)").alias("total")) for a in amounts)
    )
    return df.agg(F.lit(report).alias("report"), F.count("*").alias("n"), totals.alias("totals")).select(
        "report", "n", F.inline("totals")
    )


def _line_exports(spark: SparkSession, sf: str) -> DataFrame:
    """The line export read back by month."""
    path = scratch_folder(spark)
    a = audit(spark, sf)
    exports.write_lines(a.enriched_lines.withColumn("year", F.lit(a.params.year)), path)
    return (
        spark.read.parquet(path)
        .groupBy("year", "month")
        .agg(
            F.count("*").alias("n"),
            F.sum("earning").cast("decimal(24,2)").alias("earning"),
            F.sum("deduction").cast("decimal(24,2)").alias("deduction"),
        )
    )


def _item_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Both item exports read back."""
    path = scratch_folder(spark)
    a = audit(spark, sf)
    exports.write_items(a.item_catalog, f"{path}/items")
    exports.write_items(a.unparametrized_items, f"{path}/unparametrized")
    schema = "item_id bigint, name string"
    read = spark.read.schema(schema).option("header", True)
    return (
        read.csv(f"{path}/items")
        .withColumn("export", F.lit("items"))
        .unionByName(read.csv(f"{path}/unparametrized").withColumn("export", F.lit("unparametrized")))
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _plain(name, run) for name, run in PLAIN.items()}
    for suffix, run in TAX_RUNS.items():
        out[f"taxable_pay_base{suffix}"] = _plain("taxable_pay_base", run)
        out[f"income_tax_control{suffix}"] = _plain("income_tax_control", run)
    out["income_tax_control_corrected"] = _plain("income_tax_control", replace(JULY, corrected=True))
    out["period_years"] = _period_years
    out["pay_summary_shipboard"] = _pay_summary_shipboard
    out["withholding_control_april"] = _plain("withholding_control", APRIL)
    out["f931_bases_april"] = _plain("f931_bases", APRIL)
    out["ordered_control"] = _ordered_control
    out["bracket_match"] = _bracket_match
    out["compact_lines"] = _compact_lines
    out["pay_summary_from_compact"] = _pay_summary_from_compact
    out["taxable_pay_base_landed"] = _landed_income_tax
    out["settlement_lines_bucketed"] = lambda spark, sf: _stored(spark, sf).settlement_lines
    out["employee_attributes_indexed"] = lambda spark, sf: _stored(spark, sf).employee_attributes
    out["pay_summary_stored"] = lambda spark, sf: _relanded(spark, sf).pay_summary
    out["withholding_control_stored"] = lambda spark, sf: _stored(spark, sf).withholding_control
    out["f931_bases_stored"] = lambda spark, sf: _relanded(spark, sf).f931_bases
    out["f572_deductions_ingested"] = _f572_deductions_ingested
    out["income_tax_control_stored"] = _income_tax_stored
    out["report_exports"] = _report_exports
    out["line_exports"] = _line_exports
    out["item_exports"] = _item_exports
    return out
