"""Payroll withholding audit as plain Spark DataFrame operators."""

from payproof.params import RunParams
from payproof.plans.audit import PayrollAudit, PayrollTables

__all__ = ["PayrollAudit", "PayrollTables", "RunParams"]
