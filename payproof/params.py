"""Run parameters and the fixed values of the payroll model."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# Settlement types.
SHIPBOARD, DAILY, MONTHLY = "Emb", "Jor", "Men"

# Categories of the item catalogue, in report order.
TAXABLE = "remunerativo"
NON_TAXABLE = "no remunerativo"
DEDUCTION = "descuento"
INCOME_TAX = "ganancias"
TEMPLATE = "plantilla"
CATEGORY_ORDER = (TAXABLE, NON_TAXABLE, DEDUCTION, INCOME_TAX, TEMPLATE)

# Subcategories of the item catalogue.
PENSION = "previsional"
HEALTH = "obra social"
UNION = "sindical"
ADVANCE = "anticipo"
GARNISHMENT = "embargo"
OTHER_DEDUCTION = "descuento"
SAC = "sac"
NO_SUBCATEGORY = "n/a"

# Income-tax classes of the item catalogue.
REGULAR = "habitual"
IRREGULAR = "no habitual"
EXEMPT = "exento"
TAX = "impuesto"
SOCIAL_CLASSES = (PENSION, HEALTH, UNION)

# Employee status.
ACTIVE, LEAVER = "Activo", "Baja"

# Document type that holds the tax id, labour condition of a pensioner.
TAX_ID_DOCUMENT = 33
PENSIONER_CONDITION = 2

# Kinship codes of the tax declaration.
SPOUSE_CODES = (1,)
CHILD_CODES = (3, 30)
DISABLED_CHILD_CODES = (31, 32)
SPOUSE, CHILD, DISABLED_CHILD = "conyuge", "hijo", "hijo incapacitado"

# Declaration code of each general deduction.
DEDUCTION_CODES = {
    1: "medical_insurance",
    2: "life_insurance",
    3: "donations",
    4: "mortgage_interest",
    5: "funeral_expenses",
    7: "medical_fees",
    8: "domestic_staff",
    9: "guarantee_societies",
    10: "travelling_sales",
    11: "mobility",
    21: "work_clothing",
    22: "rent_40",
    23: "mixed_insurance",
    24: "retirement_insurance",
    25: "mutual_funds",
    32: "education",
    33: "rent_10_tenant",
    34: "rent_10_landlord",
    99: "other_deductions",
}

# Deductions with a yearly amount limit, with 40 % of the personal allowance as limit,
# with 5 % of net gain as limit, and those granted only in the final settlement of a leaver.
AMOUNT_LIMITED = (2, 4, 5, 11, 23, 24)
ALLOWANCE_LIMITED = (8, 22, 32)
NET_GAIN_LIMITED = (1, 3, 7)
LEAVER_ONLY = (2, 7, 23, 24, 25)

# Withholding rates, the 13th-salary fraction, the allowance of the R10 base.
PENSION_RATE, PENSIONER_PENSION_RATE = Decimal("0.14"), Decimal("0.11")
HEALTH_RATE, PENSIONER_HEALTH_RATE = Decimal("0.03"), Decimal("0")
ALLOWANCE_LIMIT_RATE = Decimal("0.40")
NET_GAIN_LIMIT_RATE = Decimal("0.05")
PERCENT = Decimal("0.01")
R10_ALLOWANCE = Decimal("7003.68")
STATUS_TOLERANCE = Decimal("0.1")

SAC_SEMESTER, SAC_ANNUAL = "semester", "annual"


SETTLEMENT_TYPES = ("Emb", "Jor", "Men")


@dataclass(frozen=True)
class RunParams:
    """What a run controls: a month, and how the income tax treats irregular pay and the 13th salary.

    ``settlement_type=None`` takes every type in one run. ``corrected`` replaces the two income-tax
    readings described in the README (sign of the deduction group, limits not applied).
    """

    year: int
    month: int
    settlement_type: str | None = None
    prorate_irregular: bool = True
    sac_mode: str = SAC_SEMESTER
    corrected: bool = False
    r10_allowance: Decimal = R10_ALLOWANCE

    def __post_init__(self):
        if not 1 <= self.month <= 12:
            raise ValueError(f"month {self.month} is not in 1..12")
        if self.settlement_type not in (None, *SETTLEMENT_TYPES):
            raise ValueError(f"unknown settlement type {self.settlement_type!r}")
        if self.sac_mode not in (SAC_SEMESTER, SAC_ANNUAL):
            raise ValueError(f"unknown 13th-salary mode {self.sac_mode!r}")

    @property
    def sac_is_estimated(self) -> bool:
        """Before June there is no 13th salary to look at, so it is estimated in every mode."""
        return self.sac_mode == SAC_ANNUAL or self.month < 6

    @property
    def leaver_type(self) -> int:
        """Row type of the December tables that a leaver of this month uses."""
        return 1 if self.month <= 6 else 2
