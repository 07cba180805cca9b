"""Parameter tables of the cost model.  Fixed values: results depend on them."""

from __future__ import annotations

from decimal import Decimal as D

# --- fixed values -----------------------------------------------------------

# one-way bid-ask spread as a fraction of price: key -> (low, high)
SPREAD = {
    "EC": (D("0.0005"), D("0.0010")),
    "EC_MID": (D("0.0010"), D("0.0020")),
    "EC_SMALL": (D("0.0020"), D("0.0040")),
    "EC_INTL": (D("0.0010"), D("0.0025")),
    "EC_EM": (D("0.0025"), D("0.0050")),
    "DBT_IG": (D("0.0002"), D("0.0010")),
    "DBT_HY": (D("0.0010"), D("0.0025")),
    "DBT_GOV": (D("0.0001"), D("0.0005")),
    "DBT_MUNI": (D("0.0005"), D("0.0015")),
}
SPREAD_DEFAULT = (D("0.0010"), D("0.0025"))

# holding category -> spread key
CATEGORY_SPREAD_KEY = {
    "EC": "EC",
    "EP": "EC",
    "DBT": "DBT_IG",
    "STIV": "EC",
    "OTHER": "EC",
    "ABS-MBS": "DBT_IG",
    "ABS-O": "DBT_IG",
    "ABS-CBDO": "DBT_HY",
    "ABS-A": "DBT_IG",
    "DIR": "DBT_GOV",
    "LOAN": "DBT_HY",
    "CASH": "DBT_GOV",
}

# market impact as a fraction of turnover: (low, high)
IMPACT = {
    "large_low": (0.0010, 0.0020),
    "large_high": (0.0020, 0.0050),
    "small_low": (0.0030, 0.0060),
    "small_high": (0.0050, 0.0150),
    "bond_low": (0.0005, 0.0010),
    "bond_high": (0.0010, 0.0025),
}
EQUITY_TURNOVER_CUT = 0.50
BOND_TURNOVER_CUT = 1.00

BOND_CATEGORIES = ("DBT", "ABS-MBS", "ABS-O", "ABS-CBDO", "ABS-A", "LOAN")
EQUITY_CATEGORIES = ("EC", "EP")
SMALL_POSITION_USD = 50_000_000

DEFAULT_TURNOVER_PCT = 30.0
SOFT_DOLLAR_LOW_SHARE = 0.30
SOFT_DOLLAR_HIGH_SHARE = 0.45

CASH_BASELINE_PCT = 2.0
CASH_DRAG_BPS_PER_PCT = (2.0, 6.0)
CASH_FLAG_PCT = 5.0
CASH_NAME_WORDS = (
    "MONEY MARKET", "TREASURY BILL", "T-BILL", "COMMERCIAL PAPER", "REPURCHASE AGREE", "REPO",
    "CASH COLLATERAL", "CERTIFICATE OF DEPOSIT", "TIME DEPOSIT", "OVERNIGHT", "FED FUNDS",
)

BOND_NAME_WORDS = (
    "BOND", "INCOME", "TREASURY", "TIPS", "FIXED INCOME", "FIXED-INCOME", "MUNI", "MUNICIPAL",
    "AGG", "AGGREGATE", "CORPORATE BOND", "GOVERNMENT BOND", "GOVT BOND", "FLOATING RATE",
    "BANK LOAN", "HIGH YIELD", "SHORT-TERM BOND", "INTERMEDIATE BOND", "LONG-TERM BOND",
    "MORTGAGE", "CREDIT FUND",
)

ORDINARY_RATE, LTCG_RATE, QUALIFIED_RATE = 0.37, 0.20, 0.20
NIIT_RATE, STATE_RATE = 0.038, 0.05
EQUITY_GAIN, BOND_GAIN, BOND_YIELD = 0.07, 0.02, 0.04
QUALIFIED_SHARE = 0.70
TAX_MANAGED_FACTOR = 0.30
TAX_RANGE = (0.70, 1.30)

DERIVATIVE_LABELS = {
    "DE": "Equity",
    "DFE": "Foreign Exchange / Forward",
    "DIR": "Interest Rate",
    "DCR": "Credit",
    "DCO": "Commodity",
    "DO": "Other",
}

FUND_NAME_PATTERN = r"(?i)\b(trust|fund|portfolio|etf|index\s+fund|money\s+market)\b"
SECURITISATION_PATTERN = (
    r"(?i)(asset[\s-]?backed|mortgage|remic|securitiz|receivable|"
    r"pass[\s-]?thr(ough|u)?|collateralized|\bcdo\b|\bclo\b|"
    r"home\s+equity|student\s+loan|auto\s+(loan|lease|owner)|"
    r"\bmtge?\b|\bcmbs\b|\brmbs\b|\babs\b)"
)
FUND_ISSUER_CATEGORIES = ("RF", "RIC")
STIV_FUND_PCT = 5.0

FUND_OF_FUNDS_PCT = 25.0
CASH_SWEEP_PCT = 0.5
MAX_DEPTH = 3
WRAPPER_COVERAGE = 0.90

STARTING_BALANCE = 100_000.0
GROSS_RETURN = 0.07
HORIZONS = (10, 20, 30)
WEIGHT_TOLERANCE_PCT = 2.0
DOLLAR_IMPACT = (100_000.0, 20, 7.0)  # investment, years, gross return in percent


SCORECARD_WEIGHTS = {
    "soft_dollar_intensity": 15.0,
    "affiliated_routing": 10.0,
    "principal_transactions": 8.0,
    "lending_split": 10.0,
    "credit_utilisation": 5.0,
    "derivatives_complexity": 7.0,
    "provider_concentration": 3.0,
    "governance": 10.0,
    "proxy_delegation": 7.0,
    "turnover_tax": 15.0,
    "expense_ratio": 10.0,
}

KNOWN_ETF_TICKERS = (
    "SPY", "QQQ", "VTI", "VOO", "IVV", "VEA", "VWO", "BND",
    "AGG", "IEFA", "IEMG", "IJH", "IJR", "VUG", "VTV", "VGT",
    "VNQ", "ARKK", "SOXX", "XLK", "XLF", "XLE", "XLV", "XLI",
    "TQQQ", "SQQQ", "GLD", "SLV", "TLT", "IEF", "SHY",
    "DIA", "IWM", "EFA", "EEM", "VIG", "VYM", "SCHD", "JEPI",
    "JEPQ", "BIL", "SHV", "USFR", "MUB", "VTEB", "BSV", "VCIT",
    "VCSH", "LQD", "HYG", "EMB", "FXI", "EWJ", "EWZ", "INDA",
    "MCHI", "VXUS", "VT", "AOR", "AOM", "AOA", "BIV", "BLV",
)
KNOWN_STOCK_TICKERS = (
    "AAPL", "MSFT", "GOOGL", "GOOG", "AMZN", "NVDA", "META",
    "TSLA", "BRK", "BRKB", "UNH", "JNJ", "XOM", "JPM", "V",
    "MA", "WMT", "PG", "HD", "BAC", "DIS", "NFLX", "CRM",
)

TRACKED_FEES = {
    "management_fee": "Management Fee",
    "twelve_b1_fee": "12b-1 Fee",
    "other_expenses": "Other Expenses",
    "total_annual_expenses": "Total Annual Expenses",
    "net_expenses": "Net Expenses (After Waivers)",
    "max_sales_load": "Maximum Sales Load",
}
FEE_TOLERANCE_PCT = 0.001
# --- end of fixed values ----------------------------------------------------


def spread_of_category(side: int) -> dict:
    """Holding category -> one-way spread; side 0 is low, 1 is high."""
    return {cat: SPREAD[key][side] for cat, key in CATEGORY_SPREAD_KEY.items()}
