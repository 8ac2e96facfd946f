"""The word lists and codes the reports are defined by."""

# Introducer categories per channel
DEALER_CATEGORIES = ("Car Supermarket", "Franchise Dealer", "Independent Dealer")
OFFLINE_BROKER_CATEGORIES = ("Broker", "Lead Generator")
ONLINE_BROKER = "Online Broker"
POINT_OF_SALE = "POS"
DIRECT = "DTC"

# Fuel descriptions per fuel group
PETROL = ("PETROL", "Petrol")
DIESEL = ("DIESEL", "Diesel")
HYBRID = ("Petrol/Electric", "Diesel/Electric", "HYB-PETROL", "PETROL/ELE", "HYB-DIESEL")
ELECTRIC = ("ELECTRIC", "Electric (Battery)")
LPG = ("PETROL/GAS", "GAS PETROL")
FUEL_UNKNOWN = "UNKNOWN"
LIGHT_COMMERCIAL = "Light Commercial Vehicle"

# Employment and residence descriptions per group
EMPLOYED = ("EMPLOYED", "Director")
SELF_EMPLOYED = ("Self-Employed", "SELF EMPLOYED")
RETIRED = ("Retired",)
HOMEMAKER = ("Disability", "Unemployed")
EMPLOYED_OTHER = ("XXXXXXX",)
EMPLOYED_UNKNOWN = ("1",)
HOME_OWNER = ("Home Owner",)
TENANT = ("Private Tenant", "Council Tenant", "Other Tenant", "Lodging")
WITH_PARENTS = ("Live With Parents",)
RESIDENT_OTHER = ("HM Forces",)
RESIDENT_UNKNOWN = ("Not Declared",)
SEGMENT_EMPLOYMENT = ("SELF EMPLOYED", "EMPLOYED")

# Workflow statuses
LIVE = "AG_LIVE_PRIMARY"
CLOSED = "AG_CLOSED"
PENDING_CLOSURE = "AG_PENDING_CLOSURE"
WRITTEN_OFF = "AG_WRITTEN_OFF"
INSURANCE_SHORTFALL = "AG_INSURANCE SHORTFALL"
REPO = "AG_REPO"
REPO_SHORTFALL = "AG_REPO_SHORTFALL"
REPO_CRYSTALISED = "AG_REPO_CRYSTALISED"
VT_CRYSTALISED = "AG_VT_CRYSTALISED"
CRYSTALISED = (REPO_CRYSTALISED, VT_CRYSTALISED)

# Exit types
SETTLEMENT = "Settlement"
UNWIND = "Unwind"
VT = "VT"
VT_DEFAULT = "VT - Default"
DEFAULT = "Default"

# Stock position codes
END_EARLY_CLOSURE = -10
END_FULL_TERM = -9
END_VT = -8
END_NOT_LIVE = -1
END_INSURANCE = 97
END_VT_DEFAULT = 98
END_REPOSSESSION = 99

# Arrears bands, from best to worst
ARREARS_BANDS = ("Up-to-Date", "0-Down", "1-Down", "2-Down", "3-Down", "4-Down", "5+ Down")

# Forbearance
HOLIDAY_TYPES = ("Retrospective Payment Holiday", "Payment Holiday")
REDUCTION_TYPES = ("Payment Reduction",)
EXTENSION_TYPES = ("Additional Payment Holiday",)
APPROVED_STATUSES = ("Agreed", "Expired")
BOOKED_STATUSES = ("Completed", "Reviewed")

# Activity-log phrases
REPOSSESSION_PHRASE = "%vehicle disposal record%"
SALE_PHRASE = "%vehicle have been sold%"
TERMINATION_PHRASE = "%Loan terminated%"

# Provision states
LIVE_STATES = (0, 1, 2, 3, 4)
SETTLED_STATES = (9999, 9001)

# Bureau sentinels
BUREAU_SENTINELS = ("{ND}", "{OB}")

# Weekly regulatory report: output order
WEEKLY_METRICS = (
    "total_drawn_from_committed_facilities",
    "impaired_loans",
    "total_unimpaired_loans_ph",
    "impaired_loans_ph",
    "number_of_loans_committed_facility",
    "number_impaired_loans",
    "number_total_unimpaired_loans_ph",
    "number_impaired_loans_ph",
    "value_of_loans_missing",
    "sum_unimpaired_cb_newly_entering_ph",
    "sum_impaired_cb_newly_entering_ph",
    "number_of_loans_missing",
    "number_unimpaired_newly_entering_ph",
    "number_impaired_newly_entering_ph",
    "impaired_loans_less_than_1m",
    "number_impaired_loans_less_than_1d",
    "impaired_loans_1m_3m",
    "number_impaired_loans_1m_3m",
    "impaired_loans_3m_1y",
    "number_impaired_loans_3m_1y",
    "impaired_loans_more_than_1y",
    "number_impaired_loans_more_than_1y",
    "impaired_loans_less_than_1m_ph",
    "number_impaired_loans_less_than_1m_ph",
    "impaired_loans_1m_3m_ph",
    "number_impaired_loans_1m_3m_ph",
    "impaired_loans_3m_1y_ph",
    "number_impaired_loans_3m_1y_ph",
    "impaired_loans_more_than_1y_ph",
    "number_impaired_loans_more_than_1y_ph",
    "sum_finance_declined",
    "number_declined",
)
