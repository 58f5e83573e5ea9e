"""The categories of findings: tag of their placeholders, group, style, and whether they are on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Category, tag, group, on. People's names get an invented name, all others a placeholder.
REGISTRY = (
    ("person", "NAME", "People", True),
    ("minor", "MINOR", "People", True),
    ("minor_initials", "CHILD", "People", True),
    ("organization", "ORG", "People", True),
    ("employer", "EMPLOYER", "People", True),
    ("location", "LOCATION", "People", True),
    ("party_value", "OTHER", "People", True),
    ("email", "EMAIL", "Contact", True),
    ("phone", "PHONE", "Contact", True),
    ("fax", "FAX", "Contact", True),
    ("url", "URL", "Contact", True),
    ("social_handle", "HANDLE", "Contact", True),
    ("username", "USERNAME", "Contact", True),
    ("ip_address", "IP", "Contact", True),
    ("mac_address", "DEVICE", "Contact", True),
    ("gps", "GPS", "Contact", True),
    ("ssn", "SSN", "Government ID", True),
    ("ein", "TAXID", "Government ID", True),
    ("drivers_license", "DL", "Government ID", True),
    ("passport", "PASSPORT", "Government ID", True),
    ("alien_number", "ANUM", "Government ID", True),
    ("military_id", "MILID", "Government ID", True),
    ("inmate_number", "INMATE", "Government ID", True),
    ("student_id", "STUDENTID", "Government ID", False),
    ("employee_id", "EMPLOYEEID", "Government ID", False),
    ("voter_id", "VOTERID", "Government ID", True),
    ("bar_number", "BARNO", "Government ID", True),
    ("notary_id", "NOTARY", "Government ID", True),
    ("professional_license", "LICENSE", "Government ID", True),
    ("tribal_id", "TRIBALID", "Government ID", True),
    ("mrn", "MRN", "Health", True),
    ("health_plan", "HEALTHPLAN", "Health", False),
    ("diagnosis_code", "DXCODE", "Health", True),
    ("prescription", "RX", "Health", True),
    ("bank_account", "ACCOUNT", "Financial", True),
    ("masked_account", "ACCOUNT", "Financial", True),
    ("routing_number", "ROUTING", "Financial", False),
    ("iban", "IBAN", "Financial", True),
    ("swift", "SWIFT", "Financial", True),
    ("credit_card", "CARD", "Financial", True),
    ("payment_handle", "PAYHANDLE", "Financial", True),
    ("crypto_wallet", "WALLET", "Financial", True),
    ("investment_account", "INVACCOUNT", "Financial", True),
    ("loan_number", "LOAN", "Financial", False),
    ("policy_number", "POLICY", "Financial", False),
    ("claim_number", "CLAIM", "Financial", False),
    ("check_number", "CHECK", "Financial", False),
    ("order_number", "ORDER", "Financial", False),
    ("tracking_number", "TRACKING", "Financial", False),
    ("street_address", "ADDRESS", "Property", True),
    ("parcel_number", "PARCEL", "Property", True),
    ("deed_reference", "DEEDREF", "Property", True),
    ("legal_description", "LEGALDESC", "Property", True),
    ("vin", "VIN", "Property", True),
    ("license_plate", "PLATE", "Property", True),
    ("vehicle_title", "TITLE", "Property", True),
    ("vessel_number", "VESSEL", "Property", True),
    ("safe_deposit", "SAFEBOX", "Property", True),
    ("storage_unit", "STORAGE", "Property", True),
    ("case_number", "CASENO", "Case", True),
    ("case_name", "CASENAME", "Case", True),
    ("case_designator", "CASEREF", "Case", True),
    ("dob", "DOB", "Vital", True),
    ("pob", "POB", "Vital", True),
)
TAGS = {category: tag for category, tag, _, _ in REGISTRY}
ENABLED = frozenset(category for category, _, _, on in REGISTRY if on)


def categories(spark: SparkSession) -> DataFrame:
    """The registry as a table of some sixty rows."""
    rows = [(c, t, g, "person" if c in ("person", "minor") else "placeholder", on) for c, t, g, on in REGISTRY]
    return spark.createDataFrame(rows, "category string, tag string, grp string, style string, enabled boolean")
