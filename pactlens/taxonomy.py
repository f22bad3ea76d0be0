"""Fixed maps from source clause names to the five risk classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Clause title -> class.
TITLE_TO_LABEL = {
    "Cap On Liability": "Liability",
    "Indemnification Of Indemnitee": "Liability",
    "Indemnification Of Indemnitor": "Liability",
    "Limitation Of Liability": "Liability",
    "Warranty Duration": "Liability",
    "General Damages": "Liability",
    "Consequential Damages": "Liability",
    "Liquidated Damages": "Penalty",
    "Price Restrictions": "Penalty",
    "Minimum Commitment": "Penalty",
    "Revenue/Profit Sharing": "Penalty",
    "Volume Restriction": "Penalty",
    "Termination For Convenience": "Termination",
    "Change Of Control": "Termination",
    "Anti-Assignment": "Termination",
    "Agreement Term": "Termination",
    "Renewal Term": "Termination",
    "Post-Termination Services": "Termination",
    "Non-Compete": "Obligation",
    "Non-Solicitation": "Obligation",
    "Exclusivity": "Obligation",
    "No-Solicit Of Customers": "Obligation",
    "No-Solicit Of Employees": "Obligation",
    "Ip Ownership Assignment": "Obligation",
    "License Grant": "Obligation",
    "Audit Rights": "Obligation",
    "Insurance": "Obligation",
    "Governing Law": "Arbitration",
    "Dispute Resolution": "Arbitration",
    "Venue": "Arbitration",
    "Arbitration": "Arbitration",
    "Third Party Beneficiary": "Arbitration",
    "Covenant Not To Sue": "Arbitration",
}

# Provision name -> class.
PROVISION_TO_LABEL = {
    "Indemnification": "Liability",
    "Liabilities": "Liability",
    "Indemnification And Insurance": "Liability",
    "Damages": "Liability",
    "Fees": "Penalty",
    "Penalties": "Penalty",
    "Late Charges": "Penalty",
    "Interest": "Penalty",
    "Taxes": "Penalty",
    "Term": "Termination",
    "Termination": "Termination",
    "Expiration": "Termination",
    "Survival": "Termination",
    "Obligations": "Obligation",
    "Covenants": "Obligation",
    "Compliance With Laws": "Obligation",
    "Reporting Obligations": "Obligation",
    "Confidentiality": "Obligation",
    "Non-Solicitation": "Obligation",
    "Governing Law": "Arbitration",
    "Dispute Resolution": "Arbitration",
    "Arbitration": "Arbitration",
    "Jurisdiction": "Arbitration",
}

# Wide-table clause columns that carry a class.
POSITIVE_COLUMNS = {
    "Uncapped Liability": "Liability",
    "Cap On Liability": "Liability",
    "Liquidated Damages": "Penalty",
    "Termination For Convenience": "Termination",
    "Post-Termination Services": "Termination",
    "Audit Rights": "Obligation",
    "Insurance": "Obligation",
    "Governing Law": "Arbitration",
}

# Wide-table clause columns that supply benign candidates.
NONE_COLUMNS = (
    "Document Name", "Parties", "Agreement Date", "Effective Date",
    "Expiration Date", "Renewal Term", "Notice to Terminate Renewal",
)

# Question substrings per class, first matching class wins.
QUESTION_RULES = (
    ("Arbitration", ("arbitration", "venue", "jurisdiction", "governing law")),
    ("Termination", ("termination", "renewal", "survival", "change of control")),
    ("Penalty", ("liquidated", "late payment", "interest", "penalty", "fine")),
    ("Liability", ("indemn", "limitation of liability", "cap on liability", "warranty")),
    ("Obligation", ("confidential", "insurance", "audit", "non-compete", "non-solicit",
                    "assignment", "notice", "payment", "deliver", "oblig")),
)


def mapping_frame(spark: SparkSession, mapping: dict, key: str, value: str) -> DataFrame:
    """A fixed mapping as a broadcast lookup table (one row per dictionary entry)."""
    entries = [F.struct(F.lit(k).alias(key), F.lit(v).alias(value)) for k, v in mapping.items()]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*entries))))
