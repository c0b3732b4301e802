"""What a table is, and what a charge is for: ordered rules over its text."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvata.functions.text import plain

# The terms of each rule.
METADATA = (
    "uhid", "ip no", "original bill no", "contact no", "date of admission", "d o a", "sponsor", "billing category", "mobile no", "uid", "aadhaar", "aadhar",
    "policy no", "policy number", "policy type", "treatment details", "claim eligible", "pin code", "pincode", "bill no", "bill date time", "relation", "admitting doctor", "discharge",
)
BREAK_UP = ("break up of charges", "package break up")
BILL_SUMMARY_ALL = ("service name", "bill amount", "discount amount", "total amount", "total bill amount")
SPLIT_SUMMARY_ALL = (("service name", "patient amount", "company amount", "total amount"), ("service name", "patient", "company", "grand total"))
SUMMARY_ANY = ("bill summary", "summary of charges", "department amount")
PHARMACY_ANY = ("batch", "bath no", "expiry", "cash memo", "medical general stores")
PAYER_ANY = ("payer received", "payer receivable", "patient received", "patient balance")
PAYMENT_ANY = ("payment mode", "amount paid", "amount received", "receipt ref")
LABORATORY = ("test name", "pathology", "laboratory", "investigation")
CATEGORIES = (
    ("bed", ("bed charge", "room charge", "accommodation")), ("nursing", ("nursing",)), ("doctor", ("doctor", "surgeon", "consultation", "round charge", "visit charge")),
    ("ot", ("o t charge", "ot charge", "theatre")), ("anaesthesia", ("anaesth", "anesth")), ("service", ("service",)),
)
PAGE_OF_TABLE = {"item_ledger": "itemized_bill", "category_summary": "summary", "package_summary": "summary", "pharmacy": "pharmacy", "laboratory": "laboratory", "payment": "payment", "metadata": "metadata"}


def _any(t: Column, terms: tuple[str, ...]) -> Column:
    return reduce(or_, [t.contains(x) for x in terms])


def _all(t: Column, terms: tuple[str, ...]) -> Column:
    return ~reduce(or_, [~t.contains(x) for x in terms])


def table_type(text: Column, header: Column, rows: Column, has_serial: Column, has_header: Column, zero_tail: Column) -> Column:
    """metadata, package_summary, category_summary, pharmacy, payment, laboratory or item_ledger, by the first rule that holds."""
    t, h, small = plain(text), plain(header), rows <= 24
    metadata = reduce(add, [t.contains(x).cast("int") for x in METADATA]) >= 2
    split = reduce(or_, [_all(t, x) for x in SPLIT_SUMMARY_ALL])
    lab_words = reduce(add, [(F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))) / len(x) for x in LABORATORY])
    return (
        F.when(metadata & small & ~has_serial & ~has_header, "metadata").when(_any(t, BREAK_UP), "package_summary").when(small & _all(t, BILL_SUMMARY_ALL), "category_summary")
        .when(split | zero_tail | _any(t, SUMMARY_ANY) | (t.contains("department") & t.contains("amount") & (rows <= 30)), "category_summary")
        .when(_any(t, PHARMACY_ANY) | (t.contains("m r p") & t.contains("exp")), "pharmacy").when(small & ~has_header & _any(t, PAYER_ANY), "payment").when(_any(t, PAYMENT_ANY), "payment")
        .when(_any(h, LABORATORY) | (lab_words >= 2), "laboratory").when(has_serial & (rows <= 20) & t.contains("particular"), "category_summary").otherwise("item_ledger")
    )


def charge_category(description: Column, kind: Column) -> Column:
    """package, pharmacy, laboratory, or by keyword; null without a sign."""
    t = plain(description)
    out = F.when(t.contains("package"), "package").when((kind == "pharmacy") | _any(t, ("pharmacy", "medicine", "consumable")), "pharmacy").when((kind == "laboratory") | _any(t, ("laboratory", "pathology", "investigation", "lab charges")), "laboratory")
    for name, terms in CATEGORIES:
        out = out.when(_any(t, terms), name)
    return out


def page_type(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PAGE_OF_TABLE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit("unknown"))
