"""What a printed description is not: totals, metadata, payment footers; and what is cut from it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvata.functions.dates import FRAGMENT
from corvata.functions.money import parse_decimal
from corvata.functions.text import plain

# Texts of totals, by how much of a line they have to be.
TOTAL_IS = ("total", "totals", "tota", "sub total", "subtotal")
TOTAL_HOLDS = (
    "gross bill amount", "bill round off", "round off amount", "net bill amount", "total gross bill value", "total payable amount", "net patient payable amt",
    "net patient payable amount", "net payable", "gross amount", "amount to be recelved", "amount to be receive", "company credit limit",
)
TOTAL_STARTS = (
    "sub total", "subtotal", "total for", "grand total", "total bill amount", "total discount amount", "net amount", "net tpa corporate amount", "bill amount", "amount paid",
    "amount to be received", "balance amount", "balance due", "payer amount", "payer received", "payer receivable", "patient amount", "patient received", "patient balance", "cgst amount",
    "sgst amount", "item issue total", "item issues total", "item return total", "item returns total", "patient wise total", "company wise total",
)
BARE_TOTALS = ("bill total", "sub total", "subtotal", "total")
# Texts about a bill rather than on it.
METADATA_HOLDS = (
    "uhid", "original bill no", "mobile no bill no", "bill date time", "contact no d o a", "sponsor billing category", "admitting doctor", "relation self", "amount in words", "in words",
    "print date time", "receipt details", "doctor appointments", "free home sample", "book appointment", "call for appointment", "customer care", "helpline", "website", "email",
    "e mail", "phone no", "mobile no", "uid", "aadhaar", "aadhar", "policy no", "policy number", "pin code", "pincode", "credit fro",
)
METADATA_IS = ("cgst", "sgst", "net bill", "upi", "expdate", "exp date")
METADATA_ENDS = (" admission", " discharge", "only cgst", "only sgst")
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "twenty", "thirty", "fourty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
    "hundred", "thousand", "lakh", "crore",
)
FOOTER_SUBJECTS = ("payment", "receipt", "settlement")
FOOTER_QUALIFIERS = ("breakup", "detail", "details", "history", "information", "mode", "status", "summary")
PAYERS = ("cash", "cashless", "corporate", "credit", "insurance", "patient", "payer", "scheme", "self", "sponsor", "tpa")
CODE_MARKER = r"(?i)^\s*(?:hsn|sac|service\s+code\b|request\s+no\b|ref(?:erence)?\s+no\b)"


def _some(parts) -> Column:
    return reduce(or_, parts)


def is_total(text: Column) -> Column:
    """Whether a line's text is a total's."""
    t = plain(text)
    bare = _some([t.startswith(f"{x} ") & ~F.substring(t, len(x) + 1, 10_000).rlike("[a-z]") for x in BARE_TOTALS])
    return t.isin(*TOTAL_IS, "bill total") | _some([F.contains(t, F.lit(x)) for x in TOTAL_HOLDS]) | _some([t.startswith(x) for x in TOTAL_STARTS]) | bare


def is_metadata(text: Column) -> Column:
    """Whether a text says something about a bill, its payer or its printing."""
    t = plain(text)
    words = F.split(t, " ")
    spelt = t.endswith(" only") & F.arrays_overlap(words, F.array(*[F.lit(w) for w in NUMBER_WORDS]))
    return _some([F.contains(t, F.lit(x)) for x in METADATA_HOLDS]) | t.startswith("rupees in") | t.isin(*METADATA_IS) | _some([t.endswith(x) for x in METADATA_ENDS]) | (F.contains(t, F.lit("date time")) & F.contains(t, F.lit("page"))) | spelt


def is_payment_footer(text: Column) -> Column:
    """Whether a text heads what was paid: an amount paid or received, or a payment's, receipt's or settlement's details."""
    words = F.split(plain(text), " ")
    rest = F.slice(words, 2, 1000)
    has = lambda *names: F.arrays_overlap(rest, F.array(*[F.lit(n) for n in names]))
    first = words[0]
    subject = F.regexp_replace(first, "s$", "").isin(*FOOTER_SUBJECTS)
    return F.when(first == "amount", has("paid", "received")).otherwise(subject & (has(*FOOTER_QUALIFIERS) | (F.array_contains(rest, "break") & F.array_contains(rest, "up"))))


def may_describe(text: Column) -> Column:
    """Whether what stands beside a date or serial number may be a charge's description."""
    t = plain(text)
    no = parse_decimal(text).isNotNull() | F.trim(text).rlike(f"{FRAGMENT[:4]}^{FRAGMENT[4:]}$") | ~t.rlike("[^0-9 ]") | is_metadata(text) | is_total(text) | is_payment_footer(text) | t.isin(*PAYERS)
    return (t != "") & ~F.coalesce(no, F.lit(False)) & ~text.rlike(CODE_MARKER)


def split_serial(text: Column) -> Column:
    """STRUCT(serial, description) of a description that a serial number ran into, or null."""
    shape = r"^\s*([0-9]+[.)]?)\s+(.+?)\s*$"
    rest = F.regexp_extract(text, shape, 2)
    return F.when(text.rlike(shape) & rest.rlike("[A-Za-z]") & may_describe(rest), F.struct(F.regexp_extract(text, shape, 1).alias("serial"), rest.alias("description")))


def without_echo(text: Column) -> Column:
    """A description that says the same words twice in a row, said once."""
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    half = F.floor(F.size(words) / 2).cast("int")
    left, right = F.array_join(F.slice(words, 1, F.greatest(half, F.lit(1))), " "), F.array_join(F.slice(words, F.greatest(half, F.lit(1)) + 1, F.greatest(half, F.lit(1))), " ")
    return F.when((F.size(words) >= 4) & (F.size(words) % 2 == 0) & (plain(left) == plain(right)), left).otherwise(text)


def cleaned(text: Column) -> Column:
    """Single spaces, no signs at the ends, no leading date, no echo."""
    ends = F.lit(" -:.;,[]")
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), ends)
    return without_echo(F.trim(F.regexp_replace(one, f"{FRAGMENT[:4]}^(?:{FRAGMENT[4:]})", ""), ends))
