"""Personal-data categories of security functions, and why a listing failed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed set of category labels.
CATEGORIES = [
    "ssn", "email", "phone", "credit_card", "date_of_birth", "address",
    "name", "national_id", "bank_account", "health", "salary",
    "business_unit", "region", "other", "none",
]

# What a caller may replace: words that speak for a category when they are a whole part of a name.
VOCABULARY: dict[str, tuple[str, ...]] = {
    "email": ("mail", "email", "inbox"),
    "phone": ("phone", "mobile", "fax"),
    "ssn": ("ssn", "socialsecurity"),
    "national_id": ("passport", "taxid", "citizen"),
    "credit_card": ("card", "pan", "cvv"),
    "bank_account": ("bank", "iban", "bic"),
    "date_of_birth": ("birthday", "birthdate", "dob"),
    "address": ("street", "postcode", "address"),
    "health": ("diagnosis", "patient", "health"),
    "salary": ("salary", "wage", "bonus"),
    "business_unit": ("unit", "division", "department"),
    "region": ("region", "country", "territory"),
    "name": ("name", "surname", "forename"),
}

# Marker in an error's code or message -> reason, in order.
ERROR_REASONS = [
    ("PERMISSION_DENIED", "PERMISSION_DENIED"),
    ("SAMPLE_TABLE_PERMISSIONS", "PERMISSION_DENIED"),
    ("FAILED_JDBC", "FEDERATION_UNREACHABLE"),
    ("DATA_SOURCE_NOT_FOUND", "UNSUPPORTED_DATA_SOURCE"),
]
UNKNOWN_REASON = "UNKNOWN_GATEWAY_ERROR"


def _first_match(pairs: list[tuple[Column, str]]) -> Column:
    """Value of the first condition that holds, else NULL."""
    (head, value), *rest = pairs
    return reduce(lambda acc, p: acc.when(p[0], F.lit(p[1])), rest, F.when(head, F.lit(value)))


def name_parts(name: Column) -> Column:
    """Parts of a name in lower case, cut at anything but letters and digits and where a capital follows a small letter."""
    cut = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), "[^a-z0-9]+"), lambda p: p != "")


def category(function_fqn: Column | str, columns: Column | str, vocabulary: Mapping[str, Sequence[str]] = VOCABULARY) -> Column:
    """Category of a security function from the columns it guards (an array) and its own name, without catalog and schema.

    Every column gives a vote to each category that knows one of its parts, the
    function's name half a vote.  Most votes win, ties go by the vocabulary's
    order, and without any vote it is ``other``.
    """
    fqn = F.col(function_fqn) if isinstance(function_fqn, str) else function_fqn
    cols = F.col(columns) if isinstance(columns, str) else columns
    names = list(vocabulary)
    places: dict[str, list[int]] = {}
    for place, name in enumerate(names):
        for word in vocabulary[name]:
            places.setdefault(word, []).append(place)
    if not places:
        return F.lit("other")
    known = F.create_map(*[c for w, at in places.items() for c in (F.lit(w), F.array(*[F.lit(i) for i in at]))])
    nowhere = F.array().cast("array<int>")

    def spoken_for(name: Column) -> Column:
        """Places of the categories that know a part of the name, each once."""
        return F.array_distinct(F.flatten(F.transform(name_parts(name), lambda p: F.coalesce(F.element_at(known, p), nowhere))))

    by_columns = F.flatten(F.transform(F.coalesce(cols, F.array().cast("array<string>")), lambda c: F.coalesce(spoken_for(c), nowhere)))
    own = F.coalesce(spoken_for(F.element_at(F.split(fqn, r"\."), -1)), nowhere)

    def most(cast: Column) -> Column:
        def ranked(place: Column) -> Column:
            votes = 2 * F.size(F.filter(cast["columns"], lambda v: v == place)) + F.size(F.filter(cast["own"], lambda v: v == place))
            return F.struct(votes.alias("votes"), (-place).alias("place"))

        best = F.array_max(F.transform(F.array(*[F.lit(i) for i in range(len(names))]), ranked))
        return F.when(best["votes"] > 0, F.element_at(F.array(*[F.lit(n) for n in names]), 1 - best["place"])).otherwise("other")

    # one element, so that the votes are taken once and not once per category
    return F.transform(F.array(F.struct(by_columns.alias("columns"), own.alias("own"))), most)[0]


def normalize_label(raw: Column | str) -> Column:
    """One label of the closed set from free text; empty text gives NULL.

    The first word decides if it is a label; else the first label, in the
    order of the list, that occurs anywhere; else ``other``.
    """
    c = F.col(raw) if isinstance(raw, str) else raw
    text = F.lower(c)
    for edge in (r"\s", r"\.", "['\"]"):
        text = F.regexp_replace(text, f"^{edge}+|{edge}+$", "")
    word = F.regexp_replace(F.regexp_extract(text, r"^\s*(\S+)", 1), "^[,.]+|[,.]+$", "")
    anywhere = _first_match([(F.contains(text, F.lit(k)), k) for k in CATEGORIES])
    label = F.when(word.isin(CATEGORIES), word).otherwise(F.coalesce(anywhere, F.lit("other")))
    return F.when(F.length(c) > 0, label)


def error_reason(message: Column | str, code: Column | str | None = None) -> Column:
    """Why a table could not be described; NULL where there was no error.

    A marker counts whether it is the error's code or only part of its text.
    """
    msg = F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit(""))
    if code is None:
        raised, code_col = F.col(message) if isinstance(message, str) else message, F.lit("")
    else:
        code_col = F.col(code) if isinstance(code, str) else code
        raised = F.coalesce(code_col, F.col(message) if isinstance(message, str) else message)
        code_col = F.coalesce(code_col, F.lit(""))
    found = _first_match([((code_col == m) | F.contains(msg, F.lit(m)), reason) for m, reason in ERROR_REASONS])
    return F.when(raised.isNotNull(), found.otherwise(UNKNOWN_REASON))
