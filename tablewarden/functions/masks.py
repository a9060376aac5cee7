"""Column masks: ``Column -> Column`` builders, all inside whole-stage codegen.

Masking a NULL with a value-derived mask gives NULL.  A constant mask replaces
NULL too, so that it does not tell which rows hold a value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A mask sees the raw column and its declared type.
Mask = Callable[[Column, T.DataType], Column]

# What a mask shows in place of the hidden text.
REDACTED = "REDACTED"
EMAIL_FILL = "***@"


def email_keep_domain(fallback: str = REDACTED) -> Mask:
    """First character and domain stay: ``a***@x.com``.

    A value with no ``@`` is shown as *fallback*: it must neither fail the
    query nor leak.
    """

    def mask(c: Column, _type: T.DataType) -> Column:
        shown = F.concat(F.left(c, F.lit(1)), F.lit(EMAIL_FILL), F.split_part(c, F.lit("@"), F.lit(2)))
        return F.when(F.contains(c, F.lit("@")), shown).when(c.isNotNull(), F.lit(fallback))

    return mask


def email_fixed_domain(domain: str = "masked.com") -> Mask:
    """First character stays, the domain is replaced: ``a***@masked.com``."""
    return lambda c, _type: F.concat(F.left(c, F.lit(1)), F.lit(EMAIL_FILL + domain))


def keep_last(prefix: str = "******", shown: int = 4) -> Mask:
    """The last *shown* characters behind *prefix*."""
    return lambda c, _type: F.concat(F.lit(prefix), F.right(c, F.lit(shown)))


def with_prefix(prefix: str = "****-****-****-") -> Mask:
    """The value as stored (already cut short) behind *prefix*."""
    return lambda c, _type: F.concat(F.lit(prefix), c)


def constant(text: str = REDACTED) -> Mask:
    """Every value, NULL included, becomes *text* in the column's own type."""
    return lambda _c, data_type: F.lit(text).cast(data_type)


def null_out() -> Mask:
    """Every value becomes NULL; the column keeps its type."""
    return lambda _c, data_type: F.lit(None).cast(data_type)


def unless_admin(mask: Mask, is_admin: bool) -> Mask:
    """Bypass for administrators, settled while the plan is built.

    ``is_admin`` is a Python value, so an administrator's plan holds no mask
    expression and everybody else's holds no test.
    """
    return (lambda c, _type: c) if is_admin else mask
