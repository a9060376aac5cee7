"""Row filters, column masks and their bookkeeping as Spark DataFrame work.

A policy is a row in a DataFrame; enforcing it is a DataFrame -> DataFrame
function.  Everything here is lazy unless its docstring says otherwise.
"""

from tablewarden.operators.enforce import SecurityState, secure
from tablewarden.operators.membership import Who, resolve_who
from tablewarden.plans.options import RunOptions
from tablewarden.plans.run import run

__all__ = ["RunOptions", "SecurityState", "Who", "resolve_who", "run", "secure"]
