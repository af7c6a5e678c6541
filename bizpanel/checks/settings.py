"""Parameters shared by the registered queries."""

from __future__ import annotations

import datetime as dt

from bizpanel.operators.period import Period

YEAR = 2000
AS_OF = dt.date(2000, 6, 15)
SECOND_QUARTER = Period.from_quarters(YEAR, [2])
# Two months with a gap: the month set leaves February out, the date range does not.
GAP = Period.monthly(YEAR, [1, 3])
WHOLE_YEAR = Period.yearly(YEAR)
CUSTOMER_TYPE = "White Customers"
