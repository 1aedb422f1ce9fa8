"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""

from docassay.queries import adapter, pages, plans, text, validation

QUERIES = {f.__name__: f for f in (*validation.FUNCTIONS, *text.FUNCTIONS, *adapter.FUNCTIONS, *plans.FUNCTIONS, *pages.FUNCTIONS)}
ORACLES = validation.SQL | text.SQL | adapter.SQL | plans.SQL | pages.SQL
