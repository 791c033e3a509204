"""Table bindings, file IO and HTML page sources."""

from .bindings import companies, companies_raw, entities_orders  # noqa: F401
from .tables import TABLES, read_table  # noqa: F401
