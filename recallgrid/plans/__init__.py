"""Query catalog."""
from . import catalog, fusion, ledger, rows, workflow  # noqa: F401
