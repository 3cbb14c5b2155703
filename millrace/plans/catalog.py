"""Every query of the library by name, with the SQL that checks it."""

from millrace.plans import answers, browse, details, feeds, listings, records, relational, retrieval, runs, services, stores, texts  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES  # noqa: F401
