from pageledger.plans import queries_text, queries_quality, queries_tables, queries_families, queries_steps, queries_layout, queries_pages, queries_io  # noqa: F401
from pageledger.plans.registry import ORACLES, QUERIES  # noqa: F401
