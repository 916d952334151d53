"""All registered queries."""

from markloom.plans import aggregates, cleaning, joins, reports, scores, sources, statistics, windows  # noqa: F401
from markloom.plans.base import ORACLES, QUERIES  # noqa: F401
