"""All registered queries."""

from tablewright.plans import queries_profile, queries_quality, queries_state, queries_transforms  # noqa: F401
from tablewright.plans.registry import ORACLES, QUERIES  # noqa: F401
