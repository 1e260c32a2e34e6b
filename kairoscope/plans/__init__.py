"""All queries over the driver's tables, with their SQL where there is any."""

from . import ablation, evaluation, files, flows, horizons, inputs, keyed, reports, research, rules, snapshot, study, surface, temporal, whole  # noqa: F401  (they register themselves)
from .harness import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
