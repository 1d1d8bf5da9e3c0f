from vocale.plans.registry import ORACLES, QUERIES
from vocale.plans import features, forecast, lineage, messages, store, streams  # noqa: F401
