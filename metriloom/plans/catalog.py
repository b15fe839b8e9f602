"""Imports every module that registers queries."""

from metriloom.plans import align, anomaly, cost, features, forecast, models, recommend, sources, store, telemetry  # noqa: F401
from metriloom.plans import streams  # noqa: F401  after the batch twins whose SQL it shares
