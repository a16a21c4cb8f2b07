"""All queries over the driver's tables, and their SQL."""

from cellwatch.plans import batch, model, published, signals, stored

QUERIES = batch.QUERIES | signals.QUERIES | model.QUERIES | stored.QUERIES | published.QUERIES
ORACLES = batch.ORACLES | signals.ORACLES | model.ORACLES | stored.ORACLES | published.ORACLES
