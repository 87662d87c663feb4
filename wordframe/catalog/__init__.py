from wordframe.catalog.registry import ORACLES, QUERIES  # noqa: F401
from wordframe.catalog import models, scalars, scans, vectors, contracts, sequences, aggregates, evaluation  # noqa: F401
