"""All queries of the library outside llm, from the modules of this folder."""

from plumbline.plans import campaigns, feeds, files, lensing, tables, time_series

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (time_series, tables, lensing, campaigns, files, feeds):
    QUERIES.update({f.__name__: f for f in _module.PLANS})
    ORACLES.update(_module.SQL)
