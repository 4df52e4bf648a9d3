"""All queries of the subpackage and their SQL."""

from importlib import import_module

MODULES = ["q_quality", "q_simhash", "q_urlfilter", "q_extract", "q_bundles", "q_mixing", "q_decontaminate", "q_toxicity", "q_lmscore", "q_passages"]
QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _m = import_module(f".{_name}", __package__)
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
