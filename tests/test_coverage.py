"""The survey inventory is covered line by line."""

import re

from millrace.plans.coverage import ADAPTERS, COVERAGE, resolve
from millrace.plans.registry import REGISTRY, _load_catalog

SURVEY_IDS = ([f"S{i}" for i in range(1, 18)] + [f"P{i}" for i in range(1, 16)] + [f"J{i}" for i in range(1, 10)]
              + [f"A{i}" for i in range(1, 14)] + [f"W{i}" for i in range(1, 11)] + ["U1", "U2"]
              + [f"F{i}" for i in range(1, 24)] + [f"D{i}" for i in range(1, 9)] + [f"ST{i}" for i in range(1, 8)]
              + [f"M{i}" for i in range(1, 12)] + [f"X{i}" for i in range(1, 11)] + ["Q1", "Q2", "Q3"]
              + [f"E{i}" for i in range(1, 5)])


def test_every_inventory_item_resolves():
    assert sorted(COVERAGE) == sorted(SURVEY_IDS)
    for ident, ref in COVERAGE.items():
        assert callable(resolve(ref)), ident
    assert resolve(ADAPTERS)


def test_query_tags_name_inventory_items():
    _load_catalog()
    tags = set()
    for q in REGISTRY.values():
        tags |= set(re.findall(r"\b(ST\d+|[SPJAWUFDMXQE]\d+)\b", q.doc))
    assert tags <= set(COVERAGE)
