"""

``COVERAGE[id]`` names the implementing callable as ``module:attribute``;
``tests/test_coverage.py`` imports every entry.
"""

from __future__ import annotations

_S = "millrace.sources.files"
_T = "millrace.sources.testdata"
_SI = "millrace.operators.silver"
_G = "millrace.operators.gold"
_W = "millrace.operators.timeseries"
_J = "millrace.operators.joins"
_Q = "millrace.operators.quality"
_R = "millrace.operators.rules"
_O = "millrace.operators.operations"
_P = "millrace.operators.filters"
_M = "millrace.operators.ml"
_F = "millrace.functions.scalar"
_ST = "millrace.streaming.live"

COVERAGE: dict[str, str] = {
    # scans, sources, sinks
    "S1": f"{_S}:csv_scan", "S2": f"{_S}:csv_preview", "S3": f"{_S}:csv_scan_tolerant",
    "S4": f"{_S}:bulk_load", "S5": f"{_S}:route_files", "S6": f"{_S}:normalize_columns",
    "S7": f"{_S}:replace_table", "S8": f"{_R}:read_rules_file", "S9": f"{_R}:read_baselines_file",
    "S10": f"{_S}:replace_table", "S11": f"{_S}:write_chunks", "S12": f"{_S}:publish_version",
    "S13": f"{_S}:jdbc_replace", "S14": f"{_S}:insert_batch",
    "S15": "millrace.plans.medallion:Medallion.register_views", "S16": f"{_S}:create_namespaces",
    "S17": f"{_S}:catalog_table",
    # projections, filters
    "P1": f"{_SI}:silver_sensor", "P2": f"{_SI}:silver_maintenance", "P3": f"{_SI}:silver_quality",
    "P4": f"{_SI}:silver_sensor", "P5": f"{_F}:sentinel_null", "P6": f"{_SI}:silver_production",
    "P7": f"{_P}:machine_rows", "P8": f"{_P}:factory_machines", "P9": f"{_P}:status_rows",
    "P10": f"{_P}:staff_with_roles", "P11": f"{_P}:positive_output", "P12": f"{_P}:warehouses_of_type",
    "P13": f"{_P}:display_columns", "P14": f"{_G}:oee_scores", "P15": f"{_F}:status_colour",
    # joins
    "J1": f"{_SI}:silver_production", "J2": f"{_G}:oee_daily", "J3": f"{_G}:ml_feature_view",
    "J4": f"{_J}:star_join", "J5": f"{_R}:label_modes", "J6": f"{_R}:initial_state",
    "J7": f"{_J}:factory_products", "J8": f"{_J}:staff_lookup", "J9": f"{_J}:membership",
    # aggregations
    "A1": f"{_G}:machine_downtime", "A2": f"{_G}:daily_production", "A3": f"{_G}:oee_daily",
    "A4": f"{_G}:daily_sensors", "A5": f"{_G}:ml_feature_view", "A6": f"{_G}:factory_kpi",
    "A7": f"{_O}:energy_daily", "A8": f"{_ST}:live_kpis", "A9": f"{_O}:uptime_factor",
    "A10": f"{_O}:first_per_key", "A11": f"{_W}:tail_n", "A12": "millrace.plans.q_timeseries:_any_shortage",
    "A13": f"{_R}:disturbed_machine_count",
    # ordered
    "W1": f"{_W}:latest_per_key", "W2": f"{_W}:tail_n", "W3": f"{_W}:tail_per_key",
    "W4": f"{_W}:rolling_retention", "W5": f"{_W}:latest_per_key", "W6": f"{_W}:ema_smooth",
    "W7": f"{_W}:sequence_ids", "W8": "millrace.operators.pieces:row_position", "W9": f"{_W}:stock_ledger",
    "W10": "millrace.plans.q_timeseries:_inventory_snapshot",
    # set operations
    "U1": "millrace.plans.q_relations:_union", "U2": f"{_R}:rule_upsert",
    # scalar functions
    "F1": f"{_SI}:silver_sensor", "F2": f"{_F}:event_time", "F3": f"{_SI}:silver_sensor",
    "F4": f"{_SI}:silver_sensor", "F5": f"{_SI}:silver_quality", "F6": f"{_F}:iff",
    "F7": f"{_G}:oee_daily", "F8": f"{_F}:null_least", "F9": f"{_F}:half_up", "F10": f"{_F}:minute_diff",
    "F11": f"{_F}:safe_div", "F12": f"{_F}:ymd", "F13": f"{_F}:iso_timestamp", "F14": f"{_O}:shift_windows",
    "F15": f"{_F}:at_hour", "F16": f"{_O}:expected_output", "F17": f"{_O}:inspection_coverage",
    "F18": f"{_F}:three_phase_current", "F19": f"{_S}:normalize_columns", "F20": f"{_W}:sequence_ids",
    "F21": f"{_F}:uid", "F22": f"{_R}:label_modes", "F23": f"{_M}:label",
    # rules
    "D1": f"{_R}:rule_upsert", "D2": f"{_R}:rules_clear_machines", "D3": f"{_R}:baseline_merge",
    "D4": f"{_R}:rules_by_machine", "D5": f"{_R}:label_modes", "D6": f"{_R}:label_modes",
    "D7": f"{_R}:active_alerts", "D8": f"{_R}:range_breach",
    # streaming
    "ST1": f"{_ST}:read_ticks", "ST2": f"{_ST}:smooth_batch", "ST3": f"{_ST}:SinkFanout.retention",
    "ST4": f"{_ST}:SinkFanout", "ST5": f"{_ST}:label_batch", "ST6": f"{_ST}:live_kpis",
    "ST7": f"{_ST}:FactoryDays",
    # machine learning
    "M1": f"{_M}:sample_n", "M2": f"{_M}:label", "M3": f"{_M}:fit", "M4": f"{_M}:synthetic_failures",
    "M5": f"{_M}:split", "M6": f"{_M}:fit", "M7": f"{_M}:evaluate", "M8": f"{_M}:load",
    "M9": f"{_M}:score", "M10": f"{_M}:score", "M11": f"{_F}:risk_band",
    # domain transforms
    "X1": f"{_O}:daily_failure_prob", "X2": f"{_O}:failure_signature", "X3": f"{_O}:expected_output",
    "X4": f"{_O}:expected_scrap", "X5": f"{_O}:inspection_coverage", "X6": f"{_O}:shipments_against_shortage",
    "X7": f"{_O}:repair_cost", "X8": f"{_O}:shift_windows", "X9": f"{_O}:telemetry_gaps",
    "X10": "millrace.plans.q_operations:_causal",
    # data quality
    "Q1": f"{_Q}:pk_violations", "Q2": f"{_Q}:fk_orphans", "Q3": f"{_Q}:schema_report",
    # extensions
    "E1": f"{_O}:factory_maintenance_cost", "E2": f"{_O}:rolling_sensor_averages",
    "E3": f"{_O}:bom_explosion", "E4": f"{_O}:shift_of",
}

# Adapter rules that derive the bronze tables from the driver tables.
ADAPTERS = f"{_T}:DriverTables"


def resolve(ref: str):
    import importlib
    mod, attr = ref.split(":")
    obj = importlib.import_module(mod)
    for part in attr.split("."):
        obj = getattr(obj, part)
    return obj
