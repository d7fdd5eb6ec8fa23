"""Schemas of the logical tables."""

from __future__ import annotations

FEATURE = "struct<kind:string,i:bigint,f:double,b:boolean,s:string>"
ASSOCIATIONS = f"""assoc_id bigint, owner_id bigint, owner_type string, owner_category string, time_series_type int, name string,
initial_timestamp timestamp_ntz, resolution string, resolution_kind string, resolution_n bigint, length bigint, horizon string, interval string,
count bigint, timestamps_hash string, units string, quantity_kind string, unit_system string, component_field string, percentiles array<double>,
element_type string, element_shape array<int>, application_data string, features map<string,{FEATURE}>, features_hash string, data_hash string"""
ARRAYS = "data_hash string, dtype string, shape array<int>, values array<double>, exact array<decimal(20,0)>"
TIMESTAMP_SETS = "timestamps_hash string, timestamps array<timestamp_ntz>"
ATTRIBUTE_LINKS = "id bigint, component_id bigint, component_type string, attribute_id bigint, attribute_type string"
COMPONENT_EDGES = "id bigint, parent_id bigint, parent_type string, child_id bigint, child_type string"
TABLES = {
    "associations": ASSOCIATIONS,
    "arrays": ARRAYS,
    "timestamp_sets": TIMESTAMP_SETS,
    "attribute_links": ATTRIBUTE_LINKS,
    "component_edges": COMPONENT_EDGES,
}

#: What makes a series itself; empty text stands for no resolution or interval.
IDENTITY = ("owner_id", "owner_category", "time_series_type", "name", "resolution", "interval", "features_hash")

#: Names that no feature may have (fixed values).
RESERVED_FEATURES = frozenset(
    "application_data component_field count data data_hash dtype element_shape element_type ext features horizon initial_timestamp interval length "
    "name owner_category owner_id owner_type percentiles quantity_kind resolution scenario_count time_series_type timestamps unit_system units".split()
)
