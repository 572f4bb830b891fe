"""Looking into tables and texts at scale, with Spark DataFrames."""

from tablelens.operators.aliases import alias_hops, resolve_aliases
from tablelens.operators.graph import (
    EdgeTables,
    build_edges,
    edge_ordinals,
    graph_layout,
    store_edges,
    two_hop_in,
    two_hop_out,
)
from tablelens.operators.keys import Reference, fk_check, relationship_cardinality, sketched_sets, unique_sets
from tablelens.operators.lists import collapse_list, ordered_list
from tablelens.operators.profile import (
    column_profile,
    filtered_counts,
    first_match,
    latest_match,
    presence_flags,
    sequence_profile,
    table_summary,
)
from tablelens.operators.ranges import (
    block_storage,
    discrete_boundaries,
    file_storage,
    partition_labels,
    partition_storage,
    range_partition,
    range_partition_table,
    state_pivot,
)
from tablelens.operators.report import search_report
from tablelens.operators.rules import name_audit, scoped_rules, state_words
from tablelens.operators.runs import run_lists, runs
from tablelens.operators.search import (
    Source,
    add_containers,
    grep_lines,
    header_sections,
    like_any,
    line_counts,
    search_outline,
    search_union,
    text_preview,
)
from tablelens.plans.tables import materialize

__all__ = [
    "EdgeTables",
    "Reference",
    "Source",
    "add_containers",
    "alias_hops",
    "block_storage",
    "build_edges",
    "collapse_list",
    "column_profile",
    "discrete_boundaries",
    "edge_ordinals",
    "file_storage",
    "filtered_counts",
    "first_match",
    "fk_check",
    "graph_layout",
    "grep_lines",
    "header_sections",
    "like_any",
    "latest_match",
    "line_counts",
    "materialize",
    "name_audit",
    "ordered_list",
    "partition_labels",
    "partition_storage",
    "presence_flags",
    "range_partition",
    "range_partition_table",
    "relationship_cardinality",
    "resolve_aliases",
    "run_lists",
    "runs",
    "scoped_rules",
    "search_outline",
    "search_report",
    "search_union",
    "sequence_profile",
    "sketched_sets",
    "state_pivot",
    "state_words",
    "store_edges",
    "table_summary",
    "text_preview",
    "two_hop_in",
    "two_hop_out",
    "unique_sets",
]
