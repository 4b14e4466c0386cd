from .mutate import Changes, Snapshot, Transaction, apply_changes, run_program
from .scan import Page, find_equal, find_nodes, get_edge, get_node, inspect, inspect_edges, inspect_indexes, inspect_nodes, maybe, objects, one, project
from .traverse import Walk, expanded_edges, paths, reach, walk
from .verify import verify

__all__ = [
    "Changes", "Page", "Snapshot", "Transaction", "Walk", "apply_changes", "expanded_edges", "find_equal", "find_nodes", "get_edge", "get_node", "inspect", "inspect_edges", "inspect_indexes",
    "inspect_nodes", "maybe", "objects", "one", "paths", "project", "reach", "run_program", "verify", "walk",
]
