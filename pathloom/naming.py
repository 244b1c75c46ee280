"""Names of output columns."""

from __future__ import annotations


def node_col(kind: str, c: int) -> str:
    return f"node_{kind}_col_{c}"


def edge_node_col(endpoint: int, kind: str, c: int) -> str:
    return f"index_{endpoint}_node_{kind}_col_{c}"


def path_node_col(position: int, kind: str, c: int) -> str:
    return f"Node_{position}_{kind}_Col_{c}"


def path_feature_col(what: str, kind: str, position: int) -> str:
    """``what`` is node or edge."""
    return f"{what}_{kind}_index_{position}_feat"


def feature_col(kind: str) -> str:
    return f"{kind}_feat_col"


def presence_col(feature: str) -> str:
    """1 where the feature is present."""
    return f"null_mark_of_{feature}"


def window_name(start: int, length: int, unit: str) -> str:
    return f"agg_{start}_to_{start + length}_{unit}"


def edge_type_name(a: str, b: str) -> str:
    return f"{a}___linked_with___{b}"


def collected_col(path: str, column: str) -> str:
    return f"{path}_clt_{column}"


def collected_count_col(path: str) -> str:
    return f"{path}_collect_count"


def collected_slot_col(path: str, i: int, column: str) -> str:
    return f"{path}_id_{i}_{column}"
