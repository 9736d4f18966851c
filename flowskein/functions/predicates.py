"""Predicates and ranks over nodes and edges, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowskein import model


def given(value: Column) -> Column:
    """Absent text is ''."""
    return F.coalesce(value, F.lit(""))


def meta(column: str, key: str) -> Column:
    return given(F.try_element_at(F.col(column), F.lit(key)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_file(path: Column) -> Column:
    """Test files by name (suffixes, prefixes, ``.test.``, ``.spec.``) or folder."""
    low = F.lower(given(path))
    base = base_name(low)
    by_name = base.rlike(r"\.test\.|\.spec\.|_test\.go$|_test\.rb$|_spec\.rb$|^test_")
    return by_name | low.contains("/__tests__/") | low.contains("/spec/") | low.startswith("spec/")


def test_rank_penalty(path: Column) -> Column:
    """1 for files that rank below production code; knows more test layouts than ``is_test_file``."""
    low = F.lower(given(path))
    hit = low.rlike(r"_test\.go$|_test\.py$|^test_|/test_|_spec\.rb$|_test\.rb$|\.test\.|\.spec\.|^spec/|/spec/|^test/|/test/|^tests/|/tests/|/__tests__/")
    return F.when(hit, 1).otherwise(0)


def is_structural(edge_type: Column) -> Column:
    return edge_type.isin(*model.STRUCTURAL_EDGES)


def is_flow(edge_type: Column) -> Column:
    return ~edge_type.isin(*model.NON_FLOW_EDGES)


def is_resolution(edge_type: Column) -> Column:
    return ~edge_type.isin(*model.NON_RESOLUTION_EDGES)


def is_runtime_verifiable(edge_type: Column) -> Column:
    return edge_type.isin(*model.RUNTIME_EDGES)


def noise_class(edge_type: Column, via: Column, target_type: Column) -> Column:
    """Class of an edge that hides flow; '' for none. The first rule that holds counts."""
    return (
        F.when(via.isin(*model.FILTER_VIAS), "filter_chain")
        .when(edge_type == "inherits", "mixin")
        .when(is_structural(edge_type), "containment")
        .when(target_type == "element", "render_tree")
        .otherwise("")
    )


def noise_included(include: list[str], task: str = "") -> list[str]:
    """Noise classes to show: a list, ``all`` or ``none``, or else the task's default."""
    if not include:
        return ["render_tree"] if task == "generate" else []
    if "all" in include:
        return list(model.NOISE_CLASSES)
    kept = [c for c in include if c not in ("none", "")]
    if unknown := [c for c in kept if c not in model.NOISE_CLASSES]:
        raise ValueError(f"unknown noise class {unknown[0]!r}")
    return kept


def entrypoint_kind(node_type: Column, root_kind: Column) -> Column:
    """Kind of an entry point; null for other nodes."""
    return F.when(node_type.isin(*model.ENTRYPOINT_TYPES), node_type).when((node_type == "function") & (root_kind == "entrypoint"), "function")


def skipped_root_kind(node_type: Column, root_kind: Column) -> Column:
    """Root kind of functions that the catalogue leaves out but counts."""
    return F.when((node_type == "function") & ~root_kind.isin("", "entrypoint"), root_kind)


def tree_kind(node_type: Column) -> Column:
    """Kind of a node in an outline: that of its type's name, ``other`` for types without one."""
    return F.when(node_type.isin(*model.TREE_KINDS), node_type).otherwise("other")


def under_path(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder + "/")


def passes_verification(state: Column, least: str) -> Column:
    """``any``; ``observed``: verified or gap; ``verified`` and ``declared``: verified only."""
    if least in ("", "any"):
        return F.lit(True)
    if least == "observed":
        return given(state).isin(model.VERIFIED, model.GAP)
    if least in ("verified", "declared"):
        return given(state) == model.VERIFIED
    raise ValueError(f"unknown verification {least!r}")


def verification_rank(state: Column) -> Column:
    """Best first: verified 0, gap 1, candidate 2, conflicting 3, none 4."""
    return F.when(state == model.VERIFIED, 0).when(state == model.GAP, 1).when(state == model.CANDIDATE, 2).when(state == model.CONFLICTING, 3).otherwise(4)


def worst_first_rank(state: Column) -> Column:
    """Worst first: gap 0, conflicting 1, candidate 2, verified and unknown 3."""
    return F.when(state == model.GAP, 0).when(state == model.CONFLICTING, 1).when(state == model.CANDIDATE, 2).otherwise(3)


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "static", 3).when(confidence == "inferred", 2).when(confidence == "partial", 1).otherwise(0)


def path_evidence(pattern: Column) -> Column:
    """How much a path pattern says: none, weak or strong."""
    literal = F.filter(F.split(pattern, "/"), lambda s: (s != "") & ~s.contains("*") & ~s.endswith(":"))
    return F.when(F.size(literal) == 0, "none").when((F.size(literal) >= 2) | ~pattern.contains("*"), "strong").otherwise("weak")


def is_relative_url(url: Column) -> Column:
    """Root-relative: starts with one slash."""
    return url.startswith("/") & ~url.startswith("//")


def is_browser_executed(lang: Column, nav_link: Column) -> Column:
    return lang.isin("javascript", "typescript", "vue", "svelte", "html") | (nav_link == "true")
