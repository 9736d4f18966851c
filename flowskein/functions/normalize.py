"""Normalisers of channel keys: pure expressions, applied by name.

Each takes a key column and an environment of columns and gives a key column.
All but one mention the key once, so that a chain of them stays one small
expression instead of doubling with every step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowskein import model


@dataclass(frozen=True)
class Env:
    """Where a key is normalised: the base URL of the target service, if one is linked."""

    base_url: Column | None = None


def param_wildcard(key: Column, env: Env = Env()) -> Column:
    """Path parameters of every dialect become ``*``."""
    out = F.regexp_replace(key, r"[^/]*\$\{[^/]*\}[^/]*", "*")
    for pattern in (r":[^/]+", r"\{[^}]+\}", r"\[[^\]]+\][+*?]?", r"%[0-9]*[dsv]"):
        out = F.regexp_replace(out, pattern, "*")
    return out


def query_strip(key: Column, env: Env = Env()) -> Column:
    return F.substring_index(key, "?", 1)


def quote_strip(key: Column, env: Env = Env()) -> Column:
    """One pair of matching quotes goes."""
    return F.regexp_replace(key, r"^(?s)([\"'`])(.*)\1$", "$2")


def case_fold(key: Column, env: Env = Env()) -> Column:
    return F.lower(key)


def trim_slash(key: Column, env: Env = Env()) -> Column:
    """Trailing slashes go; what was only slashes is one."""
    return F.regexp_replace(key, r"(?<=.)/+$", "")


def base_url_strip(key: Column, env: Env = Env()) -> Column:
    if env.base_url is None:
        return key
    base = F.coalesce(env.base_url, F.lit(""))
    rest = F.substr(key, F.length(base) + 1)
    return F.when((base != "") & key.startswith(base), F.when(rest == "", "/").otherwise(rest)).otherwise(key)


def segments(path: Column) -> Column:
    """Segments of a path without empty ends."""
    return F.filter(F.split(F.btrim(path, F.lit("/")), "/"), lambda s: s != "")


_ALL_WILD = r"^/*\*(?:/+\*)*/*$"


def shared_anchor_guard(key: Column, env: Env = Env()) -> Column:
    """A key of wildcards only anchors nothing."""
    return F.regexp_replace(key, _ALL_WILD, "")


def empty_path_guard(key: Column, env: Env = Env()) -> Column:
    return F.regexp_replace(key, _ALL_WILD, "")


def url_to_path(key: Column, env: Env = Env()) -> Column:
    """What follows ``scheme://host``, '/' if nothing does."""
    return F.regexp_replace(F.regexp_replace(key, r"^.*?://[^/]*$", "/"), r"^.*?://[^/]*(?=/)", "")


def dynamic_host_strip(key: Column, env: Env = Env()) -> Column:
    return F.regexp_replace(key, r"^\*/", "/")


def amqp_topic_wildcard(key: Column, env: Env = Env()) -> Column:
    return F.regexp_replace(key, r"(?<=^|\.)#(?=\.|$)", "*")


NORMALIZERS: dict[str, Callable[[Column, Env], Column]] = {
    f.__name__: f
    for f in (
        param_wildcard, query_strip, quote_strip, case_fold, trim_slash, base_url_strip, shared_anchor_guard, url_to_path,
        dynamic_host_strip, amqp_topic_wildcard, empty_path_guard,
    )
}


def normalize_fields(fields: list[Column], names: list[str], env: Env = Env()) -> Column:
    """Each field through the chain of normalisers, then joined by a blank."""
    out = []
    for field in fields:
        for name in names:
            if name not in NORMALIZERS:
                raise ValueError(f"unknown normalizer {name!r}")
            field = NORMALIZERS[name](field, env)
        out.append(field)
    return F.concat_ws(" ", *out)


def is_boilerplate(segment: Column) -> Column:
    low = F.lower(segment)
    return low.isin(*model.BOILERPLATE_SEGMENTS) | low.rlike(r"^v[0-9]+$")


def segments_match(key: Column, pattern: Column) -> Column:
    """Segment arrays of equal size agree, ``*`` on either side for any segment.

    A key with wildcards must also share a literal segment that is no boilerplate.
    """
    pairs = F.arrays_zip(key.alias("k"), pattern.alias("p"))
    k, p = (lambda x: x.getField("k")), (lambda x: x.getField("p"))
    agree = F.forall(pairs, lambda x: (k(x) == p(x)) | (k(x) == "*") | (p(x) == "*"))
    anchor = F.exists(pairs, lambda x: (k(x) == p(x)) & (k(x) != "*") & ~is_boilerplate(k(x)))
    return (F.size(key) == F.size(pattern)) & agree & (~F.array_contains(key, "*") | anchor)
