"""Detectors: a category's findings in a text column, as an array of spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.kernel import Scan, empty_spans, scan
from maskframe.functions.patterns import java, patterns_of
from maskframe.functions.registry import Category, Options, all_categories, category, register
from maskframe.operators.literal import literal_scan

Detector = Callable[[Column], Column]
_CUSTOM: dict[str, Detector] = {}


def scans_of(name: str) -> list[Scan]:
    return [Scan(java(p.regex), name, p.part, p.valid, p.after, java(p.gate)) for p in patterns_of(name)]


def detect(name: str, text: Column) -> Column:
    """Findings of one category, pattern by pattern in the order of its patterns."""
    return _CUSTOM[name](text) if name in _CUSTOM else scan(text, *scans_of(name))


def register_category(definition: Category, detector: Detector | str) -> None:
    """A new category with a detector: a pattern, or a function from the text column to an array of spans."""
    register(definition)
    _CUSTOM[definition.name] = detector if callable(detector) else lambda text: scan(text, Scan(java(detector), definition.name))


def detect_all(text: Column, options: Options | None = None, manual: Column | None = None) -> Column:
    """Findings of all enabled categories in registry order, marked spans first; they may overlap.

    A category with exact values is searched for those instead of being detected. Marked spans take part whatever
    is enabled. A category that isn't enabled isn't in the plan.
    """
    options = options or Options()
    parts, scans = [] if manual is None else [manual], []
    for name in all_categories():
        if name not in options.enabled or category(name).user_authored:
            continue
        values = options.exact_values(name)
        if values:
            scans += [x for x in (literal_scan(v, name) for v in values) if x]
        elif name in _CUSTOM:
            parts += [scan(text, *scans), _CUSTOM[name](text)]
            scans = []
        else:
            scans += scans_of(name)
    if scans or not parts:
        parts.append(scan(text, *scans))
    return F.concat(*parts) if len(parts) > 1 else parts[0]
