"""The rule set: read once on the driver, folded into the plan as literals."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.fixed import DEFAULT_RULES


@dataclass(frozen=True)
class Rules:
    """Sections as read, over the defaults; accessors give typed values."""

    sections: Mapping[str, Any] = field(default_factory=lambda: DEFAULT_RULES)

    def get(self, *path: str) -> Any:
        """The value at a path: the file's own, or else the default."""
        for source in (self.sections, DEFAULT_RULES):
            node: Any = source
            for key in path:
                node = node.get(key) if isinstance(node, Mapping) else None
            if node is not None:
                return node
        raise KeyError(".".join(path))

    def names(self, *path: str) -> list[str]:
        return [str(v).strip().casefold() for v in self.get(*path)]

    def numbers(self, *path: str) -> list[int]:
        return [int(v) for v in self.get(*path)]

    def patterns(self, *path: str) -> list[str]:
        return [str(v) for v in self.get(*path)]


def load_rules(source: str | Path | Mapping[str, Any] | None = None) -> Rules:
    """From a YAML file, a mapping, or the defaults. Bad patterns and a non-mapping file raise."""
    if source is None:
        return Rules()
    if not isinstance(source, Mapping):
        import yaml

        source = yaml.safe_load(Path(source).read_text(encoding="utf-8"))
        if not isinstance(source, Mapping):
            raise ValueError("the rule file's top level must be a mapping")
    rules = Rules(source)
    for path in (
        ("noise", "title_patterns"), ("noise", "body_patterns"), ("noise", "response_patterns"), ("noise", "default_page_patterns"),
        ("response_shells", "maintenance_title_patterns"), ("response_shells", "maintenance_body_patterns"),
        ("response_shells", "deny_text_patterns"), ("response_shells", "auth_text_patterns"), ("auth_shell_patterns",),
    ):
        for pattern in rules.patterns(*path):
            re.compile(pattern, re.I)
    re.compile(rules.get("business_text_pattern"))
    return rules


def java_regex(pattern: str) -> str:
    """A rule pattern for Java: Unicode classes and case, as Python has by default."""
    return f"(?iU)(?:{pattern})"


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found; an empty list and an empty text never match."""
    if not patterns:
        return F.lit(False)
    return (text != "") & text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))
