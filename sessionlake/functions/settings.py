"""Settings: defaults under the user's, derived limits, validated changes. Driver-side."""

from __future__ import annotations

import copy
import json

from pyspark.sql import SparkSession

# Tokens for each short-term day, and the defaults.
TOKENS_PER_DAY = 750
DEFAULTS = {
    "version": 3,
    "globalShortTerm": {"workingDays": 2},
    "globalLongTerm": {"tokenLimit": 5000},
    "projectShortTerm": {"workingDays": 7},
    "projectLongTerm": {"tokenLimit": 5000},
    "projectSettings": {"includeSubdirectories": False},
    "synthesis": {"intervalHours": 2, "model": "default", "background": True},
    "decay": {"ageDays": 30, "projectWorkingDays": 20, "archiveRetentionDays": 365},
}
# What each path may be set to.
RANGES = {
    "globalShortTerm.workingDays": (1, 30),
    "globalLongTerm.tokenLimit": (1000, 50000),
    "projectShortTerm.workingDays": (1, 30),
    "projectLongTerm.tokenLimit": (1000, 50000),
    "synthesis.intervalHours": (1, 24),
    "decay.ageDays": (7, 365),
    "decay.projectWorkingDays": (1, 365),
    "decay.archiveRetentionDays": (30, 730),
}
FLAGS = ("projectSettings.includeSubdirectories", "synthesis.background")
TEXTS = ("synthesis.model",)


def deep_merge(base: dict, override: dict) -> dict:
    """override over base, key by key; neither is changed."""
    out = copy.deepcopy(base)
    for key, value in override.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = deep_merge(out[key], value) if both else copy.deepcopy(value)
    return out


def with_limits(settings: dict) -> dict:
    """Short-term token limits from days, and the total budget of the four parts."""
    out = copy.deepcopy(settings)
    for part in ("globalShortTerm", "projectShortTerm"):
        out[part]["tokenLimit"] = out[part]["workingDays"] * TOKENS_PER_DAY
    out["totalTokenBudget"] = sum(out[p]["tokenLimit"] for p in ("globalShortTerm", "globalLongTerm", "projectShortTerm", "projectLongTerm"))
    return out


def parse_settings(text: str | None) -> dict:
    """Settings of a file's text; missing or bad text gives the defaults."""
    try:
        user = json.loads(text) if text else {}
    except ValueError:
        user = {}
    return with_limits(deep_merge(DEFAULTS, user if isinstance(user, dict) else {}))


def load_settings(spark: SparkSession, path: str) -> dict:
    from sessionlake.sources.text import read_document

    return parse_settings(read_document(spark, path))


def set_value(settings: dict, path: str, value: object) -> dict:
    """Settings with one path changed; ValueError if the path or value isn't allowed."""
    if path in RANGES:
        low, high = RANGES[path]
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise ValueError(f"{path} takes an integer from {low} to {high}")
    elif path in FLAGS:
        if not isinstance(value, bool):
            raise ValueError(f"{path} takes a boolean")
    elif path in TEXTS:
        if not isinstance(value, str) or not value:
            raise ValueError(f"{path} takes a string")
    else:
        raise ValueError(f"{path} is not a setting")
    part, key = path.split(".")
    return with_limits(deep_merge(settings, {part: {key: value}}))


def reset(settings: dict, path: str | None = None) -> dict:
    """Defaults for one path, or for all."""
    if path is None:
        return with_limits(DEFAULTS)
    part, key = path.split(".")
    if key not in DEFAULTS.get(part, {}):
        raise ValueError(f"{path} has no default")
    return with_limits(deep_merge(settings, {part: {key: DEFAULTS[part][key]}}))


def usage_ratio(tokens: int, limit: int) -> tuple[float, bool]:
    """Per cent used, and whether that is over the limit (a warning, not an error)."""
    share = 100.0 * tokens / limit if limit else 0.0
    return share, tokens > limit
