"""Feature names for people: labels from words, suffixes and a dictionary; groups from rules on names."""

from __future__ import annotations

import re
from collections.abc import Mapping

MODULE_PREFIX = "plan_module_"
#: Suffixes of what is derived from a metric over time, and how they are said.
SUFFIXES = {"_delta_1m": "change in a month", "_delta_3m": "change in three months", "_ratio_3m": "level against the last three months", "_slope_3m": "trend of the last three months"}
#: Groups in the order in which they are tried: (group, beginnings, parts, whole names).
GROUPS = (
    ("plan", ("plan",), (), ()),
    ("billing", ("estado", "severity", "debt"), ("deuda", "debt"), ()),
    ("sales", ("v_", "ventas", "ratio_ventas", "canales", "sales", "active_channels", "no_sales", "delivery_ratio", "salon_ratio"), (), ()),
    ("daily operation", ("ad_", "adiciones", "additions", "orders"), (), ()),
    ("product set-up", ("pr_", "ing_", "productos", "ingredientes", "cat_", "sub_", "ratio_", "features_in_use"), (), ()),
    ("team and access", ("usuarios", "cantidad_de_cajas", "cantidad_de_turnos"), (), ()),
    ("life cycle", (), (), ("tenure_months", "months_in_panel", "meses_desde_alta_en_panel", "pausas_previas", "months_since_first", "prior_pauses")),
)


def _words(name: str) -> str:
    text = name.replace("_", " ").strip()
    return text[:1].upper() + text[1:]


#: A name in parts: a module's code, or a metric and what is derived from it.
PARTS = re.compile(rf"{MODULE_PREFIX}(?P<module>.*)|(?P<metric>.*?)(?P<suffix>{'|'.join(SUFFIXES)})?", re.DOTALL)


def label(name: str, known: Mapping[str, str] | None = None, modules: Mapping[str, str] | None = None) -> str:
    """What a feature is called: as ``known`` says; a module by its name; with a suffix its metric's label and the suffix in words; else its own words."""
    said = known or {}
    part = PARTS.fullmatch(name).groupdict()
    module, metric, suffix = part["module"], part["metric"], part["suffix"]
    own = f"Module {(modules or {}).get(module, module)}" if metric is None else said.get(metric, _words(metric)) + (f" ({SUFFIXES[suffix]})" if suffix else "")
    return said.get(name, own)


def group(name: str) -> str:
    """The first group with a rule that fits, else ``other``."""
    for found, beginnings, parts, whole in GROUPS:
        if name.startswith(beginnings) or any(p in name for p in parts) or name in whole:
            return found
    return "other"
