"""A PySpark-native engine for cleaning and typesetting Chinese and mixed-language text."""

from inkstone.functions.edits import Edit, apply, arbitrate, edit
from inkstone.functions.pipeline import format_text
from inkstone.functions.registry import DEFAULTS, ORDER, PRESETS, Replacement, Request, RequestError, adjust, canonical, expand, normalize_keys
from inkstone.functions.spans import Span, all_spans, editable_spans, semantic_spans, structure_spans

__all__ = [
    "DEFAULTS", "ORDER", "PRESETS", "Edit", "Replacement", "Request", "RequestError", "Span", "adjust", "all_spans", "apply", "arbitrate",
    "canonical", "edit", "editable_spans", "expand", "format_text", "normalize_keys", "semantic_spans", "structure_spans",
]
