"""From an intent to a guarded DataFrame."""

from semspark.plans.compiler import Answer, Catalog, compile_intent
from semspark.plans.intent import Ask, Intent, NotDerivable, Window, period
from semspark.plans.paths import find_path

__all__ = ["Answer", "Ask", "Catalog", "Intent", "NotDerivable", "Window", "compile_intent", "find_path", "period"]
