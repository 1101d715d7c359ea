"""All registered queries; importing a module registers its plans."""

from importlib import import_module

MODULES = ("retrieval", "text", "review", "metadata", "evaluation", "analytics", "layout", "sources", "state")

for _name in MODULES:
    import_module(f"docreview.plans.{_name}")
