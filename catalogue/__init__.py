"""Registered queries over the test tables and their SQL twins."""


def load() -> None:
    """Import every module that registers queries."""
    from importlib import import_module

    for name in ("sources", "preparation", "stationary", "profiles", "dependence", "clusters"):
        import_module(f"catalogue.{name}")
