"""A Spark-native profiler for the values of JSON documents."""

from importlib import import_module

_PLACES = {"ProfileConfig": ".config", "ProfileResult": ".plans.profile", "profile": ".plans.profile", "profile_documents": ".plans.profile"}
__all__ = list(_PLACES)


def __getattr__(name: str):  # noqa: ANN202  executors that import a submodule need not load the rest
    if name in _PLACES:
        return getattr(import_module(_PLACES[name], __name__), name)
    raise AttributeError(name)
