"""Queries over the given tables. all_queries() and all_oracles() hold every one of them."""


def _registry():
    from tidings.plans import aggregates, feeds_and_streams, histories, incremental, judgement, languages, movement, names, parsers, plug_ins, registry, relations, searches, texts, views  # noqa: F401

    return registry


def all_queries() -> dict:
    return dict(_registry().QUERIES)


def all_oracles() -> dict:
    return dict(_registry().ORACLES)
