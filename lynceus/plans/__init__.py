"""Experiments: registry, training, storage, and the registered queries."""


def all_queries():
    """The catalog, with every query module loaded."""
    from lynceus.plans import catalog, queries_lifecycle, queries_mining, queries_models, queries_shaping  # noqa: F401

    return catalog
