"""The catalogue of queries, by subject."""


def load() -> None:
    """Import the modules that register queries."""
    from engram.plans import lifecycle, log, network, retrieval, runs, stores, structure, text, upkeep, vectors  # noqa: F401
