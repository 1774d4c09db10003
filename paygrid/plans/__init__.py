"""Query plans: the registered catalog of operators and their SQL oracles."""


def load_all():
    """Import every query module so that the catalog is complete."""
    from paygrid.plans import q_pay, q_text, q_history, q_rolegap, q_sources, q_stream, q_io  # noqa: F401
    try:
        from paygrid.plans import q_ml  # noqa: F401
    except ImportError:  # pragma: no cover
        pass
    from paygrid.plans.catalog import ORACLE, QUERIES
    return QUERIES, ORACLE
