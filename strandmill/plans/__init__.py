"""Registered queries over the shared tables."""


def registries():
    """All registries of the core; the subpackage for model data brings its own."""
    from strandmill.plans.bank_queries import BANK
    from strandmill.plans.metric_queries import METRICS
    from strandmill.plans.more_queries import MORE
    from strandmill.plans.orphan_queries import ORPHANS
    from strandmill.plans.text_queries import TEXT

    return [ORPHANS, METRICS, BANK, TEXT, MORE]
