"""Registered queries over the test tables: each an operator applied to rows that Spark derives from them."""

from granary.plans import evaluation, files, ingest, memory, parsing, questions, retrieval, scalar  # noqa: F401
from granary.plans.registry import QUERIES, oracles


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return oracles()
