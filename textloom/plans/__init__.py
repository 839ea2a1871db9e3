"""Named queries over the supplied tables, one per inventory operator."""

from textloom.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from textloom.plans import strings, filters, sampling, vocab, metrics, vectors, classes, corpus, behaviour, io, topics, ml, wordvec  # noqa: F401,E402


def load_all():
    return QUERIES, ORACLES
