"""Queries over the driver's tables, each with an equivalent SQL text where SQL can express it."""

from trailknit.plans import evaluation, examples, graph, groups, links, streams

MODULES = (groups, graph, evaluation, examples, links, streams)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
