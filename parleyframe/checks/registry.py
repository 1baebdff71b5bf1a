"""The list of checks: name, query and (where SQL can say it) the oracle."""

from parleyframe.checks.inputs import Inputs, oracle

QUERIES = {}
ORACLES = {}


def check(sql=None, name=None):
    """Register ``f(inputs) -> DataFrame`` under its own or the given name."""
    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Inputs(spark, folder))
        if sql is not None:
            ORACLES[key] = oracle(sql)
        return f
    return register
