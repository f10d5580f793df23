"""Every registered query by name, and its SQL twin."""

from gridloom.catalog import browsing, files, odd_files, relational, sqltext

_MODULES = (relational, browsing, files, odd_files, sqltext)


def all_queries():
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def all_oracles():
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
