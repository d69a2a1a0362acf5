"""Every ledger query with its SQL: importing this registers them."""

from . import cells, chain, extra, views

QUERIES, SQL = views.QUERIES, views.SQL

__all__ = ["QUERIES", "SQL", "cells", "chain", "extra"]
