"""All queries of the claims library and their SQL twins."""

from __future__ import annotations

from . import attribution, claims, decisions, layers, retrieval, rowwise
from .sql import with_layers

MODULES = (claims, decisions, layers, retrieval, attribution, rowwise)
QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLE = {name: with_layers(sql) for module in MODULES for name, sql in module.ORACLE.items()}
