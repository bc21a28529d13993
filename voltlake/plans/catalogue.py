"""Every registered query. Importing the modules fills the registry."""

from . import queries_ml, queries_parsing, queries_serving, queries_sources, queries_tables  # noqa: F401
from .registry import CATALOGUE  # noqa: F401
