"""Registered queries. Importing this package fills sparrowgrid.registry."""

from . import accounts, books, experiment, macro, panels, portfolios, research, search, universes  # noqa: F401
from .research import flagship  # noqa: F401
