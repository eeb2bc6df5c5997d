"""functions of the graph engine."""
from __future__ import annotations
