"""The search and recall tools for clients of the Model Context Protocol; the package ``mcp`` is needed only here."""

from __future__ import annotations

from pathlib import Path
from typing import Literal

from pyspark.sql import SparkSession

from .cli import search_chat_history, search_json
from .operators import recall

Role = Literal["human", "assistant"] | None


def tools(spark: SparkSession, index: str | Path) -> dict:
    """name to (function, description)."""

    def search(query: str, limit: int = 10, after: str | None = None, before: str | None = None, role: Role = None, conv: str | None = None) -> str:
        return search_json(spark, index, query, limit=limit, after=after, before=before, role=role, conv=conv)

    def history(
        query: str, limit: int = recall.LIMIT, token_budget: int = recall.BUDGET, neighbor_radius: int = recall.RADIUS,
        after: str | None = None, before: str | None = None, role: Role = None, conv: str | None = None,
    ) -> str:
        return search_chat_history(spark, index, query, limit=limit, token_budget=token_budget, neighbor_radius=neighbor_radius, after=after, before=before, role=role, conv=conv)

    return {"search": (search, "Ranked segments of the archive, as JSON."), "search_chat_history": (history, "A block of archived turns that fits a token budget.")}


def create_server(spark: SparkSession, index: str | Path, factory=None):
    """A server with both tools. factory: makes a server of a name, with the interface of FastMCP."""
    if factory is None:
        try:
            from mcp.server.fastmcp import FastMCP as factory
        except ModuleNotFoundError as e:
            raise RuntimeError("serving needs the package mcp") from e
    server = factory("threadloom")
    for name, (run, description) in tools(spark, index).items():
        server.tool(name=name, description=description)(run)
    return server
