"""The search tool over standard input and output: JSON-RPC 2.0, one message a line, as the public Model Context
Protocol describes its stdio transport."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from corvine import __version__
from corvine.schema import Request

PROTOCOL = "2025-06-18"
INSTRUCTIONS = (
    "A local search service over source code. Call the tool `search` with words of a description or with exact "
    "identifiers; results join keyword ranking and vector similarity. Java, JavaScript, TypeScript, Vue and XML "
    "files are indexed."
)
TOOL = {
    "name": "search",
    "description": "Ranked code blocks for a query: file, lines, kind, name and source.",
    "inputSchema": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "description": "words or an identifier"},
            "lang": {"type": "string", "description": "languages, separated by commas"},
            "limit": {"type": "integer", "minimum": 0, "default": 10, "description": "results at most"},
            "context": {"type": "string", "default": "full", "description": "'full', or lines around each hit"},
            "path": {"type": "string", "description": "part of the file path"},
        },
        "required": ["query"],
    },
}


def request_of(fields: dict) -> Request:
    """A request from its fields; what is not known or of a wrong type is an error."""
    kinds = {"query": str, "lang": str, "limit": int, "context": str, "path": str}
    given = {k: v for k, v in fields.items() if v is not None}
    for k, v in given.items():
        if k not in kinds:
            raise ValueError(f"unknown field {k}")
        if not isinstance(v, kinds[k]) or isinstance(v, bool):
            raise ValueError(f"{k} must be of type {kinds[k].__name__}")
    if "query" not in given:
        raise ValueError("query is missing")
    return Request(**given)


def answer(message: dict, search: Callable[[Request], str]) -> dict | None:
    """The response to one message; None for notifications."""
    number, method = message.get("id"), message.get("method")
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    params = message.get("params") or {}
    if method == "initialize":
        version = params.get("protocolVersion") or PROTOCOL
        info = {"name": "corvine", "version": __version__}
        return reply | {"result": {"protocolVersion": version, "capabilities": {"tools": {}}, "serverInfo": info, "instructions": INSTRUCTIONS}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [TOOL]}}
    if method == "tools/call":
        if params.get("name") != TOOL["name"]:
            return reply | {"error": {"code": -32602, "message": f"unknown tool {params.get('name')}"}}
        try:
            request = request_of(params.get("arguments") or {})
        except (TypeError, ValueError) as e:
            return reply | {"error": {"code": -32602, "message": str(e)}}
        try:
            text, failed = search(request), False
        except Exception as e:  # a failed search is a result that says so; the service goes on
            text, failed = f"{type(e).__name__}: {e}"[:2000], True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(search: Callable[[Request], str], source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answers messages until the source ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = answer(message, search) if isinstance(message, dict) else _bad(-32600, "a message must be an object")
        except json.JSONDecodeError as e:
            reply = _bad(-32700, str(e))
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=sink, flush=True)


def _bad(code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": None, "error": {"code": code, "message": text}}
