"""The tools and resources over JSON-RPC on standard input and output, a line for each message (Q-SERVE)."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import functions as F

from . import __version__
from .errors import WeftError, log
from .plans import queries as q
from .plans.index import build_index
from .sources.tree import rooted, scan

PROTOCOL = "2024-11-05"
_text = lambda most, what: {"type": "string", "maxLength": most, "description": what}


def _tool(name: str, what: str, properties: dict, required: list[str]) -> dict:
    return {"name": name, "description": what, "inputSchema": {"type": "object", "properties": properties, "required": required}}


TOOLS = [
    _tool("map", "Ranked map of the code base", {"query": _text(q.MOST_QUERY, "File to rank for"), "budget": {"type": "integer", "minimum": 1, "maximum": q.MOST_BUDGET, "description": "Most tokens (default 2048)"}}, []),
    _tool("context", "A file's definitions, dependencies and dependents", {"path": _text(q.MOST_PATH, "File path relative to the root")}, ["path"]),
    _tool("search", "Definitions by name", {"query": _text(q.MOST_QUERY, "Part of the name"), "kind": _text(q.MOST_KIND, "Kind, such as function or class")}, ["query"]),
    _tool("impact", "Files that depend on a file, directly or not", {"path": _text(q.MOST_PATH, "File path relative to the root")}, ["path"]),
    _tool("summary", "Counts, key files and packages", {}, []),
]


class InvalidParams(ValueError):
    pass


def validate(name: str, given: dict) -> None:
    schema = next((t["inputSchema"] for t in TOOLS if t["name"] == name), None)
    if schema is None:
        raise InvalidParams(f"Unknown tool: {name}")
    for key in schema["required"]:
        if key not in given:
            raise InvalidParams(f"Missing argument: {key}")
    for key, value in given.items():
        rule = schema["properties"].get(key)
        if rule and rule["type"] == "string" and not (isinstance(value, str) and len(value) <= rule["maxLength"]):
            raise InvalidParams(f"Invalid argument: {key}")
        if rule and rule["type"] == "integer" and not (isinstance(value, int) and not isinstance(value, bool) and rule["minimum"] <= value <= rule["maximum"]):
            raise InvalidParams(f"Invalid argument: {key}")


def tree_print(spark, root: str) -> tuple:
    """A number of files and a sum over their fingerprints: what a change of any file changes."""
    mark = F.xxhash64("relative", "size", "mtime_ms") % 1_000_000_007
    return tuple(scan(spark, root).agg(F.count(F.lit(1)), F.sum(mark)).first())


class Server:
    def __init__(self, spark, root: str, index: Callable = build_index):
        self.spark, self.root, self.make = spark, rooted(root), index
        self.seen, self.kept = None, {}

    def build(self, spark, root: str, focus: str | None = None):
        """The index for a focus; as long as the tree stays as it is, the one made before with the scores it has by now."""
        now = tree_print(spark, root)
        if now != self.seen:
            self.seen, self.kept = now, {}
        if focus not in self.kept:
            self.kept[focus] = self.make(spark, root, focus)
        return self.kept[focus]

    def call(self, name: str, given: dict) -> dict:
        """The content of a tool's answer."""
        validate(name, given)
        path = given.get("path", given.get("query") if name == "map" else None)
        if path is not None and name in ("map", "context", "impact"):
            path = q.inside(self.root, path)
            if path is None:
                return {"content": [{"type": "text", "text": q.OUTSIDE}], "isError": True}
        index = self.build(self.spark, self.root, path if name == "map" else None)
        if name == "map":
            text = q.map_text(index, given.get("budget", q.BUDGET))
        elif name == "context":
            text = q.file_text(index, path)
        elif name == "search":
            text = q.search_text(index, given["query"], given.get("kind"))
        elif name == "impact":
            text = q.impact_text(index, path)
        else:
            text = q.summary_text(index)
        return {"content": [{"type": "text", "text": text}]}

    def resource(self, uri: str) -> dict:
        if uri == "weftmap://map":
            text = q.map_text(self.build(self.spark, self.root), q.RESOURCE_BUDGET)
        elif uri.startswith("weftmap://file/"):
            path = q.inside(self.root, unquote(uri.removeprefix("weftmap://file/")))
            text = q.OUTSIDE if path is None else q.file_text(self.build(self.spark, self.root), path)
        else:
            raise InvalidParams(f"Unknown resource: {uri}")
        return {"contents": [{"uri": uri, "text": text, "mimeType": "text/plain"}]}

    def answer(self, message: dict) -> dict | None:
        """The reply to a message; None for a notification. No request ends the server: a tool's failure is its answer, any other an error."""
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return _error(message.get("id") if isinstance(message, dict) else None, -32600, "Invalid request")
        method, params = message["method"], message.get("params") or {}
        if "id" not in message:
            return None
        try:
            if not isinstance(params, dict):
                raise InvalidParams("params must be an object")
            if method == "initialize":
                result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "weftmap", "version": __version__}}
            elif method == "ping":
                result = {}
            elif method == "tools/list":
                result = {"tools": TOOLS}
            elif method == "tools/call":
                result = self.tool(params.get("name", ""), params.get("arguments") or {})
            elif method == "resources/list":
                result = {"resources": [{"uri": "weftmap://map", "name": "map", "description": "Full ranked map"}]}
            elif method == "resources/templates/list":
                result = {"resourceTemplates": [{"uriTemplate": "weftmap://file/{path}", "name": "file", "description": "A file with its dependencies"}]}
            elif method == "resources/read":
                result = self.resource(str(params.get("uri", "")))
            else:
                return _error(message["id"], -32601, f"Unknown method: {method}")
        except InvalidParams as e:
            return _error(message["id"], -32602, str(e))
        except WeftError as e:
            return _error(message["id"], -32603, e.message)
        except Exception as e:  # a Spark or system failure of one request
            log("error", "request failed", {"method": method, "error": type(e).__name__})
            return _error(message["id"], -32603, _first_line(e))
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}

    def tool(self, name: str, given: dict) -> dict:
        """A tool's answer, its failure included."""
        if not isinstance(given, dict):
            raise InvalidParams("arguments must be an object")
        try:
            return self.call(name, given)
        except InvalidParams:
            raise
        except WeftError as e:
            text = f"Error: {e.message}\nHint: {e.hint}"
        except Exception as e:
            log("error", "tool failed", {"tool": name, "error": type(e).__name__})
            text = f"Error: {_first_line(e)}"
        return {"content": [{"type": "text", "text": text}], "isError": True}


def _first_line(e: Exception) -> str:
    return (str(e).strip().splitlines() or [type(e).__name__])[0]


def _error(request, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": request, "error": {"code": code, "message": message}}


def serve(spark, root: str, lines, out) -> None:
    server = Server(spark, root)
    log("info", "serving", {"root": server.root})
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply = _error(None, -32700, "Parse error")
        else:
            reply = server.answer(message)
        if reply is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()
