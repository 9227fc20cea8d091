"""The capabilities as a service: JSON-RPC messages of the model context protocol, HTTP, and a command line.

    python -m quirelake.service count_papers --data /data --args '{"group_by": "area"}'
    python -m quirelake.service --serve 8000 --data /data
"""

from __future__ import annotations

import argparse
import inspect
import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quirelake.plans import capabilities, searches

ABOUT_RECALL = "candidates of a topic with their distributions"


def answer(spark: SparkSession, d: str, name: str, arguments: dict | None = None) -> dict:
    """The answer to a request as {ok, data, meta} or {ok, error}; it never raises."""
    if name != "recall_topic":
        return capabilities.call(spark, d, name, arguments)
    try:
        got = searches.recall_topic(spark, d, **(arguments or {}))
        data = {k: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in got.items()}
    except Exception as e:
        return {"ok": False, "error": str(e)}
    return {"ok": True, "data": data, "meta": {"capability": name, "rows": len(data["items"])}}


def tools() -> list[dict[str, Any]]:
    """Name, description and parameters of each capability."""
    every = [(c.name, c.about, c.run) for c in capabilities.CAPABILITIES.values()] + [("recall_topic", ABOUT_RECALL, searches.recall_topic)]
    out = []
    for name, about, run in every:
        p = {k: v for k, v in inspect.signature(run).parameters.items() if k not in ("spark", "d")}
        kinds = {k: "integer" if "int" in str(v.annotation) else "string" if "str" in str(v.annotation) and "dict" not in str(v.annotation) else "object" for k, v in p.items()}
        out.append({"name": name, "description": about, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in kinds.items()}, "required": [k for k, v in p.items() if v.default is inspect.Parameter.empty]}})
    return out


def handle(spark: SparkSession, d: str, message: dict) -> dict | None:
    """The reply to a JSON-RPC message; None to a notification."""
    method, params = message.get("method", ""), message.get("params") or {}
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quirelake", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": tools()}}
    if method == "tools/call":
        got = answer(spark, d, params.get("name", ""), params.get("arguments"))
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False, default=str)}], "isError": not got["ok"]}}
    return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}


def server(spark: SparkSession, d: str, port: int) -> ThreadingHTTPServer:
    """POST /api/cap/<name> with arguments as a JSON object, POST /mcp with a JSON-RPC message, GET /api/tools."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: Any) -> None:
            out = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def do_GET(self) -> None:
            self.reply(200, tools()) if self.path == "/api/tools" else self.reply(404, {"ok": False, "error": "not found"})

        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self.reply(400, {"ok": False, "error": "no JSON"})
            if self.path == "/mcp":
                return self.reply(200, handle(spark, d, body))
            if self.path.startswith("/api/cap/"):
                got = answer(spark, d, self.path.removeprefix("/api/cap/"), body)
                return self.reply(200 if got["ok"] else 400, got)
            self.reply(404, {"ok": False, "error": "not found"})

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quirelake.service")
    p.add_argument("name", nargs="?")
    p.add_argument("--data", required=True)
    p.add_argument("--args", default="{}")
    p.add_argument("--serve", type=int)
    a = p.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.serve:
        server(spark, a.data, a.serve).serve_forever()
        return 0
    got = answer(spark, a.data, a.name or "", json.loads(a.args))
    print(json.dumps(got, ensure_ascii=False, default=str))
    return 0 if got["ok"] else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
