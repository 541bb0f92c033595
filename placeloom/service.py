"""The search and planning service: plain handlers, and a small HTTP server over them.

Each handler takes and returns dictionaries. The model client is injected; without one, or when
it fails, the answer is the deterministic record.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import modelout as M
from .operators import planning, retrieval

ITEM = "poi_id string, name string, category string, city string, tags array<string>, description string"
Ask = Callable[[dict], str]


def http_client(base_url: str, model: str, timeout: int = 60) -> Ask:
    """A client of an OpenAI-style chat endpoint."""

    def ask(payload: dict) -> str:
        request = urllib.request.Request(f"{base_url.rstrip('/')}/v1/chat/completions", json.dumps(payload | {"model": model}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.load(response)["choices"][0]["message"]["content"]

    return ask


class Service:
    def __init__(self, spark: SparkSession, catalog_path: str | None = None, ask: Ask | None = None, model: str | None = None) -> None:
        self.spark, self.ask = spark, ask
        self.model = model or os.getenv("VLLM_MODEL_NAME", "unset")
        there = catalog_path and Path(catalog_path).exists()
        rows = spark.read.schema(ITEM).option("mode", "FAILFAST").json(catalog_path) if there else spark.createDataFrame([], ITEM)
        ranked = rows.select("*", F.monotonically_increasing_id().alias("ord"))
        text = retrieval.item_text(F.col("name"), F.col("category"), F.col("description"), F.array_join("tags", " "))
        self.catalog = ranked.select(F.col("ord").alias("item_id"), "ord", text.alias("text"), *rows.columns).cache()

    def health(self, _: dict | None = None) -> dict:
        return {"status": "ok", "service": "placeloom", "model": self.model, "backend": "vLLM", "version": "0.1.0"}

    def image_understanding(self, request: dict) -> dict:
        urls, said = request.get("image_urls") or [], request.get("user_text")
        one = self.spark.createDataFrame([(urls, said, request.get("prompt_version"))], "image_urls array<string>, user_text string, version string")
        note = None
        if self.ask is not None:
            try:
                embedded = one.withColumn("image_urls", F.array(*[F.lit(M.embedded_image(u)) for u in urls]).cast("array<string>"))
                payload = embedded.select(M.chat_payload(F.lit(self.model), M.prompt(F.col("version")), F.col("user_text"), F.col("image_urls"))).first()[0]
                return M.normalised(self.ask(json.loads(payload)))
            except Exception as why:  # whatever goes wrong there, a request has an answer
                note = f"vLLM request failed; fallback used: {why}"
        answer = one.select(M.answer_without_model(F.col("image_urls"), F.col("user_text")).alias("a")).first().a
        return answer.asDict(recursive=True) | {"raw_model_output": note}

    def _search(self, query: str, k: int) -> list[dict]:
        asked = self.spark.createDataFrame([(0, query)], "query_id long, text string")
        found = retrieval.hybrid_search(asked, self.catalog, k).join(self.catalog.drop("text", "ord"), "item_id").orderBy("rank")
        return [{k: v for k, v in r.asDict().items() if k not in ("item_id", "query_id", "rank", "matched")} | {"matched_reasons": r.matched} for r in found.collect()]

    def visual_search(self, request: dict) -> dict:
        query = request.get("query_text") or ""
        info = self.image_understanding({"image_urls": request.get("image_urls"), "user_text": query})["structured_info"]
        terms = " ".join([query, info["merchant_type"] or "", info["scene"] or "", *info["style"]])
        return {"query_understanding": {"merchant_type": info["merchant_type"], "scene": info["scene"], "intent": query}, "results": self._search(terms, int(request.get("top_k", 5)))}

    def travel_planning(self, request: dict) -> dict:
        wishes = request.get("preferences") or {}
        found = self._search(" ".join([*(request.get("reviews") or []), *(wishes.get("interests") or [])]), 4)
        if not found:
            found = [r.asDict() for r in self.catalog.orderBy("ord").limit(2).collect()]
        stops = self.spark.createDataFrame([(0, i, r["name"], r["category"]) for i, r in enumerate(found)], "trip_id long, ord long, name string, category string")
        trip = self.spark.createDataFrame([(0, *[wishes.get(k) for k in planning.DEFAULTS], wishes.get("interests"))], "trip_id long, city string, duration string, budget string, pace string, interests array<string>")
        return {k: v for k, v in planning.itineraries(stops, trip).first().asDict(recursive=True).items() if k != "trip_id"}

    def routes(self) -> dict:
        return {("GET", "/health"): self.health, ("POST", "/v1/image-understanding"): self.image_understanding, ("POST", "/v1/visual-search"): self.visual_search, ("POST", "/v1/travel-planning"): self.travel_planning}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """An HTTP server over the handlers; call serve_forever on it."""
    routes = service.routes()

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            handler = routes.get((self.command, self.path))
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                code, out = (200, handler(body)) if handler else (404, {"detail": "Not Found"})
            except (ValueError, TypeError, AttributeError) as why:
                code, out = 422, {"detail": str(why)}
            data = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
