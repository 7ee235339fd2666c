"""Start-up: settings, session, engines. Explicit arguments come before environment variables, and these before defaults; what can't be built ends the program at once."""

from __future__ import annotations

import json
import os
import sys
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tessera.plans import service
from tessera.plans.warehouse import Warehouse
from tessera.sources import embedding


@dataclass(frozen=True)
class Settings:
    """Without a model server, texts are embedded by hashing, planning is by rules and an answer is its context."""

    warehouse: str = "tessera-warehouse"
    clones: str = ""
    master: str = ""
    host: str = "127.0.0.1"
    port: int = 8000
    models: str = ""
    embed_model: str = "nomic-embed-text"
    planner_model: str = "llama3.2:3b"
    synthesizer_model: str = "llama3"


#: Environment variables of the settings.
VARIABLES = {
    "warehouse": "TESSERA_WAREHOUSE", "clones": "TESSERA_CLONES", "master": "TESSERA_MASTER", "host": "TESSERA_HOST", "port": "TESSERA_PORT",
    "models": "OLLAMA_HOST", "embed_model": "EMBED_MODEL", "planner_model": "PLANNER_MODEL", "synthesizer_model": "SYNTHESIZER_MODEL",
}


def settings(environment: Mapping[str, str] | None = None, **given) -> Settings:
    """Settings from arguments, then the environment; ValueError for a port that is no number."""
    environment = os.environ if environment is None else environment
    found = {k: environment[v] for k, v in VARIABLES.items() if environment.get(v)}
    found |= {k: v for k, v in given.items() if v is not None}
    if "port" in found:
        found["port"] = int(found["port"])
    return Settings(**found)


def session(s: Settings) -> SparkSession:
    """A session with adaptive planning, in UTC; the cluster's own configuration says the rest."""
    builder = SparkSession.builder.appName("tessera").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    return (builder.master(s.master) if s.master else builder).getOrCreate()


class HttpModels:
    """Language models behind a server that takes ``{"model", "system", "prompt"}`` and answers ``{"response"}``: one for plans, one for the rest."""

    def __init__(self, url: str, planner: str, synthesizer: str, timeout: float = 300):
        self.url, self.planner, self.synthesizer, self.timeout = url.rstrip("/"), planner, synthesizer, timeout

    def complete(self, system: str, prompt: str, most_tokens: int) -> str:
        from tessera.plans.prompts import PLAN_SYSTEM

        model = self.planner if system == PLAN_SYSTEM else self.synthesizer
        body = {"model": model, "system": system, "prompt": prompt, "stream": False, "options": {"num_predict": most_tokens, "temperature": 0}}
        request = urllib.request.Request(f"{self.url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["response"]


def build(s: Settings, spark: SparkSession | None = None) -> service.Service:
    """The service with its engines, each built once. Any failure is raised here, before the first request."""
    house = Warehouse(spark or session(s), s.warehouse)
    house.projects()  # the warehouse must be readable
    embedder = embedding.HttpEmbedder(f"{s.models.rstrip('/')}/api/embed", s.embed_model) if s.models else embedding.HashEmbedder()
    return service.Service(house, embedder, HttpModels(s.models, s.planner_model, s.synthesizer_model) if s.models else None, s.clones)


def main(arguments: list[str], **given) -> int:
    """``serve`` or ``menu``; 1 where the engines can't be built."""
    mode = arguments[0] if arguments else "menu"
    if mode not in ("serve", "menu"):
        print("python -m tessera [menu | serve]", file=sys.stderr)
        return 2
    try:
        s = settings(**given)
        engines = build(s)
        api = service.app(engines) if mode == "serve" else None
    except Exception as e:
        print(f"start-up failed: {e}", file=sys.stderr)
        return 1
    if api is None:
        service.main(engines)
    else:
        import uvicorn

        uvicorn.run(api, host=s.host, port=s.port)
    return 0
