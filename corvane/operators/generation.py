"""Generators behind one interface: requests and replies as columns, transport on the driver."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.config import Settings

#: (method, url, headers, body) -> (status, text)
Transport = Callable[[str, str, dict, str | None], tuple[int, str]]


def http(method: str, url: str, headers: dict, body: str | None) -> tuple[int, str]:
    request = urllib.request.Request(url, None if body is None else body.encode(), headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=60) as reply:
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def ollama_request(model: Column, prompt: Column) -> Column:
    return F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"), F.lit(False).alias("stream")))


def chat_request(model: Column, prompt: Column) -> Column:
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(F.struct(model.alias("model"), F.array(message).alias("messages"), F.lit(0).alias("temperature")))


def ollama_reply(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.response"), F.lit(""))


def chat_reply(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.lit(""))


def ollama_models(body: Column) -> Column:
    return F.filter(F.transform(F.from_json(body, "models array<struct<name:string>>")["models"], lambda m: m["name"]), lambda n: n.isNotNull())


def chat_models(body: Column) -> Column:
    return F.filter(F.transform(F.from_json(body, "data array<struct<id:string>>")["data"], lambda m: m["id"]), lambda n: n.isNotNull())


@dataclass(frozen=True)
class Generator:
    """One prompt to one reply; never called from within a query."""

    backend: str
    url: str
    model: str
    key: str = ""
    transport: Transport = http

    def __call__(self, prompt: str) -> str:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        if self.backend == "ollama":
            status, text = self.transport("POST", f"{self.url.removesuffix('/')}/api/generate", headers, json.dumps({"model": self.model, "prompt": prompt, "stream": False}))
        else:
            # a hosted endpoint is given as the whole address
            url = self.url if self.backend == "hosted" else f"{self.url.removesuffix('/')}/chat/completions"
            status, text = self.transport("POST", url, headers, json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0}))
        if not 200 <= status < 300:
            raise RuntimeError(f"generation failed: {status}")
        data = json.loads(text)
        if self.backend == "ollama":
            return data.get("response") or ""
        return (((data.get("choices") or [{}])[0].get("message")) or {}).get("content") or ""

    def models(self) -> list[str]:
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        path, list_, name = ("/api/tags", "models", "name") if self.backend == "ollama" else ("/models", "data", "id")
        status, text = self.transport("GET", self.url.removesuffix("/") + path, headers, None)
        if not 200 <= status < 300:
            raise RuntimeError(f"listing models failed: {status}")
        return [m[name] for m in json.loads(text).get(list_, []) if isinstance(m.get(name), str)]


def generator(settings: Settings, transport: Transport = http) -> Generator | None:
    """None for the extractive backend."""
    s = settings
    return {"none": None, "ollama": Generator("ollama", s.ollama_endpoint, s.ollama_model, "", transport), "lmstudio": Generator("lmstudio", s.lmstudio_endpoint, s.lmstudio_model, "", transport), "hosted": Generator("hosted", s.hosted_endpoint, s.hosted_model, s.hosted_api_key, transport)}[s.backend]
