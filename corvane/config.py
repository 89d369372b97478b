"""Defaults of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

#: Fixed values that rankings and stored indexes depend on.
CHUNK_TOKENS = 512
CHUNK_OVERLAP = 64
MAX_CHUNK_TOKENS = 2048
MAX_ANN_THRESHOLD = 5_000_000
ALPHA = 0.6
ANN_THRESHOLD = 20_000
K1 = 1.2
B = 0.75
SIMILARITY_FLOOR = 0.35
CONTEXT_CHUNKS = 6
HISTORY_MESSAGES = 6
TOP_K = 20
SNIPPET_CHARS = 240
POOL_FACTOR = 5
MIN_POOL = 50
METRIC_CUTOFF = 10
DEBOUNCE_MS = 1500
HASH_DIM = 384
INDEX_VERSION = 3
MODES = ("semantic", "lexical", "hybrid")
BACKENDS = ("none", "ollama", "lmstudio", "hosted")


@dataclass(frozen=True)
class ModelInfo:
    dim: int
    query_instruction: str = ""
    similarity_floor: float = SIMILARITY_FLOOR


#: Embedders by id; neural ones take precomputed vectors, as their weights are not here.
MODELS = {
    "hashing-embedder-v1": ModelInfo(HASH_DIM),
    "Xenova/bge-small-en-v1.5": ModelInfo(384, "Represent this sentence for searching relevant passages: ", 0.5),
    "Xenova/all-MiniLM-L6-v2": ModelInfo(384, "", 0.3),
}


@dataclass(frozen=True)
class Settings:
    embedding_model: str = "hashing-embedder-v1"
    chunk_tokens: int = CHUNK_TOKENS
    chunk_overlap: int = CHUNK_OVERLAP
    alpha: float = ALPHA
    ann_threshold: int = ANN_THRESHOLD
    backend: str = "none"
    ollama_endpoint: str = "http://localhost:11434"
    ollama_model: str = "llama3.1:8b"
    lmstudio_endpoint: str = "http://localhost:1234/v1"
    lmstudio_model: str = ""
    hosted_endpoint: str = ""
    hosted_model: str = ""
    hosted_api_key: str = ""
    local_model_path: str = ""
    excluded_folders: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise ValueError(f"backend is one of {BACKENDS}")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha lies between 0 and 1")

    @classmethod
    def load(cls, saved: dict) -> Settings:
        """Defaults overlaid by what was saved; unknown keys are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if k == "excluded_folders" else v for k, v in saved.items() if k in known})

    @classmethod
    def parsed(cls, raw: dict[str, str]) -> Settings:
        """From text fields: numbers that do not parse keep the default, large ones are cut to the maximum."""

        def number(key: str, default: int, least: int, most: int) -> int:
            try:
                value = int(str(raw.get(key, "")).strip())
            except ValueError:
                return default
            return min(value, most) if value >= least else default

        def text(key: str, default: str) -> str:
            return str(raw.get(key, default)).strip()

        try:
            alpha = float(str(raw.get("alpha", ALPHA)).strip())
        except ValueError:
            alpha = ALPHA
        # what is no number keeps the default; the rest goes by the slider's steps
        alpha = ALPHA if alpha != alpha else round(round(min(1.0, max(0.0, alpha)) / 0.05) * 0.05, 2)
        backend = text("backend", "none")
        named = {key: text(key, default) for key, default in (("embedding_model", "hashing-embedder-v1"), ("ollama_endpoint", cls.ollama_endpoint), ("ollama_model", cls.ollama_model), ("lmstudio_endpoint", cls.lmstudio_endpoint), ("lmstudio_model", ""), ("hosted_endpoint", ""), ("hosted_model", ""), ("hosted_api_key", ""), ("local_model_path", ""))}
        folders = tuple(x.strip() for x in raw.get("excluded_folders", "").split(",") if x.strip())
        return cls(chunk_tokens=number("chunk_tokens", CHUNK_TOKENS, 1, MAX_CHUNK_TOKENS), chunk_overlap=number("chunk_overlap", CHUNK_OVERLAP, 0, MAX_CHUNK_TOKENS), ann_threshold=number("ann_threshold", ANN_THRESHOLD, 1, MAX_ANN_THRESHOLD), excluded_folders=folders, alpha=alpha, backend=backend if backend in BACKENDS else "none", **named)

    def saved(self) -> dict:
        """What ``load`` reads back."""
        return {f.name: list(v) if isinstance(v := getattr(self, f.name), tuple) else v for f in fields(self)}

    def generation_summary(self) -> str:
        """The active answer model, for people."""
        if self.backend == "none":
            return "Retrieval-only (offline, no model)"
        name, model = {"ollama": ("Ollama", self.ollama_model), "lmstudio": ("LM Studio", self.lmstudio_model), "hosted": ("Hosted", self.hosted_model)}[self.backend]
        return f"{name} · {model or 'no model set'}"

    def has_backend(self) -> bool:
        return {"none": False, "ollama": bool(self.ollama_endpoint and self.ollama_model), "lmstudio": bool(self.lmstudio_endpoint and self.lmstudio_model), "hosted": bool(self.hosted_endpoint and self.hosted_model)}[self.backend]
