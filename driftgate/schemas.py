"""Table schemas and the fixed values the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

from driftgate import __version__

# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being reproduced; they are listed
# plainly, in their natural order, and are not derived from anything.
# ---------------------------------------------------------------------------

# Confidence classes, lowest to highest rank (rank = position in this list).
CONFIDENCE_ORDER = [
    "unavailable",
    "stale",
    "conflicting",
    "single-source",
    "multi-source-verified",
    "official-verified",
]
# Classes that make a diff "blocking eligible".
BLOCKING_CONFIDENCES = ["official-verified", "multi-source-verified"]

PROVIDERS = ["openai", "anthropic", "google", "xai", "unknown"]
LIFECYCLE_STATES = ["active", "deprecated", "retired", "unknown"]

# Source ids and the order in which sources are merged (first source first).
SOURCE_CATALOG = "models.dev"
SOURCE_FEED = "deprecations.info"
SOURCE_OFFICIAL = "official-provider"
SOURCE_ORDER = [SOURCE_CATALOG, SOURCE_FEED, SOURCE_OFFICIAL]
SOURCE_URLS = {
    SOURCE_CATALOG: "https://models.dev/api.json",
    SOURCE_FEED: "https://deprecations.info/v1/feed.json",
    SOURCE_OFFICIAL: "file:data/official/providers.json",
}
PARSER_VERSION = "1.0.0"
PARSER_VERSIONS = {
    SOURCE_CATALOG: "1.0.0+models-dev.1",
    SOURCE_FEED: "1.0.0+deprecations.1",
    SOURCE_OFFICIAL: "1.0.0+official.1",
}
GENERATOR_VERSION = __version__
SCHEMA_VERSION = 1

# Fact fields of a record, in record/diff order, with the typed value column each uses.
FACT_FIELDS = [
    ("provider", "str"),
    ("requestedModelId", "str"),
    ("identifierKind", "str"),
    ("lifecycleStatus", "str"),
    ("retirementDate", "str"),
    ("inputPricePerMillion", "num"),
    ("outputPricePerMillion", "num"),
    ("contextLimit", "num"),
    ("maxOutputLimit", "num"),
    ("toolCalling", "bool"),
    ("structuredOutput", "bool"),
    ("vision", "bool"),
]
# The ten fields that are reconciled across sources (identity facts are not).
MATERIAL_FIELDS = FACT_FIELDS[2:]
# Observation column carrying each material field.
FIELD_COLUMNS = {
    "identifierKind": "identifier_kind",
    "lifecycleStatus": "lifecycle_status",
    "retirementDate": "retirement_date",
    "inputPricePerMillion": "input_price",
    "outputPricePerMillion": "output_price",
    "contextLimit": "context_limit",
    "maxOutputLimit": "max_output_limit",
    "toolCalling": "tool_calling",
    "structuredOutput": "structured_output",
    "vision": "vision",
}

# Model ids that are moving aliases.
FLOATING_ALIASES = [
    "gpt-4", "gpt-4o", "gpt-4.1", "gpt-5", "gpt-3.5-turbo", "o1", "o3", "o4-mini",
    "claude-3-opus-latest", "claude-3-sonnet-latest", "claude-3-haiku-latest",
    "claude-sonnet-4-0", "claude-opus-4-0", "claude-haiku-4-0",
    "gemini-pro", "gemini-1.5-pro", "gemini-1.5-flash", "gemini-2.0-flash",
    "gemini-2.5-pro", "gemini-2.5-flash",
    "grok-2", "grok-3", "grok-4", "latest",
]
# Pattern a model id must match (case-insensitive) when it is not a known alias.
MODEL_ID_PATTERN = (
    r"^(gpt-[a-z0-9.-]+|o[1-9](-[a-z0-9.-]+)?|claude-[a-z0-9.-]+|gemini-[a-z0-9.-]+"
    r"|grok-[a-z0-9.-]+|text-embedding-[a-z0-9.-]+)$"
)

# SDK package -> provider, for import aliases in JS/TS.
PROVIDER_PACKAGES = [
    ("openai", "openai"),
    ("@openai/openai", "openai"),
    ("@ai-sdk/openai", "openai"),
    ("@anthropic-ai/sdk", "anthropic"),
    ("@ai-sdk/anthropic", "anthropic"),
    ("anthropic", "anthropic"),
    ("@google/generative-ai", "google"),
    ("@ai-sdk/google", "google"),
    ("@google/genai", "google"),
    ("@xai-org/xai", "xai"),
    ("@ai-sdk/xai", "xai"),
    ("xai", "xai"),
]
# Environment keys that name a model, and the provider they imply.
ENV_MODEL_KEYS = [
    ("OPENAI_MODEL", "openai"),
    ("OPENAI_API_MODEL", "openai"),
    ("ANTHROPIC_MODEL", "anthropic"),
    ("CLAUDE_MODEL", "anthropic"),
    ("GOOGLE_MODEL", "google"),
    ("GEMINI_MODEL", "google"),
    ("GOOGLE_GENAI_MODEL", "google"),
    ("XAI_MODEL", "xai"),
    ("GROK_MODEL", "xai"),
]
# Directory names never scanned (any directory starting with "." is skipped too).
SKIP_DIR_NAMES = [
    "node_modules", ".git", "dist", "build", ".venv", "venv", "__pycache__", "coverage",
    ".next", ".turbo", "vendor", ".tox", ".mypy_cache",
]
CODE_EXTS = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts"]
PYTHON_EXTS = [".py"]
DATA_EXTS = [".json", ".yaml", ".yml"]
DEFAULT_IGNORE_GLOBS = [
    "**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/.venv/**",
    "**/venv/**", "**/__pycache__/**", "**/coverage/**", "**/*.min.js", "**/*.min.css",
]

# Python call-site patterns, applied per line in this order (first match per pattern).
PYTHON_MODEL_PATTERNS = [
    r"\bmodel\s*=\s*[\"']([^\"']+)[\"']",
    r"\bmodel_id\s*=\s*[\"']([^\"']+)[\"']",
    r"[\"']model[\"']\s*:\s*[\"']([^\"']+)[\"']",
    r"\.messages\.create\([^)]*model\s*=\s*[\"']([^\"']+)[\"']",
    r"\.chat\.completions\.create\([^)]*model\s*=\s*[\"']([^\"']+)[\"']",
]
# Python import hints, in the order they are pushed for one line (last pushed wins).
PYTHON_PROVIDER_HINTS = [
    ("openai", r"from\s+openai|import\s+openai"),
    ("anthropic", r"from\s+anthropic|import\s+anthropic"),
    ("google", r"google\.generativeai|from\s+google|import\s+google\.genai"),
    ("xai", r"(?i)from\s+xai|import\s+xai|openai\.OpenAI\(.*xai"),
]

# Secret patterns (first five case-sensitive except the Bearer one).
SECRET_PATTERNS = [
    r"sk-[A-Za-z0-9_-]{20,}",
    r"sk-ant-[A-Za-z0-9_-]{20,}",
    r"xai-[A-Za-z0-9_-]{20,}",
    r"AIza[A-Za-z0-9_-]{20,}",
    r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]{20,}",
    r"(?i)api[_-]?key\s*[:=]\s*['\"][^'\"]+['\"]",
]
# Key names whose whole value is redacted.
SECRET_KEY_PATTERN = r"(?i)secret|password|token|apikey|api_key|authorization"
REDACTED = "[REDACTED]"

# Hosts allowed for metadata fetches (https only).
ALLOWED_FETCH_HOSTS = ["models.dev", "www.models.dev", "deprecations.info", "www.deprecations.info"]

# Policy defaults (one row per scope overrides any of them).
POLICY_DEFAULTS = {
    "floating_aliases": "warn",
    "retirement_window_days": 90,
    "max_input_price_increase_percent": 15.0,
    "max_output_price_increase_percent": 15.0,
    "fail_on_context_decrease": True,
    "fail_on_max_output_decrease": True,
    "fail_on_tool_calling_removal": True,
    "fail_on_structured_output_removal": True,
    "fail_on_vision_removal": False,
    "stale_source_behavior": "warn",
    "min_blocking_confidence": "official-verified",
    "allow_network": False,
    "stale_after_days": 7,
    "timeout_ms": 10000,
    "max_bytes": 8 * 1024 * 1024,
}
DEFAULT_FREEZE_MESSAGE = "Registry sources degraded; using last-known-good data"
LOW_CONFIDENCE_THRESHOLD = 0.6
ACCEPT_ANY_ID_CONFIDENCE = 0.8

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

# One normalized observation: what one source says about one entity at one fetch.
OBSERVATION = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("entity_key", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("source_ord", T.IntegerType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("source_digest", T.StringType()),
    T.StructField("parser_version", T.StringType()),
    T.StructField("lifecycle_status", T.StringType()),
    T.StructField("retirement_date", T.StringType()),
    T.StructField("input_price", T.DoubleType()),
    T.StructField("output_price", T.DoubleType()),
    T.StructField("context_limit", T.LongType()),
    T.StructField("max_output_limit", T.LongType()),
    T.StructField("tool_calling", T.BooleanType()),
    T.StructField("structured_output", T.BooleanType()),
    T.StructField("vision", T.BooleanType()),
    T.StructField("identifier_kind", T.StringType()),
])

CANDIDATE = T.StructType([
    T.StructField("source_ord", T.IntegerType()),
    T.StructField("str_value", T.StringType()),
    T.StructField("num_value", T.DoubleType()),
    T.StructField("bool_value", T.BooleanType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("source_digest", T.StringType()),
    T.StructField("parser_version", T.StringType()),
])

# One fact envelope (value columns, confidence, primary source, conflict candidates).
ENVELOPE = T.StructType([
    T.StructField("str_value", T.StringType()), T.StructField("num_value", T.DoubleType()),
    T.StructField("bool_value", T.BooleanType()), T.StructField("confidence", T.StringType()),
    T.StructField("source_id", T.StringType()), T.StructField("source_url", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()), T.StructField("source_digest", T.StringType()),
    T.StructField("parser_version", T.StringType()), T.StructField("candidates", T.ArrayType(CANDIDATE)),
])
FACTS = T.StructType([T.StructField(n, ENVELOPE) for n, _ in FACT_FIELDS])
EVIDENCE = T.StructType([
    T.StructField("source_ord", T.IntegerType()), T.StructField("source_id", T.StringType()),
    T.StructField("source_url", T.StringType()), T.StructField("fetched_at", T.TimestampType()),
    T.StructField("source_digest", T.StringType()), T.StructField("parser_version", T.StringType()),
    T.StructField("content_digest", T.StringType()),
])
# Wide snapshot record (storage form): one row per entity.
SNAPSHOT = T.StructType([
    T.StructField("entity_key", T.StringType()), T.StructField("provider", T.StringType()),
    T.StructField("model_id", T.StringType()), T.StructField("facts", FACTS),
    T.StructField("evidence", T.ArrayType(EVIDENCE)),
])
