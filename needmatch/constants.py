"""Defaults and lookup tables that results depend on."""

# ---- Fixed values: matching and search defaults
SIMILARITY_THRESHOLD = 0.5
MATCHER_THRESHOLD = 0.35
MAX_MATCHES = 10
CANDIDATE_FACTOR = 2
REFILTER_FACTOR = 3
QUERY_TOP_K = 5
CONTEXT_BUDGET_TOKENS = 51200
BM25_THRESHOLD = 5.0
VECTOR_THRESHOLD = 0.7
BM25_K1 = 1.2
BM25_B = 0.75
BM25_FIELD_BOOSTS = {"content": 3.0, "metadata": 1.0}
RRF_K = 60
RRF_VECTOR_BOOST = 1.0
EMBEDDING_DIM = 384
EMBEDDING_CACHE_TTL_SECONDS = 3600
EMBEDDING_TEXT_CHARS = 500
PREVIEW_CHARS = 200

# ---- Fixed values: log, retention, audit
EVENTS_PAGE = 100
EVENT_TTL_DAYS = 30
INACTIVE_AGENT_DAYS = 7
MAX_EVENTS_PER_PROJECT = 10000
AUDIT_RETENTION_DAYS = 90
AUDIT_QUERY_LIMIT = 100
SNAPSHOTS_KEPT = 10
EXPORT_VERSION = "1.0"

# ---- Fixed values: rate limits per minute, by first matching path prefix
RATE_WINDOW_SECONDS = 60
RATE_PREFIXES = [
    ("/api/publish", 100),
    ("/api/register", 50),
    ("/api/query", 200),
    ("/auth/", 20),
    ("/admin/", 20),
]
RATE_DEFAULT = 60
RATE_EXEMPT_PATHS = ["/health", "/", "/docs", "/openapi.json", "/redoc"]

# ---- Fixed values: circuit breaker
BREAKER_FAILURES = 5
BREAKER_SUCCESSES = 2
BREAKER_TIMEOUT_SECONDS = 60
BREAKER_STATE_CODES = {"closed": 0, "half_open": 1, "open": 2}

# ---- Fixed values: delivery retries
RETRY_CAP_SECONDS = 60
DISPATCH_RETRY_CAP_SECONDS = 30
DISPATCH_JITTER = 0.25

# ---- Fixed values: plan quotas
QUOTA_COLUMNS = [
    "max_projects", "max_agents_per_project", "max_api_keys", "max_events_per_month",
    "max_storage_mb", "max_requests_per_minute", "webhook_enabled",
]
PLAN_QUOTAS = {
    "free": (1, 5, 2, 1000, 10, 30, False),
    "starter": (3, 10, 5, 10000, 100, 100, True),
    "pro": (10, 50, 20, 100000, 1000, 500, True),
    "enterprise": (100, 500, 100, 1000000, 10000, 2000, True),
}
DEFAULT_QUOTAS = (3, 10, 5, 10000, 100, 100, True)
QUOTA_RESOURCES = ["projects", "agents", "api_keys", "events", "storage"]

# ---- Fixed values: roles and their permissions
DEFAULT_ROLE = "readonly"
ROLE_PERMISSIONS = {
    "admin": [
        "publish_data", "query_data", "register_agent", "list_agents", "delete_agent",
        "create_api_key", "list_api_keys", "revoke_api_key", "manage_roles",
        "view_rate_limits", "view_project_data", "view_project_events", "system_cleanup",
    ],
    "publisher": ["publish_data", "view_project_data", "view_project_events"],
    "consumer": [
        "register_agent", "list_agents", "delete_agent", "query_data",
        "view_project_data", "view_project_events",
    ],
    "readonly": ["query_data", "view_project_data", "view_project_events", "list_agents"],
}

# ---- Fixed values: permission rules in order (method or None for any, path pattern, permission)
PERMISSION_RULES = [
    ("GET", "/api/agents", "list_agents"),
    ("DELETE", "/api/agents/*", "delete_agent"),
    ("POST", "/api/auth/keys", "create_api_key"),
    ("GET", "/api/auth/keys", "list_api_keys"),
    ("DELETE", "/api/auth/keys/*", "revoke_api_key"),
    (None, "/api/data/publish", "publish_data"),
    (None, "/api/publish", "publish_data"),
    (None, "/api/agents/register", "register_agent"),
    (None, "/api/register", "register_agent"),
    (None, "/api/agents", "list_agents"),
    (None, "/api/query", "query_data"),
    (None, "/api/projects/*/query", "query_data"),
    (None, "/api/projects/*/data", "view_project_data"),
    (None, "/api/projects/*/events", "view_project_events"),
    (None, "/api/auth/keys", "create_api_key"),
    (None, "/api/admin/rate-limits", "view_rate_limits"),
    (None, "/api/admin/cleanup", "system_cleanup"),
    (None, "/api/admin/cleanup/*", "system_cleanup"),
    (None, "/api/admin/retention/*", "system_cleanup"),
]
API_KEY_PREFIX = "ck_"
SERVICE_KEY_PREFIX = "sak_"

# ---- Fixed values: audit domains
AUDIT_SEVERITIES = ["info", "warning", "error", "critical"]
AUDIT_RESULTS = ["success", "failure", "partial"]

# ---- Fixed values: webhook event catalogue (type, category, description)
EVENT_CATALOG = [
    ("data.published", "data", "Data was published to a project"),
    ("data.updated", "data", "Existing data was updated"),
    ("data.deleted", "data", "Data was deleted from a project"),
    ("data.version.created", "data", "New version of data was created"),
    ("data.version.restored", "data", "Previous version of data was restored"),
    ("agent.registered", "agent", "Agent registered with the system"),
    ("agent.unregistered", "agent", "Agent was unregistered"),
    ("agent.subscribed", "agent", "Agent subscribed to data needs"),
    ("agent.unsubscribed", "agent", "Agent unsubscribed from data needs"),
    ("context.queried", "context", "Context was queried"),
    ("context.matched", "context", "Context was matched to agent needs"),
    ("project.created", "project", "New project was created"),
    ("project.exported", "project", "Project data was exported"),
    ("project.imported", "project", "Project data was imported"),
    ("project.deleted", "project", "Project was deleted"),
    ("security.api_key.created", "security", "New API key was created"),
    ("security.api_key.revoked", "security", "API key was revoked"),
    ("security.auth.failed", "security", "Authentication attempt failed"),
    ("security.rate_limited", "security", "Request was rate limited"),
    ("security.permission_denied", "security", "Permission was denied for an operation"),
    ("service_account.created", "service_account", "Service account was created"),
    ("service_account.key_rotated", "service_account", "Service account key was rotated"),
    ("service_account.deleted", "service_account", "Service account was deleted"),
    ("tenant.created", "tenant", "New tenant was created"),
    ("tenant.updated", "tenant", "Tenant settings were updated"),
    ("tenant.suspended", "tenant", "Tenant was suspended"),
    ("tenant.quota.warning", "tenant", "Tenant approaching quota limit"),
    ("tenant.quota.exceeded", "tenant", "Tenant exceeded quota"),
    ("system.health.changed", "system", "System health status changed"),
    ("system.degraded", "system", "System entered degraded mode"),
    ("system.recovered", "system", "System recovered from degraded mode"),
]

# ---- Fixed values: metrics
HISTOGRAM_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
# durations of HTTP requests have one bucket more
HTTP_BOUNDS = [*HISTOGRAM_BOUNDS, 10.0]
ID_SEGMENT_PREFIXES = ["proj-", "agent-", "user-", "key-", "req-", "sess-"]
ALERT_GRID_SECONDS = 30
RATE_RANGE_SECONDS = 300
SENSITIVE_HEADERS = ["authorization", "x-api-key", "cookie", "x-forwarded-for"]
TRANSIENT_ERRORS = ["ConnectionResetError", "BrokenPipeError"]
HEALTH_PATHS = ["/health", "/metrics", "/ready", "/live"]
# component -> (measure, degraded above)
HEALTH_LIMITS = {
    "postgresql": ("latency_ms", 100.0),
    "redis": ("latency_ms", 100.0),
    "embedding_model": ("latency_ms", 1000.0),
    "memory": ("mb", 2048.0),
    "cpu": ("percent", 80.0),
}
READINESS_COMPONENTS = ["postgresql", "redis", "embedding_model"]
# alert -> (series, comparison, threshold, hold seconds, severity)
ALERT_RULES = {
    "HighErrorRate": ("error_ratio", ">", 0.05, 300, "warning"),
    "HighLatency": ("request_p95", ">", 1.0, 300, "warning"),
    "CriticalLatency": ("request_p95", ">", 5.0, 120, "critical"),
    "FrequentRateLimits": ("rate_limited_per_s", ">", 10.0, 300, "info"),
    "NoActiveAgents": ("registered_agents", "==", 0.0, 600, "warning"),
    "HighAuthFailureRate": ("auth_failure_ratio", ">", 0.1, 300, "warning"),
    "RBACDenialsSpike": ("rbac_denials_per_s", ">", 5.0, 300, "info"),
    "SlowPublishOperations": ("publish_p95", ">", 2.0, 300, "warning"),
    "SlowQueryOperations": ("query_p95", ">", 1.0, 300, "warning"),
    "HighMemoryUsage": ("memory_bytes", ">", 2147483648.0, 300, "warning"),
    "ServiceDown": ("up", "==", 0.0, 60, "critical"),
}
# metric -> (bad when, warning, critical)
SLO_THRESHOLDS = {
    "error_rate": (">", 0.001, 0.01),
    "p99_latency_ms": (">", 500.0, 2000.0),
    "cpu_percent": (">", 70.0, 90.0),
    "memory_percent": (">", 70.0, 90.0),
    "db_connections_percent": (">", 80.0, 95.0),
    "cache_hit_rate": ("<", 0.7, 0.5),
}

# ---- Fixed values: format detection patterns
FORMAT_PRIORITY = {
    "json": 0, "yaml": 1, "toml": 2, "xml": 10, "csv": 11, "markdown": 20, "code": 21, "text": 100,
}
FORMAT_HINTS = {
    "json": ["json"],
    "yaml": ["yaml"],
    "toml": ["toml"],
    "xml": ["xml"],
    "csv": ["csv", "tsv"],
    "markdown": ["markdown", "md"],
    "code": ["code", "python", "py", "javascript", "js", "typescript", "ts"],
    "text": ["text"],
}
PROSE_PATTERNS = [
    r"(?i)\b(the|a|an|we|they|this|that|these|those)\b",
    r"(?i)\b(discussed|decided|should|would|could|will)\b",
]
YAML_PATTERNS = [r"(?m)^\s*[\w-]+:\s*\S", r"(?m)^\s*-\s+[\w-]+:", r"(?m)^\s*[\w-]+:\s*$"]
CSV_REJECT_PATTERNS = [
    r"(?m)^\s*(def|class|import|from|function|const|let|var)\s+",
    r"(?m)^\s*#include",
    r"(?m)^\s*package\s+",
    r"(?m)^#{1,6}\s",
    r"(?m)^\s{2,}\w+:\s",
]
MARKDOWN_PATTERNS = [
    r"(?m)^#{1,6}\s", r"(?m)^\*\*[^*]+\*\*", r"(?m)^\*[^*]+\*", r"(?m)^\[.+\]\(.+\)",
    r"(?m)^```", r"(?m)^-\s", r"(?m)^\d+\.\s",
]
CODE_PATTERNS = [
    r"(?m)^\s*(def|class|function|const|let|var|import|from)\s",
    r"(?m)^\s*@\w+",
    r"=>\s*\{",
    r"(?m)^\s*(public|private|protected)\s",
]
PYTHON_MARKS = ["def ", "class ", "import ", "from ", "elif ", "pass"]
JS_MARKS = ["function ", "const ", "let ", "var ", "=>", "interface ", "type "]
BOOL_WORDS = ["true", "false", "yes", "no", "1", "0", "t", "f", "y", "n"]
TRUE_WORDS = ["true", "yes", "1", "t", "y"]
CSV_SAMPLE_ROWS = 100
CSV_CONSISTENT_SHARE = 0.7
RESERVED_FIELDS = ["content", "content_type", "structure", "schema", "records"]
EMBEDDING_DROPPED_FIELDS = ["content_type", "structure", "schema"]
MAX_FIELD_DEPTH = 5
DESCRIPTION_FIELDS = 20
MD_HEADING = r"^(#{1,6})\s+(.+)$"
MD_LINK = r"\[([^\]]+)\]\(([^\)]+)\)"
MD_FENCE = r"(?s)```(\w*)\n(.*?)\n```"
MD_NODE_FENCE = r"(?s)```(\w*)\n(.*?)```"
MD_BULLET = r"(?m)^\s*[-*+]\s"
MD_ORDERED = r"(?m)^\s*\d+\.\s"
MD_TITLE_CHARS = 100
MD_SUMMARY_CHARS = 200
PY_FUNCTION = r"(?m)^\s*def\s+(\w+)\s*\((.*?)\)(?:\s*->\s*([^:]+))?:"
PY_CLASS = r"(?m)^\s*class\s+(\w+)(?:\(([^)]*)\))?:"
PY_IMPORT = r"(?m)^\s*import\s+(.+)$"
PY_FROM = r"(?m)^\s*from\s+(\S+)\s+import"
PY_DECORATOR = r"(?m)^\s*@(\w+(?:\.\w+)*)"
JS_FUNCTION = r"function\s+(\w+)\s*\((.*?)\)"
JS_ARROW = r"(?:const|let|var)\s+(\w+)\s*=\s*(?:\([^)]*\)|[^=])*\s*=>"
JS_CLASS = r"class\s+(\w+)(?:\s+extends\s+(\w+))?"
JS_IMPORT = r"import\s+.*?from\s+[\"']([^\"']+)[\"']"
JS_REQUIRE = r"require\([\"']([^\"']+)[\"']\)"
JS_EXPORT = r"export\s+(?:const|let|var|function|class)\s+(\w+)"
COMMENT_MARKS = ["#", "//", "/*", "*"]
SENTENCE_END = r"[.!?]+\s+"
