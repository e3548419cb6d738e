"""Patterns, word lists and the rule table.

They define the results, so they are stated plainly and every operator takes
them as a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: ticket status codes (resolved, closed) -------------------
TERMINAL_STATUSES = (4, 5)

# --- fixed values: HTML entities, decoded in this order ---------------------
HTML_ENTITIES = (
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&#39;", "'"),
    ("&quot;", '"'),
)

# --- fixed values: secret and contact patterns ------------------------------
GUID = r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b"
SECRET_LABELS = (
    "password", "passwd", "pwd", r"recovery\s*key", r"api\s*key", "secret", "token",
    r"license\s*key",
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<!\d)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}(?!\d)"
KEY_MARK, SECRET_MARK, EMAIL_MARK, PHONE_MARK = (
    "<redacted-key>", "<redacted-secret>", "<email>", "<phone>",
)

# --- fixed values: error-code patterns (group 1 where there is one) ---------
ERROR_CODE_PATTERNS = (
    r"\b0x[0-9A-Fa-f]{4,8}\b",
    r"\b0[xX][0-9A-Fa-f]{3,}\b",
    r"(?i)\b(?:error|err|code|status)\s*[:#]?\s*(\d{3,6})\b",
    r"(?i)\bHTTP\s*(\d{3})\b",
)


def hostname_patterns(domains: tuple[str, ...] = ("local",)) -> tuple[str, ...]:
    """Host-name patterns; the last one takes the site's own DNS suffixes."""
    # fixed values: site code, lower-case desktop, UPS-named machine
    suffixes = "|".join(d.replace(".", r"\.") for d in domains)
    return (
        r"\b[A-Z]{2,}\d-[A-Za-z]{2,}[A-Za-z0-9-]*\b",
        r"\b[a-z0-9]{2,}-[a-z]{2,3}-[a-z]?-?\d{2,4}\b",
        r"\bUPS-[A-Za-z]+\d*\b",
        rf"(?i)\b[A-Za-z0-9-]+\.(?:{suffixes})\b",
    )


# --- fixed values: application dictionary, in output order ------------------
APP_DICTIONARY = (
    "outlook", "teams", "excel", "word", "onedrive", "sharepoint", "chrome",
    "edge", "firefox", "vpn", "anyconnect", "worldship", "horizon", "citrix",
    "ringcentral", "sentinelone", "sophos", "acrobat", "adobe", "java",
    "sage", "quickbooks", "engage", "epicor", "print", "printer", "scanner",
    "bitlocker", "onedrive", "exchange", "m365", "office", "windows",
)

# --- fixed values: words that never identify a system -----------------------
STOPWORDS = (
    "with", "from", "that", "this", "cannot", "issue", "issues", "other", "desktop",
    "account", "error", "errors", "change", "changes", "standard", "update", "updates",
    "service", "services", "store", "stores", "primary", "secondary", "emergency",
    "normal", "routine", "unknown",
)


@dataclass(frozen=True)
class Rule:
    key: str
    label: str
    phrases: tuple[str, ...] = field(default_factory=tuple)
    weight: int = 50


# --- fixed values: cluster rules --------------------------------------------
CLUSTER_RULES = (
    Rule("app:engage", "Engage", ("engage",), 90),
    Rule("app:outlook", "Outlook", ("outlook", "outlook web", "owa"), 70),
    Rule("app:teams", "Teams", ("microsoft teams", "ms teams", "teams"), 70),
    Rule("sys:onedrive", "OneDrive", ("onedrive", "one drive"), 60),
    Rule("vpn:connect", "VPN", ("vpn", "anyconnect", "globalprotect"), 80),
    Rule(
        "auth:login", "Login / lockout",
        (
            "cannot log in", "cannot login", "can t log in", "can t login",
            "can not log in", "can not login", "can t log on", "cannot log on",
            "locked out", "account locked", "password expired",
        ),
        50,
    ),
    Rule(
        "net:connectivity", "Network / connectivity",
        ("no signal", "no internet", "wifi", "wi fi", "wireless", "network down"), 40,
    ),
    Rule("print:printer", "Printer", ("printer", "print queue", "printing"), 40),
)


@dataclass(frozen=True)
class Metric:
    key: str
    metric: str
    flavour: str
    threshold: float | None = None


# --- fixed values: infrastructure metrics per cluster flavour ---------------
METRICS = (
    Metric("sql.lock_waits", "sqlserver.stats.lock_waits", "sql"),
    Metric("sql.procs_blocked", "sqlserver.stats.procs_blocked", "sql"),
    Metric("sql.query_time", "sqlserver.queries.time", "sql"),
    Metric("vdi.host_mem", "vsphere.mem.usage.avg", "vdi", 85.0),
    Metric("vdi.cpu_latency", "vsphere.cpu.latency.avg", "vdi"),
)
METRIC_WORDS = {
    "sql": ("engage", "sql", "database", "report", "invoice", "statement", "freez", "slow"),
    "vdi": ("vdi", "horizon", "desktop", "black screen", "fslogix", "session", "clone"),
}

# --- fixed values: operating limits -----------------------------------------
WINDOW_MINUTES = 60
MIN_COUNT = 3
COOLDOWN_MINUTES = 120
TICK_MINUTES = 5
LOOKBACK_MINUTES = 180
MAX_PER_POLL = 500
BASELINE_WEEKS = 8
BASELINE_TZ = "America/Detroit"
BASELINE_SIGMA = 3.0
MAD_TO_SIGMA = 1.4826
CAUSE_LOOKBACK_HOURS = 24
EFFECT_LOOKBACK_HOURS = 1
CHANGE_LOOKBACK_HOURS = 72
VERSION_RECENCY_HOURS = 100
MIN_SYMPTOM_CHARS = 15
RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75
