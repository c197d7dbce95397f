"""Fixed values shared by the jobs. Each table states the values every run must agree on."""

# --- URL policy -----------------------------------------------------------------------------
MAX_URL_BYTES = 8192
ALLOWED_PORTS = (80, 443)

# Query keys that never identify a page.
TRACKING_KEYS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "gclid",
    "fbclid",
)

# Fixed values: (host base, route), first match wins.
HOST_ROUTES = (
    ("github.com", "github"),
    ("x.com", "x"),
    ("twitter.com", "x"),
    ("instagram.com", "instagram"),
    ("threads.net", "threads"),
    ("reddit.com", "reddit"),
    ("redd.it", "reddit"),
    ("news.ycombinator.com", "hacker_news"),
    ("youtube.com", "youtube"),
    ("youtu.be", "youtube"),
)
PDF_ROUTE = "pdf"
DEFAULT_ROUTE = "generic_web"

# Fixed values: (network, prefix bits, class), first match wins. IPv4 networks are compared in
# their IPv4-mapped IPv6 form, so one ordered list covers both families.
IPV4_RULES = (
    ("0.0.0.0", 32, "unspecified"),
    ("127.0.0.0", 8, "loopback"),
    ("169.254.169.254", 32, "metadata"),
    ("169.254.170.2", 32, "metadata"),
    ("10.0.0.0", 8, "private"),
    ("172.16.0.0", 12, "private"),
    ("192.168.0.0", 16, "private"),
    ("100.64.0.0", 10, "shared"),
    ("169.254.0.0", 16, "link_local"),
    ("192.0.2.0", 24, "documentation"),
    ("198.51.100.0", 24, "documentation"),
    ("203.0.113.0", 24, "documentation"),
    ("198.18.0.0", 15, "benchmarking"),
    ("224.0.0.0", 4, "multicast"),
    ("0.0.0.0", 8, "reserved"),
    ("240.0.0.0", 4, "reserved"),
    ("192.0.0.0", 24, "reserved"),
    ("192.88.99.0", 24, "reserved"),
)
IPV6_RULES = (
    ("::", 128, "unspecified"),
    ("::1", 128, "loopback"),
    ("fd00:ec2::254", 128, "metadata"),
    ("fc00::", 7, "private"),
    ("fe80::", 10, "link_local"),
    ("ff00::", 8, "multicast"),
    ("2001:db8::", 32, "documentation"),
    ("3ff0::", 12, "documentation"),
    ("2001:2::", 48, "benchmarking"),
    ("100::", 96, "reserved"),
    ("64:ff9b::", 96, "reserved"),
    ("64:ff9b:1::", 48, "reserved"),
    ("2001::", 32, "reserved"),
    ("2001:10::", 28, "reserved"),
    ("2001:20::", 28, "reserved"),
    ("2002::", 16, "reserved"),
    ("fec0::", 10, "reserved"),
)
# Addresses outside this IPv6 network that no rule named are reserved.
IPV6_GLOBAL_UNICAST = ("2000::", 3)

# --- Fetch log ------------------------------------------------------------------------------
MAX_WIRE_BYTES = 25 * 1024 * 1024
MAX_DECODED_BYTES = 50 * 1024 * 1024
TRANSIENT_STATUSES = (408, 429, 500, 502, 503, 504)
REDIRECT_STATUSES = (301, 302, 303, 307, 308)
MAX_REDIRECTS = 10
MAX_RETRIES = 2
TOTAL_BUDGET_SECONDS = 30.0
GLOBAL_CONCURRENCY = 64
HOST_CONCURRENCY = 8
SNIFF_BYTES = 512
CONTENT_ENCODINGS = ("gzip", "br", "zstd")
EVIDENCE_HEADERS = ("content-type", "content-encoding", "etag", "last-modified", "cache-control")
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 10.0, 30.0)
# The jitter generator of the retry schedule.
JITTER_MULTIPLIER = 6364136223846793005
JITTER_INCREMENT = 1442695040888963407

# Fetch failure -> bounded reporting class. Failures not named here are not reported.
FAILURE_CLASSES = (
    ("url", "policy_denied"),
    ("address_policy", "policy_denied"),
    ("dns", "dns"),
    ("transport", "transport"),
    ("remote_status", "transport"),
    ("redirect_location", "transport"),
    ("redirect_loop", "transport"),
    ("unsupported_encoding", "transport"),
    ("malformed_encoding", "transport"),
    ("timeout_total", "timeout"),
    ("timeout_first_byte", "timeout"),
    ("timeout_read_idle", "timeout"),
    ("declared_body_too_large", "resource_limit"),
    ("wire_body_too_large", "resource_limit"),
    ("decoded_body_too_large", "resource_limit"),
    ("redirect_limit", "resource_limit"),
    ("overloaded", "resource_limit"),
    ("cache_integrity", "cache_integrity"),
    ("artifact", "artifact"),
)
RETRYABLE_FAILURES = (
    "transport",
    "dns",
    "timeout_total",
    "timeout_first_byte",
    "timeout_read_idle",
    "overloaded",
)

# --- Documents ------------------------------------------------------------------------------
MAX_INPUT_BYTES = 50 * 1024 * 1024
MAX_DOM_NODES = 250_000
EVALUATOR_VERSION = "quality_v1"
MIN_TEXT_BYTES = 120
MIN_SCORE = 350
STRATEGIES = ("semantic", "readability", "density")

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTAINERS = ("article", "main", "section", "div")
BOILERPLATE = ("aside", "footer", "form", "header", "nav")
RAW_TEXT = (
    "script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript",
)
# Entities are decoded in the content of these two raw-text elements only.
DECODED_RAW_TEXT = ("title", "textarea")
HEAD_ONLY = (
    "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style",
    "script", "template",
)
# Start tags that end an open paragraph (HTML standard, "close a p element").
P_CLOSING_STARTS = (
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr",
    "li", "listing", "main", "menu", "nav", "ol", "p", "plaintext", "pre", "search", "section",
    "summary", "table", "ul", "xmp",
) + HEADINGS
# End tags of block elements that are not tracked as containers; each ends an open paragraph.
P_CLOSING_ENDS = (
    "address", "blockquote", "button", "center", "dd", "details", "dialog", "dir", "dl", "dt",
    "fieldset", "figcaption", "figure", "hgroup", "li", "listing", "menu", "ol", "p", "pre",
    "search", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)

# --- Ledger ---------------------------------------------------------------------------------
OWNER_SERVICE = "web-extract"
COMMAND_PRODUCER = "web-platform"
COMMAND_SUBJECT = "cmd.content.capture.requested.v1"
COMMAND_TYPE = "content.capture.requested.v1"
REPORT_SUBJECT = "evt.platform.operation.reported.v1"
REPORT_TYPE = "platform.operation.reported.v1"
DOCUMENT_SUBJECT = "evt.content.document.extracted.v1"
DOCUMENT_TYPE = "content.document.extracted.v1"
POLICY_VERSION = "ssrf-v1"
NORMALIZER_VERSION = "url-v1"
PARSER_VERSION = "html-v1"
RUN_LEASE_SECONDS = 60
OUTBOX_LEASE_SECONDS = 30
MAX_OUTBOX_ATTEMPTS = 12
MAX_BACKOFF_SECONDS = 300
OUTBOX_BATCH = 32
MAX_DELIVERIES = 12
RETENTION_HOURS = 168
RETENTION_MESSAGES = 1_000_000
RETENTION_BYTES = 1024 * 1024 * 1024
DUPLICATE_SECONDS = 120
DUPLICATE_WINDOW = f"{DUPLICATE_SECONDS} seconds"
