"""Fixed values of the risk model."""

# ---------------------------------------------------------------------------
# Results depend on these texts and numbers being exactly so.
# ---------------------------------------------------------------------------

SENSITIVE_NAMES = (
    ".env", ".env.local", ".env.production",
    "secrets.yaml", "secrets.yml", "secrets.json",
    "credentials.json", "service-account.json",
    "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
    ".pem", ".key", ".pfx", ".p12",
)
SENSITIVE_SUFFIXES = (".pem", ".key", ".pfx", ".p12")
SENSITIVE_PATH_PATTERNS = (r"config/secrets", r"\.aws/", r"\.ssh/", r"private[_-]?key")

MANIFESTS = ("requirements.txt", "package.json", "Pipfile", "go.mod")
VULNERABLE_PYTHON = ("pycrypto", "python-jwt", "pyyaml")
VULNERABLE_JAVASCRIPT = ("event-stream", "flatmap-stream", "ua-parser-js")

# (category, points, label, ((pattern, lower-case text every match contains), ...))
DEFAULT_RULES = (
    ("command_injection", 50, "🔴 [Critical] Command Injection", (
        (r"eval\s*\([^)]*\+", "eval"),
        (r"eval\s*\(\s*[a-zA-Z_]", "eval"),
        (r"exec\s*\([^)]*\+", "exec"),
        (r"os\.system\s*\([^)]*\+", "os.system"),
        (r"subprocess\.call\s*\([^,]+shell\s*=\s*True", "subprocess.call"),
    )),
    ("sql_injection", 50, "🔴 [Critical] SQL Injection", (
        (r"execute\s*\([^,]*\+", "execute"),
        (r"execute\s*\(.*%s", "execute"),
        (r"cursor\.execute\s*\([^,]+\+", "cursor.execute"),
        (r"f[\"\']SELECT.*\{", "select"),
        (r"f[\"\']INSERT.*\{", "insert"),
        (r"f[\"\']UPDATE.*\{", "update"),
        (r"f[\"\']DELETE.*\{", "delete"),
    )),
    ("path_traversal", 50, "🔴 [Critical] Path Traversal", (
        (r"open\s*\([^)]*\+", "open"),
        (r"open\s*\(f[\"\']", "open"),
        (r"os\.path\.join\s*\([^)]*\+", "os.path.join"),
        (r"file_path\s*=\s*f[\"\']", "file_path"),
        (r"with\s+open\s*\(f[\"\']", "open"),
    )),
    ("xss_risk", 35, "🟠 [High] XSS Vulnerability", (
        (r"innerHTML\s*=\s*[^\"\']+\+", "innerhtml"),
        (r"innerHTML\s*=.*\$\{", "innerhtml"),
        (r"dangerouslySetInnerHTML", "dangerouslysetinnerhtml"),
        (r"document\.write\s*\([^)]*\+", "document.write"),
    )),
    ("hardcoded_secret", 35, "🟠 [High] Hardcoded Secret", (
        (r"password\s*=\s*[\"\'][^\"\']{8,}[\"\']", "password"),
        (r"api[_-]?key\s*=\s*[\"\'][A-Za-z0-9_\-]{20,}[\"\']", "api"),
        (r"secret[_-]?key\s*=\s*[\"\'][^\"\']+[\"\']", "secret"),
        (r"AWS[_-]?SECRET[_-]?ACCESS[_-]?KEY\s*=", "secret"),
        (r"PRIVATE[_-]?KEY\s*=", "private"),
    )),
    ("open_redirect", 35, "🟠 [High] Open Redirect", (
        (r"redirect\s*\([^)]*\+", "redirect"),
        (r"redirect\s*\(.*request\.", "redirect"),
        (r"HttpResponseRedirect\s*\([^)]*\+", "redirect"),
        (r"res\.redirect\s*\([^)]*\+", "redirect"),
    )),
    ("template_injection", 35, "🟠 [High] Template Injection (SSTI)", (
        (r"render_template_string\s*\(", "render_template_string"),
        (r"Template\s*\([^)]*\+", "template"),
        (r"\.render\s*\([^)]*\+", ".render"),
    )),
    ("insecure_crypto", 20, "🟡 [Medium] Insecure Cryptography", (
        (r"md5\s*\(", "md5"),
        (r"sha1\s*\(", "sha1"),
        (r"DES\s*\(", "des"),
        (r"random\.random\s*\(\)", "random.random"),
    )),
    ("insecure_deserialization", 20, "🟡 [Medium] Insecure Deserialization", (
        (r"pickle\.loads?\s*\(", "pickle.load"),
        (r"yaml\.load\s*\([^)]*\)", "yaml.load"),
    )),
    ("nosql_injection", 20, "🟡 [Medium] NoSQL Injection", (
        (r"\$where\s*:", "$where"),
        (r"\.find\s*\(\s*\{[^}]*\$", ".find"),
    )),
    ("weak_jwt", 20, "🟡 [Medium] Weak JWT Configuration", (
        (r"algorithm\s*=\s*[\"\']none[\"\']", "algorithm"),
        (r"verify\s*=\s*False", "verify"),
    )),
)

# Optional additions: unquoted secrets and server-side request forgery. Off by default.
EXTRA_SECRET_PATTERNS = (
    (r"[A-Z_]*KEY\s*=\s*[A-Za-z0-9_\-]{20,}", "key"),
    (r"[A-Z_]*SECRET\s*=\s*[A-Za-z0-9_\-]{10,}", "secret"),
    (r"[A-Z_]*TOKEN\s*=\s*[A-Za-z0-9_\-]{20,}", "token"),
    (r"(GEMINI|OPENAI|STRIPE|TWILIO|SENDGRID|SLACK|DISCORD)[_-]?(KEY|TOKEN|SECRET)\s*=", "="),
)
SSRF_RULE = ("ssrf", 50, "🔴 [Critical] Server-Side Request Forgery (SSRF)", (
    (r"requests\.(get|post|put|delete)\s*\([^)]*\+", "requests."),
    (r"requests\.(get|post|put|delete)\s*\(f[\"\']", "requests."),
    (r"urllib\.request\.urlopen\s*\([^)]*\+", "urlopen"),
    (r"httpx\.(get|post)\s*\(f[\"\']", "httpx."),
))

SENSITIVE_POINTS = 30
PACKAGE_POINTS = 25
MISSING_TESTS_POINTS = 25
FILES_STEPS = ((10, 25, "Large PR ({} files)"), (5, 10, "Medium-sized PR ({} files)"))
LINES_STEPS = ((500, 20, "Many lines changed ({})"), (200, 10, "Moderate lines changed ({})"))
IMPACT_STEPS = (
    (5, 15, "High impact ({} files may be affected)"),
    (0, 5, "Some impact ({} files may be affected)"),
)
LEVELS = ((70, "Critical"), (50, "High"), (30, "Medium"))
MAX_SCORE = 100
BLOCK_THRESHOLD = 70
BADGES = ((70, "🔴"), (40, "🟡"))

# ---------------------------------------------------------------------------


def rule_pack(name="default"):
    """The rules of pack `default` or `extended`, in reporting order; own packs pass through."""
    if not isinstance(name, str):
        return name
    if name == "default":
        return DEFAULT_RULES
    if name != "extended":
        raise ValueError(f"unknown rule pack: {name!r}")
    widened = tuple(
        (cat, pts, label, pats + EXTRA_SECRET_PATTERNS if cat == "hardcoded_secret" else pats)
        for cat, pts, label, pats in DEFAULT_RULES
    )
    return widened + (SSRF_RULE,)
