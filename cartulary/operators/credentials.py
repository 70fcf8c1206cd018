"""Rules for credentials in source text: a fixed table."""

#: Kinds of credentials and their patterns; the first that matches a line counts. Fixed values.
CREDENTIALS = (
    ("client secret", r"(?i)\b(consumer|client)[_-]?secret\s*[:=]\s*['\"][^'\"]{8,}['\"]"),
    ("api key", r"(?i)\bapi[_-]?key\s*[:=]\s*['\"][^'\"]{12,}['\"]"),
    ("aws access key id", r"\bAKIA[0-9A-Z]{16}\b"),
    ("aws secret access key", r"(?i)\baws_secret_access_key\s*[:=]\s*['\"][A-Za-z0-9/+=]{40}['\"]"),
    ("private key", r"-----BEGIN (RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY( BLOCK)?-----"),
    ("hardcoded bearer token", r"\bBearer\s+[A-Za-z0-9\-._~+/]{24,}=*"),
    ("hardcoded basic auth header", r"\bBasic\s+[A-Za-z0-9+/]{16,}=*"),
    ("password", r"(?i)\bpassword\s*[:=]\s*['\"][^'\"]{6,}['\"]"),
    ("database connection string with embedded credentials", r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s'\"/:@]+:[^\s'\"/:@]+@"),
    ("slack token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}"),
    ("slack webhook url", r"/services/T[A-Za-z0-9]{6,}/B[A-Za-z0-9]{6,}/[A-Za-z0-9]{16,}\b"),
    ("github token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\b"),
    ("github fine grained token", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("gitlab token", r"\bglpat-[A-Za-z0-9_-]{20,}\b"),
    ("stripe live key", r"\bsk_live_[A-Za-z0-9]{16,}\b"),
    ("npm token", r"\bnpm_[A-Za-z0-9]{30,}\b"),
    ("google api key", r"\bAIza[0-9A-Za-z_-]{30,}\b"),
    ("signed jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
#: Of these words one stands in every match.
HINT = r"(?i)secret|api[_-]?key|AKIA|PRIVATE KEY|Bearer|Basic|password|://|xox[baprs]-|/services/T|gh[pousr]_|github_pat_|glpat-|sk_live_|npm_|AIza|eyJ"
