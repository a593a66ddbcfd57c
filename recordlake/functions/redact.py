"""Secret redaction (Q9) as a chain of regular-expression replacements.

Order matters: whole header values first (a ``Cookie`` header holds several
pairs, ``Authorization`` a scheme and a credential), then bearer credentials, so
the token never stays behind, then ``key=value`` / ``key: value`` pairs whose
key (quoted or not) ends in a secret-ish word, then ``user:password@`` in URLs.
No look-around is used, so the same patterns behave alike in Java regex and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlake.functions.text import truncate_message

MASK = "<redacted>"

# A key or the word "bearer" starts at the beginning of the text or after a
# character that cannot be part of it (an explicit class instead of \b, whose
# meaning differs between Java regex and RE2 for non-ASCII letters).
HEADER_RE = r"(?i)(^|[^a-z0-9_\-])((?:set-)?cookie|(?:proxy-)?authorization)([\"']?\s*:\s*[\"']?)[^\r\n\"']+"
BEARER_RE = r"(?i)(^|[^a-z0-9_])bearer\s+[^\s\"',;]+"
# Endings of keys whose values are secrets.
_KEY_ALT = "tokens?|cookies?|session(?:_id)?|authorization|proxy(?:_url)?|passwords?|secrets?|secret_key"
KEY_VALUE_RE = (
    r"(?i)(^|[^a-z0-9_\-])([a-z0-9_\-]*(?:" + _KEY_ALT + r"))([\"']?\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^\s\"',;&]+)"
)
URL_USERINFO_RE = r"(://)[^/\s:@]+:[^/\s@]+@"

#: Pattern and replacement (groups by number), in order.
STEPS = (
    (HEADER_RE, "{1}{2}{3}" + MASK),
    (BEARER_RE, "{1}Bearer " + MASK),
    (KEY_VALUE_RE, "{1}{2}{3}" + MASK),
    (URL_USERINFO_RE, "{1}" + MASK + "@"),
)

# Every pattern above needs one of these words (or "://") to match, so texts
# without any of them are returned unchanged after a single cheap scan.
TRIGGER_RE = r"(?i)bearer|token|cookie|session|authorization|proxy|password|secret|://"


def redact(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = col
    for pattern, replacement in STEPS:
        out = F.regexp_replace(out, pattern, replacement.replace("{", "$").replace("}", ""))
    return F.when(col.rlike(TRIGGER_RE), out).otherwise(col)


def redacted_short(c: Column | str, limit: int = 200) -> Column:
    """Redact, then trim to a short diagnostic."""
    return truncate_message(redact(c), limit)
