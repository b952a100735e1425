"""Text safety functions: secrets, HTML sanitizing, snippets, finding lines, URL
allowlist (X11-X14, X19, X20, F10)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftgate.schemas import ALLOWED_FETCH_HOSTS, REDACTED, SECRET_PATTERNS

# Whitespace as JavaScript's \s and trim() understand it (Unicode spaces included),
# written as an explicit class so Java regex and RE2 agree on it.
JS_WS = (r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _as_group(p: str) -> str:
    # A leading (?i) applies to that pattern only once patterns are alternated.
    return "(?i:" + p[4:] + ")" if p.startswith("(?i)") else "(?:" + p + ")"


SECRET_ANY = "|".join(_as_group(p) for p in SECRET_PATTERNS)


#: One of these is in every text, in lower case, that a pattern of X11 or X12 matches.
SECRET_PARTS = ["sk-", "xai-", "aiza", "bearer", "apikey", "api_key", "api-key", "secret", "password", "token", "authorization"]


def holds_any(s, parts: list[str]) -> Column:
    """Whether a text holds one of ``parts`` in any case. Written so that the text is put in lower
    case once: a filter would do it again for each of them."""

    def any_of(low: Column) -> Column:
        found = F.lit(False)
        for part in parts:
            found = found | low.contains(part)
        return found

    return F.exists(F.array(F.lower(_c(s))), any_of)


def _may_hold_secret(s) -> Column:
    """A plain search, many times as fast as the patterns: false only if none of them matches."""
    return holds_any(s, SECRET_PARTS)


def contains_secret(s) -> Column:
    """X11: any of the secret patterns occurs."""
    return _may_hold_secret(s) & _c(s).rlike(SECRET_ANY)


# The secret key words (the key rule of X12) in ``key = "value"`` / ``key: "value"`` form,
# for free text where there is no object key to test.
SECRET_KEY_WORDS = "secret|password|token|apikey|api_key|authorization"
SECRET_ASSIGNMENT = r'(?i:(' + SECRET_KEY_WORDS + r'))\s*[:=]\s*"[^"]*"'


def contains_secret_assignment(s) -> Column:
    """X11 extended to text: a secret key word assigned a quoted value."""
    return _c(s).rlike(SECRET_ASSIGNMENT)


def scrub_secrets(s) -> Column:
    """X12 on one string: every match of every pattern becomes [REDACTED] (all matches,
    not only the first), and quoted values assigned to a secret key word are redacted."""
    out = _c(s)
    for p in SECRET_PATTERNS:
        out = F.regexp_replace(out, p, REDACTED)
    out = F.regexp_replace(out, r'(?i:(' + SECRET_KEY_WORDS + r')(\s*[:=]\s*)")[^"]*"', "$1$2\"" + REDACTED + '"')
    # A replacement puts none of the parts into a text.
    return F.when(_may_hold_secret(s), out).otherwise(_c(s))


def scrub(df, key_pattern: str | None = None):
    """X12 on a table: string columns whose name is a secret key are redacted whole; other
    string columns, map values and nested struct fields are scrubbed; map entries whose key
    is a secret key are redacted whole."""
    from pyspark.sql import types as T
    from driftgate.schemas import SECRET_KEY_PATTERN
    kp = re.compile(key_pattern or SECRET_KEY_PATTERN[4:], re.I)

    def walk(col: Column, dtype, name: str) -> Column:
        if name and kp.search(name) and isinstance(dtype, T.StringType):
            return F.when(col.isNotNull(), F.lit(REDACTED))
        if isinstance(dtype, T.StringType):
            return scrub_secrets(col)
        if isinstance(dtype, T.StructType):
            return F.when(col.isNotNull(), F.struct(*[walk(col[f.name], f.dataType, f.name).alias(f.name)
                                                      for f in dtype.fields]))
        if isinstance(dtype, T.ArrayType):
            return F.transform(col, lambda x: walk(x, dtype.elementType, ""))
        if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.StringType):
            return F.transform_values(col, lambda k, v: F.when(k.rlike("(?i)" + SECRET_KEY_WORDS), F.lit(REDACTED))
                                      .otherwise(scrub_secrets(v)))
        return col

    return df.select(*[walk(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


# Entity decoding, applied in this fixed order after tags are gone.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"),
            ("&nbsp;", " ")]


def sanitize_for_print(s) -> Column:
    """Drop script/style blocks, then tags that start with a letter, decode six
    entities, strip control characters except tab, newline and carriage return."""
    out = _c(s)
    out = F.regexp_replace(out, r"(?i)<script\b[^>]*>[\s\S]*?</script>", "")
    out = F.regexp_replace(out, r"(?i)<style\b[^>]*>[\s\S]*?</style>", "")
    out = F.regexp_replace(out, r"</?[a-zA-Z][^>]*>", "")
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return F.regexp_replace(out, r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}]", "")


def sanitize_line(s) -> Column:
    """Sanitize, collapse whitespace runs to one space, trim."""
    return F.trim(F.regexp_replace(sanitize_for_print(s), JS_WS + "+", " "))


def js_trim(s) -> Column:
    return F.regexp_replace(_c(s), "^" + JS_WS + "+|" + JS_WS + "+$", "")


def snippet(line) -> Column:
    """The trimmed line, first 120 characters."""
    return F.substring(js_trim(line), 1, 120)


def finding_line(severity, code, key, field, confidence, path, line, message) -> Column:
    """X20: 'SEV code key.field [conf] @ path:line: message', sanitized as one line."""
    conf = F.when(_c(confidence).isNotNull(), F.concat(F.lit(" ["), _c(confidence), F.lit("]"))).otherwise("")
    loc = F.when(_c(path).isNotNull() & (_c(path) != ""),
                 F.concat(F.lit(" @ "), _c(path),
                          F.when(_c(line).isNotNull(), F.concat(F.lit(":"), _c(line).cast("string")))
                           .otherwise(""))).otherwise("")
    return sanitize_line(F.concat(F.upper(_c(severity)), F.lit(" "), _c(code), F.lit(" "), _c(key),
                                  F.lit("."), _c(field), conf, loc, F.lit(": "), _c(message)))


URL_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def url_allowed(url, hosts=None) -> Column:
    """struct(ok, reason). Valid URL, https, and host in the allowlist."""
    hosts = list(hosts or ALLOWED_FETCH_HOSTS)
    u = _c(url)
    scheme = F.lower(F.regexp_extract(u, URL_SCHEME, 1))
    host = F.lower(F.regexp_extract(u, URL_HOST, 1))
    invalid = u.isNull() | (scheme == "") | (scheme.isin("http", "https", "ftp", "ws", "wss") & (host == ""))
    reason = (F.when(invalid, F.concat(F.lit("Invalid URL: "), F.coalesce(u, F.lit(""))))
               .when(scheme != "https", F.concat(F.lit("Only HTTPS is allowed (got "), scheme, F.lit(":)")))
               .when(~host.isin(hosts), F.concat(F.lit("Hostname not on allowlist: "), host)))
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))
