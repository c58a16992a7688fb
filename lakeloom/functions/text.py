"""Text functions and predicates, as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by extension, and what never enters a corpus.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "pdf": "application/pdf", "mp3": "audio/mpeg", "mp4": "video/mp4"}
DENIED_NAMES = r"\.git|\.obsidian|\.ds_store|\.env(\.[^/]*)?|id_rsa|id_dsa|id_ecdsa|id_ed25519|credentials|credentials\.json|\.npmrc|\.pypirc|\.netrc|secrets\.[^/]*"
DENIED_EXTENSIONS = "exe com scr dll dylib so app msi msp bat cmd ps1 sh bash zsh fish command vbs vbe js jse mjs cjs wsf wsh hta jar class wasm apk deb rpm dmg pkg key pem p12 pfx".split()
EXCLUDED = rf"(^|/)({DENIED_NAMES})(/|$)|[^/]\.({'|'.join(DENIED_EXTENSIONS)})$"


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def lookup_key(text: Column) -> Column:
    """Trimmed, lower-case key for title and path lookups."""
    return F.lower(F.trim(text))


def block_kind(text: Column) -> Column:
    """callout, quote, math, list or paragraph, by how a block starts."""
    return (
        F.when(text.rlike(r"^\s*> \[!"), "callout")
        .when(text.rlike(r"^\s*>"), "quote")
        .when(text.rlike(r"^\s*(\$\$|\\\[)"), "math")
        .when(text.rlike(r"^\s*([-*+] |[0-9]+[.)] )"), "list")
        .otherwise("paragraph")
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.]\.([A-Za-z0-9]+)$", 1))


def file_kind(path: Column) -> Column:
    e = extension(path)
    return F.when(e == "md", "markdown").when(e == "canvas", "canvas").when(e == "base", "base").otherwise("asset")


def media_type(path: Column) -> Column:
    e, out = extension(path), F.lit("application/octet-stream")
    for k, v in MEDIA_TYPES.items():
        out = F.when(e == k, v).otherwise(out)
    return out


def is_excluded(path: Column) -> Column:
    """Whether the lower-cased path is denied: by the name of any part, or by its extension. Of a URL, the path counts."""
    lower = F.translate(path, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(lower, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*).*$", "$1").rlike(EXCLUDED)


def is_external(target: Column) -> Column:
    return F.lower(target).rlike("^(https?://|mailto:|data:|obsidian:|//)")


def normalize_link(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), r"\\", "/"))


def emails(text: Column) -> Column:
    """White-space tokens that look like addresses, without punctuation around them."""
    tokens = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"^[,.;:()<>]+|[,.;:()<>]+$", ""))
    return F.filter(tokens, lambda t: t.rlike(r"^[^@]+@.*\..*[^.]$"))


def phones(text: Column) -> Column:
    """Maximal runs of digits, +, -, brackets and spaces with ten digits or more."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[0-9+][0-9+() -]*"), F.lit(0)), lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")) >= 10)


def markers(text: Column) -> Column:
    """Credential markers followed by something other than white space, quotes and angle brackets."""
    return F.regexp_extract_all(text, F.lit(r"""(?:sk-|ghp_|AKIA|postgres://|mongodb://)[^\s"'`<>]+|-----BEGIN (?:OPENSSH )?PRIVATE KEY-----"""), F.lit(0))
