"""Validators and sanitizers of names, tags, contents, identifiers and paths as column expressions.

Where a validator of one value would raise, the column function gives null (sanitizers) or a reason (checks).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip

#: Extensions, size and length limits, patterns, directories and keywords of the checks.
INPUT_EXTENSIONS = ("py", "txt", "csv", "json")
SAFE_EXTENSIONS = ("txt", "csv", "json", "py", "md", "rst", "log")
DANGEROUS_EXTENSIONS = (
    "exe", "bat", "cmd", "com", "pif", "scr", "vbs", "vbe", "js", "jse", "ws", "wsf", "wsc", "wsh", "ps1", "ps1xml", "ps2", "ps2xml", "psc1", "psc2",
    "msh", "msh1", "msh2", "mshxml", "msh1xml", "msh2xml",
)
MAX_FILE_SIZE, MAX_CONTENT, MAX_NAME, MAX_TAG, MAX_TAGS, MAX_IDENTIFIER = 100 * 1024 * 1024, 1_000_000, 255, 100, 50, 63
SUSPICIOUS = {"script_tag": r"<script[^>]*>", "javascript_url": "javascript:", "vbscript_url": "vbscript:", "event_handler": r"on\w+\s*=", "eval_call": r"eval\s*\(", "exec_call": r"exec\s*\("}
PATH_PATTERNS = r"(?i)\.\./|\.\.\\|^/etc/|^/proc/|^/sys/|^C:\\Windows\\|^C:\\Program Files\\"
SYSTEM_DIRS = ("/etc", "/proc", "/sys", "/root", "/usr/bin", "/usr/sbin", "/bin", "/sbin")
KEYWORDS = ("select", "insert", "update", "delete", "drop", "create", "alter", "grant", "revoke", "union", "join", "where")
SKIPPED_DIRS = r"(^|/)(\.[^/]+|__pycache__|node_modules)/"


def extension(path: Column) -> Column:
    """Lower-cased extension without the dot; '' for none and for names that only begin with dots."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def _cut_name(name: Column) -> Column:
    """At most MAX_NAME characters, with the extension kept."""
    ext = F.regexp_extract(name, r"[^.].*(\.[^.]*)$", 1)
    return F.when(F.char_length(name) > MAX_NAME, F.concat(F.substring(name, F.lit(1), F.greatest(F.lit(0), MAX_NAME - F.char_length(ext))), ext)).otherwise(name)


def display_name(name: Column) -> Column:
    """A file name without separators, reserved and control characters; 'unnamed_file' for null and for nothing left."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"[\x00-\x1f\x7f-\x9f]", "")
    kept = strip(_cut_name(clean))
    return F.when(F.coalesce(kept, F.lit("")) == "", "unnamed_file").otherwise(kept)


def storage_name(name: Column) -> Column:
    """A file name of word characters (of any script), '-', '_' and '.' only, that does not begin with a dot."""
    return F.regexp_replace(_cut_name(F.regexp_replace(name, r"[^\p{L}\p{N}_\-.]", "_")), r"^\.", "_")


def listed_tags(tags: Column) -> Column:
    """Distinct tags in order, stripped, without <, >, quotes, cut at MAX_TAG; null for more than MAX_TAGS; null tags are skipped."""
    clean = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.substring(F.regexp_replace(strip(t), "[<>\"']", ""), 1, MAX_TAG))
    return F.when(F.size(tags) <= MAX_TAGS, F.array_distinct(F.filter(clean, lambda t: t != "")))


def storage_tags(tags: Column) -> Column:
    """Distinct tags in order of word characters, '-', '_' and '.' only, cut at MAX_TAG, the first MAX_TAGS; null tags are skipped."""
    clean = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.substring(F.regexp_replace(t, r"[^\p{L}\p{N}_\-.]", "_"), 1, MAX_TAG))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t != "")), 1, MAX_TAGS)


def content_state(content: Column, longest: int = MAX_CONTENT) -> Column:
    """'null', 'empty', 'too_long' or 'ok'."""
    return F.when(content.isNull(), "null").when(content == "", "empty").when(F.char_length(content) > longest, "too_long").otherwise("ok")


def without_nul(content: Column) -> Column:
    return F.replace(content, F.lit("\0"), F.lit(""))


def suspicious(content: Column) -> dict[str, Column]:
    """A flag for each pattern of SUSPICIOUS, in any letter case."""
    return {name: content.rlike(f"(?i){pattern}") for name, pattern in SUSPICIOUS.items()}


def identifier_state(name: Column) -> Column:
    """'invalid', 'too_long', 'keyword' or 'ok'."""
    return (
        F.when(~F.coalesce(name.rlike(r"\A[a-zA-Z_][a-zA-Z0-9_]*\z"), F.lit(False)), "invalid").when(F.char_length(name) > MAX_IDENTIFIER, "too_long").when(F.lower(name).isin(*KEYWORDS), "keyword").otherwise("ok")
    )


def escaped_like(pattern: Column) -> Column:
    """The pattern with backslash, % and _ escaped for LIKE."""
    out = pattern
    for c in ("\\", "%", "_"):
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def normal_path(path: Column) -> Column:
    """The path without empty and '.' parts and with each 'x/..' taken out; '.' for an empty one, null for null."""
    absolute = path.startswith("/")
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")

    def add(acc: Column, part: Column) -> Column:
        kept = F.when(up(acc), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(absolute, acc).otherwise(F.concat(acc, F.array(part)))
        return F.when(part.isin("", "."), acc).when(part == "..", kept).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), add)
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def path_state(path: Column, extensions: tuple[str, ...] = INPUT_EXTENSIONS) -> Column:
    """'pattern', 'nul', 'extension', 'system_dir' or 'ok', the first that holds; null for null.

    Patterns and system directories are looked for in the normal form of the path, so that `a/../b` is no traversal.
    """
    normal, system = normal_path(path), F.lit(False)
    for d in SYSTEM_DIRS:
        system = system | normal.startswith(d)
    return (
        F.when(path.isNull(), None).when(normal.rlike(PATH_PATTERNS), "pattern").when(F.contains(path, F.lit("\0")), "nul").when(~extension(path).isin(*extensions), "extension").when(system, "system_dir").otherwise("ok")
    )


def file_state(path: Column, size: Column) -> Column:
    """'dangerous', 'too_large', 'too_small' (under 10 bytes), 'hidden' (dot files and pruned directories), 'unsupported' or 'ok'."""
    ext = extension(path)
    return (
        F.when(ext.isin(*DANGEROUS_EXTENSIONS), "dangerous").when(size > MAX_FILE_SIZE, "too_large").when(size < 10, "too_small")
        .when(path.rlike(SKIPPED_DIRS) | basename(path).startswith("."), "hidden").when(~ext.isin(*INPUT_EXTENSIONS), "unsupported").otherwise("ok")
    )


def looks_like_csv(text: Column) -> Column:
    """A separator and a line break within the first 1024 characters."""
    head = F.substring(text, 1, 1024)
    return head.rlike(r"[,\t;|]") & head.contains("\n")


def is_valid_file(path: Column, size: Column, text: Column) -> Column:
    """A supported extension, at least 10 bytes, and a CSV file's text looks like one; false for null paths and sizes."""
    ext = extension(path)
    return F.coalesce(ext.isin(*INPUT_EXTENSIONS) & (size >= 10) & ((ext != "csv") | F.coalesce(looks_like_csv(text), F.lit(False))), F.lit(False))


def short_text(text: Column, most: int = 30) -> Column:
    """Texts of more than `most` characters by their beginning, before an ellipsis."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def short_path(path: Column, most: int = 50) -> Column:
    """Paths of more than `most` characters by their end, after an ellipsis."""
    return F.when(F.char_length(path) > most, F.concat(F.lit("..."), F.right(path, F.lit(most - 3)))).otherwise(path)


def remaining_text(seconds: Column) -> Column:
    """Whole seconds below a minute, minutes with one digit below an hour, then hours."""
    return F.when(seconds < 60, F.format_string("%.0fs", seconds)).when(seconds < 3600, F.format_string("%.1fm", seconds / 60)).otherwise(F.format_string("%.1fh", seconds / 3600))


def limit_offset(limit: int | None, offset: int | None) -> tuple[int | None, int | None]:
    """The limit, at most 10,000, and the offset; negative ones and an offset above a million raise ValueError."""
    for name, x in (("limit", limit), ("offset", offset)):
        if x is not None and (not isinstance(x, int) or x < 0):
            raise ValueError(f"{name} must be a non-negative integer")
    if offset is not None and offset > 1_000_000:
        raise ValueError("offset too large")
    return (None if limit is None else min(limit, 10_000)), offset
