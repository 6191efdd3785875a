"""Column functions over archive paths: policy, types, globs, addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MIME = {
    "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "html": "text/html", "htm": "text/html", "xml": "application/xml",
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "zip": "application/zip", "py": "text/x-python", "rs": "text/x-rust",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
ZIP_LIKE = ("zip", "docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "jar", "apk", "whl")
STREAMS = ("pdf", "jpg", "jpeg", "jpe")
TEXT_VIEW = ("txt", "md", "markdown", "rst", "csv", "tsv", "json", "yaml", "yml", "toml", "ini", "cfg", "log", "xml", "html", "htm", "css", "js", "ts", "py", "rs", "sh")
RESERVED = "con|prn|aux|nul|com[1-9]|lpt[1-9]"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower case, without the dot; '' when there is none or the only dot leads."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    """A CASE over a literal table."""
    out = reduce(lambda c, kv: c.when(key == kv[0], kv[1]), table.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    return out.otherwise(F.lit(default)) if default is not None else out


def mime(path: Column) -> Column:
    return lookup(MIME, extension(path), "application/octet-stream")


def is_zip_like(path: Column) -> Column:
    return extension(path).isin(*ZIP_LIKE)


def is_stream_container(path: Column) -> Column:
    return extension(path).isin(*STREAMS)


def view_kind(path: Column) -> Column:
    """The kind of readable view that can be made of a file, or null."""
    e = extension(path)
    return F.when(e == "docx", "markdown").when(e == "pdf", "text").when(e.isin(*TEXT_VIEW), "text")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a whole path; a star also crosses '/'."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            out.append(".*")
            continue
        if c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append("\\" + c if c in r"\.^$+{}()|[]" else c)
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def glob(path: Column, pattern: str) -> Column:
    """Whether a path matches; a literal start also goes to the scan as a prefix, so that Parquet can skip row groups."""
    head = pattern.split("*")[0].split("?")[0].split("[")[0]
    hit = path.rlike(glob_regex(pattern))
    return path.startswith(head) & hit if head else hit


def cleaned(path: Column) -> Column:
    """Backslashes to slashes, leading './' stripped; composition to NFC is `nfc` in kernels."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def path_error(path: Column) -> Column:
    """Why a cleaned path is refused, or null."""
    parts = F.split(path, "/")
    bad = lambda rule: F.exists(parts, rule)
    return (
        F.when(path == "", "empty")
        .when(path.startswith("/"), "absolute")
        .when(path.rlike(r"[\x00-\x1f\x7f]"), "control")
        .when(F.contains(path, F.lit(":")), "colon")
        .when(bad(lambda p: p == ""), "empty component")
        .when(bad(lambda p: p.isin(".", "..")), "dot component")
        .when(bad(lambda p: p.rlike(r"[ .]$")), "trailing space or dot")
        .when(bad(lambda p: F.lower(p).rlike(rf"^({RESERVED})(\..*)?$")), "reserved name")
        .when(F.size(parts) > 256, "too deep")
        .when(F.octet_length(path) > 4096, "too long")
    )


def uri(root: Column, path: Column, fragment: Column | None = None) -> Column:
    base = F.concat(F.lit("siltstone://"), root, F.lit("/"), path)
    return base if fragment is None else F.concat(base, F.lit("#"), fragment)


def within(root: Column, path: Column) -> Column:
    """Whether a resolved path lies in a root directory."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def common_prefix(a: Column, b: Column, most: int = 64) -> Column:
    """Length of the common prefix of two names, counted up to `most`."""
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: (i <= F.least(F.length(a), F.length(b))) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))


def loopback(address: Column) -> Column:
    return address.rlike(r"^127\.|^::1$|^localhost$")
