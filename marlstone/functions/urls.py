"""URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HREF = r'href="([^"]*)"'


def canonical(url: Column) -> Column:
    """Without parameters, query and fragment."""
    return F.regexp_replace(url, "[;?#].*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(canonical(url), r"^[a-z]+://[^/]*(/.*)?$", 1)


def has_extension(url: Column, *extensions: str) -> Column:
    return F.lower(path(url)).rlike(rf"\.(?:{'|'.join(extensions)})$")


def links(html: Column) -> Column:
    """Array of link targets in order; empty ones, fragments and other schemes aside."""
    found = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.filter(found, lambda h: ~h.rlike(r"^(?:$|#|javascript:|mailto:|tel:)"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def versioned_name(name: Column, sha: Column, extension: str) -> Column:
    """A file name that tells contents apart: slug, twelve digits of the hash, extension."""
    return F.concat(slug(name), F.lit("__"), F.substring(sha, 1, 12), F.lit(extension))


#: Scheme, authority, path, query and fragment, with what marks each, as in the appendix of RFC 3986.
_PARTS = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def without_dots(path: Column) -> Column:
    """A path whose segments . and .. have been followed; above the root is the root."""

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    rooted = F.startswith(path, F.lit("/"))
    segments = F.split(F.when(rooted, F.substring(path, 2, 1 << 30)).otherwise(path), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    open_end = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    flat = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.concat(kept, open_end), "/"))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), flat).otherwise(path)


def absolute(base: Column, link: Column) -> Column:
    """A link target against the page it is on, by the rules of RFC 3986; null if either is null. Scheme and host stay as they are written."""
    scheme, authority, path_, query = (_part(link, g) for g in (1, 3, 5, 6))
    base_path = _part(base, 5)
    folder = F.regexp_extract(base_path, "(?s)^(.*/)[^/]*$", 1)
    merged = F.when((_part(base, 3) != "") & (base_path == ""), F.concat(F.lit("/"), path_)).otherwise(F.concat(folder, path_))
    own = (scheme != "") | (authority != "")
    new_path = F.when(own | F.startswith(path_, F.lit("/")), without_dots(path_)).when(path_ == "", base_path).otherwise(without_dots(merged))
    new_query = F.when(own | (path_ != "") | (query != ""), query).otherwise(_part(base, 6))
    return F.concat(
        F.when(scheme != "", scheme).otherwise(_part(base, 1)),
        F.when(own, authority).otherwise(_part(base, 3)),
        new_path,
        new_query,
        _part(link, 8),
    )
