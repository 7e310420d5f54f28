"""Column functions for URLs, by regular expressions that never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of paths that are not pages.
IGNORED_SUFFIXES = [".doc", ".docx", ".gif", ".jpeg", ".jpg", ".mp3", ".mp4", ".pdf", ".png", ".ppt", ".pptx", ".svg", ".webp", ".xls", ".xlsx", ".zip"]
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def _clean_path(raw: Column) -> Column:
    """Without empty and dot segments and without a slash at the end."""
    walk = F.aggregate(
        F.split(raw, "/"),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((x == "") | (x == "."), done).otherwise(F.array_append(done, x)),
    )
    return F.concat(F.lit("/"), F.array_join(walk, "/"))


def canonical(base: Column, href: Column) -> Column:
    """``href`` against ``base`` as scheme, host and path of the base's site; null if it leads elsewhere or to a file.

    A relative path starts from the base as a folder. The scheme becomes the base's; query and fragment go.
    """
    own_scheme, own_host = scheme(href), host(href)
    p = path(href)
    to_scheme = F.when(own_scheme == "", scheme(base)).otherwise(own_scheme)
    to_host = F.when((own_scheme == "") & (own_host == ""), host(base)).otherwise(own_host)
    relative = (own_scheme == "") & (own_host == "")
    full = F.when(relative & ~p.startswith("/"), F.concat(F.regexp_replace(path(base), "/+$", ""), F.lit("/"), p)).otherwise(p)
    is_file = F.lower(full).rlike("(" + "|".join(x.replace(".", "[.]") for x in IGNORED_SUFFIXES) + ")$")
    return F.when(to_scheme.isin("http", "https") & (to_host == host(base)) & ~is_file, F.concat(scheme(base), F.lit("://"), host(base), _clean_path(full)))


def public(url: Column, site: str, mirror: str, prefix: str) -> Column:
    """Links to ``site`` below ``prefix`` go to ``mirror``, without query and fragment; others stay."""
    moved = (host(url) == site) & path(url).startswith(prefix)
    return F.when(moved, F.concat(scheme(url), F.lit(f"://{mirror}"), path(url))).otherwise(url)


def malformed(url: Column, site: str, mirror: str, prefix: str) -> Column:
    """On another host, or with an empty path segment, before or after the rewrite to the mirror."""
    to = public(url, site, mirror, prefix)
    return (host(url) != site) | path(url).contains("//") | ~host(to).isin(site, mirror) | path(to).contains("//")


def ancestors(url: Column) -> Column:
    """The URL itself and every prefix of it that ends before a slash: what a root must equal to hold it."""
    pieces = F.split(url, "/")
    return F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), "/"))


def allowed(url_path: Column, rules: Column) -> Column:
    """Whether robots rules (array of struct<allow, prefix>) let a path be fetched: the longest prefix decides, then allow."""
    met = F.filter(rules, lambda r: url_path.startswith(r["prefix"]) & (r["prefix"] != ""))
    best = F.array_max(F.transform(met, lambda r: F.struct(F.length(r["prefix"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))
