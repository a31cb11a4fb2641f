"""URL parts by the generic syntax of RFC 3986, without validation.

Spark's own URL functions reject or drop what a feed may hold (relative
addresses, user info, ports), so parts come from the RFC's expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldweave.functions.text import let, or_empty, sorted_set, stripped

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Schemes whose addresses always show an authority.
NETLOC_SCHEMES = (
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero", "rtsp",
    "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
)


_SEP = "\x01"


def _parts(url: Column) -> Column:
    """Scheme, authority with its slashes, authority, path, query: one pass of the expression."""
    return F.split(F.regexp_replace(url, _PARTS, _SEP.join(f"${g}" for g in range(1, 6))), _SEP)


def host(url: Column) -> Column:
    """Authority in lower case with user info and port; null for a null or empty URL."""
    return F.when(url != "", F.lower(F.regexp_extract(F.regexp_replace(url, "[\r\n\t]", ""), _PARTS, 3)))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme (https by default) and authority, no trailing slashes, no fragment; null for null or empty."""

    def build(p: Column) -> Column:
        scheme = F.coalesce(F.nullif(F.lower(F.get(p, F.lit(0))), F.lit("")), F.lit("https"))
        return F.struct(scheme.alias("scheme"), F.lower(F.get(p, F.lit(2))).alias("authority"), F.regexp_replace(F.get(p, F.lit(3)), "/+$", "").alias("path"), F.get(p, F.lit(4)).alias("query"))

    def spell(x: Column) -> Column:
        path = x["path"]
        rooted = (path == "") | path.startswith("/")
        body = (
            F.when(x["authority"] != "", F.concat(F.lit("//"), x["authority"], F.when(rooted, "").otherwise("/"), path))
            .when(path.startswith("//") | (x["scheme"].isin(*NETLOC_SCHEMES) & rooted), F.concat(F.lit("//"), path))
            .otherwise(path)
        )
        return F.concat(x["scheme"], F.lit(":"), body, F.when(x["query"] != "", F.concat(F.lit("?"), x["query"])).otherwise(""))

    clean = F.regexp_replace(stripped(url), "[\r\n\t]", "")
    return F.when(url != "", let(let(_parts(clean), build), spell))


def url_set(references: Column) -> Column:
    """Canonical URLs of references as a sorted set."""
    return sorted_set(or_empty(F.transform(references, lambda r: canonical_url(r["url"]))))


def host_set(references: Column) -> Column:
    """Non-empty hosts of references, lower-cased, as a sorted set."""
    return sorted_set(or_empty(F.transform(references, lambda r: F.nullif(F.lower(r["host"]), F.lit("")))))
