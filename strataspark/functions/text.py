"""Column expressions on names, paths, ids, versions and metadata text. All run in the JVM."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_semver(v: Column) -> Column:
    """(major, minor, patch) as a struct of longs; what is not a version is 0, 0, 0."""
    ok = v.rlike(r"^\d+\.\d+\.\d+")
    part = lambda i: F.coalesce(F.when(ok, F.regexp_extract(v, r"^(\d+)\.(\d+)\.(\d+)", i).try_cast("long")), F.lit(0)).cast("long")
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


@lru_cache
def _decomposed() -> tuple[str, str, str]:
    """By Unicode's compatibility decomposition: the characters that become one ASCII character, these, and (as JSON) what
    others become that give several."""
    one, to, many = [], [], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        x = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(x) == 1 and ord(c) < 0x10000:
            one.append(c)
            to.append(x)
        elif x:
            many[c] = x
    return "".join(one), "".join(to), json.dumps(many)


def ascii_fold(c: Column) -> Column:
    """Characters decomposed (NFKD) and what is beyond ASCII dropped. The tables are made at plan time and stand in the plan
    as constants; texts with characters that become several take the slower way."""
    one, to, many = _decomposed()
    table = F.from_json(F.lit(many), "map<string,string>")
    x = F.translate(c, one, to)
    folded = F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    return F.regexp_replace(F.when(x.rlike(r"[^\x00-\x7F]"), folded).otherwise(x), r"[^\x00-\x7F]", "")


def normalize_collection_id(c: Column) -> Column:
    """Lower case, ASCII, other characters to single hyphens, segments trimmed (a leading mark gets an n); null if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(ascii_fold(F.lower(c)), r"[^a-z0-9_/-]", "-"), "-+", "-")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^[-/]+", ""), "[-/]+$", ""), "/+", "/")
    segs = F.filter(F.transform(F.split(x, "/"), lambda s: F.regexp_replace(F.regexp_replace(s, "^-+", ""), "-+$", "")), lambda s: s != "")
    segs = F.transform(segs, lambda s: F.when(s.rlike("^[a-z0-9]"), s).otherwise(F.concat(F.lit("n"), s)))
    return F.nullif(F.array_join(segs, "/"), F.lit(""))


def collection_id_problem(c: Column) -> Column:
    """The first reason why an id is not valid, else null."""
    return (
        F.when(c.isNull() | (F.trim(c) == ""), "empty").when(c.contains(" "), "spaces").when(c != F.lower(c), "uppercase")
        .when(~c.rlike(r"^[\p{L}\p{N}]"), "first character").when(c.rlike(r"[^a-z0-9_/-]"), "invalid character").when(~c.rlike(r"^[a-z0-9][a-z0-9_-]*(/[a-z0-9][a-z0-9_-]*)*$"), "pattern")
    )


def infer_collection_id(path: Column) -> Column:
    """The directory part of a path without ``k=v`` segments."""
    segs = F.split(path, "/")
    return F.array_join(F.filter(F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0))), lambda s: ~s.contains("=")), "/")


def short_hash(c: Column, n: int = 6) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def slugify(c: Column) -> Column:
    """Lower case, runs of other characters to one underscore, trimmed; ``unnamed`` if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", "unnamed").otherwise(x)


def humanize_slug(c: Column) -> Column:
    """The last path segment with separators as spaces and tokens without capitals capitalised; null gives an empty text."""
    words = F.filter(F.split(F.regexp_replace(F.element_at(F.split(c, "/"), -1), "[-_]+", " "), r"\s+"), lambda w: w != "")
    title = lambda w: F.when(w.rlike(r"\p{Lu}"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.coalesce(F.array_join(F.transform(words, title), " "), F.lit(""))


def technical_name(c: Column) -> Column:
    """Is text an identifier rather than a title: without spaces, and a lower-case namespace prefix, an underscore, or short,
    with no capital after its first character and either a digit or no capital at all. No text counts as one."""
    t = F.trim(c)
    short = (F.length(t) < 20) & ~F.substr(t, F.lit(2)).rlike("[A-Z]") & (t.rlike(r"\p{Nd}") | ~t.rlike(r"^\p{Lu}"))
    return F.coalesce((c == "") | (~t.contains(" ") & (t.rlike(r"^[a-z_]+:[A-Za-z]") | t.contains("_") | short)), F.lit(True))


def best_description(title: Column, abstract: Column, name: Column) -> Column:
    """The abstract unless it is technical; else the title unless it is, or repeats the name; else a title with spaces or
    dashes; else the abstract."""
    has_title = F.coalesce(title != "", F.lit(False))
    return (
        F.when(~technical_name(abstract), abstract).when(has_title & ~technical_name(title) & (F.lower(title) != F.lower(name)), title)
        .when(has_title & technical_name(abstract) & title.rlike("[ -]"), title).otherwise(abstract)
    )


def stem(name: Column) -> Column:
    """A file name without its last suffix; a name that only begins or ends with a dot has none."""
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def sanitize_filename(c: Column) -> Column:
    """A safe file name: lower case ASCII (marks decomposed, other characters dropped), with dashes for white space, brackets, control
    characters and path separators, never several in a row, at an end or beside a dot; the suffix in lower case, without white
    space. A stem of which nothing is left becomes ``file_`` and a hash."""
    safe = F.regexp_replace(c, r"[/\\]", "-")
    s = stem(safe)
    x = F.regexp_replace(F.lower(ascii_fold(s)), r"[\s()\[\]{}\x00-\x1f\x7f]", "-")
    for pattern, to in (("-+", "-"), (r"^[-.]+|[-.]+$", ""), (r"-+\.", "."), (r"\.-+", ".")):
        x = F.regexp_replace(x, pattern, to)
    ext = F.regexp_replace(F.lower(F.substr(safe, F.length(s) + 1)), r"[\s\x00-\x1f\x7f]", "")
    return F.concat(F.when(x == "", F.concat(F.lit("file_"), short_hash(s))).otherwise(x), ext)


#: Device names that some file systems reserve.
RESERVED = ("con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)])


def filename_issues(path: Column, size: Column) -> Column:
    """Array of issue names: invalid characters, reserved name or parent, path over 200 characters, no bytes."""
    name = F.regexp_replace(path, "^.*/", "")
    stem = F.lower(F.regexp_replace(name, r"\..*$", ""))
    parents = F.transform(F.filter(F.split(path, "/"), lambda s: s != name), F.lower)
    return F.array_compact(F.array(
        F.when(name.rlike(r"[^A-Za-z0-9._-]"), "invalid_characters"), F.when(stem.isin(*RESERVED), "reserved_name"), F.when(F.length(path) > 200, "path_too_long"),
        F.when(size == 0, "zero_bytes"), F.when(F.arrays_overlap(parents, F.array(*[F.lit(r) for r in RESERVED])), "reserved_parent")))


#: Extension, category, status, display name, conversion target, media type, asset role.
FORMATS = (
    ("parquet", "geo_asset", "cloud_native", "GeoParquet", None, "application/vnd.apache.parquet", "data"),
    ("tif", "geo_asset", "cloud_native", "COG", None, "image/tiff; application=geotiff; profile=cloud-optimized", "data"),
    ("tiff", "geo_asset", "cloud_native", "COG", None, "image/tiff; application=geotiff; profile=cloud-optimized", "data"),
    ("fgb", "geo_asset", "cloud_native", "FlatGeobuf", None, "application/vnd.flatgeobuf", "data"),
    ("pmtiles", "visualization", "cloud_native", "PMTiles", None, "application/vnd.pmtiles", "visual"),
    ("geojson", "geo_asset", "convertible", "GeoJSON", "GeoParquet", "application/geo+json", "data"),
    ("shp", "geo_asset", "convertible", "Shapefile", "GeoParquet", "application/x-shapefile", "data"),
    ("gpkg", "geo_asset", "convertible", "GeoPackage", "GeoParquet", "application/geopackage+sqlite3", "data"),
    ("csv", "tabular_data", "convertible", "CSV", "Parquet", "text/csv", "data"),
    ("tsv", "tabular_data", "convertible", "TSV", "Parquet", "text/tab-separated-values", "data"),
    ("jp2", "geo_asset", "convertible", "JPEG2000", "COG", "image/jp2", "data"),
    ("dbf", "known_sidecar", "unsupported", "dBASE", None, "application/x-dbf", "metadata"),
    ("shx", "known_sidecar", "unsupported", "Shape index", None, "application/x-shapefile", "metadata"),
    ("prj", "known_sidecar", "unsupported", "Projection", None, "text/plain", "metadata"),
    ("json", "metadata", "unsupported", "JSON", None, "application/json", "metadata"),
    ("md", "documentation", "unsupported", "Markdown", None, "text/markdown", "documentation"),
    ("txt", "documentation", "unsupported", "Text", None, "text/plain", "documentation"),
    ("png", "thumbnail", "unsupported", "PNG", None, "image/png", "thumbnail"),
    ("jpg", "thumbnail", "unsupported", "JPEG", None, "image/jpeg", "thumbnail"),
)
_FIELD = {n: i for i, n in enumerate(("extension", "category", "status", "display", "target", "media_type", "role"))}


def format_field(ext: Column, field: str, default: str | None = None) -> Column:
    """A field of the format table by extension (the table is a literal map in the plan, not a join)."""
    pairs = [x for f in FORMATS if f[_FIELD[field]] is not None for x in (F.lit(f[0]), F.lit(f[_FIELD[field]]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(ext)), F.lit(default))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def classify_file(path: Column, size: Column) -> Column:
    """Category of a file: junk directories, catalog documents, styles, then the format table; empty files are junk."""
    name = F.regexp_replace(path, "^.*/", "")
    return (
        F.when(path.rlike(r"(^|/)(__pycache__|node_modules|\.git|\.svn)/") | name.isin(".DS_Store", "Thumbs.db"), "junk").when(size == 0, "junk")
        .when(name.isin("catalog.json", "collection.json", "item.json", "versions.json"), "stac_metadata").when(name.rlike(r"^style.*\.json$"), "style").otherwise(format_field(extension(path), "category", "unknown"))
    )


def media_type(path: Column) -> Column:
    """Media type of the last path segment that has a known extension."""
    segs = F.reverse(F.split(path, "/"))
    known = F.filter(F.transform(segs, lambda s: format_field(extension(s), "media_type")), lambda m: m.isNotNull())
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("application/octet-stream"))


def id_from_url(url: Column) -> Column:
    """A collection id from the last meaningful path segment; of ``k=v`` the value, without extension."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    segs = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.contains("*"))
    last = F.regexp_replace(F.regexp_replace(F.try_element_at(segs, F.lit(-1)), r"^[^=]*=", ""), r"\.[A-Za-z0-9]+$", "")
    return F.coalesce(normalize_collection_id(last), F.lit("unnamed"))


def split_object_url(url: Column) -> Column:
    """(bucket URL, prefix) of an object-store URL."""
    return F.struct(F.regexp_extract(url, r"^([a-z0-9]+://[^/?#]+)", 1).alias("bucket"), F.regexp_replace(F.regexp_extract(url, r"^[a-z0-9]+://[^/?#]+/([^?#]*)", 1), "/+$", "").alias("prefix"))


def is_external_href(h: Column) -> Column:
    return F.coalesce(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.lit(False))


def hive_parse(segment: Column) -> Column:
    """(key, value) of a ``k=v`` directory, else nulls."""
    ok = segment.rlike(r"^[^/=]+=[^/]*$")
    return F.struct(F.when(ok, F.regexp_extract(segment, r"^([^/=]+)=", 1)).alias("key"), F.when(ok, F.regexp_extract(segment, r"=([^/]*)$", 1)).alias("value"))


def remote_glob(root: Column, href: Column) -> Column:
    """A relative glob as an absolute one; other hrefs give null."""
    return F.when(href.contains("*"), F.concat_ws("/", F.regexp_replace(root, "/+$", ""), F.regexp_replace(href, r"^\./", "")))


#: Accepted date formats, in the order tried.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")


def parse_datetime(c: Column) -> Column:
    """The first format that fits, in UTC; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def multihash(content: Column) -> Column:
    """SHA-256 as a multihash: the code and length prefix 1220, then the digest in hex."""
    return F.concat(F.lit("1220"), F.sha2(content, 256))


def fingerprint(lines: Column) -> Column:
    """First 16 hex digits of the SHA-256 over the sorted lines of a schema."""
    return F.substring(F.sha2(F.array_join(F.sort_array(lines), "|"), 256), 1, 16)


def crs_to_epsg(crs: Column) -> Column:
    """EPSG code of a CRS text (EPSG:n, an OGC URN or URL) or PROJJSON; CRS84 is 4326; else null."""
    direct = F.nullif(F.regexp_extract(crs, r"(?i)EPSG[:/]+(?:[\d.]*[:/]+)?(\d+)$", 1), F.lit(""))
    return F.when(crs.rlike("(?i)CRS84$"), F.lit(4326)).otherwise(F.coalesce(direct.cast("int"), F.when(crs.startswith("{"), F.get_json_object(crs, "$.id.code").cast("int")))).cast("long")


def parse_nodata(c: Column) -> Column:
    """A number in text as (integer, real), one of them set: without point and exponent an integer (beyond 64 bits a real), else a
    real. Both null where the text is no number: nothing, words, "nan" and "inf" too."""
    t = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    whole, number = t.rlike(r"^[+-]?\d+$"), t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    integer = F.when(whole, F.regexp_replace(t, r"^\+", "").try_cast("long"))
    return F.struct(integer.alias("integer"), F.when(number & integer.isNull(), t.try_cast("double")).alias("real"))


def _glob_class(items: str) -> str:
    """A regex class of what stands between a glob's brackets; ranges that run backwards hold nothing."""
    no, out, i = items.startswith("!"), "", 0
    items = items[no:]
    quote = lambda ch: "\\" + ch if ch in "\\[]^&-~" else ch
    while i < len(items):
        if i + 2 < len(items) and items[i + 1] == "-":
            if items[i] <= items[i + 2]:
                out += f"{quote(items[i])}-{quote(items[i + 2])}"
            i += 3
        else:
            out += quote(items[i])
            i += 1
    return (f"[{'^' * no}{out}]") if out else ("." if no else "(?!)")


def glob_to_regex(glob: str) -> str:
    """An anchored regex of a glob, made at plan time: * and ? within and across segments, [..] as classes ([!..] for all others);
    a bracket that is never closed stands for itself."""
    out, i = "", 0
    while i < len(glob):
        ch, i = glob[i], i + 1
        end = glob.find("]", i + 1 + glob.startswith("!", i)) if ch == "[" else -1
        if end > 0:
            out, i = out + _glob_class(glob[i:end]), end + 1
        else:
            out += {"*": ".*", "?": "."}.get(ch, re.escape(ch))
    return f"(?s)^{out}\\z"


def any_glob(c: Column, globs: list[str], case: bool = True) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | c.rlike(("" if case else "(?i)") + glob_to_regex(g))
    return hit


def resolve_href(base: Column, href: Column) -> Column:
    """An href relative to a directory, with ``.`` and ``..`` resolved by a fold over its segments; external hrefs stay."""
    segs = F.split(F.concat_ws("/", base, href), "/")
    up = F.aggregate(segs, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s.isin("", "."), acc).otherwise(F.concat(acc, F.array(s))))
    return F.when(is_external_href(href), href).otherwise(F.array_join(up, "/"))
