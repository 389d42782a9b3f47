"""Queries that apply the text functions to whole columns of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspark.functions import text as T
from strataspark.plans.views import sql, view
from strataspark.registry import register


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "pages").select("page_id", "url")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "part")


_RAW = "concat('  ', p_name, '//', p_type, '--', cast(p_partkey as string), '!')"
_RAW_SQL = "'  ' || p_name || '//' || p_type || '--' || cast(p_partkey as varchar) || '!'"


@register("normalize_collection_id", """select p_partkey, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('  ' || p_name || '//' || p_type || '--' || cast(p_partkey as varchar) || '!'), '[^a-z0-9_/-]', '-', 'g'), '-+', '-', 'g'), '^[-/]+|[-/]+$', '', 'g'), '/+', '/', 'g'), '/'), lambda s: s <> ''), lambda s: trim(s, '-')), '/') as id from part""")
def normalize_collection_id_q(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", T.normalize_collection_id(F.expr(_RAW)).alias("id"))


_IDS = "case p_partkey % 6 when 0 then '' when 1 then p_name when 2 then p_type when 3 then '-x' || cast(p_partkey as varchar) when 4 then 'a.b' || cast(p_partkey as varchar) else 'ok/' || cast(p_partkey as varchar) end"


@register("validate_collection_id", f"select p_partkey, case p_partkey % 6 when 0 then 'empty' when 1 then 'spaces' when 2 then 'uppercase' when 3 then 'first character' when 4 then 'invalid character' end as problem from (select p_partkey, {_IDS} as id from part) p")
def validate_collection_id_q(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", T.collection_id_problem(F.expr(_IDS.replace("varchar", "string"))).alias("problem"))


@register("infer_collection_id", sql("files", "select path, case when len(string_split(path, '/')) = 3 then split_part(path, '/', 1) || '/' || split_part(path, '/', 2) else split_part(path, '/', 1) end as id from files"))
def infer_collection_id_q(spark: SparkSession, sf: str) -> DataFrame:
    segs = F.split("path", "/")
    path = F.concat_ws("/", F.slice(segs, F.lit(1), F.size(segs) - 1), F.lit("year=2024/month=1"), F.element_at(segs, -1))
    return view(spark, sf, "files").select("path", T.infer_collection_id(path).alias("id"))


@register("slugify", "select p_partkey, case when p_partkey % 9 = 0 then 'unnamed' else regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') || '_' || cast(p_partkey as varchar) end as slug, substr(sha256(p_name), 1, 6) as hash from part")
def slugify_q(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 9 == 0, "--!").otherwise(F.concat(F.lit("("), "p_name", F.lit(") - "), F.col("p_partkey").cast("string"), F.lit(".")))
    return _parts(spark, sf).select("p_partkey", T.slugify(raw).alias("slug"), T.short_hash(F.col("p_name")).alias("hash"))


@register("slug_collision", "select p_partkey, case when n > 1 then s || '_' || substr(sha256(cast(p_partkey as varchar)), 1, 6) else s end as slug from (select p_partkey, s, count(*) over (partition by s) as n from (select p_partkey, replace(p_name, ' ', '_') || '_' || cast(p_partkey % 300 as varchar) as s from part) a) b")
def slug_collision_q(spark: SparkSession, sf: str) -> DataFrame:
    named = _parts(spark, sf).select("p_partkey", F.concat_ws(" ", "p_name", (F.col("p_partkey") % 300).cast("string")).alias("name"))
    return slug_collision(named, "name", F.col("p_partkey").cast("string")).select("p_partkey", "slug")


def slug_collision(df: DataFrame, name: str, salt) -> DataFrame:
    """Slug per name; a six-digit hash only where a slug repeats (counted first, so no large group is gathered)."""
    s = df.withColumn("slug", T.slugify(F.col(name)))
    n = s.groupBy("slug").agg((F.count("*") > 1).alias("_many"))
    return s.join(n, "slug").withColumn("slug", F.when(F.col("_many"), F.concat_ws("_", "slug", T.short_hash(salt))).otherwise(F.col("slug"))).drop("_many")


@register("humanize_slug", "select p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || ' ' || p_type as title from part")
def humanize_slug_q(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", T.humanize_slug(F.concat(F.lit("a/b/"), F.regexp_replace("p_name", " ", "-"), F.lit("_"), "p_type")).alias("title"))


#: Names of every kind that the rule tells apart, by part.
_NAME = """case p_partkey % 16 when 0 then p_name when 1 then 'ns:' || p_type when 2 then replace(p_name, ' ', '_') when 3 then split_part(p_name, ' ', 1)
  when 4 then 'Q' || p_size when 5 then 'Provincia' when 6 then 'País' when 7 then p_brand when 8 then 'DenHaagHousing' when 9 then '' when 10 then '  layer' || p_size || ' '
  when 11 then 'Word:' || p_size when 12 then replace(p_name, ' ', '') when 13 then 'USA' when 14 then replace(p_type, ' ', '-') end"""


def _technical(n: str) -> str:
    return rf"(coalesce({n}, '') = '' or (strpos(trim({n}), ' ') = 0 and (regexp_matches(trim({n}), '^[a-z_]+:[A-Za-z]') or strpos(trim({n}), '_') > 0 or (length(trim({n})) < 20 and not regexp_matches(substr(trim({n}), 2), '[A-Z]') and (regexp_matches(trim({n}), '[0-9]') or not regexp_matches(trim({n}), '^\p{{Lu}}'))))))"


@register("technical_name", f"select p_partkey, {_technical('n')} as technical from (select p_partkey, {_NAME} as n from part) p")
def technical_name_q(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", T.technical_name(F.expr(_NAME)).alias("technical"))


_TITLE = "case p_partkey % 5 when 0 then upper(p_name) when 1 then p_type || ' part' when 2 then replace(p_name, ' ', '-') when 3 then '' end"


@register("best_description", f"""select p_partkey, case when not {_technical('a')} then a when coalesce(t, '') <> '' and not {_technical('t')} and lower(t) <> lower(p_name) then t
  when coalesce(t, '') <> '' and (strpos(t, ' ') > 0 or strpos(t, '-') > 0) then t else a end as description from (select p_partkey, p_name, {_NAME} as a, {_TITLE} as t from part) p""")
def best_description_q(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", T.best_description(F.expr(_TITLE), F.expr(_NAME), F.col("p_name")).alias("description"))


_ODD_NAME = """case p_partkey % 10 when 0 then concat('(', p_name, ') ', p_type, '!.TIF') when 1 then concat('Données ', p_brand, '.Shp') when 2 then concat('Plzeň_', p_name) when 3 then concat('日本語', '.shp') when 4 then concat('..', p_type, ' .tar.gz ')
  when 5 then concat(p_type, '/../', p_name, '.CSV') when 6 then concat('a -. ', p_brand, '. -b.json') when 7 then concat('[', p_type, ']{', p_brand, '}') when 8 then concat('.', lower(p_type)) else concat(p_type, '--', p_brand, '.') end"""


@register("sanitize_filename", f"""with t as (select p_partkey, regexp_replace({_ODD_NAME}, '[/\\\\]', '-', 'g') as n from part), s as (select p_partkey, n, regexp_replace(n, '^(.+)\\.[^.]+$', '\\1') as stem from t),
x as (select p_partkey, stem, lower(regexp_replace(substr(n, length(stem) + 1), '\\s', '', 'g')) as ext, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(stem)), '[^\\x00-\\x7F]', '', 'g'), '[\\s()\\[\\]{{}}]', '-', 'g'), '-+', '-', 'g') as y from s)
select p_partkey, case when trim(y, '-.') = '' then 'file_' || substr(sha256(stem), 1, 6) else regexp_replace(regexp_replace(trim(y, '-.'), '-+\\.', '.', 'g'), '\\.-+', '.', 'g') end || ext as name from x""")
def sanitize_filename_q(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", T.sanitize_filename(F.expr(_ODD_NAME)).alias("name"))


@register("filename_issues", sql("files", "select path, concat_ws(',', case when size_bytes % 4 = 0 then 'invalid_characters' end, case when size_bytes % 5 = 0 then 'reserved_name' end, case when size_bytes % 6 = 0 then 'zero_bytes' end, case when size_bytes % 7 = 0 then 'reserved_parent' end) as issues from files"))
def filename_issues_q(spark: SparkSession, sf: str) -> DataFrame:
    p = F.concat(F.when(F.col("size_bytes") % 7 == 0, "aux/").otherwise("d/"), F.when(F.col("size_bytes") % 5 == 0, "con").otherwise("file"), F.when(F.col("size_bytes") % 4 == 0, ". x").otherwise(".x"))
    return view(spark, sf, "files").select("path", F.array_join(T.filename_issues(p, F.when(F.col("size_bytes") % 6 == 0, 0).otherwise(1)), ",").alias("issues"))


@register("id_from_url", r"select page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(string_split(trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/'), '/')[-1], '\.[A-Za-z0-9]+$', ''), '[^a-z0-9_/-]', '-', 'g'), '-+', '-', 'g'), '-'), ''), 'unnamed') as id from pages")
def id_from_url_q(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", T.id_from_url(F.col("url")).alias("id"))


@register("split_object_url", r"select page_id, regexp_extract(url, '^([a-z0-9]+://[^/?#]+)', 1) as bucket, rtrim(regexp_extract(url, '^[a-z0-9]+://[^/?#]+/([^?#]*)', 1), '/') as prefix from pages")
def split_object_url_q(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", T.split_object_url(F.col("url")).alias("s")).select("page_id", "s.*")


@register("is_external_href", "select page_id, page_id % 2 = 0 as external from pages")
def is_external_href_q(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", T.is_external_href(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("./"), F.col("page_id").cast("string")))).alias("external"))


@register("rebase_asset_href", "select page_id, case page_id % 3 when 0 then url when 1 then 'c/' || cast(page_id as varchar) || '.parquet' else 'c/item/' || cast(page_id as varchar) || '.tif' end as href from pages")
def rebase_asset_href_q(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    h = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("../"), n, F.lit(".parquet"))).otherwise(F.concat(F.lit("./x/../"), n, F.lit(".tif")))
    return _pages(spark, sf).select("page_id", T.resolve_href(F.lit("c/item"), h).alias("href"))


@register("hive_parse", "select page_id, case when page_id % 2 = 0 then 'year' end as key, case when page_id % 2 = 0 then cast(page_id as varchar) end as value from pages")
def hive_parse_q(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.concat(F.when(F.col("page_id") % 2 == 0, "year=").otherwise("year"), F.col("page_id").cast("string"))
    return _pages(spark, sf).select("page_id", T.hive_parse(seg).alias("h")).select("page_id", "h.*")


@register("remote_glob", "select page_id, case when page_id % 2 = 0 then 's3://b/r/k=' || cast(page_id as varchar) || '/*.parquet' end as glob from pages")
def remote_glob_q(spark: SparkSession, sf: str) -> DataFrame:
    href = F.concat(F.lit("./k="), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "/*.parquet").otherwise("/a.parquet"))
    return _pages(spark, sf).select("page_id", T.remote_glob(F.lit("s3://b/r/"), href).alias("glob"))


@register("parse_semver", "select p_partkey, case when p_partkey % 5 = 0 then 0 else cast(p_size as bigint) end as major, case when p_partkey % 5 = 0 then 0 else p_partkey % 13 end as minor, case when p_partkey % 5 = 0 then 0 else p_partkey end as patch from part")
def parse_semver_q(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 5 == 0, "latest").otherwise(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 13).cast("string"), F.col("p_partkey").cast("string")))
    return _parts(spark, sf).select("p_partkey", T.parse_semver(v).alias("v")).select("p_partkey", "v.*")


@register("parse_datetime", "select o_orderkey, case when o_orderkey % 5 = 4 then null else strftime(case when o_orderkey % 5 in (2, 3) then cast(cast(o_orderdate as date) as timestamp) else o_orderdate end, '%Y-%m-%dT%H:%M:%SZ') end as rfc from orders")
def parse_datetime_q(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    f = lambda p: F.date_format("o_orderdate", p)
    t = F.when(k == 0, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, f("yyyy-MM-dd HH:mm:ss")).when(k == 2, f("yyyy-MM-dd")).when(k == 3, f("yyyy/MM/dd")).otherwise("soon")
    return view(spark, sf, "orders").select("o_orderkey", T.rfc3339(T.parse_datetime(t)).alias("rfc"))


@register("checksum", "select page_id, sha256(html) as sha, '1220' || sha256(html) as multihash from pages")
def checksum_q(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha"), T.multihash(F.col("html")).alias("multihash"))


@register("crs_to_epsg", "select p_partkey, case p_partkey % 5 when 0 then p_partkey when 1 then p_partkey when 2 then 4326 when 3 then p_partkey end as epsg from part")
def crs_to_epsg_q(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    c = F.when(k == 0, F.concat(F.lit("EPSG:"), n)).when(k == 1, F.concat(F.lit("urn:ogc:def:crs:EPSG::"), n)).when(k == 2, "OGC:CRS84").when(k == 3, F.concat(F.lit('{"type": "ProjectedCRS", "id": {"authority": "EPSG", "code": '), n, F.lit("}}"))).otherwise("local")
    return _parts(spark, sf).select("p_partkey", T.crs_to_epsg(c).alias("epsg"))


def geo_metadata_fields(geo) -> list:
    """Columns from the ``geo`` file metadata: primary column, CRS text, first geometry type, box."""
    primary = F.coalesce(F.get_json_object(geo, "$.primary_column"), F.lit("geometry"))
    cols = F.from_json(F.get_json_object(geo, "$.columns"), "map<string, struct<crs: string, geometry_types: array<string>, bbox: array<double>>>")
    c = F.try_element_at(cols, primary)
    return [primary.alias("primary_column"), c["crs"].alias("crs"), F.try_element_at(c["geometry_types"], F.lit(1)).alias("geometry_type"), c["bbox"].alias("bbox")]


@register("geo_metadata_fields", "select p_partkey, 'geom' as primary_column, 'EPSG:' || cast(p_size as varchar) as crs, 'Polygon' as geometry_type, cast(p_partkey as double) as west from part")
def geo_metadata_fields_q(spark: SparkSession, sf: str) -> DataFrame:
    g = F.concat(F.lit('{"primary_column": "geom", "columns": {"geom": {"crs": "EPSG:'), F.col("p_size").cast("string"), F.lit('", "geometry_types": ["Polygon", "Point"], "bbox": ['), F.col("p_partkey").cast("string"), F.lit(", 1, 2, 3]}}}"))
    out = _parts(spark, sf).select("p_partkey", *geo_metadata_fields(g))
    return out.select("p_partkey", "primary_column", "crs", "geometry_type", F.col("bbox")[0].alias("west"))


_NODATA = """case p_partkey % 14 when 0 then concat(' ', cast(p_size as string), ' ') when 1 then cast(p_retailprice as string) when 2 then 'none' when 3 then 'nan' when 4 then 'inf' when 5 then concat('-', cast(p_size as string)) when 6 then concat(cast(p_size as string), 'e-2')
  when 7 then '' when 8 then concat('+', cast(p_size as string), '.') when 9 then '-Infinity' when 10 then concat('.', cast(p_size as string)) when 11 then '1 2' when 12 then concat(cast(p_size as string), '0000000000000000000000') end"""


@register("parse_nodata", """select p_partkey, case when p_partkey % 14 = 0 then p_size when p_partkey % 14 = 5 then -p_size end::bigint as integer,
  case p_partkey % 14 when 1 then p_retailprice when 6 then cast(p_size || 'e-2' as double) when 8 then cast(p_size as double) when 10 then cast('0.' || p_size as double) when 12 then cast(p_size || '0000000000000000000000' as double) end as real from part""")
def parse_nodata_q(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", T.parse_nodata(F.expr(_NODATA)).alias("n")).select("p_partkey", "n.integer", "n.real")


def meaningful_keyword(k):
    """A term to find data by, not an identifier: no underscore, no colon, and not a short code (up to three letters, then up to four
    digits, in eight characters at most)."""
    t = F.trim(k)
    code = (F.length(t) <= 8) & t.rlike(r"^[A-Za-z]{1,3}\d{1,4}[A-Za-z0-9]*$")
    return F.coalesce((t != "") & ~t.contains("_") & ~t.contains(":") & ~code, F.lit(False))


_WORDS = """array(p_name, replace(p_name, ' ', '_'), replace(p_name, ' ', '-'), concat('ns:', p_type), concat('AB', cast(p_size as string)), concat('covid', cast(p_size as string)), concat('x', cast(p_partkey as string), 'abcdefg'), cast(2000 + p_size as string), ' ', concat(' ', substring(p_type, 1, 2), ' '), concat('a', cast(p_partkey % 100000 as string)))"""


@register("meaningful_keyword", f"""select p_partkey, array_to_string(list_filter({_WORDS.replace("array(", "list_value(")}, lambda k: trim(k) <> '' and not regexp_matches(trim(k), '[_:]') and not (length(trim(k)) <= 8 and regexp_full_match(trim(k), '[A-Za-z]{{1,3}}[0-9]{{1,4}}[A-Za-z0-9]*'))), ',') as keywords from part""")
def meaningful_keyword_q(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", F.array_join(F.filter(F.expr(_WORDS), meaningful_keyword), ",").alias("keywords"))


#: Phrases of servers' default descriptions, and titles that say nothing.
BOILERPLATE_PHRASES = (
    "this is the reference implementation of wfs",
    "this is the default geoserver",
    "this is a geoserver instance",
    "geoserver web feature service",
    "mapserver web feature service",
    "supports all wfs operations including",
    "reference implementation of wfs",
    "deegree web feature service",
    "qgis server wfs",
    "a compliant implementation of ogc",
)
BOILERPLATE_TITLES = ("geoserver", "mapserver", "web feature service", "wfs")


def boilerplate_text(c):
    """One of the titles, or a text that holds one of the phrases; a mere mention of a server is none, nor is no text."""
    t = F.lower(c)
    hit = F.trim(t).isin(*BOILERPLATE_TITLES)
    for p in BOILERPLATE_PHRASES:
        hit = hit | t.contains(p)
    return F.coalesce(hit, F.lit(False))


_ABOUT = """case p_partkey % 8 when 0 then p_name when 1 then 'A GeoServer of ' || p_name when 2 then ' ' when 3 then ' GeoServer ' when 4 then p_name || ' GeoServer Web Feature Service ' || p_type
  when 5 then 'Supports all WFS operations including ' || p_type when 6 then 'QGIS Server, WFS of ' || p_name end"""


@register("boilerplate_text", f"""select p_partkey, coalesce(trim(lower(t)) in ({", ".join(f"'{x}'" for x in BOILERPLATE_TITLES)}) or regexp_matches(lower(t), '{"|".join(BOILERPLATE_PHRASES)}'), false) as boilerplate
  from (select p_partkey, {_ABOUT} as t from part) p""")
def boilerplate_text_q(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", boilerplate_text(F.expr(_ABOUT)).alias("boilerplate"))


#: Fixed values, a part: identifiers of the public SPDX list in common use for data and code; callers with the whole list pass it.
LICENSES = (
    "0BSD", "AAL", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "APSL-2.0", "Artistic-1.0", "Artistic-2.0",
    "BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "BUSL-1.0", "C-UDA-1.0", "CC-BY-1.0", "CC-BY-2.0", "CC-BY-2.5",
    "CC-BY-3.0", "CC-BY-3.0-AT", "CC-BY-3.0-DE", "CC-BY-3.0-IGO", "CC-BY-3.0-NL", "CC-BY-3.0-US", "CC-BY-4.0", "CC-BY-NC-1.0", "CC-BY-NC-2.0", "CC-BY-NC-2.5",
    "CC-BY-NC-3.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-3.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-3.0", "CC-BY-ND-4.0", "CC-BY-SA-2.0", "CC-BY-SA-2.5",
    "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-PDDC", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CDLA-Permissive-1.0", "CDLA-Permissive-2.0", "CDLA-Sharing-1.0", "CECILL-2.1",
    "CECILL-B", "CECILL-C", "DL-DE-BY-2.0", "DL-DE-ZERO-2.0", "ECL-2.0", "EFL-2.0", "EPL-1.0", "EPL-2.0", "etalab-2.0", "EUPL-1.1",
    "EUPL-1.2", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "HPND", "ISC", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL",
    "NCSA", "NLOD-1.0", "NLOD-2.0", "O-UDA-1.0", "ODbL-1.0", "ODC-By-1.0", "OFL-1.1", "OGC-1.0", "OGDL-Taiwan-1.0", "OGL-Canada-2.0",
    "OGL-UK-1.0", "OGL-UK-2.0", "OGL-UK-3.0", "OSL-3.0", "PDDL-1.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "SISSL", "TAPR-OHL-1.0",
    "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)


def license_gap(c, url, ids=LICENSES):
    """Why a licence id fails: missing, todo, deprecated, needs_url, misspelled, unknown; null if it is fine. ``ids``: the
    accepted identifiers."""
    t = F.trim(c)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "missing").when(F.upper(t).startswith("TODO"), "todo").when(t == "proprietary", "deprecated")
        .when((t == "other") & url.isNull(), "needs_url").when((t == "other") | t.isin(*ids), None).when(F.lower(t).isin(*[x.lower() for x in ids]), "misspelled").otherwise("unknown")
    )


_LICENSE = "case p_partkey % 10 when 0 then '' when 1 then 'todo: ask' when 2 then 'proprietary' when 3 then 'other' when 4 then 'MIT' when 5 then 'cc-by-4.0' when 6 then p_brand when 7 then ' EUPL-1.2 ' when 8 then 'various' end"
_LINK = "case when p_partkey % 20 < 10 then 'https://example.org/' || p_brand end"


@register("license_gap", f"""select p_partkey, case when coalesce(trim(c), '') = '' then 'missing' when upper(trim(c)) like 'TODO%' then 'todo' when trim(c) = 'proprietary' then 'deprecated' when trim(c) = 'other' and u is null then 'needs_url'
  when trim(c) = 'other' or trim(c) in ({", ".join(f"'{x}'" for x in LICENSES)}) then null when lower(trim(c)) in ({", ".join(f"'{x.lower()}'" for x in LICENSES)}) then 'misspelled' else 'unknown' end as gap
  from (select p_partkey, {_LICENSE} as c, {_LINK} as u from part) p""")
def license_gap_q(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", license_gap(F.expr(_LICENSE), F.expr(_LINK)).alias("gap"))


def derive_provenance(providers):
    """official when a producer is the single host (names case-folded), mirror when the host is another, null without one host."""
    hosts = F.filter(providers, lambda p: F.array_contains(p["roles"], "host"))
    makers = F.filter(providers, lambda p: F.array_contains(p["roles"], "producer"))
    same = F.exists(makers, lambda p: F.lower(p["name"]) == F.lower(hosts[0]["name"]))
    return F.when((F.size(hosts) == 1) & (F.size(makers) > 0), F.when(same, "official").otherwise("mirror"))


@register("derive_provenance", "select p_partkey, case p_partkey % 3 when 0 then 'official' when 1 then 'mirror' end as provenance from part")
def derive_provenance_q(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    who = lambda name, role: F.struct(name.alias("name"), F.array(F.lit(role)).alias("roles"))
    providers = F.array(who(F.upper("p_name"), "producer"), who(F.when(k == 0, F.col("p_name")).otherwise("Mirror Inc"), "host"), who(F.col("p_brand"), "host"))
    return _parts(spark, sf).select("p_partkey", derive_provenance(F.slice(providers, F.lit(1), F.when(k == 2, 3).otherwise(2))).alias("provenance"))


#: Patterns of addresses, identifiers, dates and links, and the roles a provider may have.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
DOI = r"^10\.\d{4,}/\S+$"
ORCID = r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
LINK = r"""^https?://[^\s<>"{}|\\^`\[\]]+$"""
ROLES = ("licensor", "producer", "processor", "host")

METADATA = """contact struct<name: string, email: string>, license string, license_url string, providers array<struct<name: string, roles: array<string>, url: string, email: string>>, doi string,
  defaults struct<year: bigint, start: string, end: string, nodata: array<double>>, authors array<struct<name: string, orcid: string, email: string>>, related_dois array<string>, citations array<string>, upstream_version_url string"""


def metadata_rules(m, ids=LICENSES):
    """Array of what is wrong with a record of the fields in METADATA (``m(name)`` gives a field's column), in their order.

    Required: contact with name and email, license. Optional, checked where given: providers (names, roles, at most one host, which
    has a link or an address), doi, defaults (year from 1800 to 2100 or a start, dates that exist, finite nodata), authors (names,
    ORCIDs, addresses), related DOIs, citations, the upstream version's link. ``ids``: the accepted licences.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    bad = lambda c, p: ~blank(c) & ~c.rlike(p)
    say = lambda i, what: F.concat(F.lit(what[0]), i.cast("string"), F.lit(what[1]))
    some = lambda *whens: F.array_compact(F.array(*whens))
    every = lambda c, f: F.coalesce(F.flatten(F.transform(c, f)), F.array().cast("array<string>"))

    contact, email = m("contact"), m("contact")["email"]
    none = contact.isNull()
    first = some(
        F.when(none, "contact missing"), F.when(~none & blank(contact["name"]), "contact.name empty"), F.when(~none & blank(email), "contact.email empty"), F.when((email != "") & ~email.rlike(EMAIL), "contact.email format"),
        F.when(m("license").isNull(), "license missing").when(blank(m("license")), "license empty").otherwise(F.concat(F.lit("license "), license_gap(m("license"), F.nullif(m("license_url"), F.lit("")), ids))))

    def provider(p, i):
        unknown = F.transform(F.filter(F.coalesce(p["roles"], F.array().cast("array<string>")), lambda r: ~F.coalesce(r.isin(*ROLES), F.lit(False))), lambda r: F.concat(say(i, ("providers[", "].roles ")), F.coalesce(r, F.lit("null"))))
        return F.concat(some(F.when(p.isNull(), say(i, ("providers[", "] no mapping"))).when(p["name"].isNull(), say(i, ("providers[", "].name missing"))).when(blank(p["name"]), say(i, ("providers[", "].name empty")))), unknown)

    is_host = lambda p: F.coalesce(F.array_contains(p["roles"], "host"), F.lit(False))
    hosts = F.coalesce(F.size(F.filter(m("providers"), is_host)), F.lit(0))
    reach = lambda p, i: some(F.when(is_host(p) & blank(p["url"]) & blank(p["email"]), say(i, ("providers[", "] unreachable host"))), F.when(is_host(p) & bad(p["email"], EMAIL), say(i, ("providers[", "].email format"))))

    d = m("defaults")
    day = lambda f: F.when(d[f].isNotNull() & ~d[f].rlike(ISO_DATE), f"defaults.{f} format").when(d[f].isNotNull() & F.try_to_date(d[f], "yyyy-MM-dd").isNull(), f"defaults.{f} no date")
    finite = lambda x, i: some(F.when(F.isnan(x) | (F.abs(x) == float("inf")), say(i, ("defaults.nodata[", "] not finite"))))
    rest = some(F.when(bad(m("doi"), DOI), "doi format"))
    defaults = some(F.when((d["year"] < 1800) | (d["year"] > 2100), "defaults.year range"), day("start"), day("end"), F.when(d["year"].isNotNull() & d["start"].isNotNull(), "defaults.year and start"), F.when(F.size(d["nodata"]) == 0, "defaults.nodata empty"))
    author = lambda a, i: some(
        F.when(a.isNull(), say(i, ("authors[", "] none"))).when(a["name"].isNull(), say(i, ("authors[", "].name missing"))).when(blank(a["name"]), say(i, ("authors[", "].name empty"))),
        F.when(bad(a["orcid"], ORCID), say(i, ("authors[", "].orcid format"))), F.when(bad(a["email"], EMAIL), say(i, ("authors[", "].email format"))))
    listed = lambda f, p: lambda x, i: some(F.when(x.isNull(), say(i, (f"{f}[", "] no text"))).when(F.trim(x) == "", say(i, (f"{f}[", "] empty"))).when(bad(x, p), say(i, (f"{f}[", "] format"))))
    link = m("upstream_version_url")
    last = some(F.when(F.trim(link) == "", "upstream_version_url empty").when(bad(link, LINK), "upstream_version_url format"))
    return F.concat(
        first, every(m("providers"), provider), some(F.when(hosts > 1, "providers several hosts")), every(m("providers"), reach), rest, defaults, every(d["nodata"], finite),
        every(m("authors"), author), every(m("related_dois"), listed("related_dois", DOI)), every(m("citations"), listed("citations", "(?s).*")), last)


_RECORD = """to_json(named_struct(
  'contact', case when p_partkey % 11 = 0 then null else named_struct('name', case when p_partkey % 7 = 0 then ' ' else p_name end, 'email', case p_partkey % 5 when 0 then 'a@b' when 1 then '' else 'a@b.org' end) end,
  'license', case p_partkey % 4 when 0 then 'CC-BY-4.0' when 1 then null when 2 then 'other' else 'mit' end, 'license_url', case when p_partkey % 8 = 2 then 'https://x.org' end,
  'providers', case p_partkey % 6 when 0 then array(named_struct('name', p_name, 'roles', array('host', 'maker'), 'url', '', 'email', null)) when 1 then array(named_struct('name', '', 'roles', array('host'), 'url', 'https://x.org', 'email', 'no'), named_struct('name', 'b', 'roles', array('host', 'producer'), 'url', null, 'email', 'b@b.org')) end,
  'doi', case p_partkey % 3 when 0 then '10.1234/x y' when 1 then '10.5281/z.1' end,
  'defaults', case p_partkey % 9 when 0 then named_struct('year', 1700, 'start', '2024-01-02', 'end', '2024-02-30', 'nodata', array()) when 1 then named_struct('year', null, 'start', '2024', 'end', '2024-12-31', 'nodata', array(0.0, 'NaN')) end,
  'authors', case when p_partkey % 10 = 3 then array(named_struct('name', null, 'orcid', '0000-0002-1825-0097', 'email', 'x'), named_struct('name', ' ', 'orcid', '0000', 'email', ' ')) end,
  'related_dois', case when p_partkey % 10 = 4 then array('10.1/x', '', '10.1234/ok') end, 'citations', case when p_partkey % 10 = 5 then array('c', ' ') end,
  'upstream_version_url', case p_partkey % 12 when 0 then ' ' when 1 then 'ftp://x' when 2 then 'https://x.org/v1' end))"""


def _metadata_sql() -> str:
    """The oracle: the rules applied to the same cases, one condition a line, joined in their order."""
    k = "p_partkey"
    rows = [
        (f"{k} % 11 = 0", "contact missing"), (f"{k} % 11 <> 0 and {k} % 7 = 0", "contact.name empty"), (f"{k} % 11 <> 0 and {k} % 5 = 1", "contact.email empty"), (f"{k} % 11 <> 0 and {k} % 5 = 0", "contact.email format"),
        (f"{k} % 4 = 1", "license missing"), (f"{k} % 4 = 2 and {k} % 8 <> 2", "license needs_url"), (f"{k} % 4 = 3", "license misspelled"),
        (f"{k} % 6 = 1", "providers[0].name empty"), (f"{k} % 6 = 0", "providers[0].roles maker"), (f"{k} % 6 = 1", "providers several hosts"), (f"{k} % 6 = 0", "providers[0] unreachable host"), (f"{k} % 6 = 1", "providers[0].email format"),
        (f"{k} % 3 = 0", "doi format"), (f"{k} % 9 = 0", "defaults.year range"), (f"{k} % 9 = 1", "defaults.start format"), (f"{k} % 9 = 0", "defaults.end no date"), (f"{k} % 9 = 0", "defaults.year and start"), (f"{k} % 9 = 0", "defaults.nodata empty"), (f"{k} % 9 = 1", "defaults.nodata[1] not finite"),
        (f"{k} % 10 = 3", "authors[0].name missing"), (f"{k} % 10 = 3", "authors[0].email format"), (f"{k} % 10 = 3", "authors[1].name empty"), (f"{k} % 10 = 3", "authors[1].orcid format"),
        (f"{k} % 10 = 4", "related_dois[0] format"), (f"{k} % 10 = 4", "related_dois[1] empty"), (f"{k} % 10 = 5", "citations[1] empty"), (f"{k} % 12 = 0", "upstream_version_url empty"), (f"{k} % 12 = 1", "upstream_version_url format"),
    ]
    return "select p_partkey, concat_ws(', ', " + ", ".join(f"case when {c} then '{t}' end" for c, t in rows) + ") as errors from part"


@register("metadata_rules", _metadata_sql())
def metadata_rules_q(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as JSON text and read with their schema, as files of records are."""
    record = F.from_json(F.expr(_RECORD.replace("array(0.0, 'NaN')", "array(0.0D, double('NaN'))").replace("'nodata', array())", "'nodata', cast(array() as array<double>))")), METADATA)
    rows = _parts(spark, sf).select("p_partkey", record.alias("m"))
    return rows.select("p_partkey", F.array_join(metadata_rules(lambda f: F.col("m")[f]), ", ").alias("errors"))


def safe_path(c, base: str):
    """'traversal' where a path, resolved against an absolute folder (or from the root), lies outside it; null if it is fine."""
    inside = lambda p: F.concat(F.lit("/"), T.resolve_href(F.lit(""), p))
    root = "/" + base.strip("/")
    full = inside(F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(root + "/"), c)))
    return F.when(~((full == root) | full.startswith(root.rstrip("/") + "/")), "traversal")


def item_id_problem(c):
    """Why an item id is refused: empty, control, query, encoded, separator; null if it is fine."""
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "empty").when(c.rlike(r"[\x00-\x1f]"), "control").when(c.rlike("[?#]"), "query").when(c.contains("%"), "encoded").when(c.contains("..") | c.rlike(r"[/\\]"), "separator")
    )


def remote_url_problem(c):
    """Why a remote URL is refused: empty, scheme, host, traversal, control; null if it is fine."""
    scheme, rest = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(rest, "^//[^/?#]*", ""), "(?s)[?#].*$", "")
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "empty").when(~scheme.isin("s3", "gs", "az", "http", "https"), "scheme").when(host == "", "host").when(path.contains(".."), "traversal").when(c.rlike(r"[\x00-\x1f]"), "control")
    )


_PATHS = """case p_partkey % 8 when 0 then concat('a/../', p_brand) when 1 then concat('../', p_brand) when 2 then concat('/data/base/', p_brand) when 3 then concat('/data/basement/', p_brand) when 4 then concat('../base/', p_brand) when 5 then concat('a/../../', p_brand, '/x') when 6 then 'x/..' else p_name end"""
_ITEMS = """case p_partkey % 8 when 0 then '' when 1 then concat(p_type, chr(9)) when 2 then concat(p_type, '?a=1') when 3 then concat('%2e', p_type) when 4 then concat(p_type, '/x') when 5 then concat('v1..', p_type) when 6 then concat(p_type, '.v1 2024') end"""
_URLS = """case p_partkey % 9 when 0 then '' when 1 then concat('s3://', p_type, '/a') when 2 then concat('ftp://', p_type) when 3 then 'https:///x' when 4 then concat('gs://', p_type, '/../a') when 5 then concat('HTTPS://x.org/', p_type, '?a=..#b') when 6 then concat('az://c/', chr(10), p_type) when 7 then p_name end"""


@register("safe_path", """select p_partkey, case when p_partkey % 8 in (1, 3, 5) then 'traversal' end as path, case p_partkey % 8 when 0 then 'empty' when 1 then 'control' when 2 then 'query' when 3 then 'encoded' when 4 then 'separator' when 5 then 'separator' when 7 then 'empty' end as item,
  case p_partkey % 9 when 0 then 'empty' when 2 then 'scheme' when 3 then 'host' when 4 then 'traversal' when 6 then 'control' when 7 then 'scheme' when 8 then 'empty' end as url from part""")
def safe_path_q(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", safe_path(F.expr(_PATHS), "/data/base").alias("path"), item_id_problem(F.expr(_ITEMS)).alias("item"), remote_url_problem(F.expr(_URLS)).alias("url"))
