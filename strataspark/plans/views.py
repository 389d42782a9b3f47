"""Tables and derived views that queries run on.

The driver tables hold no geometry, versions or files, so views derive them by arithmetic on keys. A view's SQL is the same
text in Spark and in the oracle's engine, but for hashing and array explosion.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name: (tables or views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "points": (("orders", "customer"), """
        select o_orderkey as id, c_mktsegment as collection, ((o_orderkey * 7919) % 36000) / 100.0e0 - 180 as lon,
               ((o_custkey * 104729) % 17000) / 100.0e0 - 85 as lat, o_orderdate as ts, o_totalprice as price
        from {orders} join {customer} on o_custkey = c_custkey"""),
    "items": (("lineitem",), """
        select l_orderkey, cast(l_linenumber as bigint) as ln, cast(collection as bigint) as collection, lon, lat,
               case when lon - w < -180 then lon - w + 360 else lon - w end as xmin, lat - w as ymin,
               case when lon + w > 180 then lon + w - 360 else lon + w end as xmax,
               case when l_linenumber = 7 then 95.0e0 else lat + w end as ymax, ts
        from (select l_orderkey, l_linenumber, min(l_suppkey) % 20 as collection, ((l_orderkey * 7919) % 36000) / 100.0e0 - 180 as lon,
                     ((min(l_partkey) * 104729) % 17000) / 100.0e0 - 85 as lat, max(l_quantity) / 20 as w, min(l_shipdate) as ts
              from {lineitem} group by l_orderkey, l_linenumber) b"""),
    "assets": (("lineitem",), """
        select cast(l_suppkey % 20 as bigint) as collection, concat('asset_', cast(l_partkey % 50 as string)) as asset, cast(l_linenumber as bigint) as ord,
               concat('1.', cast(l_linenumber - 1 as string), '.0') as version,
               sha2(concat_ws('|', cast(l_partkey % 50 as string), cast(cast(floor(max(l_quantity) / 25) as bigint) as string)), 256) as sha256,
               cast(max(l_orderkey) * 10 as bigint) as size_bytes, min(l_returnflag) = 'R' as removed
        from {lineitem} group by l_suppkey % 20, l_partkey % 50, l_linenumber"""),
    "local": (("assets",), "select * from {assets} where ord <= 4"),
    "remote": (("assets",), "select * from {assets} where ord >= 2"),
    "files": (("events",), """
        select path, regexp_replace(path, '/[^/]*$', '') as dir, regexp_replace(path, '^.*/', '') as name, regexp_replace(regexp_replace(path, '^.*/', ''), '[.][^.]*$', '') as stem,
               regexp_replace(path, '^.*[.]', '') as ext, split_part(path, '/', 1) as collection, size_bytes, mtime
        from (select path, max(event_id % 5000) as size_bytes, max(event_id * 0.5e0) as mtime
              from (select event_id, concat('c', cast(user_id % 7 as string), case when user_id % 3 = 0 then '' else concat('/i', cast(user_id % 11 as string)) end, '/', event_type, '_', cast(event_id % 23 as string), '.',
                       split_part('parquet,geojson,shp,dbf,shx,tif,csv,json,txt,zip', ',', cast(event_id % 10 as int) + 1)) as path from {events}) e
              group by path) f"""),
    "stored": (("files",), """
        select path, dir, name, collection, case when size_bytes % 4 = 0 then size_bytes + 1 else size_bytes end as size_bytes, case when size_bytes % 3 = 0 then mtime - 10 else mtime end as mtime
        from {files} where size_bytes % 10 <> 1 union all
        select concat(path, '.gone') as path, dir, concat(name, '.gone') as name, collection, size_bytes, mtime from {files} where size_bytes % 10 = 2"""),
    "schemas": (("part",), """
        select p_brand as table_name, cast(p_size % 3 as bigint) as version, p_type as element,
               case min(p_partkey) % 3 when 0 then 'int64' when 1 then 'float64' else 'string' end as dtype, min(p_partkey) % 2 = 0 as nullable,
               case when min(p_partkey) % 5 = 0 then 'EPSG:3857' else 'EPSG:4326' end as crs, case when min(p_partkey) % 11 = 0 then 'Polygon' else 'Point' end as geometry_type,
               case when min(p_partkey) % 4 = 0 then cast('nan' as double) when min(p_partkey) % 4 = 1 then null else cast(min(p_partkey) % 4 as double) end as nodata
        from {part} group by p_brand, p_type, p_size % 3 having min(p_partkey) % 7 <> 0"""),
    "pixels": (("embeddings",), "select vec_id as image, cast(label as bigint) as band, cast(p + 1 as bigint) as idx, cast(x as double) as value from {embeddings} lateral view posexplode(embedding) e as p, x"),
}
_DUCK = {"pixels": "select vec_id as image, cast(label as bigint) as band, cast(generate_subscripts(embedding, 1) as bigint) as idx, cast(unnest(embedding) as double) as value from embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a derived view, as a lazy DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    needs, sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in needs})


def sql(views: str, body: str) -> str:
    """Oracle SQL: the views (separated by spaces, with what they need) as CTEs before ``body``; a body that starts with a
    comma adds CTEs of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in VIEWS[name][0]:
            if n in VIEWS:
                add(n)
        if name not in order:
            order.append(name)

    for v in views.split():
        add(v)
    parts = []
    for v in order:
        text = _DUCK.get(v) or re.sub(r"\{(\w+)\}", r"\1", VIEWS[v][1])
        parts.append(f"{v} as ({re.sub(r'sha2[(](.*), 256[)]', r'sha256(\1)', text)})")
    return "with " + ", ".join(parts) + (body if body.lstrip().startswith(",") else " " + body)
