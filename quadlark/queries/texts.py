"""File names, URL templates, text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as tx, tiles as t
from . import query
from .index import _A, KEY, a

_NAME = "lod || '-' || x || '-' || y"


@query("tile_filename", f"select lod, x, y, lod || '-' || lpad(cast(x as varchar), 7, '0') || '-' || lpad(cast(y as varchar), 7, '0') || '.bin' as padded, {_NAME} || '.meta' as plain, {_NAME} || '-1.jpg' as part from {_A} a")
def tile_filename(spark, d):
    return a(spark, d).select(*KEY, tx.padded_filename(*KEY, "mesh").alias("padded"), tx.filename(*KEY, "meta").alias("plain"), tx.filename(*KEY, "atlas", F.lit(1)).alias("part"))


_MADE = f"(select case when (x + y) % 5 = 0 then '0' else '' end || {_NAME} || case when (x + y) % 3 = 0 then '-2' else '' end || case when y % 2 = 0 then '.jpg' else '.bin' end as name from {_A} a)"


@query("parse_filename", "select name, case when f then cast(regexp_extract(name, p, 1) as int) end as lod, case when f then cast(regexp_extract(name, p, 2) as bigint) end as x, case when f then cast(regexp_extract(name, p, 3) as bigint) end as y, case when f and regexp_extract(name, p, 4) <> '' then cast(regexp_extract(name, p, 4) as int) end as part, case when f then regexp_extract(name, p, 5) end as ext from (select name, p, regexp_matches(name, p) and ((regexp_extract(name, p, 5) = 'jpg') = (regexp_extract(name, p, 4) <> '')) as f from (select name, '" + tx.FILE_PATTERN + f"' as p from {_MADE} m) q) r")
def parse_filename(spark, d):
    made = F.concat(F.when((F.col("x") + F.col("y")) % 5 == 0, "0").otherwise(""), F.concat_ws("-", *KEY), F.when((F.col("x") + F.col("y")) % 3 == 0, "-2").otherwise(""), F.when(F.col("y") % 2 == 0, ".jpg").otherwise(".bin"))
    return a(spark, d).select(made.alias("name")).select("name", *(c.alias(n) for n, c in tx.parsed_filename(F.col("name")).items()))


_M = "4294967295"


def _hash_sql(v: str) -> str:
    step = lambda h: f"((xor(({h}) >> 16, {h}) * 73244475) & {_M})"
    h = step(step(f"(({v}) & {_M})"))
    return f"xor(({h}) >> 16, {h})"


_HASHED = f"(select *, {_hash_sql('cast(lod as bigint) + x + y')} as h from {_A} a)"


@query("url_alt", f"select lod, x, y, h as hash, case h % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' else 'd' end as host from {_HASHED} q")
def url_alt(spark, d):
    return a(spark, d).select(*KEY, tx.id_hash(*KEY).alias("hash"), tx.alternative(*KEY, ["a", "b", "c", "d"]).alias("host"))


@query("url_pp", f"select lod, x, y, lpad(lower(to_hex(x << (28 - lod))), 7, '0') as ppx, lpad(lower(to_hex(((cast(1 as bigint) << lod) - 1 - y) << (28 - lod))), 7, '0') as ppy from {_A} a")
def url_pp(spark, d):
    return a(spark, d).select(*KEY, tx.ppx("lod", "x").alias("ppx"), tx.ppy("lod", "y").alias("ppy"))


_QUAD = " || ".join(f"case when lod >= {i} then cast(((x >> greatest(lod - {i}, 0)) & 1) + 2 * ((y >> greatest(lod - {i}, 0)) & 1) as varchar) else '' end" for i in range(1, 9))


@query("quadkey", f"select lod, x, y, {_QUAD} as quad, cast(2 * (y & 3) + (x & 1) as int) as digit from {_A} a")
def quadkey(spark, d):
    return a(spark, d).select(*KEY, t.quadkey(*KEY).alias("quad"), tx.ms_digit("x", "y").alias("digit"))


@query("url_template", f"select lod, x, y, 'http://' || case h % 2 when 0 then 's1' else 's2' end || '.example/m/' || lod || '/' || (x & 7) || '-' || y || '.bin?' || 'unknown' || '&sub=0&' || {_QUAD} as url from {_HASHED} q")
def url_template(spark, d):
    """A template compiled on the driver; an unknown directive loses its braces."""
    tile = {"lod": F.col("lod"), "x": F.col("x"), "y": F.col("y"), "loclod": F.col("lod"), "locx": F.col("x").bitwiseAND(7), "locy": F.col("y"), "sub": F.lit(0)}
    url = tx.template("http://{alt(s1,s2)}.example/m/{lod}/{locx}-{y}.bin?{unknown}&sub={sub}&{quad}", tile)
    return a(spark, d).select(*KEY, url.alias("url"))


@query("url_switch", "select n_nationkey, case n_regionkey when 0 then 'zero' when 2 then 'two' else 'other' end || '/' || replace(n_name, ' ', '%20') as url from nation")
def url_switch(spark, d):
    tile = {"lod": F.lit(0), "x": F.lit(0), "y": F.lit(0), "rf": F.col("n_regionkey")}
    url = tx.template("{switch(rf,0:zero,2:two,*:other)}/{param(0)}", tile, [F.col("n_name")])
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", url.alias("url"))


_CRC = "list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(name, ''), lambda c: cast(ascii(c) as bigint))), lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda s, k: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end))"


@query("archive_dir", f"select name, lpad(lower(to_hex(xor({_CRC}, 4294967295) >> 24)), 2, '0') as dir from (select distinct lod || '-' || (x >> 5) || '-' || (y >> 5) as name from {_A} a) t")
def archive_dir(spark, d):
    name = F.concat_ws("-", "lod", t.shr("x", 5).cast("string"), t.shr("y", 5).cast("string"))
    return a(spark, d).select(name.alias("name")).distinct().withColumn("dir", tx.archive_dir(F.col("name")))


@query("position_text", "select c_custkey, 'obj,' || c_custkey || ',' || c_nationkey || ',fix,' || (c_custkey % 90) || ',0,-90,0,1000,55' as position, list_aggregate(list_sort(list_distinct(list_filter(list_transform(string_split('b, ' || c_nationkey || ',,a', ','), lambda c: trim(c)), lambda c: c <> ''))), 'string_agg', '|') as credits from customer")
def position_text(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    text = tx.position_text(F.lit("obj"), [F.col("c_custkey"), F.col("c_nationkey"), F.lit("fix"), F.col("c_custkey") % 90, *map(F.lit, (0, -90, 0, 1000, 55))])
    credits = tx.parsed_credits(F.concat(F.lit("b, "), F.col("c_nationkey").cast("string"), F.lit(",,a")))
    return c.select("c_custkey", text.alias("position"), F.array_join(credits, "|").alias("credits"))


_LOC = "case n_nationkey % 5 when 0 then '@TOP' when 1 then '@BOTTOM' when 2 then '-' || n_name when 3 then '+' || n_name else n_name end"


@query("location_parse", f"select loc, case when loc = '@TOP' or starts_with(loc, '-') then 'below' when loc = '@BOTTOM' or starts_with(loc, '+') then 'above' end as direction, case when starts_with(loc, '-') or starts_with(loc, '+') then substr(loc, 2) when loc in ('@TOP', '@BOTTOM') then '' end as location from (select {_LOC} as loc from nation) q")
def location_parse(spark, d):
    n = fx.sql(spark, d, f"select {_LOC} as loc from nation")
    return n.select("loc", *(c.alias(k) for k, c in tx.location(F.col("loc")).items()))


@query("glue_path", "select r_regionkey, string_agg(n_name, '_' order by n_nationkey) as path, max(r_name) || '@' || cast(count(*) as varchar) as version from nation join region on n_regionkey = r_regionkey group by 1")
def glue_path(spark, d):
    n = fx.sql(spark, d, "select r_regionkey, r_name, n_nationkey, n_name from nation join region on n_regionkey = r_regionkey")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"])
    g = n.groupBy("r_regionkey").agg(ids.alias("ids"), F.max("r_name").alias("base"), F.count("*").alias("n"))
    return g.select("r_regionkey", tx.glue_path(F.col("ids")).alias("path"), tx.version_id(F.col("base"), F.col("n")).alias("version"))
