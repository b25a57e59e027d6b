"""Tile tables derived from the driver's tables. The same SQL text runs in Spark and in the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _grid(lod: str, x: str, y: str) -> str:
    mask = f"((cast(1 as bigint) << {lod}) - 1)"
    return f"{lod} as lod, cast({x} as bigint) & {mask} as x, cast({y} as bigint) & {mask} as y"


_A = _grid("cast(5 + (l_linenumber & 3) as int)", "l_partkey", "l_orderkey")
_B = _grid("cast(4 + (o_orderkey & 3) as int)", "o_custkey", "(o_orderkey >> 2)")

#: Multi-LOD index of dense and sparse levels.
A = f"""select lod, x, y, cast(bit_or(f) as bigint) as flags from (
  select {_A}, cast(1 | case when l_returnflag = 'R' then 2 else 0 end | case when l_linestatus = 'O' then 4 else 0 end
    | case when l_quantity > 45 then 8 else 0 end as bigint) as f
  from lineitem where l_quantity > 40) a_rows group by lod, x, y"""

#: Multi-LOD index over other levels; its first level is full at sf0.01.
B = f"""select lod, x, y, cast(bit_or(f) as bigint) as flags from (
  select {_B}, cast(1 | case when o_orderstatus = 'F' then 2 else 0 end as bigint) as f from orders) b_rows group by lod, x, y"""

#: Stack of layers: position, tileset, tag and tiles at one LOD; 32 is the alien bit.
C = """select pos, tileset, tag, 6 as lod, x, y, cast(bit_or(f) as bigint) as flags from (
  select c_nationkey as pos, n_name as tileset, r_name as tag, c_custkey & 63 as x, (c_custkey >> 3) & 63 as y,
    cast(1 | case when c_acctbal > 5000 then 2 else 0 end | case when c_mktsegment = 'BUILDING' then 32 else 0 end as bigint) as f
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) c_rows
  group by pos, tileset, tag, x, y"""

#: Height raster.
D = """select l_partkey & 127 as px, l_orderkey & 127 as py, max(l_extendedprice) as h from lineitem where l_linenumber = 1 group by 1, 2"""

#: Metanodes over A.
F = f"""select lod, x, y, cast(flags & 15 as bigint) as flags, cast(0.5 + (flags & 7) as double) as texel, cast((x + y) % 5 as int) as credit,
  cast(x as double) as zmin, cast(x + y as double) as zmax from ({A}) f_a"""

#: Reference-frame nodes: a manual root over two bisection roots and two empty ones.
G = """select * from (values
  (0, cast(0 as bigint), cast(0 as bigint), 'r', cast(-180.0 as double), cast(-90.0 as double), cast(180.0 as double), cast(90.0 as double), 'manual', 3, cast(null as double), cast(null as double), cast(null as double), cast(null as double)),
  (1, cast(0 as bigint), cast(0 as bigint), 'a', cast(-180.0 as double), cast(-90.0 as double), cast(0.0 as double), cast(90.0 as double), 'bisection', 0, cast(-170.0 as double), cast(-60.0 as double), cast(-5.0 as double), cast(60.0 as double)),
  (1, cast(1 as bigint), cast(0 as bigint), 'b', cast(0.0 as double), cast(-90.0 as double), cast(180.0 as double), cast(90.0 as double), 'bisection', 0, cast(10.0 as double), cast(-60.0 as double), cast(170.0 as double), cast(60.0 as double)),
  (1, cast(0 as bigint), cast(1 as bigint), '', cast(null as double), cast(null as double), cast(null as double), cast(null as double), 'none', 0, cast(null as double), cast(null as double), cast(null as double), cast(null as double)),
  (1, cast(1 as bigint), cast(1 as bigint), '', cast(null as double), cast(null as double), cast(null as double), cast(null as double), 'none', 0, cast(null as double), cast(null as double), cast(null as double), cast(null as double))
  ) g(lod, x, y, srs, llx, lly, urx, ury, mode, child_flags, c_llx, c_lly, c_urx, c_ury)"""

#: Points.
H = "select c_custkey as id, c_custkey * 360.0e0 / 1500 - 180 as px, c_acctbal / 100.0e0 as py from customer"

#: Tile boxes, one for each order.
BOXES = """select o_orderkey as id, cast(6 as int) as lod, o_custkey & 31 as x0, (o_orderkey >> 1) & 31 as y0,
  (o_custkey & 31) + (o_orderkey & 7) as x1, ((o_orderkey >> 1) & 31) + (o_custkey & 3) as y1 from orders"""

#: Mesh faces: seven triangles for each embedding.
_V = "cast({c}[{i}] as double)"


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs a text over the tables it names, read from sf_dir."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    named = re.sub(rf"\b(from|join)\s+({'|'.join(TABLES)})\b", r"\1 {\2}", text.replace("{", "{{").replace("}", "}}"))
    return spark.sql(named, **frames)


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mesh, f, x0..z2, surface): seven triangles of consecutive float triples for each embedding."""
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("f"))
    at = lambda k: F.element_at("embedding", F.col("f") * 9 + k + 1).cast("double")
    return rows.select(F.col("vec_id").alias("mesh"), "f", *(at(k).alias(f"{'xyz'[k % 3]}{k // 3}") for k in range(9)), (F.col("label") + 1).alias("surface"))


FACES = "select vec_id as mesh, f, " + ", ".join(f"cast(embedding[f * 9 + {k + 1}] as double) as {'xyz'[k % 3]}{k // 3}" for k in range(9)) + ", label + 1 as surface from embeddings, (select cast(unnest(range(7)) as int) as f) fs"
