"""Structure operators on the driver's tables.

The first three numbers of an embedding, times 10, are a point's coordinates, the label its chain and vec_id the atom;
further triples are further models. Line items in order are atoms; part and supplier of a line item are bonded.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import geometry as g
from strandlake.operators import bonds, compare, encodings, filters, segments, spatial, trees
from strandlake.plans import search
from strandlake.plans.registry import query, table

BOX = [[3.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 5.0]]


def points(spark: SparkSession, sf_dir: str, model: int = 0) -> DataFrame:
    e = F.col("embedding")
    xyz = [(F.get(e, F.lit(3 * model + i)).cast("double") * 10).alias(c) for i, c in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("atom_idx"), F.col("label").cast("long").alias("chain_id"), F.floor(F.col("vec_id") / 4).alias("res_id"), *xyz)


def _p(name: str = "p", model: int = 0) -> str:
    xyz = ", ".join(f"embedding[{3 * model + i + 1}]::DOUBLE * 10 AS {c}" for i, c in enumerate("xyz"))
    return f"{name} AS (SELECT vec_id AS atom_idx, label::BIGINT AS chain_id, vec_id // 4 AS res_id, {xyz} FROM embeddings)"


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
LINES = ", ".join(LINE)


# Segments -------------------------------------------------------------------------------


@query(
    """SELECT user_id, event_id, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS is_start FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def segment_starts(spark, sf_dir):
    return segments.with_starts(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "is_start")


@query(
    """SELECT user_id, event_id, (sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS segment
FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
)
def segment_positions(spark, sf_dir):
    return segments.with_positions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "segment")


_SEGMENTS = """s AS (SELECT *, (sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS segment
FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


@query(f"WITH {_SEGMENTS} SELECT user_id, segment, round(sum(value), 4)::DOUBLE AS total, count(*) AS n FROM s GROUP BY 1, 2")
def segment_apply(spark, sf_dir):
    rows = segments.with_positions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return segments.apply(rows, ["user_id"], F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query(f"WITH {_SEGMENTS} SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, segment), 4)::DOUBLE AS total FROM s")
def segment_spread(spark, sf_dir):
    rows = segments.with_positions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    sums = segments.apply(rows, ["user_id"], F.round(F.sum("value"), 4).alias("total"))
    return segments.spread(rows, sums, ["user_id"]).select("event_id", "total")


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_linestatus IS DISTINCT FROM lag(l_linestatus) OVER w OR coalesce(l_partkey < lag(l_partkey) OVER w, false) OR row_number() OVER w = 1) AS is_start
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {LINES})"""
)
def chain_starts_continuous(spark, sf_dir):
    rows = segments.with_starts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE, ["l_linestatus"], ["l_partkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_start")


# Filters and integrity ------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY {LINES}) AS step FROM lineitem) WHERE step NOT IN (0, 1)")
def discontinuities(spark, sf_dir):
    return filters.discontinuities(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE, "l_linenumber", steps=(0, 1)).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    f"""WITH {_p()} SELECT atom_idx, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2) BETWEEN 1.0 AND 2.0, true) AS continuous
FROM p WINDOW w AS (PARTITION BY chain_id ORDER BY atom_idx)"""
)
def linear_continuity(spark, sf_dir):
    return filters.linear_continuity(points(spark, sf_dir), ["chain_id"], ["atom_idx"], ("x", "y", "z"), 1.0, 2.0).select("atom_idx", "continuous")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINES}) AS n FROM lineitem) WHERE n > 1")
def duplicate_rows(spark, sf_dir):
    return filters.duplicates(table(spark, sf_dir, "lineitem"), [], LINE, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (SELECT *, first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY {LINES}) AS f FROM lineitem) WHERE l_returnflag = f"""
)
def altloc_first(spark, sf_dir):
    rows = filters.first_altloc(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE, "l_returnflag")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query(
    """WITH s AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_orderkey, l_returnflag FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_returnflag) = 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem JOIN b USING (l_orderkey, l_returnflag)"""
)
def altloc_occupancy(spark, sf_dir):
    rows = filters.highest_occupancy_altloc(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 5000)")
def intersection_semi(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation")
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").withColumnRenamed("s_nationkey", "nation")
    return filters.intersection(c, s, ["nation"]).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 4)")
def polymer_filter(spark, sf_dir):
    return filters.polymer(table(spark, sf_dir, "lineitem"), [], "l_orderkey", "l_linenumber", 4).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS new_id FROM orders")
def continuous_residue_ids(spark, sf_dir):
    return segments.continuous_ids(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "new_id")


# Geometry -------------------------------------------------------------------------------


def _neighbours(spark, sf_dir):
    w = Window.partitionBy("chain_id").orderBy("atom_idx")
    rows = points(spark, sf_dir)
    for k in (1, 2, 3):
        for c in "xyz":
            rows = rows.withColumn(f"{c}{k}", F.lead(c, k).over(w))
    return rows


_LEADS = ", ".join(f"lead({c}, {k}) OVER w AS {c}{k}" for k in (1, 2, 3) for c in "xyz")
_N = f"{_p()}, n AS (SELECT *, {_LEADS} FROM p WINDOW w AS (PARTITION BY chain_id ORDER BY atom_idx))"


@query(f"WITH {_N} SELECT atom_idx, round(sqrt((x - x1)**2 + (y - y1)**2 + (z - z1)**2), 6)::DOUBLE AS dist FROM n WHERE x1 IS NOT NULL")
def distances(spark, sf_dir):
    a, b = g.vector("x", "y", "z"), g.vector("x1", "y1", "z1")
    return _neighbours(spark, sf_dir).where("x1 IS NOT NULL").select("atom_idx", F.round(g.distance(a, b), 6).alias("dist"))


@query(
    f"""WITH {_N} SELECT atom_idx, round(acos(greatest(-1.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1) + (z - z1) * (z2 - z1)) /
(sqrt((x - x1)**2 + (y - y1)**2 + (z - z1)**2) * sqrt((x2 - x1)**2 + (y2 - y1)**2 + (z2 - z1)**2))))), 5)::DOUBLE AS angle FROM n WHERE x2 IS NOT NULL"""
)
def angles(spark, sf_dir):
    a, b, c = g.vector("x", "y", "z"), g.vector("x1", "y1", "z1"), g.vector("x2", "y2", "z2")
    return _neighbours(spark, sf_dir).where("x2 IS NOT NULL").select("atom_idx", F.round(g.angle(a, b, c), 5).alias("angle"))


@query(
    f"""WITH {_N}, v AS (SELECT atom_idx, x1 - x AS ux, y1 - y AS uy, z1 - z AS uz, x2 - x1 AS vx, y2 - y1 AS vy, z2 - z1 AS vz, x3 - x2 AS wx, y3 - y2 AS wy, z3 - z2 AS wz FROM n WHERE x3 IS NOT NULL),
c AS (SELECT *, uy * vz - uz * vy AS ax, uz * vx - ux * vz AS ay, ux * vy - uy * vx AS az, vy * wz - vz * wy AS bx, vz * wx - vx * wz AS by_, vx * wy - vy * wx AS bz FROM v)
SELECT atom_idx, round(atan2(((ay * bz - az * by_) * vx + (az * bx - ax * bz) * vy + (ax * by_ - ay * bx) * vz) / sqrt(vx * vx + vy * vy + vz * vz), ax * bx + ay * by_ + az * bz), 5)::DOUBLE AS dihedral FROM c"""
)
def dihedrals(spark, sf_dir):
    a, b, c, d = g.vector("x", "y", "z"), g.vector("x1", "y1", "z1"), g.vector("x2", "y2", "z2"), g.vector("x3", "y3", "z3")
    return _neighbours(spark, sf_dir).where("x3 IS NOT NULL").select("atom_idx", F.round(g.dihedral(a, b, c, d), 5).alias("dihedral"))


@query(f"WITH {_p()} SELECT chain_id, round(avg(x), 6)::DOUBLE AS x, round(avg(y), 6)::DOUBLE AS y, round(avg(z), 6)::DOUBLE AS z FROM p GROUP BY 1")
def centroid(spark, sf_dir):
    out = compare.centroid(points(spark, sf_dir), ["chain_id"])
    return out.select("chain_id", *[F.round(c, 6).alias(c) for c in "xyz"])


_MASS = "(1 + atom_idx % 16)"


@query(f"WITH {_p()} SELECT chain_id, " + ", ".join(f"round(sum({c} * {_MASS}) / sum({_MASS}), 6)::DOUBLE AS {c}" for c in "xyz") + " FROM p GROUP BY 1")
def mass_center(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("mass", 1 + F.col("atom_idx") % 16)
    return compare.mass_center(rows, ["chain_id"]).select("chain_id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(
    f"""WITH {_p()}, c AS (SELECT chain_id, """
    + ", ".join(f"sum({c} * {_MASS}) / sum({_MASS}) AS c{c}" for c in "xyz")
    + f""" FROM p GROUP BY 1)
SELECT chain_id, round(sqrt(sum({_MASS} * ((x - cx)**2 + (y - cy)**2 + (z - cz)**2)) / sum({_MASS})), 5)::DOUBLE AS rg FROM p JOIN c USING (chain_id) GROUP BY 1"""
)
def gyration_radius(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("mass", 1 + F.col("atom_idx") % 16)
    return compare.gyration_radius(rows, ["chain_id"]).select("chain_id", F.round("rg", 5).alias("rg"))


# Boxes ----------------------------------------------------------------------------------


@query(f"WITH {_p()} SELECT atom_idx, " + ", ".join(f"round({c} - floor({c} / {BOX[i][i]}) * {BOX[i][i]}, 6)::DOUBLE AS {c}" for i, c in enumerate("xyz")) + " FROM p")
def move_inside_box(spark, sf_dir):
    moved = g.inside_box(g.vector("x", "y", "z"), BOX)
    return points(spark, sf_dir).select("atom_idx", *[F.round(v, 6).alias(c) for v, c in zip(moved, "xyz", strict=True)])


def _image(c: str, size: float) -> str:
    d = f"({c}1 - {c})"
    return f"({d} - {size} * (floor({d} / {size}) + CASE WHEN {d} / {size} - floor({d} / {size}) > 0.5 THEN 1 ELSE 0 END))**2"


@query(f"WITH {_N} SELECT atom_idx, round(sqrt({' + '.join(_image(c, BOX[i][i]) for i, c in enumerate('xyz'))}), 6)::DOUBLE AS dist FROM n WHERE x1 IS NOT NULL")
def pbc_distances(spark, sf_dir):
    return _neighbours(spark, sf_dir).where("x1 IS NOT NULL").select("atom_idx", F.round(g.pbc_distance(g.vector("x1", "y1", "z1"), g.vector("x", "y", "z"), BOX), 6).alias("dist"))


@query(
    f"""WITH {_p()} SELECT chain_id, count(*) AS n, round(sum(x + 3.0 * i), 4)::DOUBLE AS sx, round(sum(y + 4.0 * j), 4)::DOUBLE AS sy FROM p,
(SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k) GROUP BY 1"""
)
def repeat_box(spark, sf_dir):
    rows = g.repeat_box(points(spark, sf_dir), BOX)
    return rows.groupBy("chain_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"))


@query(
    f"""WITH {_p()}, o AS (SELECT n_nationkey AS op_id, cos(n_nationkey) AS c, sin(n_nationkey) AS s, n_regionkey AS t FROM nation)
SELECT op_id, atom_idx, round(c * x - s * y + t, 5)::DOUBLE AS x, round(s * x + c * y, 5)::DOUBLE AS y, round(z - t, 5)::DOUBLE AS z FROM p, o"""
)
def assembly(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    zero, t = F.lit(0.0), F.col("n_regionkey").cast("double")
    cells = {"r11": F.cos(k), "r12": -F.sin(k), "r13": zero, "r21": F.sin(k), "r22": F.cos(k), "r23": zero, "r31": zero, "r32": zero, "r33": F.lit(1.0), "t1": t, "t2": zero, "t3": -t}
    ops = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("op_id"), *[v.alias(n) for n, v in cells.items()])
    return g.apply_operations(points(spark, sf_dir), ops).select("op_id", "atom_idx", *[F.round(c, 5).alias(c) for c in "xyz"])


_STEP = ", ".join(f"CASE WHEN i = 1 THEN {c} ELSE {c} - p{c} - {BOX[k][k]} * (floor(({c} - p{c}) / {BOX[k][k]}) + CASE WHEN ({c} - p{c}) / {BOX[k][k]} - floor(({c} - p{c}) / {BOX[k][k]}) > 0.5 THEN 1 ELSE 0 END) END AS s{c}" for k, c in enumerate("xyz"))


@query(
    f"""WITH {_p()}, o AS (SELECT *, row_number() OVER w AS i, {", ".join(f"lag({c}) OVER w AS p{c}" for c in "xyz")} FROM p WHERE x IS NOT NULL WINDOW w AS (PARTITION BY res_id ORDER BY atom_idx)),
s AS (SELECT res_id, atom_idx, {_STEP} FROM o)
SELECT atom_idx, {", ".join(f"round(sum(s{c}) OVER (PARTITION BY res_id ORDER BY atom_idx ROWS UNBOUNDED PRECEDING), 5)::DOUBLE AS {c}" for c in "xyz")} FROM s"""
)
def remove_pbc(spark, sf_dir):
    """Four atoms of a residue are one molecule."""
    atoms = points(spark, sf_dir).where("x IS NOT NULL")
    return g.remove_pbc(atoms, BOX, ["res_id"], ["atom_idx"]).select("atom_idx", *[F.round(c, 5).alias(c) for c in "xyz"])


@query(
    f"""WITH {_p()} SELECT op_id, atom_idx, round(CASE op_id WHEN 0 THEN x WHEN 1 THEN -x + {BOX[0][0]} / 2 ELSE -y / {BOX[1][1]} * {BOX[0][0]} END, 5)::DOUBLE AS x,
round(CASE op_id WHEN 0 THEN y WHEN 1 THEN -y ELSE (x / {BOX[0][0]} - y / {BOX[1][1]}) * {BOX[1][1]} END, 5)::DOUBLE AS y, round(CASE op_id WHEN 0 THEN z WHEN 1 THEN z + {BOX[2][2]} / 2 ELSE z + {BOX[2][2]} / 3 END, 5)::DOUBLE AS z
FROM p, (SELECT unnest([0, 1, 2])::BIGINT AS op_id)"""
)
def symmetry_mates(spark, sf_dir):
    out = g.symmetry_mates(points(spark, sf_dir), BOX, ["x, y, z", "-x+1/2, -y, z+1/2", "-y, x-y, z+1/3"])
    return out.select("op_id", "atom_idx", *[F.round(c, 5).alias(c) for c in "xyz"])


# Spatial joins --------------------------------------------------------------------------

_D2 = "(a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2"


@query(f"WITH {_p()} SELECT a.chain_id, a.atom_idx, b.atom_idx AS r_atom_idx, round(sqrt({_D2}), 6)::DOUBLE AS dist FROM p a JOIN p b ON a.chain_id = b.chain_id AND a.atom_idx <> b.atom_idx AND {_D2} <= 0.25")
def contacts_grid(spark, sf_dir):
    return spatial.contacts(points(spark, sf_dir), 0.5, by=["chain_id"]).select("chain_id", "atom_idx", "r_atom_idx", F.round(F.sqrt("dist2"), 6).alias("dist"))


@query(f"WITH {_p()} SELECT a.chain_id, a.atom_idx, count(b.atom_idx) AS degree FROM p a LEFT JOIN p b ON a.chain_id = b.chain_id AND a.atom_idx <> b.atom_idx AND {_D2} <= 0.64 GROUP BY 1, 2")
def adjacency_degree(spark, sf_dir):
    return spatial.degrees(points(spark, sf_dir), 0.8, by=["chain_id"])


@query(
    f"""WITH {_p()}, d AS (SELECT a.chain_id, least(floor(sqrt({_D2}) / 0.1), 9)::BIGINT AS bin FROM p a JOIN p b ON a.chain_id = b.chain_id AND a.atom_idx <> b.atom_idx AND {_D2} <= 1.0),
s AS (SELECT chain_id, count(*) AS n FROM p GROUP BY 1), h AS (SELECT chain_id, bin, count(*) AS pairs FROM d GROUP BY 1, 2)
SELECT g.chain_id, g.bin, coalesce(pairs, 0) AS pairs, round(coalesce(pairs, 0) / n / (4.0 / 3 * pi() * 0.001 * (pow(g.bin + 1, 3) - pow(g.bin, 3))) / (n / 27.0), 5)::DOUBLE AS g
FROM (SELECT chain_id, n, unnest(range(0, 10)) AS bin FROM s) g LEFT JOIN h ON h.chain_id = g.chain_id AND h.bin = g.bin"""
)
def rdf_histogram(spark, sf_dir):
    out = spatial.rdf(points(spark, sf_dir), radius=1.0, bins=10, by=["chain_id"], volume=27.0)
    return out.select("chain_id", "bin", "pairs", F.round("g", 5).alias("g"))


@query(f"WITH {_p()} SELECT floor(x / 0.5)::BIGINT AS i, floor(y / 0.5)::BIGINT AS j, floor(z / 0.5)::BIGINT AS k, count(*) AS n FROM p GROUP BY 1, 2, 3")
def density_grid(spark, sf_dir):
    return spatial.density(points(spark, sf_dir), delta=0.5)


@query(
    f"""WITH {_p()}, {_p('d', 1)},
t AS (SELECT h.chain_id, h.atom_idx AS donor, h.atom_idx AS hydrogen, a.atom_idx AS acceptor, sqrt((h.x - a.x)**2 + (h.y - a.y)**2 + (h.z - a.z)**2) AS dist,
((d.x - h.x) * (a.x - h.x) + (d.y - h.y) * (a.y - h.y) + (d.z - h.z) * (a.z - h.z)) / (sqrt((d.x - h.x)**2 + (d.y - h.y)**2 + (d.z - h.z)**2) * sqrt((a.x - h.x)**2 + (a.y - h.y)**2 + (a.z - h.z)**2)) AS c
FROM p h JOIN d USING (atom_idx) JOIN p a ON a.chain_id = h.chain_id AND a.atom_idx <> h.atom_idx AND (h.x - a.x)**2 + (h.y - a.y)**2 + (h.z - a.z)**2 <= 0.64)
SELECT chain_id, donor, hydrogen, acceptor, round(degrees(acos(greatest(-1.0, least(1.0, c)))), 4)::DOUBLE AS theta, round(dist, 6)::DOUBLE AS dist FROM t WHERE degrees(acos(greatest(-1.0, least(1.0, c)))) > 120"""
)
def hydrogen_bonds(spark, sf_dir):
    p = points(spark, sf_dir)
    d = points(spark, sf_dir, 1).select("atom_idx", *[F.col(c).alias(f"d{c}") for c in "xyz"])
    donors = p.join(d, "atom_idx").select("chain_id", F.col("atom_idx").alias("donor"), F.col("atom_idx").alias("hydrogen"), "x", "y", "z", "dx", "dy", "dz")
    acceptors = p.select("chain_id", F.col("atom_idx").alias("acceptor"), "x", "y", "z")
    out = spatial.hydrogen_bonds(donors, acceptors, cutoff=0.8, by=["chain_id"])
    return out.select("chain_id", "donor", "hydrogen", "acceptor", F.round("theta", 4).alias("theta"), F.round("dist", 6).alias("dist"))


_RINGS = "(r.x - l.x) * {m}y - (r.y - l.y) * {m}x, (r.y - l.y) * {m}z - (r.z - l.z) * {m}y, (r.z - l.z) * {m}x - (r.x - l.x) * {m}z"


def _off(m: str) -> str:
    return f"sqrt({' + '.join(f'({c})**2' for c in _RINGS.format(m=m).split(', '))}) / sqrt({m}x**2 + {m}y**2 + {m}z**2)"


@query(
    f"""WITH {_p()}, {_p('n', 1)}, c AS (SELECT p.chain_id, p.atom_idx AS ring, p.x, p.y, p.z, n.x AS nx, n.y AS ny, n.z AS nz FROM p JOIN n USING (atom_idx)),
t AS (SELECT l.chain_id, l.ring, r.ring AS r_ring, sqrt((l.x - r.x)**2 + (l.y - r.y)**2 + (l.z - r.z)**2) AS dist, least({_off('l.n')}, {_off('r.n')}) AS off,
degrees(acos(least(1.0, abs(l.nx * r.nx + l.ny * r.ny + l.nz * r.nz) / (sqrt(l.nx**2 + l.ny**2 + l.nz**2) * sqrt(r.nx**2 + r.ny**2 + r.nz**2))))) AS bend
FROM c l JOIN c r ON l.chain_id = r.chain_id AND l.ring < r.ring AND (l.x - r.x)**2 + (l.y - r.y)**2 + (l.z - r.z)**2 <= 0.81)
SELECT * FROM (SELECT chain_id, ring, r_ring, CASE WHEN bend <= 30 AND dist <= 0.9 AND off <= 0.6 THEN 'parallel' WHEN bend >= 60 AND dist <= 0.8 AND off <= 0.6 THEN 'perpendicular' END AS kind, round(dist, 6)::DOUBLE AS dist FROM t) WHERE kind IS NOT NULL"""
)
def ring_stacking(spark, sf_dir):
    n = points(spark, sf_dir, 1).select("atom_idx", *[F.col(c).alias(f"n{c}") for c in "xyz"])
    rings = points(spark, sf_dir).join(n, "atom_idx").withColumnRenamed("atom_idx", "ring").drop("res_id")
    return spatial.stacking(rings, parallel=(0.9, 0.6), perpendicular=(0.8, 0.6), by=["chain_id"]).withColumn("dist", F.round("dist", 6))


@query(
    f"""WITH {_p()}, a AS (SELECT chain_id, atom_idx, x, y, z, 0.2 + (atom_idx % 3) * 0.1 AS radius FROM p),
u AS (SELECT i, 1 - (2 * i + 1) / 200.0::DOUBLE AS uz, pi() * (3 - sqrt(5.0::DOUBLE)) * i AS t FROM (SELECT unnest(range(0, 200)) AS i)),
s AS (SELECT chain_id, atom_idx, radius::DOUBLE + 0.1 AS size, x + (radius::DOUBLE + 0.1) * sqrt(1 - uz * uz) * cos(t) AS x, y + (radius::DOUBLE + 0.1) * sqrt(1 - uz * uz) * sin(t) AS y, z + (radius::DOUBLE + 0.1) * uz AS z FROM a, u),
h AS (SELECT *, EXISTS (SELECT 1 FROM a o WHERE o.chain_id = s.chain_id AND o.atom_idx <> s.atom_idx AND (s.x - o.x)**2 + (s.y - o.y)**2 + (s.z - o.z)**2 < (o.radius::DOUBLE + 0.1)**2) AS hidden FROM s)
SELECT chain_id, atom_idx, round(4 * pi() * max(size)**2 * count(*) FILTER (NOT hidden) / 200.0::DOUBLE, 6)::DOUBLE AS sasa FROM h GROUP BY 1, 2"""
)
def solvent_area(spark, sf_dir):
    atoms = points(spark, sf_dir).withColumn("radius", 0.2 + (F.col("atom_idx") % 3) * 0.1)
    return spatial.sasa(atoms, probe=0.1, points=200, most_radius=0.4, by=["chain_id"]).withColumn("sasa", F.round("sasa", 6))


# Comparison -----------------------------------------------------------------------------


@query(f"WITH {_p()}, {_p('q', 1)} SELECT p.chain_id, round(sqrt(avg((p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2)), 6)::DOUBLE AS rmsd FROM p JOIN q USING (atom_idx) GROUP BY 1")
def rmsd_by_label(spark, sf_dir):
    out = compare.rmsd(points(spark, sf_dir), points(spark, sf_dir, 1), atom=["atom_idx"], by=["chain_id"])
    return out.select("chain_id", F.round("rmsd", 6).alias("rmsd"))


def _models(spark, sf_dir):
    out = points(spark, sf_dir, 1).withColumn("model", F.lit(1))
    for m in (2, 3):
        out = out.unionAll(points(spark, sf_dir, m).withColumn("model", F.lit(m)))
    return out


_M = f"{_p()}, {_p('m1', 1)}, {_p('m2', 2)}, {_p('m3', 3)}, m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"


@query(f"WITH {_M} SELECT atom_idx, round(sqrt(avg((p.x - m.x)**2 + (p.y - m.y)**2 + (p.z - m.z)**2)), 6)::DOUBLE AS rmsf FROM p JOIN m USING (atom_idx) GROUP BY 1")
def rmsf(spark, sf_dir):
    return compare.rmsf(points(spark, sf_dir), _models(spark, sf_dir), atom=["atom_idx"]).select("atom_idx", F.round("rmsf", 6).alias("rmsf"))


@query(f"WITH {_M} SELECT atom_idx, " + ", ".join(f"round(avg({c}), 6)::DOUBLE AS {c}" for c in "xyz") + " FROM m GROUP BY 1")
def average_structure(spark, sf_dir):
    return compare.average(_models(spark, sf_dir), atom=["atom_idx"]).select("atom_idx", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(
    f"""WITH {_p()}, {_p('q', 1)}, b AS (SELECT p.chain_id, p.atom_idx, p.x AS fx, p.y AS fy, p.z AS fz, q.x, q.y, q.z FROM p JOIN q USING (atom_idx))
SELECT a.chain_id, round(sqrt(sum((sqrt((a.fx - b.fx)**2 + (a.fy - b.fy)**2 + (a.fz - b.fz)**2) - sqrt((a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2))**2)) / count(DISTINCT a.atom_idx), 6)::DOUBLE AS rmspd FROM b a JOIN b USING (chain_id) GROUP BY 1"""
)
def rmspd(spark, sf_dir):
    out = compare.rmspd(points(spark, sf_dir).drop("chain_id", "res_id"), points(spark, sf_dir, 1), atom="atom_idx", by=["chain_id"])
    return out.select("chain_id", F.round("rmspd", 6).alias("rmspd"))


_LDDT = f"""{_p()}, {_p('q', 1)}, s AS (SELECT p.chain_id, p.res_id, p.atom_idx, p.x, p.y, p.z, p.x + q.x * 0.1 AS sx, p.y + q.y * 0.1 AS sy, p.z + q.z * 0.1 AS sz FROM p JOIN q USING (atom_idx)),
c AS (SELECT a.chain_id, a.res_id, a.atom_idx, abs(sqrt((a.sx - b.sx)**2 + (a.sy - b.sy)**2 + (a.sz - b.sz)**2) - sqrt({_D2})) AS off FROM s a JOIN s b ON a.atom_idx <> b.atom_idx AND (a.chain_id <> b.chain_id OR a.res_id <> b.res_id) AND {_D2} <= 0.36),
f AS (SELECT *, (CASE WHEN off <= 0.05 THEN 1.0 ELSE 0 END + CASE WHEN off <= 0.1 THEN 1.0 ELSE 0 END + CASE WHEN off <= 0.2 THEN 1.0 ELSE 0 END + CASE WHEN off <= 0.4 THEN 1.0 ELSE 0 END) / 4 AS f FROM c)"""


def _lddt(spark, sf_dir, level):
    q = points(spark, sf_dir, 1).select("atom_idx", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    p = points(spark, sf_dir)
    subject = p.join(q, "atom_idx").select("atom_idx", *[(F.col(c) + F.col(f"q{c}") * 0.1).alias(c) for c in "xyz"])
    return compare.lddt(p, subject, radius=0.6, bins=(0.05, 0.1, 0.2, 0.4), level=level)


@query(f"WITH {_LDDT} SELECT round(avg(f), 6)::DOUBLE AS lddt FROM f")
def lddt_all(spark, sf_dir):
    return _lddt(spark, sf_dir, "all").select(F.round("lddt", 6).alias("lddt"))


@query(f"WITH {_LDDT} SELECT chain_id, round(avg(f), 6)::DOUBLE AS lddt FROM f GROUP BY 1")
def lddt_chain(spark, sf_dir):
    return _lddt(spark, sf_dir, "chain").select("chain_id", F.round("lddt", 6).alias("lddt"))


@query(f"WITH {_LDDT} SELECT atom_idx, round(avg(f), 6)::DOUBLE AS lddt FROM f GROUP BY 1")
def lddt_atom(spark, sf_dir):
    return _lddt(spark, sf_dir, "atom").select("atom_idx", F.round("lddt", 6).alias("lddt"))


def _key_matrix() -> list[list[str]]:
    """The symmetric matrix whose greatest eigenvalue is the overlap after the best rotation (quaternion form)."""
    rows = [["xx + yy + zz", "yz - zy", "zx - xz", "xy - yx"], ["", "xx - yy - zz", "xy + yx", "zx + xz"], ["", "", "-xx + yy - zz", "yz + zy"], ["", "", "", "-xx - yy + zz"]]
    return [[f"({rows[min(i, j)][max(i, j)]})" for j in range(4)] for i in range(4)]


def _determinant(m: list[list[str]]) -> str:
    even = lambda p: sum(p[i] > p[j] for i in range(4) for j in range(i + 1, 4)) % 2 == 0
    return " ".join(("+ " if even(p) else "- ") + " * ".join(m[i][p[i]] for i in range(4)) for p in permutations(range(4)))


@query(
    f"""WITH {_p()}, {_p('q', 1)}, b AS (SELECT q.chain_id, {", ".join(f"p.{c} AS f{c}, q.{c} AS m{c}" for c in "xyz")} FROM p JOIN q USING (atom_idx)),
c AS (SELECT chain_id, {", ".join(f"f{c} - avg(f{c}) OVER w AS f{c}, m{c} - avg(m{c}) OVER w AS m{c}, f{c} - m{c} AS d{c}" for c in "xyz")} FROM b WINDOW w AS (PARTITION BY chain_id)),
s AS (SELECT chain_id, count(*) AS n, sum(fx**2 + fy**2 + fz**2) AS gf, sum(mx**2 + my**2 + mz**2) AS gm, avg(dx**2 + dy**2 + dz**2) AS d2, {", ".join(f"sum(m{i} * f{j}) AS {i}{j}" for i in "xyz" for j in "xyz")} FROM c GROUP BY 1),
k AS (SELECT *, -2 * ({" + ".join(f"{i}{j}**2" for i in "xyz" for j in "xyz")}) AS c2, 8 * (xx * yz * zy + yy * zx * xz + zz * xy * yx - xx * yy * zz - yz * zx * xy - zy * yx * xz) AS c1, {_determinant(_key_matrix())} AS c0 FROM s),
l AS (SELECT *, list_reduce(list_prepend((gf + gm) / 2, list_transform(range(0, 60), lambda i: i::DOUBLE)), lambda v, i: v - (v**4 + c2 * v**2 + c1 * v + c0) / (4 * v**3 + 2 * c2 * v + c1)) AS top FROM k)
SELECT chain_id, round(sqrt((gf + gm - 2 * top) / n), 6)::DOUBLE AS rmsd, round(sqrt(d2), 6)::DOUBLE AS before FROM l"""
)
def superimpose_labels(spark, sf_dir):
    """Each label's second model fitted onto the first: deviation before and after."""
    fixed, mobile = points(spark, sf_dir).drop("chain_id", "res_id"), points(spark, sf_dir, 1)
    after = compare.rmsd(fixed, compare.superimpose(fixed, mobile, atom=["atom_idx"], by=["chain_id"]), atom=["atom_idx"], by=["chain_id"])
    before = compare.rmsd(fixed, mobile, atom=["atom_idx"], by=["chain_id"]).withColumnRenamed("rmsd", "before")
    return after.join(before, "chain_id").select("chain_id", F.round("rmsd", 6).alias("rmsd"), F.round("before", 6).alias("before"))


@query()
def tm_scores(spark, sf_dir):
    fixed, mobile = points(spark, sf_dir).drop("res_id"), points(spark, sf_dir, 1)
    moved = compare.superimpose(fixed, mobile, atom=["atom_idx"], by=["chain_id"])
    return compare.tm_score(fixed, moved, atom=["atom_idx"], by=["chain_id"])


@query(
    f"""WITH {_p()}, c AS (SELECT chain_id AS state, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY 1)
SELECT atom_idx, state FROM (SELECT atom_idx, state, row_number() OVER (PARTITION BY atom_idx ORDER BY (x - cx)**2 + (y - cy)**2 + (z - cz)**2, state) AS n FROM p, c) WHERE n = 1"""
)
def structural_states(spark, sf_dir):
    p = points(spark, sf_dir)
    c = compare.centroid(p, ["chain_id"]).select(F.col("chain_id").alias("state"), *[F.col(x).alias(f"c{x}") for x in "xyz"])
    d = sum(((F.col(x) - F.col(f"c{x}")) ** 2 for x in "xyz"), F.lit(0.0))
    near = p.crossJoin(F.broadcast(c)).groupBy("atom_idx").agg(F.min(F.struct(d.alias("d"), "state")).alias("m"))
    return near.select("atom_idx", "m.state")


# Bonds ----------------------------------------------------------------------------------


def _edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    order = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad((F.col("l_extendedprice") * 100).cast("long").cast("string"), 14, "0"))
    return rows.select(F.col("l_partkey").alias("atom1"), (F.col("l_suppkey") + 10_000_000).alias("atom2"), F.col("l_linenumber").cast("long").alias("bond_type"), order.alias("ord"))


_E = """e AS (SELECT l_partkey AS atom1, l_suppkey + 10000000 AS atom2, l_linenumber::BIGINT AS bond_type, lpad(l_orderkey::VARCHAR, 12, '0') || '-' || lpad(l_linenumber::VARCHAR, 3, '0') || '-' || lpad(trunc(l_extendedprice * 100)::BIGINT::VARCHAR, 14, '0') AS ord FROM lineitem),
b AS (SELECT atom1, atom2, arg_min(bond_type, ord) AS bond_type FROM e GROUP BY 1, 2)"""


@query(f"WITH {_E} SELECT * FROM b")
def bond_normalize(spark, sf_dir):
    return bonds.normalized(_edges(spark, sf_dir), order="ord")


@query(f"WITH {_E} SELECT atom, count(*) AS degree FROM (SELECT atom1 AS atom FROM b UNION ALL SELECT atom2 FROM b) GROUP BY 1")
def bond_degrees(spark, sf_dir):
    return bonds.partner_counts(bonds.normalized(_edges(spark, sf_dir), order="ord"))


@query(
    f"""WITH {_E}, o AS (SELECT atom1, atom2, 9::BIGINT AS bond_type FROM b WHERE atom1 % 3 = 0 UNION ALL SELECT p_partkey, 20000000, 1 FROM part)
SELECT coalesce(o.atom1, b.atom1) AS atom1, coalesce(o.atom2, b.atom2) AS atom2, coalesce(o.bond_type, b.bond_type) AS bond_type FROM b FULL JOIN o ON b.atom1 = o.atom1 AND b.atom2 = o.atom2"""
)
def bond_merge(spark, sf_dir):
    b = bonds.normalized(_edges(spark, sf_dir), order="ord")
    o = b.where("atom1 % 3 = 0").withColumn("bond_type", F.lit(9).cast("long"))
    o = o.unionAll(table(spark, sf_dir, "part").select("p_partkey", F.lit(20_000_000).cast("long"), F.lit(1).cast("long")))
    return bonds.merge(b, o)


@query(f"WITH {_E} SELECT * FROM b WHERE atom1 NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def bond_remove_to(spark, sf_dir):
    gone = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("atom_idx"))
    return bonds.remove_bonds_to(bonds.normalized(_edges(spark, sf_dir), order="ord"), gone)


@query(f"WITH {_E} SELECT atom1, atom2, CASE bond_type WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 3 ELSE bond_type END::INT AS bond_type FROM b")
def bond_without_aromaticity(spark, sf_dir):
    return bonds.without_aromaticity(bonds.normalized(_edges(spark, sf_dir), order="ord"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_partkey + 1000000000 AS b FROM lineitem), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(node, component) USING KEY (node) AS (
  SELECT a, least(a, min(b)) FROM both_ GROUP BY a
  UNION
  (SELECT m.node, min(n.component) FROM recurring.cc m JOIN both_ ON both_.b = m.node JOIN cc n ON n.node = both_.a WHERE n.component < m.component GROUP BY m.node))
SELECT node, component FROM cc"""
)
def molecules(spark, sf_dir):
    """Connected components of orders and parts."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("atom1"), (F.col("l_partkey") + 1_000_000_000).alias("atom2"))
    return bonds.connected(rows)


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS mol, l_orderkey AS a, l_partkey + 1000000000 AS b FROM lineitem),
h AS (SELECT mol, a AS u, b AS v FROM e UNION ALL SELECT mol, b, a FROM e), d AS (SELECT mol, u, count(*) AS n FROM h GROUP BY 1, 2),
c AS (SELECT e.* FROM e JOIN d p ON p.mol = e.mol AND p.u = e.a JOIN d q ON q.mol = e.mol AND q.u = e.b WHERE p.n > 1 AND q.n > 1),
r(mol, a, b, node) AS (SELECT mol, a, b, a FROM c UNION SELECT r.mol, r.a, r.b, h.v FROM r JOIN h ON h.mol = r.mol AND h.u = r.node WHERE NOT (h.u = r.a AND h.v = r.b) AND NOT (h.u = r.b AND h.v = r.a))
SELECT mol, a AS atom1, b AS atom2, {bonds.SINGLE}::BIGINT AS bond_type FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.mol = c.mol AND r.a = c.a AND r.b = c.b AND r.node = c.b)"""
)
def rotatable_bonds(spark, sf_dir):
    """Bridges of each supplier's graph of orders and parts."""
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.select(F.col("l_suppkey").alias("mol"), F.col("l_orderkey").alias("atom1"), (F.col("l_partkey") + 1_000_000_000).alias("atom2"), F.lit(bonds.SINGLE).cast("long").alias("bond_type"))
    return bonds.rotatable(bonds.normalized(rows, by=["mol"]), "mol")


# Encodings, search, trees ---------------------------------------------------------------


@query(
    f"""WITH d AS (SELECT l_orderkey, l_linenumber - coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY {LINES}), 0) AS delta, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINES}) AS i FROM lineitem),
g AS (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey, delta ORDER BY i) AS island FROM d)
SELECT l_orderkey, min(i) - 1 AS start, delta::BIGINT AS delta, count(*) AS n FROM g GROUP BY l_orderkey, delta, island"""
)
def integer_delta_rle(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE)) - 1)
    deltas = encodings.delta(rows.select("l_orderkey", "pos", "l_linenumber"), by=["l_orderkey"], order="pos", value="l_linenumber")
    out = encodings.run_length(deltas, by=["l_orderkey"], order="pos", value="delta")
    return out.select("l_orderkey", F.col("start").cast("long").alias("start"), "delta", "n")


@query(
    """SELECT p_partkey, p_brand, p_size FROM part WHERE (p_size BETWEEN 10 AND 30 AND p_retailprice > 1000) OR (p_brand = 'Brand#11' AND NOT p_size > 40) ORDER BY p_size DESC, p_partkey LIMIT 100 OFFSET 5"""
)
def catalog_search(spark, sf_dir):
    """A top-k report of a predicate tree."""
    q = (search.field("p_size", range_closed=(10, 30)) & search.field("p_retailprice", greater=1000)) | (search.field("p_brand", exact_match="Brand#11") & ~search.field("p_size", greater=40))
    return search.search(table(spark, sf_dir, "part"), q, sort_by=[search.Sorting("p_size"), search.Sorting("p_partkey", descending=False)], window=(5, 105)).select("p_partkey", "p_brand", "p_size")


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part WHERE p_size > 20) WHERE n = 1")
def catalog_representatives(spark, sf_dir):
    q = search.field("p_size", greater=20)
    return search.search(table(spark, sf_dir, "part"), q, group_by="p_brand", rank_by=[search.Sorting("p_retailprice"), search.Sorting("p_partkey", descending=False)]).select("p_brand", "p_partkey")


@query()
def cluster_trees(spark, sf_dir):
    """UPGMA and neighbour-joining trees of each label's chains, by distances of label centroids, as Newick."""
    c = compare.centroid(points(spark, sf_dir), ["chain_id"])
    o = c.select(F.col("chain_id").alias("j"), *[F.col(x).alias(f"o{x}") for x in "xyz"])
    d = F.sqrt(sum(((F.col(x) - F.col(f"o{x}")) ** 2 for x in "xyz"), F.lit(0.0)))
    pairs = c.crossJoin(F.broadcast(o)).select(F.lit(0).alias("tree_id"), F.col("chain_id").alias("i"), "j", d.alias("distance"))
    return trees.cluster(pairs, "upgma").withColumn("method", F.lit("upgma")).unionAll(trees.cluster(pairs, "nj").withColumn("method", F.lit("nj")))


