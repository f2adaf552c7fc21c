"""The registered queries over the driver's tables, each with its DuckDB equivalent where SQL can express it.

Doubles are rounded to six digits on both sides; floors are integers on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boscage.functions import geometry as G
from boscage.operators import ground, graph, mesh, points, qsm, routes, skeleton, spatial, trees, verbs
from boscage.params import PathFinder
from boscage.sources import sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The views of sources.tables in SQL.
VIEWS = """
evt AS (SELECT event_id AS point_id, ((event_id*7919)%1000)/100 AS X, ((event_id*104729)%997)/100 AS Y, value/10 AS Z, value/10 AS hag, user_id AS treeID,
        epoch_us(ts)/1e6 AS gpstime, CAST(event_id%20 AS INTEGER) AS passage, CAST(event_id%3 AS INTEGER) AS foliage, CAST(event_id%4 AS INTEGER) AS UserData FROM events),
emb AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE)*10 AS X, CAST(embedding[2] AS DOUBLE)*10 AS Y, CAST(embedding[3] AS DOUBLE)*10 AS Z, CAST(label AS INTEGER) AS treeID, CAST(vec_id%3 AS INTEGER) AS foliage FROM embeddings),
circle AS (SELECT s_suppkey AS id, s_acctbal/1000 AS X, CAST(s_nationkey AS DOUBLE) AS Y, CAST(s_suppkey%3 AS DOUBLE) AS Z, 0.02+(s_suppkey%10)/20 AS R FROM supplier),
num AS (SELECT user_id AS tree_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
cyl0 AS (SELECT tree_id, rn AS cyl_ID, rn*0.02+value*0.001 AS endX, (rn%7)*0.05 AS endY, rn*0.1+value/500 AS endZ, 0.001+value/1000 AS radius, rn//2 AS half, rn-1 AS before FROM num),
heap AS (SELECT c.tree_id, c.cyl_ID, c.half AS parent_ID, coalesce(p.endX,0) AS startX, coalesce(p.endY,0) AS startY, coalesce(p.endZ,0) AS startZ, c.endX, c.endY, c.endZ, c.radius,
         sqrt((c.endX-coalesce(p.endX,0))**2+(c.endY-coalesce(p.endY,0))**2+(c.endZ-coalesce(p.endZ,0))**2) AS len FROM cyl0 c LEFT JOIN cyl0 p ON p.tree_id=c.tree_id AND p.cyl_ID=c.half),
chain AS (SELECT c.tree_id, c.cyl_ID, c.before AS parent_ID, coalesce(p.endX,0) AS startX, coalesce(p.endY,0) AS startY, coalesce(p.endZ,0) AS startZ, c.endX, c.endY, c.endZ, c.radius,
         sqrt((c.endX-coalesce(p.endX,0))**2+(c.endY-coalesce(p.endY,0))**2+(c.endZ-coalesce(p.endZ,0))**2) AS len FROM cyl0 c LEFT JOIN cyl0 p ON p.tree_id=c.tree_id AND p.cyl_ID=c.before),
chain2 AS (SELECT *, sum(len) OVER (PARTITION BY tree_id ORDER BY cyl_ID)-len AS dist_to_root, coalesce(sum(len) OVER (PARTITION BY tree_id ORDER BY cyl_ID ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),0) AS subtree_length, 1 AS branch_order FROM chain),
up AS (SELECT tree_id, cyl_ID AS node, cyl_ID AS anc, 0.0 AS path FROM heap),
line AS (SELECT tree_id, cyl_ID AS node, cyl_ID AS anc FROM heap UNION ALL SELECT l.tree_id, l.node, h.parent_ID FROM line l JOIN heap h ON h.tree_id=l.tree_id AND h.cyl_ID=l.anc WHERE h.parent_ID>0),
grown AS (SELECT h.tree_id, h.cyl_ID, sum(a.len) AS path, sum(pi()*a.radius*a.radius*a.len) AS bulk FROM heap h JOIN line l ON l.tree_id=h.tree_id AND l.node=h.cyl_ID JOIN heap a ON a.tree_id=h.tree_id AND a.cyl_ID=l.anc GROUP BY ALL),
below AS (SELECT l.tree_id, l.anc AS cyl_ID, max(g.path) AS far, max(h.endZ) AS top, max(g.bulk) AS most, max(h.radius) AS thick FROM line l JOIN grown g ON g.tree_id=l.tree_id AND g.cyl_ID=l.node JOIN heap h ON h.tree_id=l.tree_id AND h.cyl_ID=l.node GROUP BY ALL),
sub AS (SELECT h.*, b.far-g.path AS subtree_length, b.top AS subtree_max_z, b.most-g.bulk AS subtree_volume, g.path-h.len AS dist_to_root, b.thick FROM heap h JOIN below b USING (tree_id,cyl_ID) JOIN grown g USING (tree_id,cyl_ID)),
lat AS (SELECT *, CASE WHEN parent_ID=0 THEN 0 ELSE CAST(row_number() OVER (PARTITION BY tree_id,parent_ID ORDER BY round(subtree_max_z,9) DESC, round(subtree_length+len,9) DESC, cyl_ID)>1 AS INTEGER) END AS lateral FROM sub),
arch AS (SELECT t.*, o.branch_order, o.axis FROM lat t JOIN (SELECT l.tree_id, l.node AS cyl_ID, 1+sum(a.lateral) AS branch_order, max(CASE WHEN a.lateral=1 OR a.parent_ID=0 THEN a.cyl_ID END) AS axis FROM line l JOIN lat a ON a.tree_id=l.tree_id AND a.cyl_ID=l.anc GROUP BY ALL) o USING (tree_id,cyl_ID))
"""


def query(sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL in terms of VIEWS; doubles are rounded in Spark."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            body = sql.strip()
            if views:
                body = f"WITH RECURSIVE {VIEWS.strip()}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"
            ORACLE[f.__name__] = body
        return f

    return add


evt, emb = tables.points_of_events, tables.points_of_embeddings


def heap(s: SparkSession, d: str) -> DataFrame:
    return tables.cylinders_of_events(s, d)


def chain(s: SparkSession, d: str) -> DataFrame:
    """A chain's folds are running sums: one window, no doubling."""
    from pyspark.sql import Window

    w = Window.partitionBy("tree_id").orderBy("cyl_ID")
    c = tables.cylinders_of_events(s, d, chain=True).withColumn("len", G.length())
    rest = F.coalesce(F.sum("len").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return c.withColumns({"dist_to_root": F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"), "subtree_length": rest, "branch_order": F.lit(1)}).drop("len")


def grown(s: SparkSession, d: str) -> DataFrame:
    """Cylinders of the heap trees with all folds."""
    return trees.grown(heap(s, d))


VOX = "least AS (SELECT min(X) AS x0, min(Y) AS y0, min(Z) AS z0 FROM evt), vox AS (SELECT evt.*, CAST(floor((X-x0)/0.5) AS BIGINT) AS vx, CAST(floor((Y-y0)/0.5) AS BIGINT) AS vy, CAST(floor((Z-z0)/0.5) AS BIGINT) AS vz FROM evt, least), mean AS (SELECT vx,vy,vz, avg(X) AS mx, avg(Y) AS my, avg(Z) AS mz FROM vox GROUP BY ALL), kept AS (SELECT arg_min(point_id, (d2, point_id)) AS point_id FROM (SELECT vox.*, round((X-mx)**2+(Y-my)**2+(Z-mz)**2,9) AS d2 FROM vox JOIN mean USING (vx,vy,vz)) GROUP BY vx,vy,vz)"


@query(f"WITH {VOX} SELECT point_id, round(X,6) AS X, round(Y,6) AS Y, round(Z,6) AS Z FROM evt JOIN kept USING (point_id)")
def voxel_barycentric(s, d):
    """A1."""
    return points.homogenise(evt(s, d), 0.5).select("point_id", "X", "Y", "Z")


@query(f"WITH {VOX}, n AS (SELECT CAST(floor(0.1*count(*)) AS BIGINT) AS n FROM kept), more AS (SELECT point_id, row_number() OVER (ORDER BY md5(point_id::VARCHAR||'-42'), point_id) AS rn FROM evt WHERE point_id NOT IN (SELECT point_id FROM kept)) SELECT point_id FROM kept UNION ALL SELECT point_id FROM more, n WHERE rn <= n")
def hybrid_md5(s, d):
    """A2."""
    return points.hybrid_homogenise(evt(s, d), 0.5).select("point_id")


@query(f"WITH {VOX} SELECT vx, vy, vz, count(*) AS n FROM vox GROUP BY ALL")
def voxel_occupancy(s, d):
    """A3, D5."""
    return points.voxel_occupancy(evt(s, d), 0.5)


@query("SELECT round(min(l_quantity),6) AS minX, round(max(l_quantity),6) AS maxX, round(min(l_extendedprice/1000),6) AS minY, round(max(l_extendedprice/1000),6) AS maxY, round(min(l_discount*100),6) AS minZ, round(max(l_discount*100),6) AS maxZ FROM lineitem", views=False)
def bbox(s, d):
    """A7."""
    return points.bbox(tables.points_of_lines(s, d))


@query("SELECT point_id, CASE WHEN hag > 0.25 THEN UserData ELSE 1 END AS UserData FROM evt")
def height_cut(s, d):
    """F5."""
    return points.cut_low(evt(s, d)).select("point_id", "UserData")


@query("SELECT point_id FROM (SELECT *, abs(gpstime % 40) AS rng FROM evt) WHERE hag >= 4 OR rng <= 15")
def range_filter(s, d):
    """F6."""
    return points.filter_range(evt(s, d).withColumn("range", F.abs(F.col("gpstime") % 40))).select("point_id")


@query("SELECT point_id FROM evt, (SELECT min(hag)+0.05 AS low FROM evt) WHERE foliage=0 AND (abs(hag-low)<0.025 OR abs(hag-0.7)<0.025 OR abs(hag-0.9)<0.025)")
def wood_slices(s, d):
    """F10, A8."""
    return points.wood_slices(evt(s, d)).select("point_id")


@query("SELECT point_id FROM evt WHERE passage > 15 AND hag < 0.9+0.2")
def long_passages(s, d):
    """F11."""
    return points.long_passages(evt(s, d)).select("point_id")


@query("SELECT point_id FROM evt, (SELECT min(hag) AS low FROM evt) WHERE passage > 1 AND passage < 10 AND hag < low+0.5")
def short_passages(s, d):
    """F12."""
    return points.short_passages(evt(s, d)).select("point_id")


@query("SELECT point_id FROM evt e WHERE NOT EXISTS (SELECT 1 FROM circle c WHERE sqrt((e.X-c.X)**2+(e.Y-c.Y)**2+(e.Z-c.Z)**2) > c.R+0.02 AND sqrt((e.X-c.X)**2+(e.Y-c.Y)**2+(e.Z-c.Z)**2) < c.R+0.2)")
def safe_zone_anti(s, d):
    """F13."""
    return points.outside_safe_zone(evt(s, d), tables.circles_of_suppliers(s, d)).select("point_id")


FLAGS = "flagged AS (SELECT point_id, treeID, CASE WHEN UserData=2 THEN 0 ELSE UserData END AS u FROM evt), tall AS (SELECT treeID FROM evt WHERE treeID>0 GROUP BY treeID HAVING max(hag)>2 AND min(hag)<2)"


@query(f"WITH {FLAGS} SELECT point_id, CASE WHEN u<>1 AND treeID NOT IN (SELECT treeID FROM tall) THEN 2 ELSE u END AS UserData FROM flagged")
def flag_small_trees(s, d):
    """A12, A11."""
    return points.flag_small_trees(evt(s, d), 2).select("point_id", "UserData")


@query("SELECT point_id FROM evt WHERE treeID IN (SELECT treeID FROM evt GROUP BY treeID HAVING max(hag) < 47)")
def keep_small_trees(s, d):
    """F15."""
    return points.keep_small_trees(evt(s, d), 47).select("point_id")


@query("SELECT point_id FROM evt WHERE UserData=0 AND treeID>0 AND treeID IN (SELECT treeID FROM evt WHERE UserData=0 GROUP BY treeID HAVING max(hag) >= 10)")
def eligible_trees(s, d):
    """F16."""
    return points.eligible_trees(evt(s, d), 10).select("point_id")


ROOTS = "roots AS (SELECT treeID, avg(X) AS X, avg(Y) AS Y, avg(Z) AS Z FROM (SELECT *, row_number() OVER (PARTITION BY treeID ORDER BY Z, point_id) AS rn FROM evt WHERE treeID>0) WHERE rn<=100 GROUP BY treeID HAVING count(*)>=10)"


@query(f"WITH {ROOTS} SELECT treeID, round(X,6) AS X, round(Y,6) AS Y, round(Z,6) AS Z FROM roots")
def tree_roots_lowest(s, d):
    """A14, W9."""
    return points.tree_roots(evt(s, d))


@query("SELECT treeID, round(avg(X),6) AS X, round(avg(Y),6) AS Y, round(avg(Z),6) AS Z FROM evt WHERE treeID>0 AND passage>10 GROUP BY treeID")
def tree_roots_seeds(s, d):
    """A13."""
    return points.tree_roots(evt(s, d), evt(s, d).where("passage > 10"))


@query(f"WITH {ROOTS}, ins AS (SELECT treeID FROM roots WHERE X>=4 AND X<=6 AND Y>=4 AND Y<=6) SELECT point_id, CASE WHEN v<>1 AND treeID NOT IN (SELECT treeID FROM ins) THEN 3 ELSE v END AS UserData FROM (SELECT *, CASE WHEN UserData=3 THEN 0 ELSE UserData END AS v FROM evt)")
def flag_buffer_box(s, d):
    """A16, J18, A15."""
    p = evt(s, d)
    return points.flag_buffer(p, points.convex_hull([(0, 0), (10, 0), (10, 10), (0, 10), (5, 5)]), points.tree_roots(p), -4).select("point_id", "UserData")


@query("SELECT point_id, round(X+o,6) AS X, round(Z-o,6) AS Z, CASE WHEN o=0 THEN passage ELSE -1 END AS passage FROM evt, (VALUES (0.0),(-0.01),(0.01)) v(o)")
def densify(s, d):
    """U4."""
    return points.densify(evt(s, d)).select("point_id", "X", "Z", "passage")


@query("SELECT point_id, round(X,6) AS X, treeID FROM evt UNION ALL SELECT point_id, round(X,6), treeID FROM emb")
def union_common(s, d):
    """U1, U5."""
    return points.union_common(evt(s, d).select("point_id", "X", "hag", "treeID"), emb(s, d).withColumn("treeID", F.col("treeID").cast("long")).select("point_id", "X", "treeID", "foliage"))


@query("SELECT point_id, round((X-1)*2,6) AS X, round((Y-2)*3,6) AS Y, round((Z-3)*4,6) AS Z FROM evt")
def translate_scale(s, d):
    """P1, P2, P4."""
    return points.scale(points.translate(evt(s, d), 1, 2, 3), 2, 3, 4).select("point_id", "X", "Y", "Z")


@query("SELECT point_id, round(X-ox,6) AS X, round(Y-oy,6) AS Y, round(Z-oz,6) AS Z FROM evt, (SELECT round(avg(X),1) AS ox, round(avg(Y),1) AS oy, round(min(Z),1) AS oz FROM evt)")
def center_scene(s, d):
    """P5."""
    return points.centre(evt(s, d)).select("point_id", "X", "Y", "Z")


PAIRS = "pair AS (SELECT a.point_id AS qid, b.point_id, a.treeID AS ta, b.treeID AS tb, b.X, b.Y, b.Z, b.foliage, (a.X-b.X)**2+(a.Y-b.Y)**2+(a.Z-b.Z)**2 AS d2 FROM emb a, emb b), near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, point_id) AS rank FROM pair)"


@query(f"WITH {PAIRS} SELECT qid, point_id, round(d2,6) AS d2, CAST(rank AS INTEGER) AS rank FROM near WHERE rank<=8")
def knn8(s, d):
    """J1, J2."""
    return spatial.knn_join(emb(s, d), emb(s, d), 8).select("qid", "point_id", "d2", "rank")


@query(f"WITH {PAIRS} SELECT qid, point_id, round(d2,6) AS d2 FROM pair WHERE d2 < 0.5*0.5")
def radius_pairs(s, d):
    """J3."""
    return spatial.radius_join(emb(s, d), emb(s, d), 0.5)


@query("WITH r AS (SELECT e.point_id, m.treeID, row_number() OVER (PARTITION BY e.point_id ORDER BY (e.X-m.X)**2+(e.Y-m.Y)**2+(e.Z-m.Z)**2, m.point_id) AS rn FROM emb e, emb m WHERE e.point_id%2=0 AND m.point_id%2=1) SELECT point_id, treeID FROM r WHERE rn=1")
def nn_transfer(s, d):
    """J4, J5, J8."""
    e = emb(s, d)
    return spatial.transfer_attributes(e.where("point_id % 2 = 1"), e.where("point_id % 2 = 0"), ["treeID"]).select("point_id", "treeID")


@query(f"WITH {PAIRS}, m AS (SELECT qid AS point_id, avg(sqrt(d2)) AS mean_d FROM near WHERE rank<=9 AND qid<>point_id AND d2>0 GROUP BY qid) SELECT point_id, round(mean_d,6) AS mean_d, mean_d > (SELECT avg(mean_d)+stddev_samp(mean_d) FROM m) AS noise FROM m")
def sor_noise(s, d):
    """A4, U3."""
    return points.sor(emb(s, d), 8, 1.0)


@query(f"""WITH {PAIRS}, c AS (SELECT qid, covar_samp(X,X) AS xx, covar_samp(Y,Y) AS yy, covar_samp(Z,Z) AS zz, covar_samp(X,Y) AS xy, covar_samp(X,Z) AS xz, covar_samp(Y,Z) AS yz FROM near WHERE rank<=8 GROUP BY qid),
q AS (SELECT *, (xx+yy+zz)/3 AS q, sqrt(((xx-(xx+yy+zz)/3)**2+(yy-(xx+yy+zz)/3)**2+(zz-(xx+yy+zz)/3)**2+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM c),
f AS (SELECT *, acos(greatest(-1,least(1,((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(2*p*p*p))))/3 AS phi FROM q)
SELECT qid AS point_id, round((q+2*p*cos(phi)-(q+2*p*cos(phi+2*pi()/3)))/(q+2*p*cos(phi)),6) AS pwood FROM f""")
def anisotropy(s, d):
    """A5."""
    return points.anisotropy(emb(s, d), 8)


@query(f"WITH {PAIRS} SELECT qid AS point_id, round(avg(X),6) AS X, round(avg(Y),6) AS Y, round(avg(Z),6) AS Z FROM pair WHERE d2 < 0.25 GROUP BY qid")
def smooth3d(s, d):
    """A6."""
    return points.smooth(emb(s, d), 0.5)


@query(f"WITH {PAIRS} SELECT point_id FROM emb WHERE treeID IN (SELECT tb FROM pair WHERE ta=3 AND tb>0 AND d2 < 0.09)")
def tree_context(s, d):
    """J14, J15."""
    return spatial.tree_context(emb(s, d), 3, 0.3)


@query(f"WITH {PAIRS} SELECT DISTINCT point_id FROM near WHERE qid%3=0 AND rank<=10 AND d2 <= 0.3*0.3 UNION SELECT point_id FROM emb WHERE foliage=0")
def wood_dilation(s, d):
    """J12, J13, V3a, V3d, U2."""
    return points.dilate(emb(s, d), F.col("foliage") == 0, 10, 0.3)


def _cc(conn: int) -> str:
    most = {6: 1, 18: 2, 26: 3}[conn]
    return f"""base AS (SELECT floor(min(X)/0.3)*0.3 AS x0, floor(min(Y)/0.3)*0.3 AS y0, floor(min(Z)/0.3)*0.3 AS z0 FROM emb),
v AS (SELECT point_id, CAST(floor((X-x0)/0.3) AS BIGINT) AS a, CAST(floor((Y-y0)/0.3) AS BIGINT) AS b, CAST(floor((Z-z0)/0.3) AS BIGINT) AS c FROM emb, base),
cell AS (SELECT a,b,c,row_number() OVER (ORDER BY a,b,c) AS node FROM (SELECT DISTINCT a,b,c FROM v)),
link AS (SELECT p.node AS s, q.node AS t FROM cell p JOIN cell q ON abs(p.a-q.a)<=1 AND abs(p.b-q.b)<=1 AND abs(p.c-q.c)<=1 AND abs(p.a-q.a)+abs(p.b-q.b)+abs(p.c-q.c) BETWEEN 0 AND {most}),
reach(s,t) AS (SELECT s,t FROM link UNION SELECT r.s, l.t FROM reach r JOIN link l ON r.t=l.s), comp AS (SELECT s AS node, min(t) AS m FROM reach GROUP BY s),
lab AS (SELECT point_id, CAST(dense_rank() OVER (ORDER BY m) AS INTEGER) AS cluster FROM v JOIN cell USING (a,b,c) JOIN comp USING (node))"""


for _conn in (6, 18, 26):

    def _f(s, d, c=_conn):
        """C1."""
        return points.voxel_components(emb(s, d), 0.3, c)

    _f.__name__ = f"voxel_cc{_conn}"
    query(f"WITH {_cc(_conn)} SELECT point_id, cluster FROM lab")(_f)


@query(f"WITH {_cc(26)} SELECT point_id, CASE WHEN count(*) OVER (PARTITION BY cluster) >= 10 THEN cluster ELSE 0 END AS cluster FROM lab")
def cc_min_size(s, d):
    """C2, A9, V3b."""
    return points.large_components(emb(s, d), 0.3, 10)


@query("""WITH base AS (SELECT floor(min(X)/0.8)*0.8 AS x0, floor(min(Y)/0.8)*0.8 AS y0, floor(min(Z*0.1)/0.8)*0.8 AS z0 FROM emb),
v AS (SELECT point_id, treeID, CAST(floor((X-x0)/0.8) AS BIGINT) AS a, CAST(floor((Y-y0)/0.8) AS BIGINT) AS b, CAST(floor((Z*0.1-z0)/0.8) AS BIGINT) AS c FROM emb, base),
cell AS (SELECT treeID,a,b,c,row_number() OVER (ORDER BY treeID,a,b,c) AS node FROM (SELECT DISTINCT treeID,a,b,c FROM v)),
link AS (SELECT p.node AS s, q.node AS t FROM cell p JOIN cell q ON p.treeID=q.treeID AND abs(p.a-q.a)<=1 AND abs(p.b-q.b)<=1 AND abs(p.c-q.c)<=1),
reach(s,t) AS (SELECT s,t FROM link UNION SELECT r.s, l.t FROM reach r JOIN link l ON r.t=l.s), comp AS (SELECT s AS node, min(t) AS m FROM reach GROUP BY s),
n AS (SELECT treeID, m, count(*) AS n FROM v JOIN cell USING (treeID,a,b,c) JOIN comp USING (node) GROUP BY ALL), best AS (SELECT treeID, arg_max(m, (n, -m)) AS m FROM n GROUP BY treeID)
SELECT point_id, v.treeID, comp.m = best.m AS largest FROM v JOIN cell USING (treeID,a,b,c) JOIN comp USING (node) JOIN best ON best.treeID=v.treeID""")
def largest_component(s, d):
    """A10, C6, C7."""
    return points.largest_component(emb(s, d), 0.8, "treeID", 0.1)


@query(f"""WITH {PAIRS}, link AS (SELECT qid AS s, point_id AS t FROM pair WHERE ta=tb AND d2 < 0.36), reach(s,t) AS (SELECT s,t FROM link UNION SELECT r.s, l.t FROM reach r JOIN link l ON r.t=l.s), comp AS (SELECT s AS point_id, min(t) AS m FROM reach GROUP BY s)
SELECT point_id, treeID, CAST(dense_rank() OVER (ORDER BY treeID, m) AS INTEGER) AS cluster FROM emb JOIN comp USING (point_id)""")
def dbscan_layers(s, d):
    """C3."""
    return points.layer_clusters(emb(s, d), "treeID", 0.6)


@query("""WITH link AS (SELECT a.id AS s, b.id AS t FROM circle a, circle b WHERE a.id=b.id OR sqrt((a.X-b.X)**2+(a.Y-b.Y)**2) < a.R+b.R), reach(s,t) AS (SELECT s,t FROM link UNION SELECT r.s, l.t FROM reach r JOIN link l ON r.t=l.s)
SELECT s AS id, min(t) AS grp FROM reach GROUP BY s""")
def circle_groups(s, d):
    """C4, J21."""
    return verbs.circle_groups(tables.circles_of_suppliers(s, d))


@query("SELECT id, CAST(i AS INTEGER) AS i, round(X+R*cos(i*2*pi()/ceil(2*pi()*R/0.0375)),6) AS x, round(Y+R*sin(i*2*pi()/ceil(2*pi()*R/0.0375)),6) AS y, round(Z,6) AS z FROM (SELECT *, unnest(range(CAST(ceil(2*pi()*R/0.0375) AS BIGINT))) AS i FROM circle)")
def cage_points(s, d):
    """Points along each circle, 0.75 decimations apart."""
    n = F.ceil(2 * F.pi() * F.col("R") / 0.0375)
    c = tables.circles_of_suppliers(s, d).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    angle = F.col("i") * 2 * F.pi() / F.col("n")
    return c.select("id", "i", (F.col("X") + F.col("R") * F.cos(angle)).alias("x"), (F.col("Y") + F.col("R") * F.sin(angle)).alias("y"), F.col("Z").alias("z"))


EDGES = f"{PAIRS}, edge AS (SELECT n.qid AS src, n.point_id AS dst, d2, CASE WHEN dz>0 THEN 1 ELSE 0 END AS up, sqrt(d2)**3 * CASE WHEN deg>100 THEN 100 ELSE exp(deg*0.046051) END * CASE WHEN a.foliage=0 AND n.foliage=0 THEN 0.1 WHEN a.foliage<>0 AND n.foliage<>0 THEN 20 WHEN a.foliage=0 THEN 1000 ELSE 1 END AS cost FROM (SELECT *, rank AS rk FROM near) n JOIN emb a ON a.point_id=n.qid JOIN LATERAL (SELECT n.Z-a.Z AS dz, round_even(degrees(acos(greatest(-1,least(1,(n.Z-a.Z)/sqrt(n.d2))))),0) AS deg) g ON true WHERE rk<=11 AND n.qid<>n.point_id AND sqrt(d2) <= 1.0)"


def edges(s: SparkSession, d: str) -> DataFrame:
    """Core edges with cost d^3, penalty by the angle to upwards, and wood factors."""
    e = emb(s, d)
    n = spatial.knn_join(e, e, 11, ("Z", "foliage")).where("qid <> point_id and sqrt(d2) <= 1.0")
    a = e.select(F.col("point_id").alias("qid"), F.col("Z").alias("z0"), F.col("foliage").alias("f0"))
    wood, was = F.col("foliage") == 0, F.col("f0") == 0
    factor = F.when(was & wood, 0.1).when(~was & ~wood, 20.0).when(was, 1000.0).otherwise(1.0)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("Z") - F.col("z0")) / F.sqrt("d2")))))
    return n.join(a, "qid").select(F.col("qid").alias("src"), F.col("point_id").alias("dst"), (F.pow(F.sqrt("d2"), F.lit(3.0)) * G.penalty(angle) * factor).alias("cost"))


@query(f"WITH {EDGES} SELECT src, dst, round(cost,6) AS cost FROM edge")
def graph_edges(s, d):
    """G1, J7, P18, V3f."""
    return edges(s, d)


@query(f"WITH {EDGES}, seen(node) AS (SELECT 0::BIGINT UNION SELECT dst FROM seen JOIN edge ON src=node) SELECT node FROM seen")
def reachable(s, d):
    """G3."""
    return graph.reachable(edges(s, d), s.range(1).select(F.col("id").alias("node")), spatial.places(emb(s, d)))


#: Bellman-Ford over paths with a bound on steps: the best costs so far travel with the recursion.
PATHS = "walk(node, dist, source, step) AS (SELECT s, 0.0::DOUBLE, s, 0 FROM starts UNION ALL (SELECT node, dist, source, step FROM (SELECT e.dst AS node, w.dist+e.cost AS dist, w.source, w.step+1 AS step, row_number() OVER (PARTITION BY e.dst ORDER BY w.dist+e.cost, w.source) AS rn FROM walk w JOIN edge e ON e.src=w.node) WHERE rn=1 AND step<=60)), best AS (SELECT node, min(dist) AS dist, arg_min(source, dist) AS source FROM walk GROUP BY node)"


@query(f"WITH {EDGES}, starts(s) AS (SELECT 0::BIGINT), {PATHS} SELECT node, round(dist,6) AS dist FROM best")
def sssp(s, d):
    """G6."""
    return graph.shortest_paths(edges(s, d), s.range(1).select(F.col("id").alias("node")), spatial.places(emb(s, d))).select("node", "dist")


@query(f"WITH {EDGES}, starts(s) AS (SELECT point_id FROM emb WHERE point_id%100=7), {PATHS} SELECT node, round(dist,6) AS dist, source FROM best")
def multi_source(s, d):
    """G7, V5's core: distance and label of the nearest source."""
    return graph.shortest_paths(edges(s, d), emb(s, d).where("point_id % 100 = 7").select(F.col("point_id").alias("node")), spatial.places(emb(s, d))).select("node", "dist", "source")


@query()
def passages(s, d):
    """Number of shortest paths from node 0 through each node: the sizes of the subtrees of the predecessor forest."""
    return graph.passages(graph.shortest_paths(edges(s, d), s.range(1).select(F.col("id").alias("node")), spatial.places(emb(s, d))))


@query("SELECT tree_id, cyl_ID, round(len,6) AS len, round(pi()*radius*radius*len,6) AS volume, round(CASE WHEN len<1e-6 THEN 0 ELSE degrees(acos(greatest(-1,least(1,(endZ-startZ)/len)))) END,6) AS inclination FROM heap")
def cyl_geometry(s, d):
    """P7."""
    return heap(s, d).select("tree_id", "cyl_ID", G.length().alias("len"), G.volume().alias("volume"), G.inclination().alias("inclination"))


DIST = "pc AS (SELECT e.point_id, h.*, ((e.X-startX)*(endX-startX)+(e.Y-startY)*(endY-startY)+(e.Z-startZ)*(endZ-startZ))/(len*len) AS t, e.X, e.Y, e.Z FROM evt e JOIN heap h ON h.tree_id=e.treeID WHERE len>1e-9), pr AS (SELECT *, sqrt((X-startX-t*(endX-startX))**2+(Y-startY-t*(endY-startY))**2+(Z-startZ-t*(endZ-startZ))**2) AS rho, CASE WHEN t<0 THEN -t ELSE t-1 END*len AS ax FROM pc), dist AS (SELECT point_id, cyl_ID, radius, CASE WHEN t>=0 AND t<=1 THEN greatest(0,rho-radius) WHEN rho<=radius THEN ax ELSE sqrt(ax*ax+greatest(0,rho-radius)**2) END AS dist FROM pr)"


@query(f"WITH {DIST} SELECT point_id, cyl_ID, round(dist,6) AS dist FROM dist")
def point_cyl_distance(s, d):
    """An equi-join on the tree."""
    j = evt(s, d).join(heap(s, d).where(G.length() > 1e-9), F.col("treeID") == F.col("tree_id"))
    return G.with_surface_distance(j, *"XYZ").select("point_id", "cyl_ID", "dist")


@query(f"WITH {DIST} SELECT point_id, CAST(CASE WHEN min(dist - 1.3*radius) < 0.02 THEN 0 ELSE 1 END AS INTEGER) AS foliage FROM dist GROUP BY point_id")
def segment_by_model(s, d):
    """Wood within 1.3 radii and two centimetres of any cylinder of its tree."""
    j = evt(s, d).join(heap(s, d).where(G.length() > 1e-9), F.col("treeID") == F.col("tree_id"))
    off = F.col("dist") - 1.3 * F.col("radius")
    return G.with_surface_distance(j, *"XYZ").groupBy("point_id").agg(F.when(F.min(off) < 0.02, 0).otherwise(1).alias("foliage"))


@query("""WITH mid AS (SELECT cyl_ID + tree_id*1000 AS id, *, (startX/2+endX/2) AS mx, (startY/2+endY/2) AS my, (startZ/2+endZ/2) AS mz FROM heap WHERE len>1e-9),
near AS (SELECT e.point_id, m.*, e.X AS px, e.Y AS py, e.Z AS pz, row_number() OVER (PARTITION BY e.point_id ORDER BY (e.X-mx)**2+(e.Y-my)**2+(e.Z-mz)**2, id) AS rn FROM emb e, mid m),
p AS (SELECT *, ((px-startX)*(endX-startX)+(py-startY)*(endY-startY)+(pz-startZ)*(endZ-startZ))/(len*len) AS t FROM near WHERE rn<=10),
q AS (SELECT *, sqrt((px-startX-t*(endX-startX))**2+(py-startY-t*(endY-startY))**2+(pz-startZ-t*(endZ-startZ))**2) AS rho, CASE WHEN t<0 THEN -t ELSE t-1 END*len AS ax FROM p)
SELECT point_id, round(min(CASE WHEN t>=0 AND t<=1 THEN greatest(0,rho-radius) WHEN rho<=radius THEN ax ELSE sqrt(ax*ax+greatest(0,rho-radius)**2) END),6) AS dist FROM q GROUP BY point_id""")
def model_distances(s, d):
    """The ten nearest midpoints of all trees, then the exact distance to the surface."""
    c = heap(s, d).where(G.length() > 1e-9).withColumn("cyl_ID", F.col("cyl_ID") + F.col("tree_id") * 1000)
    return spatial.model_distances(emb(s, d), c, 10).select("point_id", "dist")


@query("SELECT tree_id, cyl_ID, round(dist_to_root,6) AS dist_to_root FROM sub")
def dist_to_root(s, d):
    """G13, G10's accumulation."""
    return trees.dist_to_root(heap(s, d)).select("tree_id", "cyl_ID", "dist_to_root")


@query("SELECT tree_id, cyl_ID, round(subtree_length,6) AS subtree_length, round(subtree_max_z,6) AS subtree_max_z, round(subtree_volume,6) AS subtree_volume FROM sub")
def subtree_folds(s, d):
    """G14, G15, G16."""
    return trees.subtree(heap(s, d)).select("tree_id", "cyl_ID", "subtree_length", "subtree_max_z", "subtree_volume")


@query("SELECT tree_id, cyl_ID, CAST(branch_order AS BIGINT) AS branch_order, axis FROM arch")
def branch_order(s, d):
    """G17."""
    return trees.architecture(heap(s, d)).select("tree_id", "cyl_ID", F.col("branch_order").cast("long").alias("branch_order"), "axis")


#: Every fifth tree has a cycle, the next a second root, the next an unset radius.
UNSOUND = """sick AS (SELECT tree_id, cyl_ID, CASE WHEN tree_id%5=1 AND cyl_ID=3 THEN 6 WHEN tree_id%5=2 AND cyl_ID=5 THEN -7 ELSE parent_ID END AS parent_ID, CASE WHEN tree_id%5=3 AND cyl_ID=4 THEN NULL ELSE radius END AS radius FROM heap),
head AS (SELECT s.* FROM sick s WHERE NOT EXISTS (SELECT 1 FROM sick p WHERE p.tree_id=s.tree_id AND p.cyl_ID=s.parent_ID)),
seen(tree_id, cyl_ID) AS (SELECT tree_id, cyl_ID FROM head UNION SELECT s.tree_id, s.cyl_ID FROM seen x JOIN sick s ON s.tree_id=x.tree_id AND s.parent_ID=x.cyl_ID)"""


def sick(s: SparkSession, d: str) -> DataFrame:
    t, c = F.col("tree_id") % 5, F.col("cyl_ID")
    return heap(s, d).withColumns({"parent_ID": F.when((t == 1) & (c == 3), 6).when((t == 2) & (c == 5), -7).otherwise(F.col("parent_ID")), "radius": F.when(~((t == 3) & (c == 4)), F.col("radius"))})


@query(f"WITH {UNSOUND}, r AS (SELECT tree_id, count(DISTINCT parent_ID) AS roots FROM head GROUP BY 1), o AS (SELECT tree_id, count(*) AS n, count(*) FILTER (radius IS NULL) AS unset FROM sick GROUP BY 1), g AS (SELECT tree_id, count(*) AS got FROM seen GROUP BY 1) SELECT tree_id, n, coalesce(roots,0) AS roots, n-coalesce(got,0) AS unreached, unset, coalesce(roots,0)=1 AND n=coalesce(got,0) AND unset=0 AS valid FROM o LEFT JOIN r USING (tree_id) LEFT JOIN g USING (tree_id)")
def validate_tree(s, d):
    """G11, G18."""
    return trees.validate(sick(s, d))


@query(f"WITH {UNSOUND}, f AS (SELECT tree_id, arg_min(parent_ID, cyl_ID) AS p FROM head GROUP BY 1), own(tree_id, cyl_ID) AS (SELECT h.tree_id, h.cyl_ID FROM head h JOIN f ON f.tree_id=h.tree_id AND f.p=h.parent_ID UNION SELECT s.tree_id, s.cyl_ID FROM own x JOIN sick s ON s.tree_id=x.tree_id AND s.parent_ID=x.cyl_ID) SELECT tree_id, cyl_ID FROM own")
def remove_disconnected(s, d):
    """G19."""
    return trees.remove_disconnected(sick(s, d)).select("tree_id", "cyl_ID")


@query("WITH t AS (SELECT tree_id, cyl_ID, CASE WHEN cyl_ID IN (2,3) THEN 0 ELSE parent_ID END AS parent_ID, startX, startY, startZ FROM heap), h AS (SELECT * FROM t WHERE parent_ID=0), n AS (SELECT tree_id, count(*) AS n, arg_min(startX, (startZ, cyl_ID)) AS x, arg_min(startY, (startZ, cyl_ID)) AS y, min(startZ) AS z FROM h GROUP BY 1 HAVING count(*)>1) SELECT tree_id, cyl_ID, CASE WHEN parent_ID=0 AND tree_id IN (SELECT tree_id FROM n) THEN -1 ELSE parent_ID END AS parent_ID, round(startZ,6) AS startZ FROM t UNION ALL SELECT tree_id, -1, -2, round(z-0.01,6) FROM n")
def fix_multiple_root(s, d):
    """The second and third cylinder start at the root as well."""
    t = heap(s, d).withColumn("parent_ID", F.when(F.col("cyl_ID").isin(2, 3), 0).otherwise(F.col("parent_ID")))
    return trees.fix_multiple_root(t).select("tree_id", "cyl_ID", "parent_ID", "startZ")


@query("SELECT h.tree_id, h.cyl_ID, h.parent_ID AS parent, coalesce(list_aggregate(k.kids, 'string_agg', ','), '') AS children, h.parent_ID=0 AS root FROM heap h LEFT JOIN (SELECT tree_id, parent_ID, list(cyl_ID ORDER BY cyl_ID) AS kids FROM heap GROUP BY 1, 2) k ON k.tree_id=h.tree_id AND k.parent_ID=h.cyl_ID")
def family(s, d):
    """G12, G18."""
    f = trees.family(heap(s, d))
    return f.select("tree_id", "cyl_ID", F.coalesce("parent", F.lit(0)).alias("parent"), F.array_join("children", ",").alias("children"), "root")


@query("SELECT tree_id, cyl_ID, row_number() OVER (PARTITION BY tree_id, axis ORDER BY subtree_length DESC, cyl_ID) AS place FROM arch")
def axis_map(s, d):
    """W1."""
    return trees.axis_map(grown(s, d).withColumn("axis_ID", F.col("axis"))).select("tree_id", "cyl_ID", F.col("place").cast("long").alias("place"))


@query("WITH q AS (SELECT *, cyl_ID*7%11 AS quality, row_number() OVER (PARTITION BY tree_id, axis ORDER BY subtree_length DESC, cyl_ID) AS i FROM arch), g AS (SELECT *, i-coalesce(max(CASE WHEN quality>=4 THEN i END) OVER (PARTITION BY tree_id, axis ORDER BY i),0) AS run FROM q), e AS (SELECT *, max(CASE WHEN quality<4 THEN run ELSE 0 END) OVER (PARTITION BY tree_id, axis ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM g) SELECT tree_id, cyl_ID FROM e WHERE coalesce(most,0)<3")
def failing_run(s, d):
    """An axis ends with the third failure in a row."""
    c = grown(s, d).withColumns({"axis_ID": F.col("axis"), "quality": F.col("cyl_ID") * 7 % 11})
    return trees.failing_run(c, 3).select("tree_id", "cyl_ID")


@query("SELECT tree_id, cyl_ID, round(radius,6) AS radius FROM arch WHERE branch_order=1")
def stem(s, d):
    """F17."""
    return trees.stem(grown(s, d)).select("tree_id", "cyl_ID", "radius")


@query("SELECT tree_id, cyl_ID, round(CASE WHEN dist_to_root<0.15 THEN 0 ELSE radius END,6) AS radius FROM sub")
def nostump(s, d):
    """F19."""
    return trees.nostump(trees.dist_to_root(heap(s, d))).select("tree_id", "cyl_ID", "radius")


@query("WITH k AS (SELECT * FROM arch WHERE thick > 0.045), ax AS (SELECT tree_id, axis FROM k GROUP BY ALL HAVING sum(len) >= 1) SELECT tree_id, cyl_ID FROM k JOIN ax USING (tree_id, axis)")
def merchantable(s, d):
    """G21."""
    return trees.merchantable(grown(s, d)).select("tree_id", "cyl_ID")


DBH = "o AS (SELECT *, lead(dist_to_root) OVER w AS d2, lead(radius) OVER w AS r2, lead(startX) OVER w AS x2, lead(startY) OVER w AS y2, lead(startZ) OVER w AS z2, row_number() OVER w AS rn FROM chain2 WINDOW w AS (PARTITION BY tree_id ORDER BY dist_to_root, cyl_ID)), b AS (SELECT tree_id, CASE WHEN (rn=1 AND dist_to_root>1.3) OR d2 IS NULL THEN 0 ELSE (1.3-dist_to_root)/(d2-dist_to_root) END AS f, o.* EXCLUDE (tree_id) FROM o WHERE (rn=1 AND dist_to_root>1.3) OR (d2 IS NULL AND dist_to_root<=1.3) OR (dist_to_root<=1.3 AND d2>1.3)), dbh AS (SELECT tree_id, 2*(radius+f*(coalesce(r2,radius)-radius)) AS dbh, startX+f*(coalesce(x2,startX)-startX) AS x, startY+f*(coalesce(y2,startY)-startY) AS y, startZ+f*(coalesce(z2,startZ)-startZ) AS z FROM b)"


@query(f"WITH {DBH} SELECT tree_id, round(dbh,6) AS dbh, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z FROM dbh")
def dbh(s, d):
    """W4."""
    return trees.dbh(chain(s, d))


@query("SELECT tree_id, cyl_ID, round(max(subtree_length) OVER (PARTITION BY tree_id)-subtree_length,6) AS distance, round(2*radius,6) AS diameter FROM chain2")
def stem_taper(s, d):
    """A19."""
    return trees.stem_taper(chain(s, d))


@query("SELECT tree_id, CAST(ceil(radius*100/2) AS BIGINT)*2 AS class_cm, round(sum(pi()*radius*radius*len),3) AS volume, count(*) AS n FROM heap GROUP BY ALL")
def stats_radius(s, d):
    """A17."""
    return trees.stats_radius(heap(s, d))


@query("WITH v AS (SELECT tree_id, CAST(branch_order AS BIGINT) AS branch_order, round(sum(pi()*radius*radius*len),3) AS volume FROM arch GROUP BY ALL) SELECT tree_id, branch_order, volume, round(sum(volume) OVER (PARTITION BY tree_id ORDER BY branch_order)/sum(volume) OVER (PARTITION BY tree_id)*100,1) AS percent FROM v")
def stats_order(s, d):
    """A18, W2."""
    return trees.stats_order(grown(s, d).withColumn("branch_order", F.col("branch_order").cast("long")))


STATS = f"{DBH}, st AS (SELECT c.tree_id, arg_min(startX,cyl_ID) AS X_root, arg_min(startY,cyl_ID) AS Y_root, arg_min(startZ,cyl_ID) AS Z_root, round(sum(pi()*radius*radius*len),3) AS V, round(max(endZ)-arg_min(startZ,cyl_ID),3) AS H FROM chain2 c GROUP BY c.tree_id)"


@query(f"WITH {STATS} SELECT st.tree_id, round(X_root,6) AS X_root, round(Y_root,6) AS Y_root, round(Z_root,6) AS Z_root, round(x,6) AS X_bh, round(y,6) AS Y_bh, round(z,6) AS Z_bh, round(dbh,6) AS DBH, V, H FROM st JOIN dbh USING (tree_id)")
def stats_global(s, d):
    """A20, A21, A22, A23."""
    return trees.stats_global(chain(s, d))


@query(f"WITH {STATS} SELECT st.tree_id, round(X_root,6) AS X, round(Y_root,6) AS Y FROM st")
def treemap(s, d):
    """V8."""
    return trees.stats_global(chain(s, d)).select("tree_id", F.col("X_root").alias("X"), F.col("Y_root").alias("Y"))


@query(f"WITH {STATS} SELECT tree_id FROM st JOIN dbh USING (tree_id) WHERE dbh/2 > 0.045")
def qsf_merchantable(s, d):
    """F18."""
    return trees.qsf_merchantable(trees.stats_global(chain(s, d))).select("tree_id")


@query(f"WITH {STATS} SELECT count(*) AS n, round(round((max(X_bh)-min(X_bh))*(max(Y_bh)-min(Y_bh))*1000/50)*50,6) AS area, round(sum(pi()*(dbh/2)**2),6) AS ba, round(avg(dbh),6) AS mean_dbh, round(avg(H),6) AS mean_h, round(sum(V),6) AS volume, (SELECT max(n0+ceil(round((h-v0)/v,9))) FROM (SELECT v, sum(v*k) OVER ()/2 AS h, coalesce(sum(v*k) OVER o,0) AS v0, coalesce(sum(k) OVER o,0) AS n0, k FROM (SELECT round(V,3) AS v, count(*) AS k FROM st WHERE V>0 GROUP BY 1) WINDOW o AS (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE v0<h AND v0+v*k>=h)::BIGINT AS half FROM (SELECT st.*, dbh, x AS X_bh, y AS Y_bh FROM st JOIN dbh USING (tree_id))")
def forest_report(s, d):
    """Roots are spread by their places at breast height, a thousandfold, for want of a real plot."""
    t = trees.stats_global(chain(s, d))
    spread = t.withColumns({"X_root": F.col("X_bh") * 1000, "Y_root": F.col("Y_bh")})
    r = trees.forest_report(spread)
    return r.select("n", "area", (F.col("ba_ha") * F.col("area") / 10000).alias("ba"), "mean_dbh", "mean_h", "volume", F.col("half").cast("long").alias("half"))


@query("SELECT source AS type, count(*) AS n, CAST(min(doc_id) AS BIGINT) AS first FROM documents GROUP BY source", views=False)
def log_tags(s, d):
    """A25, P16."""
    m = tables.read(s, d, "documents").select(F.col("doc_id").alias("tree_id"), F.concat(F.lit("["), "source", F.lit("] "), F.coalesce("lang", F.lit(""))).alias("message"))
    return trees.log_tags(m).select("type", "n", F.get("trees", 0).alias("first"))


@query("WITH r AS (SELECT *, round(abs(sum(len) OVER (PARTITION BY tree_id ORDER BY cyl_ID)-1.3),9) AS off FROM chain), b AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY off, cyl_ID) AS rn FROM r) SELECT tree_id, cyl_ID, round((startX+endX)/2,6) AS x, round((startY+endY)/2,6) AS y, round((startZ+endZ)/2,6) AS z, round(radius+0.01,6) AS radius FROM b WHERE rn=1")
def ring(s, d):
    """W3."""
    return trees.ring(chain(s, d))


@query("WITH i AS (SELECT *, CASE WHEN len<1e-6 THEN 0 ELSE degrees(acos(greatest(-1,least(1,(endZ-startZ)/len)))) END AS inc FROM chain2), w AS (SELECT *, max(inc) OVER (PARTITION BY tree_id ORDER BY cyl_ID ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS most, count(*) OVER (PARTITION BY tree_id ORDER BY cyl_ID ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM i) SELECT tree_id, min(cyl_ID) AS first FROM w WHERE n=4 AND most<50 GROUP BY tree_id")
def weird_butt(s, d):
    """W7's index; trees.drop_butt removes."""
    return trees.weird_butt(chain(s, d))


@query("SELECT tree_id, cyl_ID, round(CASE WHEN count(*) OVER t=1 THEN 0.2 WHEN max(subtree_length) OVER t=0 THEN 0.0025 ELSE 0.0025+pow(subtree_length/max(subtree_length) OVER t,1.1)*(0.2-0.0025) END,6) AS radius FROM chain2 WINDOW t AS (PARTITION BY tree_id)")
def conic(s, d):
    """R8, P21."""
    return trees.conic(chain(s, d), 0.2).select("tree_id", "cyl_ID", "radius")


#: Trees of several axes whose radii are unset for every third cylinder; qualities differ.
AXES = """ax AS (SELECT *, axis AS axis_ID, CASE WHEN cyl_ID%3=0 THEN NULL ELSE radius END AS r, CAST(cyl_ID*7%6 AS INTEGER) AS quality, dist_to_root*4 AS far FROM arch)"""
#: Sums of the taper over what `m` measures of an axis: r(x) = tip + a x + b x^2.
TAPER = """u AS (SELECT *, max(CASE WHEN m THEN subtree_length END) OVER w AS xm, min(CASE WHEN m THEN subtree_length END) OVER w AS last, count(*) FILTER (m) OVER w AS n FROM t WINDOW w AS (PARTITION BY tree_id, axis_ID)),
v AS (SELECT *, sum(CASE WHEN m THEN (subtree_length**2-2*xm*subtree_length)**2 END) OVER w AS zz, sum(CASE WHEN m THEN (subtree_length**2-2*xm*subtree_length)*(r-tip) END) OVER w AS zy FROM u WINDOW w AS (PARTITION BY tree_id, axis_ID)),
p AS (SELECT *, CASE WHEN zz>=1e-12 THEN -2*zy/zz*xm*subtree_length+zy/zz*subtree_length**2+tip END AS guess FROM v)"""


def _axes(s: SparkSession, d: str) -> DataFrame:
    return grown(s, d).withColumns({"axis_ID": F.col("axis"), "radius": F.when(F.col("cyl_ID") % 3 != 0, F.col("radius")), "quality": (F.col("cyl_ID") * 7 % 6).cast("int"), "dist_to_root": F.col("dist_to_root") * 4})


@query(f"WITH {AXES}, t AS (SELECT *, 0.0025 AS tip, r IS NOT NULL AND far>1.3 AS m FROM ax), {TAPER} SELECT DISTINCT tree_id, axis_ID, round(-2*zy/zz*xm,6) AS a, round(zy/zz,6) AS b, n FROM v WHERE n>6 AND zz>=1e-12")
def poly_taper(s, d):
    """R6, A30."""
    return trees.taper_sums(_axes(s, d))


@query(f"WITH {AXES}, t AS (SELECT *, 0.0025 AS tip, r IS NOT NULL AND far>1.3 AS m FROM ax), {TAPER}, o AS (SELECT *, n>6 AND subtree_length>=last AND (r IS NULL OR (abs(r-guess)>0.3*guess AND quality<5)) AS new FROM p) SELECT tree_id, cyl_ID, round(CASE WHEN n<=6 THEN NULL WHEN new THEN guess ELSE r END,6) AS radius, CAST(CASE WHEN n<=6 THEN 0 WHEN new THEN 3 ELSE quality END AS INTEGER) AS quality FROM o")
def polynomial_fitting(s, d):
    """R4."""
    return trees.polynomial_fitting(_axes(s, d)).select("tree_id", "cyl_ID", "radius", "quality")


@query(f"WITH {AXES}, one AS (SELECT tree_id, cyl_ID, 1 AS axis_ID, CASE WHEN cyl_ID%3=0 THEN NULL ELSE radius END AS r, CAST(cyl_ID*7%6 AS INTEGER) AS quality, dist_to_root AS far, subtree_length FROM chain2), t AS (SELECT *, 0.0 AS tip, r IS NOT NULL AND far<=1.3 AS m FROM one), {TAPER}, o AS (SELECT *, n>4 AND subtree_length>=last AND (r IS NULL OR (abs(r-guess)>0.3*guess AND quality<5 AND far<=1.3)) AS new FROM p) SELECT tree_id, cyl_ID, round(CASE WHEN new THEN guess ELSE r END,6) AS radius, CAST(CASE WHEN new THEN 3 ELSE quality END AS INTEGER) AS quality FROM o")
def polynomial_fitting_root(s, d):
    """R5."""
    c = chain(s, d).withColumns({"axis_ID": F.lit(1), "radius": F.when(F.col("cyl_ID") % 3 != 0, F.col("radius")), "quality": (F.col("cyl_ID") * 7 % 6).cast("int")})
    return trees.polynomial_fitting_root(c).select("tree_id", "cyl_ID", "radius", "quality")


@query("SELECT tree_id, round(max(hag),6) AS prolong FROM evt JOIN (SELECT tree_id, min(endZ) AS low FROM heap GROUP BY tree_id) l ON l.tree_id=evt.treeID WHERE Z<=low GROUP BY tree_id")
def prolongation(s, d):
    """R10."""
    return trees.prolongation(evt(s, d), heap(s, d).withColumn("startZ", F.col("endZ")))


@query("SELECT round(gpstime,6) AS gpstime, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z FROM (SELECT gpstime, X AS x, Y AS y, Z AS z, row_number() OVER (PARTITION BY floor(gpstime/86400) ORDER BY gpstime) AS rn FROM evt WHERE treeID=1) WHERE rn=1")
def trajectory_thin(s, d):
    """S7."""
    return tables.thin(tables.trajectory(s, d), 86400.0)


@query("WITH t AS (SELECT gpstime AS t1, X AS x1, Y AS y1, Z AS z1, lead(gpstime) OVER w AS t2, lead(X) OVER w AS x2, lead(Y) OVER w AS y2, lead(Z) OVER w AS z2 FROM evt WHERE treeID=1 WINDOW w AS (ORDER BY gpstime)), j AS (SELECT e.point_id, e.X, e.Y, e.Z, t.*, (e.gpstime-t1)/(t2-t1) AS f FROM evt e JOIN t ON e.gpstime>=t1 AND e.gpstime<t2) SELECT point_id, round(sqrt((X-x1-f*(x2-x1))**2+(Y-y1-f*(y2-y1))**2+(Z-z1-f*(z2-z1))**2),5) AS range FROM j")
def range_asof(s, d):
    """J20."""
    return points.range_asof(points.rename_xyz(evt(s, d)), tables.trajectory(s, d)).select("point_id", F.round("range", 5).alias("range"))


@query("WITH h AS (SELECT CAST(unnest(range(81)) AS DOUBLE)*0.5 AS H), k AS (SELECT -20*ln(1-pow(35.5/36.03,1/1.1)) AS d0) SELECT H, round(CASE WHEN H<35.5 THEN -20*ln(1-pow(H/36.03,1/1.1)) ELSE d0+(H-35.5)/(36.03*1.1*pow(1-exp(-0.05*d0),0.1)*0.05*exp(-0.05*d0)) END/100,6) AS DBH FROM h, k", views=False)
def allometry_table(s, d):
    """S10, P19."""
    return tables.allometry_table(s)


@query("SELECT tree_id, " + ", ".join(f"printf('%.3f',{c}+0.0000137) AS {c}" for c in ("startX", "startY", "startZ", "endX", "endY", "endZ", "dist_to_root", "subtree_length", "radius")) + ", cyl_ID, parent_ID, axis AS axis_ID, CAST(branch_order AS INTEGER) AS branch_order, 0 AS quality FROM arch")
def csv_export_rows(s, d):
    """K2."""
    numbers = [f"{e}{a}" for e in ("start", "end") for a in "XYZ"] + ["dist_to_root", "subtree_length", "radius"]
    c = grown(s, d).withColumns({"axis_ID": F.col("axis"), "quality": F.lit(0)})
    return sinks.csv_rows(c.withColumns({c: F.col(c) + 0.0000137 for c in numbers}))  # off ties, which the engines format differently


@query("WITH r AS (SELECT DISTINCT l_suppkey AS row, l_linenumber AS col FROM lineitem WHERE l_quantity > 10) SELECT row, col FROM r WHERE EXISTS (SELECT 1 FROM r b WHERE b.row=r.row+1 AND b.col=r.col) AND EXISTS (SELECT 1 FROM r b WHERE b.row=r.row AND b.col=r.col+1) AND EXISTS (SELECT 1 FROM r b WHERE b.row=r.row+1 AND b.col=r.col+1)", views=False)
def raster_quads(s, d):
    """K9."""
    l = tables.read(s, d, "lineitem").where("l_quantity > 10").select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col")).distinct()
    return sinks.raster_quads(l.withColumn("z", F.lit(1.0)))


@query("WITH p AS (SELECT o_orderkey, o_totalprice/10000 AS ax, o_custkey%17 AS ay, o_custkey%23 AS bx, o_totalprice/30000 AS y2, o_orderkey%29 AS cx, o_orderkey%31 AS cy FROM orders), d AS (SELECT *, 2*(ax*(y2-cy)+bx*(cy-ay)+cx*(ay-y2)) AS det FROM p), u AS (SELECT o_orderkey, ax, ay, ((ax*ax+ay*ay)*(y2-cy)+(bx*bx+y2*y2)*(cy-ay)+(cx*cx+cy*cy)*(ay-y2))/det AS ux, ((ax*ax+ay*ay)*(cx-bx)+(bx*bx+y2*y2)*(ax-cx)+(cx*cx+cy*cy)*(bx-ax))/det AS uy FROM d WHERE abs(det)>=1) SELECT o_orderkey, round(ux,3) AS cx, round(uy,3) AS cy, round(sqrt((ax-ux)**2+(ay-uy)**2),3) AS r FROM u", views=False)
def circumcircle(s, d):
    """P11, P12."""
    k, c, t = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    p = [(t / 10000, (c % 17).cast("double")), ((c % 23).cast("double"), t / 30000), ((k % 29).cast("double"), (k % 31).cast("double"))]
    det = 2 * (p[0][0] * (p[1][1] - p[2][1]) + p[1][0] * (p[2][1] - p[0][1]) + p[2][0] * (p[0][1] - p[1][1]))
    return tables.read(s, d, "orders").where(F.abs(det) >= 1).select("o_orderkey", G.circumcircle(p).alias("c")).select("o_orderkey", *[F.round(f"c.{x}", 3).alias(x) for x in ("cx", "cy", "r")])


@query("SELECT a.id AS id1, b.id AS id2, round(CASE WHEN d>=a.R+b.R THEN 0 WHEN d<=abs(a.R-b.R) THEN 1 ELSE (a.R*a.R*acos(greatest(-1,least(1,(d*d+a.R*a.R-b.R*b.R)/(2*d*a.R))))+b.R*b.R*acos(greatest(-1,least(1,(d*d+b.R*b.R-a.R*a.R)/(2*d*b.R))))-0.5*sqrt(greatest(0,(a.R+b.R-d)*(d+a.R-b.R)*(d-a.R+b.R)*(d+a.R+b.R))))/(pi()*least(a.R,b.R)**2) END,6) AS ratio FROM circle a JOIN circle b ON a.Y=b.Y AND a.id<b.id JOIN LATERAL (SELECT sqrt((a.X-b.X)**2+(a.Y-b.Y)**2) AS d) ON true")
def lens_overlap(s, d):
    """P13."""
    c = tables.circles_of_suppliers(s, d)
    a, b = (c.select(F.col("id").alias(f"id{i}"), "Y", F.col("X").alias(f"X{i}"), F.col("R").alias(f"R{i}")) for i in (1, 2))
    j = a.join(b, "Y").where("id1 < id2")
    return j.select("id1", "id2", G.lens_ratio(F.abs(F.col("X1") - F.col("X2")), F.col("R1"), F.col("R2")).alias("ratio"))


@query("WITH b AS (SELECT DISTINCT treeID, CAST(round_even(degrees(atan2(Y-5,X-5))/10,0) AS BIGINT) AS bin FROM evt WHERE hag<0.3), w AS (SELECT DISTINCT treeID, ((bin%36)+36)%36 AS bin FROM b), dbl AS (SELECT treeID, bin+o AS bin FROM w, (VALUES (0),(36)) v(o)), g AS (SELECT treeID, bin, bin-row_number() OVER (PARTITION BY treeID ORDER BY bin) AS island FROM dbl), r AS (SELECT treeID, island, count(*) AS n FROM g GROUP BY ALL) SELECT treeID, least(36,max(n))*10 AS arc FROM r GROUP BY treeID")
def arc_coverage(s, d):
    """Longest circular run of 10-degree bins."""
    from boscage.operators.fitting import arc_coverage as arc

    return arc(evt(s, d).where("hag < 0.3"), "treeID", F.col("X") - 5, F.col("Y") - 5)


@query("SELECT point_id, CASE WHEN treeID IN (2,3,5) THEN 1 ELSE treeID END AS treeID FROM evt")
def reassign_ids(s, d):
    """I6."""
    return points.reassign_trees(evt(s, d), [2, 3, 5], 1).select("point_id", "treeID")


@query(f"WITH {VOX}, v AS (SELECT * FROM evt JOIN kept USING (point_id)), tall AS (SELECT treeID FROM v WHERE treeID>0 GROUP BY treeID HAVING max(hag)>2 AND min(hag)<2), f AS (SELECT treeID, CASE WHEN UserData=2 THEN 0 ELSE UserData END AS u FROM v) SELECT CASE WHEN u<>1 AND treeID NOT IN (SELECT treeID FROM tall) THEN 2 ELSE u END AS UserData, count(*) AS n FROM f GROUP BY 1")
def decimate_and_flag(s, d):
    """The flagship: decimation, tree heights, flags, counts."""
    return points.flag_small_trees(points.homogenise(evt(s, d), 0.5), 2).groupBy("UserData").agg(F.count("*").alias("n"))


@query("SELECT treeID, CAST(floor(X/0.5) AS BIGINT) AS vx, count(*) AS n, round(max(hag),6) AS top, round(avg(Z),6) AS z FROM (SELECT l_suppkey AS treeID, l_quantity AS X, l_discount*100 AS Z, l_tax*100 AS hag FROM lineitem) GROUP BY ALL", views=False)
def line_profile(s, d):
    """A3, A11 at scale."""
    p = tables.points_of_lines(s, d)
    return p.groupBy("treeID", F.floor(F.col("X") / 0.5).cast("long").alias("vx")).agg(F.count("*").alias("n"), F.max("hag").alias("top"), F.avg("Z").alias("z"))


@query()
def mesh_rings(s, d):
    """OBJ lines of every cylinder."""
    return sinks.obj_lines(heap(s, d))


@query("""WITH run AS (SELECT tree_id, axis, count(*) AS n, sum(endX) AS x, sum(endY) AS y, sum(endZ) AS z, sum(radius) AS r, sum(CASE WHEN cyl_ID=axis THEN startX END) AS x0, sum(CASE WHEN cyl_ID=axis THEN startY END) AS y0,
  sum(CASE WHEN cyl_ID=axis THEN startZ END) AS z0, sum(CASE WHEN cyl_ID=axis THEN radius END) AS first, arg_max(radius, cyl_ID) AS last FROM arch GROUP BY ALL),
nodes AS (SELECT tree_id, sum(n+1) AS k, sum(n) AS n, sum(x+x0) AS x, sum(y+y0) AS y, sum(z+z0) AS z, sum(r+(first+last)/2) AS r FROM run GROUP BY 1)
SELECT tree_id, CAST(12*k AS BIGINT) AS vertices, CAST(24*n AS BIGINT) AS triangles, x/k AS x, y/k AS y, z/k AS z, r/k AS r FROM nodes""")
def mesh_tubes(s, d):
    """M1, M2, M3: size, centre and mean radius of the tubes' vertices of each tree."""
    own = trees.architecture(heap(s, d)).withColumnRenamed("axis", "axis_ID")
    e = mesh.elements(mesh.rings(own))
    away = F.sqrt(sum(((F.col(a) - F.col(f"centre.{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    size = e.groupBy("tree_id").agg(F.count("*").alias("vertices"), F.sum(F.when(F.col("faces").isNotNull(), F.size("faces")).otherwise(0)).alias("triangles"), *[F.avg(a).alias(a) for a in "xyz"], F.avg(away).alias("r"))
    return size.select("tree_id", "vertices", "triangles", "x", "y", "z", "r")


@query("WITH b AS (SELECT treeID, min(Z) AS lo, max(Z) AS hi, arg_max(point_id, {'z': Z, 'm': -point_id}) AS top FROM evt GROUP BY 1) SELECT e.treeID, count(*) AS n, CAST(sum(e.point_id) AS BIGINT) AS ids FROM evt e JOIN b USING (treeID) WHERE (foliage=0 AND Z>=lo+(hi-lo)*0.01) OR point_id=top GROUP BY 1")
def wood_subset(s, d):
    """F8."""
    return points.wood_subset(evt(s, d)).groupBy("treeID").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"))


@query("SELECT treeID, arg_min(point_id, {'z': Z, 'm': point_id}) AS low, arg_max(point_id, {'z': Z, 'm': -point_id}) AS high FROM evt GROUP BY 1")
def highest_lowest(s, d):
    """W8."""
    return points.highest_lowest(evt(s, d))


@query("WITH b AS (SELECT treeID, min(Z) AS lo FROM evt GROUP BY 1) SELECT point_id, treeID FROM evt JOIN b USING (treeID) WHERE Z < CASE WHEN lo>=0.05 THEN 0.05*(floor(lo/0.05)+1) ELSE 0.05 END")
def ground_seed(s, d):
    """F9."""
    return points.ground_seed(evt(s, d)).select("point_id", "treeID")


@query("WITH b AS (SELECT treeID, floor(min(hag)) AS lo, ceil(max(hag)) AS hi FROM evt GROUP BY 1) SELECT point_id, CAST(greatest(0, least(floor((hag-lo+1e-9)/0.5), round((hi-lo)/0.5)-1)) AS BIGINT) AS bin FROM evt JOIN b USING (treeID)")
def distance_bins(s, d):
    """P25."""
    return points.bins(evt(s, d), "hag", 0.5).select("point_id", "bin")


@query("WITH c AS (SELECT point_id, passage AS chunk, treeID FROM evt), m AS (SELECT chunk, max(treeID) AS m FROM c GROUP BY 1), o AS (SELECT chunk, coalesce(sum(m) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS o FROM m) SELECT point_id, CAST(CASE WHEN treeID>0 THEN treeID+o ELSE treeID END AS BIGINT) AS treeID FROM c JOIN o USING (chunk)")
def merge_chunks(s, d):
    """U6."""
    return points.merge_chunks(evt(s, d).withColumn("chunk", F.col("passage"))).select("point_id", "treeID")


@query("SELECT c.tree_id, c.cyl_ID, round(CASE WHEN cyl_ID%5=1 THEN radius ELSE greatest(0.0025, 0.0025+(first_value(radius) OVER w-0.0025)*subtree_length/first_value(subtree_length) OVER w) END,6) AS radius FROM chain2 c WINDOW w AS (PARTITION BY tree_id, (cyl_ID-1)//5 ORDER BY cyl_ID)")
def pipe_model(s, d):
    """R7."""
    c = chain(s, d).withColumns({"radius": F.when(F.col("cyl_ID") % 5 == 1, F.col("radius")), "quality": F.lit(0)})
    return skeleton.pipe_model(c).select("tree_id", "cyl_ID", "radius")


def _one_axis(s, d):
    return chain(s, d).withColumns({"axis_ID": F.lit(1), "quality": F.lit(0)})


@query()
def smooth_skeleton(s, d):
    """W5."""
    return skeleton.smooth_skeleton(_one_axis(s, d))


@query()
def smooth_radii(s, d):
    """W6."""
    return skeleton.smooth_radii(_one_axis(s, d)).select("tree_id", "cyl_ID", "radius")


@query()
def prolongate(s, d):
    """R11."""
    c = _one_axis(s, d)
    return skeleton.prolongate(c, c.groupBy("tree_id").agg(F.max("endY").alias("prolong")))


@query()
def skeleton_chains(s, d):
    """G22, A29."""
    p = evt(s, d).withColumns({"layer": F.floor(F.col("hag") * 2), "cluster": F.col("point_id") % 3})
    return skeleton.skeleton(skeleton.layer_centres(p), 3.0)


CENTRE = "c AS (SELECT id, X, Y, Z, R, R*400 AS arc, (id*37)%100 AS inl, (id*13)%40 AS ins FROM circle)"


@query(f"WITH {CENTRE} SELECT id, R>=0.02 AND R<=2 AND CASE WHEN R<0.05 THEN arc>180 AND inl>30 WHEN ins>20 THEN false WHEN R<0.1 THEN arc>130 AND inl>60 ELSE arc>140 AND inl>40 END AS valid, R>=0.03 AND arc>180 AND inl>30 AS standard, arc>300 AND inl>70 AND (R-0.3)/0.3>=-0.1 AS accurate, round(arc/360*inl/100,6) AS score FROM c")
def fit_rules(s, d):
    """P22, P23."""
    i = F.col("id")
    c = tables.circles_of_suppliers(s, d).withColumns({"arc": F.col("R") * 400, "inl": i * 37 % 100, "ins": i * 13 % 40})
    ok = F.lit(True)
    return c.select("id", G.circle_valid(F.col("R"), F.col("arc"), F.col("inl"), F.col("ins")).alias("valid"), G.fit_accepted(ok, F.col("R"), F.col("arc"), F.col("inl")).alias("standard"), G.fit_accepted(ok, F.col("R"), F.col("arc"), F.col("inl"), "accurate", F.lit(0.3)).alias("accurate"), G.fit_score(F.col("arc"), F.col("inl")).alias("score"))


@query("SELECT CAST(h AS BIGINT) AS h, round(CASE WHEN h<25 THEN -20*ln(1-pow(h/36.03,1/1.1)) ELSE 4*h-75 END,6) AS legacy, round(36.03*pow(1-exp(-0.05*h),1.1),6) AS griese, round(exp((ln(h)-1.029)/0.567)/100,6) AS costa, round(exp(1.029)*pow(h*100,0.567),6) AS costa_h, round(pow(h/5.135,1/0.451)/100,6) AS chenge, round(5.135*pow(h*100,0.451),6) AS chenge_h FROM (SELECT unnest(range(1,41))::DOUBLE AS h)", views=False)
def allometries(s, d):
    """The other models, both ways."""
    h = F.col("id").cast("double")
    return s.range(1, 41).select(F.col("id").alias("h"), G.legacy_dbh_of_height(h).alias("legacy"), G.height_of_dbh(h).alias("griese"), G.dbh_of_height(h, "CostaCysneiros2020").alias("costa"), G.height_of_dbh(h, "CostaCysneiros2020").alias("costa_h"), G.dbh_of_height(h, "Chenge2020").alias("chenge"), G.height_of_dbh(h, "Chenge2020").alias("chenge_h"))


@query("WITH r AS (SELECT e.point_id, g.Z, row_number() OVER (PARTITION BY e.point_id ORDER BY (e.X-g.X)**2+(e.Y-g.Y)**2, g.point_id) AS rn FROM emb e, emb g WHERE e.point_id%3=0 AND g.point_id%3=1) SELECT point_id, round(Z,6) AS ground FROM r WHERE rn=1")
def nearest_ground(s, d):
    """J6."""
    e = emb(s, d)
    return spatial.nearest_ground(e.where("point_id % 3 = 0"), e.where("point_id % 3 = 1"))


@query(f"WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, point_id) AS rk FROM pair WHERE ta=3 AND tb>0) SELECT point_id FROM emb WHERE treeID IN (SELECT tb FROM n WHERE rk<=2)")
def tree_context_knn(s, d):
    """J14."""
    return spatial.tree_context_knn(emb(s, d), 3, 2)


@query("WITH t AS (SELECT point_id, treeID, X, Y, CAST(unnest(range(CAST(floor((X-1)/4) AS BIGINT), CAST(floor((X+1)/4) AS BIGINT)+1)) AS BIGINT) AS tx FROM evt), u AS (SELECT *, CAST(unnest(range(CAST(floor((Y-1)/4) AS BIGINT), CAST(floor((Y+1)/4) AS BIGINT)+1)) AS BIGINT) AS ty FROM t) SELECT point_id, tx, ty, floor(X/4)=tx AND floor(Y/4)=ty AS core FROM u")
def tiles(s, d):
    """S2."""
    return spatial.tiles(evt(s, d), 4, 1).select("point_id", "tx", "ty", "core")


@query("WITH t AS (SELECT point_id, treeID, X, Y, CAST(unnest(range(CAST(floor((X-1)/4) AS BIGINT), CAST(floor((X+1)/4) AS BIGINT)+1)) AS BIGINT) AS tx FROM evt), u AS (SELECT *, CAST(unnest(range(CAST(floor((Y-1)/4) AS BIGINT), CAST(floor((Y+1)/4) AS BIGINT)+1)) AS BIGINT) AS ty FROM t), h AS (SELECT treeID, tx, ty FROM u WHERE treeID>0 GROUP BY ALL HAVING floor(avg(X)/4)=tx AND floor(avg(Y)/4)=ty) SELECT point_id, tx, ty FROM u JOIN h USING (treeID, tx, ty)")
def trees_of_tile(s, d):
    """The points are their own seeds."""
    t = spatial.tiles(evt(s, d), 4, 1)
    return spatial.trees_of_tile(t, t, 4).select("point_id", "tx", "ty")


@query("WITH n AS (SELECT a.point_id AS s, b.point_id AS c, (a.X-b.X)**2+(a.Y-b.Y)**2+(a.Z-b.Z)**2 AS d2 FROM emb a, emb b WHERE a.point_id%50=0), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d2, c) AS rn FROM n) SELECT s*4+2 AS src, c*4 AS dst, round(sqrt(d2)**3,6) AS cost FROM r WHERE rn<=5")
def seed_edges(s, d):
    """J9."""
    return routes.seed_edges(emb(s, d).where("point_id % 50 = 0"), emb(s, d), PathFinder(k_seed_connectivity=5))


@query("WITH n AS (SELECT t.point_id AS t, c.point_id AS c, row_number() OVER (PARTITION BY t.point_id ORDER BY (t.X-c.X)**2+(t.Y-c.Y)**2+(t.Z-c.Z)**2, c.point_id) AS rn FROM emb t, emb c WHERE t.point_id%9=0 AND c.point_id%9<>0) SELECT c*4 AS src, t*4+1 AS dst, 0.0 AS cost FROM n WHERE rn=1")
def target_edges(s, d):
    """J8."""
    return routes.target_edges(emb(s, d).where("point_id % 9 <> 0"), emb(s, d).where("point_id % 9 = 0"))


def _gapped(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, PathFinder]:
    """Core points, seeds and parameters of a graph with clusters out of reach."""
    p = PathFinder(k_neighborhood_connectivity=3, k_seed_connectivity=2, max_gap=0.8, penalty=(1.0,) * 181)
    return emb(s, d), emb(s, d).where("point_id % 100 = 7"), p


GAPPED = f"""{PAIRS}, pt AS (SELECT * FROM emb WHERE point_id%100=7),
ce AS (SELECT qid AS a, point_id AS b, sqrt(d2)**3 AS cost FROM near WHERE rank<=4 AND qid<>point_id AND sqrt(d2)<=0.8),
se AS (SELECT a, b, sqrt(d2)**3 AS cost FROM (SELECT t.point_id AS a, c.point_id AS b, (t.X-c.X)**2+(t.Y-c.Y)**2+(t.Z-c.Z)**2 AS d2, row_number() OVER (PARTITION BY t.point_id ORDER BY (t.X-c.X)**2+(t.Y-c.Y)**2+(t.Z-c.Z)**2, c.point_id) AS rn FROM pt t, emb c) WHERE rn<=2),
held(n) AS (SELECT b FROM se UNION SELECT ce.b FROM held JOIN ce ON ce.a=held.n),
lost AS (SELECT point_id FROM emb WHERE point_id NOT IN (SELECT n FROM held))"""


@query(f"WITH {GAPPED} SELECT point_id FROM lost")
def unreached(s, d):
    """G2, G3, V3f."""
    core, seeds, p = _gapped(s, d)
    return routes.unreached(routes.layered(core, seeds, p), core).select("point_id")


@query(f"WITH {GAPPED}, more AS (SELECT qid AS a, point_id AS b, sqrt(d2)**3 AS cost FROM near WHERE rank<=13 AND qid<>point_id AND sqrt(d2)<=0.8 AND qid IN (SELECT point_id FROM lost)), e AS (SELECT a*4 AS src, b*4 AS dst, cost FROM ce WHERE a NOT IN (SELECT point_id FROM lost) UNION ALL SELECT a*4, b*4, cost FROM more UNION ALL SELECT b*4, a*4, cost FROM more UNION ALL SELECT a*4+2, b*4, cost FROM se UNION ALL SELECT -1, point_id*4+2, 0 FROM pt) SELECT src, dst, round(min(cost),6) AS cost FROM e GROUP BY ALL")
def repair_nodes(s, d):
    """G4, J10."""
    core, seeds, p = _gapped(s, d)
    return routes.repair_nodes(routes.layered(core, seeds, p), core, p)


@query(f"WITH {GAPPED}, lk AS (SELECT a, b FROM ce WHERE a IN (FROM lost) AND b IN (FROM lost)), bi AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk UNION SELECT point_id, point_id FROM lost), rc(s, t) AS (SELECT a, b FROM bi UNION SELECT rc.s, bi.b FROM rc JOIN bi ON bi.a=rc.t), cl AS (SELECT s AS point_id, min(t) AS cluster FROM rc GROUP BY s), nn AS (SELECT p.qid, p.point_id, p.d2, cl.cluster, row_number() OVER (PARTITION BY cl.cluster ORDER BY round(p.d2,12), p.qid, p.point_id) AS rn FROM pair p JOIN cl ON cl.point_id=p.qid WHERE p.point_id NOT IN (FROM lost)) SELECT qid AS src, point_id AS dst, round(sqrt(d2)**3,6) AS cost FROM nn WHERE rn=1 AND NOT EXISTS (SELECT 1 FROM ce WHERE ce.a=nn.qid AND ce.b=nn.point_id)")
def cluster_bridges(s, d):
    """Of both ways the one towards what is in reach, where there was none."""
    core, seeds, p = _gapped(s, d)
    before = routes.layered(core, seeds, p)
    after = routes.repair_clusters(before, core, p)
    lost = routes.unreached(before, core).select((F.col("point_id") * 4).alias("src"))
    new = after.join(before.select("src", "dst"), ["src", "dst"], "left_anti").join(lost, "src", "left_semi")
    return new.select(F.expr("src div 4").alias("src"), F.expr("dst div 4").alias("dst"), "cost")


@query()
def find_paths(s, d):
    """Nodes of the ways from every fiftieth node back to node 0."""
    best = graph.shortest_paths(edges(s, d), s.range(1).select(F.col("id").alias("node")), spatial.places(emb(s, d)))
    return graph.find_paths(best, emb(s, d).where("point_id % 50 = 3").select(F.col("point_id").alias("node")))


@query("SELECT point_id FROM evt WHERE hag<1 AND passage>0")
def filter_seeds(s, d):
    """F14."""
    return points.filter_seeds(evt(s, d)).select("point_id")


@query("SELECT treeID, arg_min(CAST(point_id%256 AS INTEGER), point_id) AS R, arg_min(CAST(point_id%255 AS INTEGER), point_id) AS G, arg_min(CAST(point_id%254 AS INTEGER), point_id) AS B FROM evt GROUP BY 1")
def first_colours(s, d):
    """A27."""
    p = evt(s, d)
    return points.first_colours(p.withColumns({c: (F.col("point_id") % m).cast("int") for c, m in (("R", 256), ("G", 255), ("B", 254))}))


@query(f"WITH {PAIRS} SELECT DISTINCT point_id FROM near WHERE qid%20>3 AND rank<=10 AND d2 < 0.09 UNION SELECT point_id FROM emb WHERE point_id%20>3")
def wood_from_passage(s, d):
    """V3a, J12."""
    from boscage.params import Semantic

    p = emb(s, d).withColumn("passage", (F.col("point_id") % 20).cast("int"))
    return verbs.assign_wood_from_passage(p, Semantic(wood_assignation_k=10, wood_assignation_dist=0.3))


@query(f"""WITH cand AS (SELECT * FROM emb WHERE foliage=0 OR (point_id%100)/100.0>0.9), base AS (SELECT floor(min(X)/0.3)*0.3 AS x0, floor(min(Y)/0.3)*0.3 AS y0, floor(min(Z)/0.3)*0.3 AS z0 FROM cand),
v AS (SELECT point_id, CAST(floor((X-x0)/0.3) AS BIGINT) AS a, CAST(floor((Y-y0)/0.3) AS BIGINT) AS b, CAST(floor((Z-z0)/0.3) AS BIGINT) AS c FROM cand, base), cell AS (SELECT a,b,c,row_number() OVER (ORDER BY a,b,c) AS node FROM (SELECT DISTINCT a,b,c FROM v)),
link AS (SELECT p.node AS s, q.node AS t FROM cell p JOIN cell q ON abs(p.a-q.a)<=1 AND abs(p.b-q.b)<=1 AND abs(p.c-q.c)<=1), reach(s,t) AS (SELECT s,t FROM link UNION SELECT r.s, l.t FROM reach r JOIN link l ON r.t=l.s), comp AS (SELECT s AS node, min(t) AS m FROM reach GROUP BY s)
SELECT point_id FROM (SELECT point_id, count(*) OVER (PARTITION BY m) AS n FROM v JOIN cell USING (a,b,c) JOIN comp USING (node)) WHERE n>=5""")
def wood_from_likelihood(s, d):
    """V3b."""
    from boscage.params import Semantic

    p = emb(s, d).withColumn("pwood", F.col("point_id") % 100 / 100)
    return verbs.assign_wood_from_high_likelihood(p, F.col("foliage") == 0, Semantic(cc_res=0.3, cc_min=5))


@query("WITH c AS (SELECT id, id%7 AS grp, X, Y, CAST(id AS DOUBLE)/10 AS Z, R/10 AS R FROM circle), u AS (SELECT *, lead(X) OVER w AS x2, lead(Y) OVER w AS y2, lead(Z) OVER w AS z2, lead(R) OVER w AS r2 FROM c WINDOW w AS (PARTITION BY grp ORDER BY Z, id)), k AS (SELECT grp, X, Y, Z, R, x2, y2, z2, r2, unnest(range(8))*2*pi()/8 AS a FROM u WHERE z2 IS NOT NULL), e AS (SELECT grp, X+R*cos(a) AS ax, Y+R*sin(a) AS ay, Z AS az, x2+r2*cos(a) AS bx, y2+r2*sin(a) AS by_, z2 AS bz FROM k), m AS (SELECT *, CAST(floor(sqrt((bx-ax)**2+(by_-ay)**2+(bz-az)**2)/0.375) AS INTEGER) AS m FROM e), l AS (SELECT *, unnest(range(1, m)) AS t FROM m WHERE m>1), al AS (SELECT grp, az+t/m*(bz-az) AS z FROM l UNION ALL SELECT grp, Z FROM (SELECT grp, Z, unnest(range(CAST(ceil(2*pi()*R/0.375) AS BIGINT))) FROM c)) SELECT grp, count(*) AS n, round(sum(z),6) AS z FROM al GROUP BY 1")
def cage_spokes(s, d):
    """Points of circles and spokes by group."""
    c = tables.circles_of_suppliers(s, d).withColumns({"grp": F.col("id") % 7, "Z": F.col("id") / 10, "R": F.col("R") / 10})
    return verbs.cage(c, 0.5).groupBy("grp").agg(F.count("*").alias("n"), F.sum("Z").alias("z"))


@query("SELECT tree_id, cyl_ID, round(startX+1,6) AS startX, round(endY-2,6) AS endY, round(startZ+0.5,6) AS startZ FROM heap")
def shift(s, d):
    """P3."""
    return trees.shift(heap(s, d), 1, -2, 0.5).select("tree_id", "cyl_ID", "startX", "endY", "startZ")


@query("SELECT point_id, cyl_ID, round(greatest(0, sqrt((X-startX-u*(endX-startX))**2+(Y-startY-u*(endY-startY))**2+(Z-startZ-u*(endZ-startZ))**2)-radius),6) AS dist FROM (SELECT e.point_id, e.X, e.Y, e.Z, h.*, greatest(0,least(1,((e.X-startX)*(endX-startX)+(e.Y-startY)*(endY-startY)+(e.Z-startZ)*(endZ-startZ))/(len*len))) AS u FROM evt e JOIN heap h ON h.tree_id=e.treeID WHERE len>1e-9)")
def segment_distance(s, d):
    """P8."""
    j = evt(s, d).join(heap(s, d).where(G.length() > 1e-9), F.col("treeID") == F.col("tree_id"))
    return G.with_segment_distance(j, *"XYZ").select("point_id", "cyl_ID", "dist")


@query("SELECT i.o_custkey AS k, count(*) AS n, round(sum(e.X),6) AS x FROM orders i JOIN evt e ON e.point_id=i.o_custkey AND e.treeID=7 GROUP BY 1")
def gather_points(s, d):
    """the rows of one tree, repeated as often as they are asked for."""
    ids = tables.read(s, d, "orders").select(F.col("o_custkey").alias("point_id"))
    return points.gather(points.of_tree(evt(s, d), 7), ids).groupBy(F.col("point_id").alias("k")).agg(F.count("*").alias("n"), F.sum("X").alias("x"))


@query("SELECT point_id FROM evt WHERE CAST(point_id%5 AS INTEGER)-1 >= 0")
def connected_points(s, d):
    """F20."""
    return points.connected(evt(s, d).withColumn("dist2root", F.col("point_id") % 5 - 1)).select("point_id")


@query()
def clean_butt(s, d):
    """C7."""
    return points.clean_butt(emb(s, d), 1.0, 0.8).select("point_id")


@query()
def small_isolated_clusters(s, d):
    """C6."""
    return points.fix_small_isolated_low_clusters(emb(s, d).withColumn("hag", F.col("Z")), 0.8).select("point_id", "foliage")


@query()
def tree_colours(s, d):
    """V9, P14."""
    return points.colour_trees(evt(s, d)).select("point_id", "R", "G", "B")


@query()
def segment_ground(s, d):
    """V1."""
    return ground.segment_ground(evt(s, d).drop("hag")).select("point_id", "Classification", "hag")


@query()
def terrain(s, d):
    """V2."""
    return ground.dtm(evt(s, d).withColumn("Classification", F.when(F.col("hag") < 1, 2).otherwise(1)), 0.5)


@query()
def dist2root(s, d):
    """G10."""
    return routes.dist2root(emb(s, d), emb(s, d).where("point_id % 100 = 7"), 8, 1.5, 2.0).select("point_id", "dist2root")


@query()
def models(s, d):
    """A model of each tree of the events' points; most have too few points for more than allometry."""
    return qsm.qsf(evt(s, d), 10)
