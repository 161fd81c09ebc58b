"""Registered queries over the whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import exact, graph, lsh, metrics, partition, srp
from tessera.plans.data import POINTS_SQL, SCALED_SQL, points, queries_of, scaled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DIM = 64
MIN_CHUNK, K = 32, 10
PLANES = srp.planes(DIM)
#: Euclidean LSH: tables, values a table, cell width.
L, M, WIDTH = 4, 3, 1.5
DIRECTIONS, OFFSETS = lsh.parameters(DIM, L, M, WIDTH)
Z_BITS = 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _list(x: np.ndarray) -> str:
    if x.ndim == 1:
        return "[" + ", ".join(repr(float(v)) for v in x) + "]"
    return "[" + ", ".join(_list(r) for r in x) + "]"


def _ip(x: str, y: str) -> str:
    return f"list_inner_product({x}, {y})"


def _l2(x: str, y: str) -> str:
    return f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: ({x}[i] - {y}[i]) * ({x}[i] - {y}[i])))"


def _top(score: str, name: str, order: str, source: str = POINTS_SQL, k: int = K) -> str:
    return f"""WITH {source},
s AS (SELECT qid, id, {score} AS {name} FROM queries CROSS JOIN points),
r AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY {name} {order}, id) AS INTEGER) AS rank, id, {name} FROM s)
SELECT * FROM r WHERE rank <= {k}"""


def _ranked(df: DataFrame, name: str, sign: int = -1) -> DataFrame:
    return df.select("qid", "rank", "id", (sign * F.col("dist")).alias(name))


# ---- exact search and vector expressions ------------------------------------


@query(_top(_ip("vec", "qvec"), "ip", "DESC"))
def mips_exact_topk(spark, sf_dir):
    p = points(spark, sf_dir)
    return _ranked(exact.knn(p, queries_of(p), K), "ip")


@query(_top(_l2("vec", "qvec"), "dist", "ASC"))
def l2_exact_topk(spark, sf_dir):
    p = points(spark, sf_dir)
    return _ranked(exact.knn(p, queries_of(p), K, "l2sqr"), "dist", 1)


@query(_top(f"{_ip('vec', 'qvec')} / (sqrt({_ip('vec', 'vec')}) * sqrt({_ip('qvec', 'qvec')}))", "cosine", "DESC", SCALED_SQL))
def cosine_topk(spark, sf_dir):
    p = scaled(spark, sf_dir)
    return _ranked(exact.knn(p, queries_of(p), K, "cosine"), "cosine")


SELF_KNN = f"""WITH {POINTS_SQL},
s AS (SELECT a.id AS qid, b.id, {_l2('b.vec', 'a.vec')} AS dist FROM points a JOIN points b ON a.id <> b.id),
r AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id, dist FROM s)
SELECT * FROM r WHERE rank <= 8"""


@query(SELF_KNN)
def self_knn(spark, sf_dir):
    p = points(spark, sf_dir)
    return exact.knn(p, p, 8, "l2sqr", self_too=False)


@query(f"""WITH {SCALED_SQL}
SELECT qid, id, {_ip('vec', 'qvec')} AS ip, -{_ip('vec', 'qvec')} AS neg_ip, {_l2('vec', 'qvec')} AS l2sqr, sqrt({_l2('vec', 'qvec')}) AS l2,
       list_sum(list_transform(range(1, len(vec) + 1), lambda i: abs(vec[i] - qvec[i]))) AS l1,
       list_max(list_transform(range(1, len(vec) + 1), lambda i: abs(vec[i] - qvec[i]))) AS linf,
       {_ip('vec', 'qvec')} / (sqrt({_ip('vec', 'vec')}) * sqrt({_ip('qvec', 'qvec')})) AS cosine
FROM queries CROSS JOIN points""")
def vec_metrics(spark, sf_dir):
    p = scaled(spark, sf_dir)
    both = exact.pairs(queries_of(p), p)
    return both.select("qid", "id", *[f("vec", "qvec").alias(n) for n, f in (("ip", vector.ip), ("neg_ip", vector.neg_ip), ("l2sqr", vector.l2sqr), ("l2", vector.l2), ("l1", vector.l1), ("linf", vector.linf), ("cosine", vector.cosine))])


@query(f"WITH {SCALED_SQL} SELECT max({_ip('vec', 'vec')}) AS max_norm2, min({_ip('vec', 'vec')}) AS min_norm2, count(*) AS n FROM points")
def norm2_stats(spark, sf_dir):
    return partition.with_norm(scaled(spark, sf_dir)).agg(F.max("norm2").alias("max_norm2"), F.min("norm2").alias("min_norm2"), F.count("*").alias("n"))


@query(f"WITH {SCALED_SQL} SELECT id, CAST(i - 1 AS INTEGER) AS pos, vec[i] / sqrt({_ip('vec', 'vec')}) AS value FROM (SELECT *, unnest(range(1, len(vec) + 1)) AS i FROM points)")
def unit_normalize(spark, sf_dir):
    return scaled(spark, sf_dir).select("id", F.posexplode(vector.unit("vec")).alias("pos", "value"))


# ---- norm chunks -------------------------------------------------------------

NORMED = f"{SCALED_SQL}, normed AS (SELECT id, vec, {_ip('vec', 'vec')} AS norm2, row_number() OVER (ORDER BY {_ip('vec', 'vec')}, id) - 1 AS pos FROM points)"


def _chunk_sql(end: str) -> str:
    """Chunks by following the next chunk's first place from 0 on."""
    return f"""{NORMED},
below AS (SELECT a.pos, {end} AS nxt FROM normed a),
starts(pos, chunk_id) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT b.nxt, s.chunk_id + 1 FROM starts s JOIN below b ON b.pos = s.pos WHERE b.nxt < (SELECT count(*) FROM normed)),
chunked AS (SELECT n.*, (SELECT max(chunk_id) FROM starts s WHERE s.pos <= n.pos) AS chunk_id FROM normed n)"""


CHUNKED = _chunk_sql(f"greatest(a.pos + {MIN_CHUNK}, (SELECT count(*) FROM normed b WHERE b.norm2 <= a.norm2 / 0.95))")


def _chunks(spark, sf_dir) -> DataFrame:
    return partition.chunks(partition.with_norm(scaled(spark, sf_dir)), MIN_CHUNK)


@query(f"WITH RECURSIVE {CHUNKED} SELECT id, CAST(chunk_id AS INTEGER) AS chunk_id, CAST(pos AS BIGINT) AS pos FROM chunked")
def norm_partition(spark, sf_dir):
    return _chunks(spark, sf_dir).select("id", "chunk_id", "pos")


RATIO_ONLY = partition.two_ratio(2.0, 0.9)


@query(f"WITH RECURSIVE {_chunk_sql(f'least(a.pos + 40, (SELECT count(*) FROM normed b WHERE b.norm2 <= a.norm2 / {RATIO_ONLY!r}::DOUBLE))')} SELECT id, CAST(chunk_id AS INTEGER) AS chunk_id FROM chunked")
def norm_partition_ratio(spark, sf_dir):
    return partition.chunks(partition.with_norm(scaled(spark, sf_dir)), 0, RATIO_ONLY, 40).select("id", "chunk_id")


@query(f"WITH RECURSIVE {CHUNKED} SELECT CAST(chunk_id AS INTEGER) AS chunk_id, count(*) AS n, min(norm2) AS min_norm2, max(norm2) AS max_norm2 FROM chunked GROUP BY 1")
def chunk_stats(spark, sf_dir):
    return partition.chunk_stats(_chunks(spark, sf_dir))


PAIRS = "pairs AS (SELECT c.chunk_id AS hi, c.chunk_id - CAST(pow(2, j) AS BIGINT) AS lo, greatest(1, CAST(32 AS BIGINT) >> j) AS s FROM (SELECT DISTINCT chunk_id FROM chunked) c, (SELECT unnest(range(0, 31)) AS j) WHERE c.chunk_id - CAST(pow(2, j) AS BIGINT) >= 0)"


@query(f"WITH RECURSIVE {CHUNKED}, {PAIRS} SELECT CAST(hi AS INTEGER) AS hi, CAST(lo AS INTEGER) AS lo, CAST(s AS INTEGER) AS s FROM pairs")
def block_pairs(spark, sf_dir):
    return partition.block_pairs(partition.chunk_stats(_chunks(spark, sf_dir))).select("hi", F.col("lo").cast("int").alias("lo"), F.col("s").cast("int").alias("s"))


@query(_top(_ip("vec", "qvec"), "ip", "DESC", SCALED_SQL))
def mips_chunk_pruned(spark, sf_dir):
    chunked = _chunks(spark, sf_dir)
    return partition.pruned_mips(chunked, queries_of(chunked.select("id", "vec")), K)


@query(f"""WITH RECURSIVE {CHUNKED},
e AS (SELECT a.id AS src, b.id AS dst, -{_ip('a.vec', 'b.vec')} AS dist FROM chunked a JOIN chunked b ON a.chunk_id = b.chunk_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 4)
SELECT * FROM e""")
def bf_window_edges(spark, sf_dir):
    return partition.window_edges(_chunks(spark, sf_dir), 4)


# ---- sign random projections --------------------------------------------------

CODES = f"""planes AS (SELECT {_list(PLANES)} AS p),
bits AS (SELECT id, vec, list_transform(range(1, 65), lambda i: CASE WHEN list_inner_product(vec, p[i]) > 0 THEN 1 ELSE 0 END) AS b FROM points, planes),
coded AS (SELECT id, vec, b, {', '.join(f'CAST(list_sum(list_transform(range(0, 16), lambda i: b[{16 * t} + i + 1] * CAST(pow(2, i) AS BIGINT))) AS INTEGER) AS c{t}' for t in range(4))} FROM bits)"""
ENTRIES = "entries AS (SELECT id, vec, t AS tbl, CASE t WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS code FROM coded, (SELECT unnest(range(0, 4)) AS t))"
TABLE = f"{ENTRIES}, tab AS (SELECT id, vec, tbl, code, row_number() OVER (PARTITION BY tbl ORDER BY code, id) - 1 AS pos FROM entries)"
APART = "list_sum(list_transform(range(1, 65), lambda i: abs(x.b[i] - y.b[i])))"


def _coded(spark, sf_dir) -> DataFrame:
    return srp.codes(points(spark, sf_dir), PLANES).withColumn("chunk_id", F.lit(0))


@query(f"WITH {POINTS_SQL}, {CODES} SELECT id, c0, c1, c2, c3 FROM coded")
def srp_codes(spark, sf_dir):
    return _coded(spark, sf_dir).select("id", "c0", "c1", "c2", "c3")


@query(f"""WITH {POINTS_SQL}, {CODES}
SELECT x.id AS qid, y.id, CAST({APART} AS INTEGER) AS hamming,
       CAST(list_sum(list_transform(range(1, 65), lambda i: greatest(x.b[i], y.b[i]))) AS INTEGER) AS or_bits,
       CAST(list_sum(list_transform(range(1, 65), lambda i: x.b[i] * y.b[i])) AS INTEGER) AS and_bits,
       {APART} / list_sum(list_transform(range(1, 65), lambda i: greatest(x.b[i], y.b[i])))::DOUBLE AS jaccard
FROM coded x CROSS JOIN coded y WHERE x.id % 100 = 0""")
def hamming_pairs(spark, sf_dir):
    c = _coded(spark, sf_dir).select("id", "code")
    both = c.crossJoin(c.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("code").alias("qcode")))
    return both.select("qid", "id", vector.hamming("code", "qcode").alias("hamming"), vector.or_bits("code", "qcode").alias("or_bits"), vector.and_bits("code", "qcode").alias("and_bits"), vector.jaccard_bits("code", "qcode").alias("jaccard"))


@query(f"WITH {POINTS_SQL}, {CODES} SELECT x.id AS qid, y.id, sqrt({_ip('y.vec', 'y.vec')}) * cos(3.141592653589793::DOUBLE * {APART}::DOUBLE / 64.0::DOUBLE) AS estimate FROM coded x CROSS JOIN coded y WHERE x.id % 100 = 0")
def srp_est_ip(spark, sf_dir):
    c = _coded(spark, sf_dir).select("id", "code", F.sqrt(vector.norm2("vec")).alias("norm"))
    both = c.crossJoin(c.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("code").alias("qcode")))
    return both.select("qid", "id", vector.estimated_ip("norm", "code", "qcode").alias("estimate"))


@query(f"""WITH {POINTS_SQL}, {CODES},
s AS (SELECT x.id AS qid, y.id, x.vec AS qvec, y.vec, sqrt({_ip('y.vec', 'y.vec')}) * cos(3.141592653589793::DOUBLE * {APART}::DOUBLE / 64.0::DOUBLE) AS estimate FROM coded x CROSS JOIN coded y WHERE x.id % 100 = 0),
e AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(estimate, 9) DESC, id) AS place FROM s),
t AS (SELECT qid, id, {_ip('vec', 'qvec')} AS ip FROM e WHERE place <= 100),
r AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY ip DESC, id) AS INTEGER) AS rank, id, ip FROM t)
SELECT * FROM r WHERE rank <= {K}""")
def est_rerank_topk(spark, sf_dir):
    """The 100 best by code estimate, then exactly."""
    estimate = srp_est_ip(spark, sf_dir).withColumn("dist", -F.round("estimate", 9))
    p = points(spark, sf_dir)
    return _ranked(exact.rerank(exact.top(estimate, 100), p, queries_of(p), K), "ip")


@query(f"WITH {POINTS_SQL}, {CODES}, {TABLE} SELECT CAST(tbl AS INTEGER) AS tbl, CAST(pos AS BIGINT) AS pos, code, id FROM tab")
def srp_table_rank(spark, sf_dir):
    return srp.tables(_coded(spark, sf_dir)).select("tbl", "pos", "code", "id")


KJOIN = f"""WITH {POINTS_SQL}, {CODES}, {TABLE},
n AS (SELECT DISTINCT a.id AS qid, b.id, a.vec AS qvec, b.vec FROM tab a JOIN tab b ON a.tbl = b.tbl AND a.id <> b.id AND abs(a.pos - b.pos) <= 8),
s AS (SELECT qid, id, {_ip('vec', 'qvec')} AS ip FROM n),
r AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY ip DESC, id) AS INTEGER) AS rank, id, ip FROM s)
SELECT * FROM r WHERE rank <= {K}"""


@query(KJOIN)
def srp_kjoin(spark, sf_dir):
    c = _coded(spark, sf_dir)
    return _ranked(srp.kjoin(c, srp.tables(c), 8, K), "ip")


@query(f"""WITH RECURSIVE {CHUNKED}, {PAIRS}, {CODES}, {ENTRIES},
tab AS (SELECT e.id, e.vec, e.tbl, e.code, c.chunk_id, row_number() OVER (PARTITION BY c.chunk_id, e.tbl ORDER BY e.code, e.id) - 1 AS pos FROM entries e JOIN chunked c ON c.id = e.id),
q AS (SELECT DISTINCT p.lo, t.tbl, t.id AS qid, t.vec AS qvec, (SELECT count(*) FROM tab u WHERE u.chunk_id = p.lo AND u.tbl = t.tbl AND u.code < t.code) AS place FROM tab t JOIN pairs p ON p.hi = t.chunk_id),
n AS (SELECT DISTINCT q.lo, q.qid, u.id, q.qvec, u.vec FROM q JOIN tab u ON u.chunk_id = q.lo AND u.tbl = q.tbl AND u.pos BETWEEN q.place - 4 AND q.place + 3),
s AS (SELECT lo, qid, id, {_ip('vec', 'qvec')} AS ip FROM n),
r AS (SELECT CAST(lo AS INTEGER) AS lo, qid, CAST(row_number() OVER (PARTITION BY qid, lo ORDER BY ip DESC, id) AS INTEGER) AS rank, id, ip FROM s)
SELECT * FROM r WHERE rank <= 4""")
def srp_cross_kjoin(spark, sf_dir):
    chunked = srp.codes(_chunks(spark, sf_dir), PLANES)
    pairs = partition.block_pairs(partition.chunk_stats(chunked))
    out = srp.cross_kjoin(chunked, srp.tables(chunked), pairs, 4, 4)
    return out.select(F.col("lo").cast("int").alias("lo"), "qid", "rank", "id", (-F.col("dist")).alias("ip"))


@query(f"""WITH {POINTS_SQL}, {CODES}, q AS (SELECT id AS qid, c0 AS qc FROM coded WHERE id % 100 = 0)
SELECT qid, coalesce((SELECT id FROM coded WHERE c0 <= qc ORDER BY c0 DESC, id DESC LIMIT 1), (SELECT id FROM coded ORDER BY c0, id LIMIT 1)) AS entry FROM q""")
def srp_entry_point(spark, sf_dir):
    c = _coded(spark, sf_dir)
    return srp.entry_point(srp.tables(c), c.where("id % 100 = 0"))


@query(f"""WITH {POINTS_SQL}, {CODES}, {ENTRIES},
q AS (SELECT id AS qid, tbl, code AS qcode FROM entries WHERE id % 100 = 0),
z AS (SELECT q.qid, cut, count(*) AS n FROM q JOIN entries e ON e.tbl = q.tbl, (SELECT unnest(range(0, 17)) AS cut) WHERE (e.code >> CAST(cut AS INTEGER)) = (q.qcode >> CAST(cut AS INTEGER)) GROUP BY 1, 2),
c AS (SELECT qid, min(cut) AS cut FROM z WHERE n >= 200 GROUP BY 1)
SELECT DISTINCT q.qid, e.id, CAST(16 - c.cut AS INTEGER) AS bits FROM q JOIN c ON c.qid = q.qid JOIN entries e ON e.tbl = q.tbl AND (e.code >> CAST(c.cut AS INTEGER)) = (q.qcode >> CAST(c.cut AS INTEGER))""")
def srp_prefix_candidates(spark, sf_dir):
    c = _coded(spark, sf_dir)
    return srp.prefix_candidates(srp.tables(c), c.where("id % 100 = 0"), 200)


# ---- Euclidean LSH -------------------------------------------------------------

PROJECTED = f"""params AS (SELECT {_list(DIRECTIONS)} AS a, {_list(OFFSETS)} AS o),
proj AS (SELECT id, vec, list_transform(range(1, {L * M + 1}), lambda i: (list_inner_product(vec, a[i]) + o[i]) / {WIDTH}::DOUBLE) AS h FROM points, params)"""
KEYS = f"keys AS (SELECT id, vec, t, list_transform(h[t * {M} + 1:t * {M} + {M}], lambda v: CAST(floor(v) AS BIGINT)) AS key FROM proj, (SELECT unnest(range(0, {L})) AS t))"


def _projected(spark, sf_dir) -> DataFrame:
    return lsh.project(points(spark, sf_dir), DIRECTIONS, OFFSETS, WIDTH)


@query(f"""WITH {POINTS_SQL}, {PROJECTED}, {KEYS},
c AS (SELECT DISTINCT q.id AS qid, k.id, q.vec AS qvec, k.vec FROM keys q JOIN keys k ON k.t = q.t AND k.key = q.key WHERE q.id % 100 = 0),
s AS (SELECT qid, id, {_l2('vec', 'qvec')} AS dist FROM c),
r AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id, dist FROM s)
SELECT * FROM r WHERE rank <= {K}""")
def e2lsh_bucket_join(spark, sf_dir):
    keys = lsh.bucket_keys(_projected(spark, sf_dir), L, M)
    p = points(spark, sf_dir)
    return exact.rerank(lsh.bucket_join(keys, keys.where("id % 100 = 0")), p, queries_of(p), K, "l2sqr")


@query(f"WITH {POINTS_SQL}, {PROJECTED} SELECT CAST(i - 1 AS INTEGER) AS hash, min(h[i]) AS low, max(h[i]) AS high FROM (SELECT h, unnest(range(1, {L * M + 1})) AS i FROM proj) GROUP BY 1")
def hash_minmax(spark, sf_dir):
    return lsh.spread(_projected(spark, sf_dir))


CELLS = f"cells AS (SELECT id, list_transform(h, lambda v: greatest(0, least({2**Z_BITS - 1}, CAST(floor(v + {2 ** (Z_BITS - 1)}::DOUBLE) AS BIGINT)))) AS c FROM proj)"
ZKEYS = "zk AS (" + " UNION ALL ".join(
    f"SELECT id, {t} AS tbl, " + " + ".join(f"((c[{t * M + i + 1}] >> {b}) & 1) * {1 << (b * M + M - 1 - i)}" for b in range(Z_BITS) for i in range(M)) + " AS z FROM cells" for t in range(L)
) + ")"


def _z(spark, sf_dir) -> DataFrame:
    return lsh.z_keys(_projected(spark, sf_dir), L, M, [float(2 ** (Z_BITS - 1))] * (L * M), [1.0] * (L * M), Z_BITS)


@query(f"WITH {POINTS_SQL}, {PROJECTED}, {CELLS}, {ZKEYS} SELECT id, CAST(tbl AS INTEGER) AS tbl, CAST(z AS BIGINT) AS z FROM zk")
def zorder_key(spark, sf_dir):
    return _z(spark, sf_dir)


@query(f"WITH {POINTS_SQL}, {PROJECTED}, {CELLS}, {ZKEYS} SELECT DISTINCT q.id AS qid, k.id FROM zk q JOIN zk k ON k.tbl = q.tbl AND k.z = q.z WHERE q.id % 100 = 0")
def zorder_join(spark, sf_dir):
    z = _z(spark, sf_dir).withColumnRenamed("z", "key")
    return lsh.bucket_join(z, z.where("id % 100 = 0"))


@query(f"""WITH {POINTS_SQL}, {PROJECTED}, {CELLS}, {ZKEYS}
SELECT q.id AS qid, k.id, CASE WHEN q.z = k.z THEN 64 ELSE 64 - length(bin(xor(CAST(q.z AS BIGINT), CAST(k.z AS BIGINT)))) END AS llcp,
       CASE WHEN q.z = k.z THEN {Z_BITS} ELSE CAST(floor(list_position(list_transform(range(0, 40), lambda b: (xor(CAST(q.z AS BIGINT), CAST(k.z AS BIGINT)) >> CAST(b AS INTEGER)) & 1), 1) - 1) AS INTEGER) // {M} END AS level
FROM zk q JOIN zk k ON k.tbl = q.tbl WHERE q.id % 100 = 0 AND q.tbl = 0""")
def llcp_level(spark, sf_dir):
    z = _z(spark, sf_dir).where("tbl = 0")
    both = z.crossJoin(z.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("z").alias("qz")))
    return both.select("qid", "id", vector.common_prefix("z", "qz").cast("int").alias("llcp"), vector.level("z", "qz", M, Z_BITS).alias("level"))


@query(f"""WITH {POINTS_SQL}, {PROJECTED}
SELECT q.id AS qid, p.id, {_l2('p.vec', 'q.vec')} AS dist FROM proj q CROSS JOIN proj p
WHERE q.id % 100 = 0 AND {_l2('p.h', 'q.h')} * {(WIDTH / 5.37302) ** 2!r}::DOUBLE < 1.0""")
def low_dimension_filter(spark, sf_dir):
    """Exact distances of the rows that the projected distance lets through."""
    h = _projected(spark, sf_dir)
    both = h.crossJoin(queries_of(h).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("h").alias("qh")))
    return lsh.low_dimension_filter(both, F.lit(1.0), M, WIDTH).select("qid", "id", vector.l2sqr("vec", "qvec").alias("dist"))


@query(f"""WITH RECURSIVE {CHUNKED}, m AS (SELECT chunk_id, max(norm2) AS top FROM chunked GROUP BY 1)
SELECT id, (CASE WHEN (id * 7919 + 13) % 127 % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE * sqrt(greatest(top - norm2, 0.0::DOUBLE)) AS added FROM chunked JOIN m USING (chunk_id)""")
def alsh_lift(spark, sf_dir):
    chunked = _chunks(spark, sf_dir)
    return lsh.lift(chunked, partition.chunk_stats(chunked)).select("id", F.element_at("lifted", -1).alias("added"))


# ---- graphs ----------------------------------------------------------------------

KNN_EDGES = f"""{POINTS_SQL}, s0 AS (SELECT a.id AS src, b.id AS dst, {_l2('b.vec', 'a.vec')} AS dist FROM points a JOIN points b ON a.id <> b.id),
edges AS (SELECT src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS place FROM s0) WHERE place <= 8)"""


def _edges(spark, sf_dir) -> DataFrame:
    return self_knn(spark, sf_dir).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")


def _best(source: str, k: int) -> str:
    return f"SELECT src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS place FROM (SELECT src, dst, min(dist) AS dist FROM ({source}) WHERE src <> dst GROUP BY 1, 2)) WHERE place <= {k}"


BOTH = "SELECT src, dst, dist FROM edges UNION ALL SELECT dst, src, dist FROM edges"


@query(f"WITH {KNN_EDGES} {_best(BOTH, 12)}")
def reverse_edges(spark, sf_dir):
    return graph.with_reverse(_edges(spark, sf_dir), 12)


@query(f"WITH {KNN_EDGES}, f AS ({_best('SELECT * FROM edges', 4)}), b AS ({_best('SELECT dst AS src, src AS dst, dist FROM edges', 4)}) {_best('SELECT * FROM f UNION ALL SELECT * FROM b', 8)}")
def apg_merge(spark, sf_dir):
    return graph.forward_and_back(_edges(spark, sf_dir), 4)


@query(f"""WITH {KNN_EDGES}, start AS ({_best('SELECT * FROM edges WHERE (src + dst) % 3 <> 0', 8)}),
n0 AS (SELECT DISTINCT src, dst, dist FROM (SELECT src, dst, dist FROM start UNION ALL SELECT dst, src, dist FROM start)),
n AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS place FROM n0) WHERE place <= 6),
c AS (SELECT DISTINCT x.dst AS a, y.dst AS b FROM n x JOIN n y ON x.src = y.src AND x.dst < y.dst),
found AS (SELECT a, b, {_l2('p.vec', 'q.vec')} AS dist FROM c JOIN points p ON p.id = a JOIN points q ON q.id = b)
{_best('SELECT src, dst, dist FROM start UNION ALL SELECT a, b, dist FROM found UNION ALL SELECT b, a, dist FROM found', 8)}""")
def nn_descent_round(spark, sf_dir):
    """One local join over a thinned graph, all of whose edges are fresh."""
    start = graph.best_edges(_edges(spark, sf_dir).where("(src + dst) % 3 <> 0"), 8)
    return graph.descent_round(start, start, points(spark, sf_dir), 8, 6, "l2sqr")


@query(f"""WITH {KNN_EDGES}, e AS (SELECT qid, (qid * 37 + j) % (SELECT count(*) FROM points) AS id FROM queries, (SELECT unnest(range(0, 20)) AS j)),
c AS (SELECT qid, id FROM e UNION SELECT qid, dst FROM e JOIN edges ON src = id),
s AS (SELECT c.qid, c.id, {_ip('p.vec', 'q.qvec')} AS ip FROM c JOIN points p ON p.id = c.id JOIN queries q ON q.qid = c.qid),
r AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY ip DESC, id) AS INTEGER) AS rank, id, ip FROM s)
SELECT * FROM r WHERE rank <= {K}""")
def one_hop_search(spark, sf_dir):
    """Twenty entries of each query and their neighbours, exactly measured."""
    p = points(spark, sf_dir)
    q = queries_of(p)
    entries = q.crossJoin(p.agg(F.count("*").alias("n"))).select(F.col("id").alias("qid"), "n", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("j")).select("qid", ((F.col("qid") * 37 + F.col("j")) % F.col("n")).alias("id"))
    return _ranked(graph.one_hop(entries, _edges(spark, sf_dir), p, q, K), "ip")


@query(f"WITH {KNN_EDGES}, b AS ({_best(BOTH, 12)}), d AS (SELECT src, count(*) AS degree FROM b GROUP BY 1) SELECT max(degree) AS max_degree, min(degree) AS min_degree, avg(degree) AS avg_degree, stddev_pop(degree) AS sd_degree FROM d")
def degree_stats(spark, sf_dir):
    return metrics.degrees(reverse_edges(spark, sf_dir))


@query(f"WITH {KNN_EDGES}, b AS ({_best(BOTH, 12)}) SELECT avg(dist) AS mean_dist, 1.0::DOUBLE AS unique_share, (SELECT count(*) FROM b JOIN edges USING (src, dst)) / (SELECT count(*) FROM edges)::DOUBLE AS recall FROM b")
def graph_quality(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return metrics.graph_quality(graph.with_reverse(edges, 12), edges)


@query(f"WITH {KNN_EDGES}, b AS ({BOTH}) SELECT CAST(sum(n - 1) AS BIGINT) AS repeated, CAST(sum(CASE WHEN src = dst THEN 1 ELSE 0 END) AS BIGINT) AS self_edges FROM (SELECT src, dst, count(*) AS n FROM b GROUP BY 1, 2)")
def duplicate_edges(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return metrics.duplicates(edges.unionByName(graph.reverse(edges)))


@query(f"WITH {KNN_EDGES} SELECT src, dst, (greatest(src, dst) * 4294967296) + least(src, dst) AS edge FROM edges")
def edge_keys(spark, sf_dir):
    return _edges(spark, sf_dir).select("src", "dst", vector.edge_key("src", "dst").alias("edge"))


# ---- quality of a search -----------------------------------------------------------

APPROXIMATE = f"""{KJOIN.rpartition('SELECT * FROM r')[0]},
got AS (SELECT * FROM r WHERE rank <= {K}),
t0 AS (SELECT a.id AS qid, b.id, {_ip('b.vec', 'a.vec')} AS ip FROM points a JOIN points b ON a.id <> b.id),
truth AS (SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY ip DESC, id) AS INTEGER) AS rank, id, ip FROM t0) WHERE rank <= {K})"""


def _truth(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir)
    return _ranked(exact.knn(p, p, K, self_too=False), "ip")


@query(f"{APPROXIMATE} SELECT count(*) AS found, (SELECT count(*) FROM truth) AS asked, count(*) / (SELECT count(*) FROM truth)::DOUBLE AS recall FROM got JOIN truth USING (qid, id)")
def recall(spark, sf_dir):
    return metrics.recall(srp_kjoin(spark, sf_dir), _truth(spark, sf_dir), K)


@query(f"""{APPROXIMATE}, b AS (SELECT g.qid, rank, abs(g.ip / t.ip) AS ratio FROM got g JOIN truth t USING (qid, rank)),
l AS (SELECT qid, arg_max(ratio, rank) AS kth FROM b GROUP BY 1)
SELECT round((SELECT avg(ratio) FROM b), 9) AS overall_ratio, round((SELECT avg(kth) FROM l), 9) AS kth_ratio""")
def ratio(spark, sf_dir):
    out = metrics.ratio(srp_kjoin(spark, sf_dir), _truth(spark, sf_dir))
    return out.select(F.round("overall_ratio", 9).alias("overall_ratio"), F.round("kth_ratio", 9).alias("kth_ratio"))


# ---- iterative builders and graph searches: rows only --------------------------------


@query()
def nn_descent(spark, sf_dir):
    return graph.nn_descent(points(spark, sf_dir), 10)


@query()
def rnn_descent(spark, sf_dir):
    return graph.rnn_descent(points(spark, sf_dir), 10)


@query()
def rng_prune(spark, sf_dir):
    return graph.pruned(reverse_edges(spark, sf_dir), points(spark, sf_dir), 8, "l2sqr")[0]


@query()
def mst_graph(spark, sf_dir):
    return graph.mst_graph(points(spark, sf_dir))


@query()
def chunk_graph(spark, sf_dir):
    chunked = srp.codes(_chunks(spark, sf_dir), PLANES)
    inside, normal = graph.chunk_graph(chunked, srp.tables(chunked))
    return inside.withColumn("kind", F.lit("tangential")).unionByName(normal.withColumn("kind", F.lit("normal")))


def _searchable(spark, sf_dir, metric: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    return p, graph.searchable(p, graph.with_reverse(graph.shard_edges(p, 16, metric), 24))


@query()
def graph_search_ip(spark, sf_dir):
    p, g = _searchable(spark, sf_dir, "ip")
    return _ranked(graph.search(g, queries_of(p), None, K, 60), "ip")


@query()
def graph_search_l2(spark, sf_dir):
    p, g = _searchable(spark, sf_dir, "l2sqr")
    return graph.search(g, queries_of(p), None, K, 60, "l2sqr")


@query()
def lite_search_seeded(spark, sf_dir):
    """Entries from shared code prefixes."""
    p, g = _searchable(spark, sf_dir, "ip")
    return _ranked(graph.search(g, queries_of(p), srp_prefix_candidates(spark, sf_dir).select("qid", "id"), K, 180), "ip")


@query()
def lite_search_entry(spark, sf_dir):
    """Entry by the predecessor of the query's code."""
    p, g = _searchable(spark, sf_dir, "ip")
    return _ranked(graph.search(g, queries_of(p), srp_entry_point(spark, sf_dir).withColumnRenamed("entry", "id"), K, 180), "ip")


@query()
def lite_search_normfilter(spark, sf_dir):
    """Rows whose norm cannot reach the worst kept score are not measured."""
    p = scaled(spark, sf_dir)
    g = graph.searchable(p, graph.with_reverse(graph.shard_edges(p, 16, "ip"), 24))
    return _ranked(graph.search(g, queries_of(p), None, K, 180, norm_filter=True), "ip")


@query()
def llcp_cursor_search(spark, sf_dir):
    """Candidates by the longest common prefix of Z-order keys, then the graph from them."""
    z = _z(spark, sf_dir)
    seeds = lsh.longest_prefix(z, z.where("id % 100 = 0"), M, 40).select("qid", "id")
    p, g = _searchable(spark, sf_dir, "l2sqr")
    return graph.search(g, queries_of(p), seeds, K, 60, "l2sqr")


@query()
def alsh_multiprobe(spark, sf_dir):
    """Codes of lifted vectors; candidates by estimated inner product within shared prefixes, exactly reranked."""
    chunked = _chunks(spark, sf_dir)
    lifted = lsh.lift(chunked, partition.chunk_stats(chunked)).select("id", F.col("lifted").alias("vec"), "chunk_id")
    directions = srp.planes(DIM + 1, 13)
    coded = srp.codes(lifted, directions).select("id", "chunk_id", "c0", "c1", "c2", "c3")
    p = chunked.select("id", "vec")
    q = queries_of(p)
    asked = srp.codes(q.select("id", F.concat("vec", F.array(F.lit(0.0))).alias("vec")), directions)
    found = srp.prefix_candidates(srp.tables(coded), asked, 200)
    return _ranked(exact.rerank(found, p, q, K), "ip")
