"""Identity, incremental recompute and lineage over orders, pages and the table keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import lineage as ln
from trackloom.plans.registry import query
from trackloom.plans.rules_queries import page_files, page_refs

ROW_JSON = """'{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"'
  || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'"""
FIELDS = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"]


@query("fingerprint", f"SELECT o_orderkey, sha256({ROW_JSON}) AS fingerprint FROM orders")
def fingerprint(t):
    return t.orders.select("o_orderkey", ln.fingerprint(FIELDS).alias("fingerprint"))


def keyed(t, source=None):
    rows = t.orders if source is None else source
    return ln.cache_key(rows, ["o_custkey"], FIELDS, F.lit("seed=7"))


def _keys_sql(where):
    lanes = " || '|' || ".join(
        f"CAST(sum(CAST(('0x' || substr(h, {1 + i * 15}, 15)) AS HUGEINT)) AS VARCHAR)"
        for i in range(4)
    )
    return (
        f"SELECT o_custkey, sha256('seed=7|' || count(*) || '|' || {lanes}) AS cache_key "
        f"FROM (SELECT o_custkey, sha256({ROW_JSON}) AS h FROM orders {where}) GROUP BY 1"
    )


@query("cache_key", _keys_sql(""))
def cache_key(t):
    return keyed(t)


def previous_run(t):
    """Keys as they were before the open orders came in; every fifth run failed."""
    old = keyed(t, t.orders.where("o_orderstatus <> 'O'"))
    return old.withColumn(
        "status", F.when(F.col("o_custkey") % 5 == 0, "failed").otherwise("completed")
    )


@query(
    "to_recompute",
    f"""WITH n AS ({_keys_sql("")}), o AS ({_keys_sql("WHERE o_orderstatus <> 'O'")})
        SELECT n.o_custkey, n.cache_key FROM n LEFT JOIN o
          ON o.o_custkey = n.o_custkey AND o.cache_key = n.cache_key AND o.o_custkey % 5 <> 0
        WHERE o.o_custkey IS NULL""",
)
def to_recompute(t):
    return ln.to_recompute(keyed(t), previous_run(t), ["o_custkey"])


@query(
    "audit_outputs",
    """SELECT 'pages/' || page_id || CASE WHEN page_id % 17 = 0 THEN '.gone' ELSE '' END AS path,
              CASE WHEN page_id % 17 = 0 THEN 'missing' ELSE 'tampered' END AS state
       FROM pages WHERE (page_id % 17 = 0 OR page_id % 13 = 0) AND page_id % 3 <> 0""",
)
def audit_outputs(t):
    outputs = page_refs(t).withColumn(
        "status", F.when(F.col("page_id") % 3 == 0, "failed").otherwise("completed")
    )
    return ln.audit(outputs, page_files(t))


@query(
    "output_conflicts",
    f"""WITH n AS ({_keys_sql("")}), o AS ({_keys_sql("WHERE o_orderstatus <> 'O'")})
        SELECT 'out/' || n.o_custkey AS path, n.cache_key AS new_key, o.cache_key AS old_key
        FROM n JOIN o ON o.o_custkey = n.o_custkey WHERE n.cache_key <> o.cache_key""",
)
def output_conflicts(t):
    path = F.concat(F.lit("out/"), F.col("o_custkey").cast("string"))
    return ln.conflicts(
        keyed(t).withColumn("path", path), previous_run(t).withColumn("path", path)
    )


def edges(t):
    ident = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    pair = lambda df, a, x, b, y: df.select(
        ident(a, x).alias("from_id"), ident(b, y).alias("to_id")
    )
    return (
        pair(t.nation, "n", "n_nationkey", "r", "n_regionkey")
        .unionByName(pair(t.customer, "c", "c_custkey", "n", "c_nationkey"))
        .unionByName(pair(t.supplier, "s", "s_suppkey", "n", "s_nationkey"))
        .unionByName(pair(t.orders, "o", "o_orderkey", "c", "o_custkey"))
        .unionByName(
            t.lineitem.select(
                F.concat_ws("-", F.lit("l"), "l_orderkey", "l_suppkey").alias("from_id"),
                ident("o", "l_orderkey").alias("to_id"),
            ).distinct()
        )
    )


@query(
    "stale",
    """WITH RECURSIVE e AS (
         SELECT 'n' || n_nationkey AS f, 'r' || n_regionkey AS d FROM nation
         UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
         UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
         UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
         UNION ALL SELECT DISTINCT 'l-' || l_orderkey || '-' || l_suppkey, 'o' || l_orderkey FROM lineitem),
       r AS (SELECT 'r1' AS id, 0 AS depth UNION
             SELECT 'c' || c_custkey, 0 FROM customer WHERE c_acctbal < 500
             UNION ALL SELECT e.f, r.depth + 1 FROM r JOIN e ON e.d = r.id)
       SELECT id, min(depth) AS depth FROM r GROUP BY 1""",
)
def stale(t):
    changed = t.region.where("r_regionkey = 1").select(F.lit("r1").alias("id")).unionByName(
        t.customer.where("c_acctbal < 500").select(
            F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")
        )
    )
    return ln.stale(edges(t), changed)


@query(
    "check_binding",
    """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, min(l_returnflag) AS flag FROM lineitem GROUP BY 1),
       q AS (SELECT o_orderkey AS k, o_orderkey % 6 AS n,
                    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE substr('NRA', CAST(o_orderkey % 3 + 1 AS INT), 1)
                    END AS flag FROM orders)
       SELECT q.k AS o_orderkey, unnest(list_filter([
                CASE WHEN l.k IS NULL THEN 'missing_result' END,
                CASE WHEN l.k IS NOT NULL AND q.n IS DISTINCT FROM l.n THEN 'n' END,
                CASE WHEN l.k IS NOT NULL AND q.flag IS DISTINCT FROM l.flag THEN 'flag' END],
                lambda x: x IS NOT NULL)) AS field
       FROM q LEFT JOIN l ON l.k = q.k""",
)
def check_binding(t):
    results = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.min("l_returnflag").alias("flag")
    )
    key = F.col("o_orderkey")
    letter = F.substring(F.lit("NRA"), (key % 3 + 1).cast("int"), F.lit(1))
    requests = t.orders.select(
        key, (key % 6).alias("n"), F.when(F.col("o_orderstatus") != "P", letter).alias("flag")
    )
    return ln.check_binding(requests, results, ["o_orderkey"], ["n", "flag"])
