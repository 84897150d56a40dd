"""Cache queries: orders as entries (the customer's number is the size), line items as their uses, suppliers as projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import storage as op
from ..registry import query
from ..sources.tables import micros, table

_USE = "u AS (SELECT l_orderkey AS entry, l_suppkey AS project, epoch_us(l_shipdate) AS at_us FROM lineitem)"
_ENT = "x AS (SELECT o_orderkey AS entry, o_custkey AS bytes, o_orderstatus = 'F' AS bulk FROM orders)"
_OWN = "o AS (SELECT entry, count(DISTINCT project) AS owners, CASE WHEN count(DISTINCT project) = 1 THEN min(project) END AS sole, max(at_us) AS used FROM u GROUP BY entry)"


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_suppkey").alias("project"), micros("l_shipdate").alias("at_us"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_custkey").alias("bytes"), (F.col("o_orderstatus") == "F").alias("bulk"))


@query("reachability", f"WITH {_USE}, {_ENT}, {_OWN} SELECT x.entry, coalesce(o.owners, 0) AS owners, o.sole AS sole_owner FROM x LEFT JOIN o USING (entry)")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.owners(entries(spark, sf_dir), uses(spark, sf_dir), "entry", "project").select("entry", "owners", "sole_owner")


@query("storage_totals", f"WITH {_USE}, {_ENT}, {_OWN} SELECT o.sole AS project, CAST(sum(CASE WHEN o.owners = 1 THEN bytes ELSE 0 END) AS BIGINT) AS owned, CAST(sum(bytes) AS BIGINT) AS total, CAST(sum(CASE WHEN o.owners IS NULL THEN bytes ELSE 0 END) AS BIGINT) AS dead FROM x LEFT JOIN o USING (entry) GROUP BY o.sole")
def storage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = op.owners(entries(spark, sf_dir), uses(spark, sf_dir), "entry", "project")
    part = lambda c: F.sum(F.when(c, F.col("bytes")).otherwise(0))
    return x.groupBy(F.col("sole_owner").alias("project")).agg(part(F.col("owners") == 1).alias("owned"), F.sum("bytes").alias("total"), part(F.col("owners") == 0).alias("dead"))


@query("top10_owners", f"WITH {_USE}, {_ENT}, {_OWN} SELECT o.sole AS project, CAST(sum(bytes) AS BIGINT) AS bytes FROM x JOIN o USING (entry) WHERE o.owners = 1 GROUP BY o.sole ORDER BY bytes DESC, project LIMIT 10")
def top10_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = op.owners(entries(spark, sf_dir), uses(spark, sf_dir), "entry", "project").filter("owners = 1")
    return x.groupBy(F.col("sole_owner").alias("project")).agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "project").limit(10)


@query("evict_dry_run", f"WITH {_USE}, {_ENT}, {_OWN} SELECT o.sole AS project, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM x JOIN o USING (entry) WHERE o.owners = 1 AND x.entry NOT IN (SELECT entry FROM u WHERE at_us > epoch_us(TIMESTAMP '1998-01-01')) GROUP BY o.sole")
def evict_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evicting a project would free: entries that only it uses, without the outputs to keep."""
    u = uses(spark, sf_dir)
    kept = u.filter(F.col("at_us") > 883_612_800_000_000).select("entry")
    x = op.owners(entries(spark, sf_dir), u, "entry", "project").filter("owners = 1").join(kept, "entry", "left_anti")
    return x.groupBy(F.col("sole_owner").alias("project")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query("evict_budget", f"""WITH {_USE}, {_ENT}, {_OWN}, c AS (SELECT x.entry, x.bytes, coalesce(sum(x.bytes) OVER (ORDER BY coalesce(o.owners, 0) > 0, NOT x.bulk, o.used NULLS LAST, x.entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, (SELECT sum(bytes) // 2 FROM x) AS excess FROM x LEFT JOIN o USING (entry))
SELECT entry, bytes, CAST(freed AS BIGINT) AS freed_before FROM c WHERE freed < excess""")  # fmt: skip
def evict_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans first, bulk before kept, longest unused first, until the budget holds."""
    e, u = entries(spark, sf_dir), uses(spark, sf_dir)
    x = op.owners(e, u, "entry", "project", at="at_us")
    total = e.agg(F.expr("sum(bytes) div 2").alias("excess"))  # one row
    x = x.crossJoin(F.broadcast(total))
    order = [F.col("owners") > 0, ~F.col("bulk"), F.col("used").isNull(), F.col("used"), F.col("entry")]
    return op.evict(x, order, "bytes", F.col("excess"), ["entry", "bytes"], e.count())


@query("cleanup_age_then_space", """WITH s AS (SELECT o_orderkey AS id, CAST(o_custkey AS BIGINT) AS bytes, epoch_us(o_orderdate) AS at_us FROM orders),
old AS (SELECT id, bytes FROM s WHERE at_us < 820454400000000), rest AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY at_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM s WHERE at_us >= 820454400000000)
SELECT id, 'age' AS rule FROM old UNION ALL SELECT id, 'space' FROM rest WHERE freed < 100000""")  # fmt: skip
def cleanup_age_then_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything too old; then the oldest of the rest while space is low."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("bytes"), micros("o_orderdate").alias("at_us"))
    old = s.filter("at_us < 820454400000000").select("id", F.lit("age").alias("rule"))
    more = op.evict(s.filter("at_us >= 820454400000000"), [F.col("at_us"), F.col("id")], "bytes", F.lit(100_000), ["id"], s.count())
    return old.unionByName(more.select("id", F.lit("space").alias("rule")))


@query("size_estimate", "SELECT l_orderkey AS seq, CAST(floor(sum(l_quantity) * (32 / 16) * 0.25e0) AS BIGINT) AS estimate FROM lineitem GROUP BY l_orderkey")
def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input bytes times the ratio of depths times the square of the scale."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.floor(F.sum("l_quantity") * (32 / 16) * 0.25).cast("long").alias("estimate"))


@query("export_renders", "SELECT o_orderkey, c_name, l_partkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linenumber = 1")
def export_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished renders: history by project by job."""
    o, c, li = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    return o.join(c, o.o_custkey == c.c_custkey).join(li, li.l_orderkey == o.o_orderkey).select("o_orderkey", "c_name", "l_partkey")
