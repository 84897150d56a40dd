"""Text normalisation, classification, lookups and JSON over ``part``, ``documents``, ``pages``, ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..registry import query
from ..sources.tables import table


def _case(column: str, values: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query("classify_rules", """WITH h AS (SELECT p_partkey, upper(p_brand) AS creator, lower(p_type) AS kind, p_size FROM part)
SELECT p_partkey, CASE WHEN starts_with(creator, 'BRAND#1') THEN 'dwarf' WHEN starts_with(creator, 'BRAND#2') THEN 'asiair' WHEN starts_with(creator, 'BRAND#3') THEN 'nina' END AS scope,
 CASE WHEN kind LIKE '%economy' THEN 'LIGHT' WHEN kind LIKE '%small' THEN 'DARK' WHEN kind LIKE '%large' THEN 'FLAT' END AS image_type, p_size >= 45 AS derived, CASE WHEN p_partkey % 10 = 0 THEN 'failed' ELSE 'good' END AS quality
FROM h WHERE NOT (p_size >= 45) AND (starts_with(creator, 'BRAND#1') OR starts_with(creator, 'BRAND#2') OR starts_with(creator, 'BRAND#3')) AND (kind LIKE '%economy' OR kind LIKE '%small' OR kind LIKE '%large')""")  # fmt: skip
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope by the first prefix rule, type by alias, derived frames rejected, quality by the file's name."""
    creator, kind = F.upper("p_brand"), F.substring_index(F.lower("p_type"), " ", -1)
    scope = F.when(creator.startswith("BRAND#1"), "dwarf").when(creator.startswith("BRAND#2"), "asiair").when(creator.startswith("BRAND#3"), "nina")
    image = F.try_element_at(tx.literal_map({"economy": "LIGHT", "small": "DARK", "large": "FLAT"}), kind)
    derived = F.coalesce(F.col("p_size").try_cast("int") >= 45, F.lit(False))
    name = F.concat(F.when(F.col("p_partkey") % 10 == 0, "failed_").otherwise("raw_"), F.col("p_partkey").cast("string"))
    x = table(spark, sf_dir, "part").select("p_partkey", scope.alias("scope"), image.alias("image_type"), derived.alias("derived"), F.when(name.startswith("failed_"), "failed").otherwise("good").alias("quality"))
    return x.filter("NOT derived AND scope IS NOT NULL AND image_type IS NOT NULL")


@query("alias_lookup", "SELECT c_custkey, coalesce(a.n_name, b.n_name) AS canonical FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'nation  ' || CAST(c_nationkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN 'Nation' || CAST(c_nationkey AS VARCHAR) ELSE 'unknown' END AS raw FROM customer) c LEFT JOIN nation a ON 'nation ' || CAST(a.n_nationkey AS VARCHAR) = lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) LEFT JOIN nation b ON 'nation' || CAST(b.n_nationkey AS VARCHAR) = replace(lower(trim(raw)), ' ', '')")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised key first, compact key second; the first alias of a key wins."""
    c = table(spark, sf_dir, "customer").withColumn("raw", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("nation  "), F.col("c_nationkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Nation"), F.col("c_nationkey").cast("string"))).otherwise("unknown"))
    n = table(spark, sf_dir, "nation").select("n_name", "n_nationkey", F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("key"))
    w = Window.partitionBy("key").orderBy("n_nationkey")
    first = n.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    a = first.select(F.col("key").alias("k1"), F.col("n_name").alias("name1"))
    b = first.select(F.replace("key", F.lit(" "), F.lit("")).alias("k2"), F.col("n_name").alias("name2"))
    key = tx.lookup_key(F.col("raw"))
    x = c.join(a, key == F.col("k1"), "left").join(b, F.replace(key, F.lit(" "), F.lit("")) == F.col("k2"), "left")
    return x.select("c_custkey", F.coalesce("name1", "name2").alias("canonical"))


@query("normalize_names", r"""SELECT p_partkey, trim(regexp_replace(trim(regexp_replace('  ' || replace(p_name, ' ', '   ') || ' (' || CAST(p_size AS VARCHAR) || ') ', '\s+', ' ', 'g')), '\s*\(\d+\)\s*$', '')) AS target,
 replace(upper(replace('Dwarf III ' || p_brand, ' ', '')), 'III', '3') AS instrument, regexp_replace(trim(p_type), '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM part""")  # fmt: skip
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" ("), F.col("p_size").cast("string"), F.lit(") "))
    return table(spark, sf_dir, "part").select("p_partkey", tx.normalize_target(raw).alias("target"), tx.canonical_instrument(F.concat(F.lit("Dwarf III "), F.col("p_brand"))).alias("instrument"), tx.safe_name(F.col("p_type")).alias("safe"))


_FILTER_KEYS = ["none", " Ha-OIII ", "duo_band", "LUM", "", "Custom X", "uv ir"]


@query("filter_alias", "WITH f AS (SELECT p_partkey, [" + ", ".join(f"'{k}'" for k in _FILTER_KEYS) + r"][1 + p_partkey % 7] AS raw FROM part) SELECT p_partkey, nullif(coalesce(" + _case(r"lower(regexp_replace(raw, '[\s_\-]+', '', 'g'))", tx.FILTERS) + ", trim(raw)), '') AS filter FROM f")
def filter_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, _FILTER_KEYS)), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.canonical_filter(raw).alias("filter"))


@query("alias_expand", "WITH c AS (SELECT n_nationkey, 'NGC' || lpad(CAST(n_nationkey + 7 AS VARCHAR), 4, '0') AS name FROM nation) SELECT DISTINCT n_nationkey, unnest(['ngc ' || CAST(n_nationkey + 7 AS VARCHAR), 'ngc' || CAST(n_nationkey + 7 AS VARCHAR), 'ngc ' || lpad(CAST(n_nationkey + 7 AS VARCHAR), 4, '0'), 'ngc' || lpad(CAST(n_nationkey + 7 AS VARCHAR), 4, '0')]) AS alias, 'NGC ' || CAST(n_nationkey + 7 AS VARCHAR) AS canonical FROM c")
def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("NGC"), F.lpad((F.col("n_nationkey") + 7).cast("string"), 4, "0"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(tx.alias_keys(name)).alias("alias"), tx.canonical_id(name).alias("canonical"))


@query("search_compact", r"WITH p AS (SELECT p_partkey, lower(regexp_replace(coalesce(p_name, ''), '\s+', ' ', 'g')) AS a, lower(regexp_replace(coalesce(p_type, ''), '\s+', ' ', 'g')) AS b FROM part) SELECT p_partkey FROM p WHERE contains(a, 'small r') OR contains(replace(a, ' ', ''), 'smallr') OR contains(b, 'small r') OR contains(replace(b, ' ', ''), 'smallr')")
def search_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(tx.matches_search("  Small   R ", F.col("p_name"), F.col("p_type"))).select("p_partkey")


@query("type_group", "SELECT CASE split_part(lower(p_type), ' ', 1) WHEN 'promo' THEN 'nebula' WHEN 'large' THEN 'galaxy' WHEN 'small' THEN 'cluster' WHEN 'medium' THEN 'cluster' ELSE 'other' END AS grp, count(*) AS n FROM part GROUP BY 1")
def type_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = tx.literal_map({"promo": "nebula", "large": "galaxy", "small": "cluster", "medium": "cluster"})
    return table(spark, sf_dir, "part").groupBy(F.coalesce(F.try_element_at(kinds, F.substring_index(F.lower("p_type"), " ", 1)), F.lit("other")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("progress_parse", r"""WITH l AS (SELECT conv_id, turn, 'step ' || CAST(turn AS VARCHAR) || '/' || CAST(1 + conv_id % 9 AS VARCHAR) || CASE WHEN conv_id % 2 = 0 THEN ' (' || CAST(turn * 7.5 AS VARCHAR) || ' %)' ELSE '' END AS line FROM conversations)
SELECT conv_id, turn, round(greatest(0, least(1, coalesce(TRY_CAST(regexp_extract(line, '(\d+(?:\.\d+)?)\s*%', 1) AS DOUBLE) / 100, CASE WHEN TRY_CAST(regexp_extract(line, '(\d+)\s*/\s*(\d+)', 2) AS DOUBLE) > 0 THEN TRY_CAST(regexp_extract(line, '(\d+)\s*/\s*(\d+)', 1) AS DOUBLE) / TRY_CAST(regexp_extract(line, '(\d+)\s*/\s*(\d+)', 2) AS DOUBLE) END))), 9) AS fraction FROM l""")  # fmt: skip
def progress_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = F.concat(F.lit(" ("), (F.col("turn") * 7.5).cast("decimal(10,1)").cast("string"), F.lit(" %)"))
    line = F.concat(F.lit("step "), F.col("turn").cast("string"), F.lit("/"), (1 + F.col("conv_id") % 9).cast("string"), F.when(F.col("conv_id") % 2 == 0, pct).otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(tx.progress(line), 9).alias("fraction"))


@query("filename_fields", r"""WITH f AS (SELECT p_partkey, 'dark_exp_' || CAST(p_size AS VARCHAR) || '.000000_gain_' || CAST(p_partkey % 200 AS VARCHAR) || '_bin_1_' || CAST(p_size - 10 AS VARCHAR) || 'C_stack_' || CAST(1 + p_partkey % 20 AS VARCHAR) || '.fits' AS name FROM part)
SELECT p_partkey, CAST(regexp_extract(name, 'exp_(\d+\.\d+)_gain_(\d+)_bin_(\d+)_(-?\d+)C_stack_(\d+)', 1) AS DOUBLE) AS exposure, CAST(regexp_extract(name, 'gain_(\d+)', 1) AS INTEGER) AS gain, CAST(regexp_extract(name, '_(-?\d+)C_', 1) AS INTEGER) AS temp, CAST(regexp_extract(name, 'stack_(\d+)', 1) AS INTEGER) AS stack FROM f""")  # fmt: skip
def filename_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master metadata from file names."""
    from ..sources.fits import master_fields

    s = lambda c: c.cast("string")
    name = F.concat(F.lit("dark_exp_"), s(F.col("p_size")), F.lit(".000000_gain_"), s(F.col("p_partkey") % 200), F.lit("_bin_1_"), s(F.col("p_size") - 10), F.lit("C_stack_"), s(1 + F.col("p_partkey") % 20), F.lit(".fits"))
    return table(spark, sf_dir, "part").withColumn("m", master_fields(name)).select("p_partkey", "m.exposure", "m.gain", "m.temp", "m.stack")


@query("safe_coerce", r"""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, TRY_CAST(event_type AS DOUBLE) AS bad,
 coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0.0e0 ELSE value END, 0), nullif(CAST(user_id % 4 AS DOUBLE), 0), -1.0e0) AS truthy, greatest(0, 40 - CAST(json_extract_string(props, '$.k') AS INTEGER)) AS clamped FROM events""")  # fmt: skip
def safe_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coercion failing to null; fallbacks that skip zeros; values not below zero."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    v = F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.col("event_type").try_cast("double").alias("bad"), tx.first_set(v, (F.col("user_id") % 4).cast("double"), F.lit(-1.0)).alias("truthy"), F.greatest(F.lit(0), 40 - k).alias("clamped"))


@query("props_promote", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing, CASE WHEN json_valid(CASE WHEN event_id % 5 = 0 THEN '{' ELSE props END) THEN 'ok' ELSE 'bad' END AS state FROM events")
def props_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header keys as columns; broken JSON is null, not an error."""
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("{")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), F.when(F.try_parse_json(raw).isNull(), "bad").otherwise("ok").alias("state"))


@query("override_merge", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 2 = 0 THEN '9' ELSE json_extract_string(props, '$.k') END AS k, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'yes' END AS extra FROM events""")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep merge of two maps: the patch wins, a null value in it deletes."""
    from ..functions.values import merge_maps

    base = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("kind"), F.col("event_type"))
    patch = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("k"), F.lit(None).cast("string"), F.lit("extra"), F.lit("yes"))).when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("9"), F.lit("extra"), F.lit("yes"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    m = merge_maps(base, patch)
    return table(spark, sf_dir, "events").withColumn("m", m).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"), F.col("m")["extra"].alias("extra"))


@query("param_diff", "SELECT a.conv_id, a.turn, CASE WHEN a.role IS DISTINCT FROM b.role THEN a.role || '>' || coalesce(b.role, '-') END AS role_change, length(a.text) - length(b.text) AS size_change FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def param_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed-only union of the parameters of two versions."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf_dir, "conversations").withColumn("r2", F.lead("role").over(w)).withColumn("t2", F.lead("text").over(w)).withColumn("n2", F.lead("turn").over(w))
    adjacent = F.col("n2") == F.col("turn") + 1
    r2 = F.when(adjacent, F.col("r2"))
    return x.select("conv_id", "turn", F.when(~F.col("role").eqNullSafe(r2), F.concat(F.col("role"), F.lit(">"), F.coalesce(r2, F.lit("-")))).alias("role_change"), F.when(adjacent, F.length("text") - F.length("t2")).cast("long").alias("size_change"))


@query("rows_to_json", "SELECT conv_id, turn, '{\"conv_id\":' || CAST(conv_id AS VARCHAR) || ',\"role\":\"' || role || '\"}' AS line FROM conversations")
def rows_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("conv_id", "role")).alias("line"))


@query("job_membership", "SELECT DISTINCT c.conv_id, d.source FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE c.role = 'user'")
def job_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents").select("doc_id", "source")
    return c.filter("role = 'user'").select("conv_id").distinct().join(d, F.col("conv_id") == F.col("doc_id")).select("conv_id", "source")


@query("catalog_union", "SELECT key, min_by(src || ':' || CAST(id AS VARCHAR), src || lpad(CAST(id AS VARCHAR), 12, '0')) AS first, count(*) AS entries FROM (SELECT lower(trim(c_mktsegment)) AS key, 'a' AS src, c_custkey AS id FROM customer UNION ALL SELECT lower(p_brand), 'b', p_partkey FROM part) GROUP BY key")
def catalog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogs concatenated; the first entry of a key wins."""
    a = table(spark, sf_dir, "customer").select(F.lower(F.trim("c_mktsegment")).alias("key"), F.lit("a").alias("src"), F.col("c_custkey").alias("id"))
    b = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("key"), F.lit("b").alias("src"), F.col("p_partkey").alias("id"))
    u = a.unionByName(b).groupBy("key").agg(F.min(F.struct("src", "id")).alias("f"), F.count(F.lit(1)).alias("entries"))
    return u.select("key", F.concat_ws(":", "f.src", F.col("f.id").cast("string")).alias("first"), "entries")


@query("catalog_stats", "SELECT count(*) AS entries, count(DISTINCT lower(p_type)) AS alias_keys, CAST(count(*) FILTER (p_name LIKE '% %') AS BIGINT) AS named FROM part")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct(F.lower("p_type")).alias("alias_keys"), F.count_if(F.col("p_name").contains(" ")).alias("named"))


@query("human_labels", "SELECT p_partkey, CASE WHEN p_size / 10.0 < 1 THEN CAST(CAST(round(p_size / 10.0 * 60) AS INTEGER) AS VARCHAR) || ' min' ELSE printf('%.1f', p_size / 10.0) || ' h' END AS hours FROM part")
def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.hours_label(F.col("p_size") / 10.0).alias("hours"))


@query("override_spec", "SELECT conv_id, turn, CAST(turn AS VARCHAR) AS value, 'int' AS kind FROM conversations UNION ALL SELECT conv_id, turn, role, 'text' FROM conversations")
def override_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node.param=value`` lists parsed into typed rows."""
    spec = F.concat(F.lit("stretch.turn = "), F.col("turn").cast("string"), F.lit(" , stack.role="), F.col("role"))
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tx.parse_overrides(spec)).alias("param", "value"))
    return x.select("conv_id", "turn", "value", tx.typed(F.col("value")).alias("kind"))
