"""Queries that apply each operator to the analytics tables, with equivalent SQL.

The tables hold no archives, so every operator is shown on a stand-in: intervals
are event spans, sets are conversations, trees are nations below regions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import kernels as k
from tessera.plans import conversations
from tessera.plans.validation import root_mismatches, toc_accounting, type_names, violations
from tessera.shared import fresh_dir, small_batches
from tessera.sources import layout, storage
from tessera.sources.catalog import Catalog, listed, read_files, scan, strict_blobs, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, and its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(url):
    return F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


SQL_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT CASE WHEN contains(p, '.') THEN '.' || lower(regexp_extract(p, '\\.([^.]*)$', 1)) ELSE '<no extension>' END AS extension, count(*) AS n FROM (SELECT {SQL_PATH} AS p FROM pages) GROUP BY 1")
def q_ext_histogram(spark, sf_dir):
    """Counts by file extension, the most frequent first."""
    return k.histogram(_t(spark, sf_dir, "pages"), tx.extension(_path(F.col("url"))), "extension")


_TOKENS = "list_distinct(string_split_regex(lower(regexp_replace(text, '[^ -~]', ' ', 'g')), '[_\\W]+'))"
_EXCLUDED = "[" + ",".join(f"'{t}'" for t in tx.EXCLUDED_TOKENS) + "]"


@query(f"""WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM (SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN ' mus' WHEN 1 THEN ' amb_sting' WHEN 2 THEN ' drone env' WHEN 3 THEN ' stinger ui music' WHEN 4 THEN ' env_hit' ELSE '' END AS text FROM documents)),
f AS (SELECT doc_id, list_has_any(t, ['mus','music']) AS m, list_has_any(t, {_EXCLUDED}) AS x, t FROM d)
SELECT doc_id, array_to_string(list_filter([CASE WHEN m THEN 'music' END, CASE WHEN list_has_any(t, ['stinger','sting']) AND (m OR NOT x) THEN 'stingers' END,
CASE WHEN NOT x AND list_has_any(t, ['amb','ambience','ambient','atmos','atmosphere']) THEN 'ambience' END, CASE WHEN NOT x AND list_has_any(t, ['bed','drone']) THEN 'beds' END,
CASE WHEN NOT x AND list_has_any(t, ['env']) THEN 'environment' END], lambda c: c IS NOT NULL), ';') AS categories FROM f""")
def q_token_classify(spark, sf_dir):
    """Token sets to categories; names are texts with a marker, characters beyond ASCII are blanks."""
    mark = F.expr("CASE doc_id % 7 WHEN 0 THEN ' mus' WHEN 1 THEN ' amb_sting' WHEN 2 THEN ' drone env' WHEN 3 THEN ' stinger ui music' WHEN 4 THEN ' env_hit' ELSE '' END")
    name = F.regexp_replace(F.concat("text", mark), "[^ -~]", " ")
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.categories(name), ";").alias("categories"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1")
def q_argmin_pick(spark, sf_dir):
    """For each customer the order of the best priority; ties go to the first key."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return k.argmin_pick(orders, ["o_custkey"], F.col("o_orderpriority"), ["o_orderkey"])


@query("""WITH own AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS own FROM orders GROUP BY 1)
SELECT o.o_custkey, own, substr(coalesce(string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) FILTER (o_orderpriority <> own), ''), 1, 300) AS others FROM orders o JOIN own USING (o_custkey) GROUP BY 1, 2""")
def q_label_set(spark, sf_dir):
    """The other priorities of a customer besides that of the first order."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    own = k.first_wins(orders, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderpriority").alias("own"))
    return k.label_sets(orders.join(own, "o_custkey"), ["o_custkey"], "o_orderpriority", "own")


@query("SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def q_first_wins(spark, sf_dir):
    return k.first_wins(_t(spark, sf_dir, "documents").select("text", "doc_id", "source"), ["text"], ["doc_id"])


@query("SELECT text, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY text")
def q_last_wins(spark, sf_dir):
    return k.last_wins(_t(spark, sf_dir, "documents").select("text", "doc_id", "source"), ["text"], ["doc_id"])


@query("SELECT doc_id, n_chars, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents")
def q_prefix_offsets(spark, sf_dir):
    """Running start of each document in one image of all of them."""
    return k.global_offsets(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("""WITH o AS (SELECT doc_id, n_chars, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM documents)
SELECT *, greatest(100000 - "offset", 0) AS cut_from, least("offset" + n_chars, 350000) - "offset" - greatest(100000 - "offset", 0) AS cut_size FROM o WHERE "offset" + n_chars > 100000 AND "offset" < 350000 AND n_chars > 0""")
def q_range_overlap(spark, sf_dir):
    """What a read of 250,000 characters from 100,000 on takes from each document."""
    placed = k.global_offsets(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")
    return k.overlapping(placed, "offset", "n_chars", F.lit(100_000), F.lit(250_000))


@query("""WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), p AS (SELECT conv_id, n, CAST(coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM s)
SELECT conv_id, n, doc_id, pos, pos - st AS slot FROM (SELECT *, unnest(range(st, st + n)) AS pos FROM p) LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) USING (pos)""")
def q_positional_join(spark, sf_dir):
    """Conversations as sets that take the next documents in order."""
    sets = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    one = _t(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("one"))
    items = k.global_offsets(one, "one", "doc_id", "pos").select("doc_id", "pos")
    return k.positional_join(sets, items, "n", ["conv_id"], "pos")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber AS b, l_linenumber + 1 AS e, count(*) OVER (PARTITION BY l_orderkey) + 1 AS hi, coalesce(lag(l_linenumber + 1) OVER w, 1) AS want, lead(l_linenumber) OVER w IS NULL AS last
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linenumber + 1))
SELECT v AS violation, count(*) AS n FROM (SELECT CASE WHEN b > want THEN 'gap' WHEN b < want THEN 'overlap' WHEN last AND e <> hi THEN 'end' END AS v FROM w) WHERE v IS NOT NULL GROUP BY 1""")
def q_partition_check(spark, sf_dir):
    """Whether line numbers cover 1 to the number of lines exactly once."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("b"), (F.col("l_linenumber") + 1).alias("e"))
    lines = lines.withColumn("hi", F.count("*").over(W.partitionBy("l_orderkey")) + 1)
    return k.partition_violations(lines, ["l_orderkey"], "b", "e", F.lit(1), F.col("hi")).groupBy("violation").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events),
runs AS (SELECT user_id, event_type, min(event_id) AS f, max(event_id) AS l, count(*) AS n FROM r GROUP BY user_id, event_type, g)
SELECT user_id, event_type, f AS run_first, l AS run_last, n AS run_size FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def q_islands(spark, sf_dir):
    """The longest run of equal events of each user; the first of several."""
    events = _t(spark, sf_dir, "events").withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    best = k.longest_island(events, ["user_id"], "pos", 1, ["event_type"])
    ids = events.select("user_id", F.col("pos"), F.col("event_id"))
    first = ids.select("user_id", F.col("pos").alias("run_first"), F.col("event_id").alias("a"))
    last = ids.select("user_id", F.col("pos").alias("run_last"), F.col("event_id").alias("b"))
    return best.join(first, ["user_id", "run_first"]).join(last, ["user_id", "run_last"]).select("user_id", "event_type", F.col("a").alias("run_first"), F.col("b").alias("run_last"), "run_size")


_SPANS = "SELECT user_id, epoch_us(ts) AS b, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 60000000 AS e FROM events"


@query(f"""WITH s AS ({_SPANS}), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR b > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(b) AS b, max(e) AS e, count(*) AS n_merged FROM i GROUP BY user_id, g""")
def q_merge_intervals(spark, sf_dir):
    """The union of each user's event spans, in microseconds."""
    return k.merge_intervals(_spans(spark, sf_dir), ["user_id"], "b", "e")


def _spans(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return _t(spark, sf_dir, "events").select("user_id", start.alias("b"), (start + F.floor("value").cast("long") * 60_000_000).alias("e"))


@query(f"""WITH s AS ({_SPANS}), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s)
SELECT user_id, p AS gap_begin, b AS gap_end FROM m WHERE b > p""")
def q_gaps(spark, sf_dir):
    """The time between merged spans of a user."""
    return k.gaps(_spans(spark, sf_dir), ["user_id"], "b", "e")


@query(f"SELECT user_id, count(*) AS n FROM (SELECT user_id, e, lead(b) OVER (PARTITION BY user_id ORDER BY b, e) AS nb FROM ({_SPANS})) WHERE nb < e GROUP BY 1")
def q_neighbour_overlap(spark, sf_dir):
    """Spans that reach into the next."""
    return k.neighbour_violations(_spans(spark, sf_dir), ["user_id"], "b", "e").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, votes FROM (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS f FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) = 1")
def q_majority(spark, sf_dir):
    """The usual event of each user; ties go to the one seen first."""
    return k.majority(_t(spark, sf_dir, "events"), ["user_id"], "event_type", ["event_id"])


@query("SELECT n.n_nationkey + 100 AS node, r.r_name || '/' || n.n_name AS path, false AS is_cycle FROM nation n JOIN region r ON r_regionkey = n_regionkey UNION ALL SELECT r_regionkey, r_name, false FROM region")
def q_closure_path(spark, sf_dir):
    """Paths of nations below regions."""
    regions = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("node"), F.lit(None).cast("int").alias("up"), F.col("r_name").alias("name"))
    nations = _t(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("node"), F.col("n_regionkey").alias("up"), F.col("n_name").alias("name"))
    return k.closure_path(regions.union(nations), "node", "up", "name")


@query("SELECT DISTINCT n FROM (SELECT source || '/' || (doc_id % 40) || CASE WHEN doc_id % 3 = 0 THEN '-development' ELSE '' END AS n FROM documents) a WHERE NOT (n LIKE '%-development' AND replace(n, '-development', '') IN (SELECT source || '/' || (doc_id % 40) FROM documents WHERE doc_id % 3 <> 0))")
def q_anti_variant(spark, sf_dir):
    """Names without those variants whose plain form is there."""
    plain = F.concat("source", F.lit("/"), (F.col("doc_id") % 40).cast("string"))
    names = _t(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.concat(plain, F.lit("-development"))).otherwise(plain).alias("n")).distinct()
    return k.without_variant(names, "n", "-development")


@query("SELECT c_custkey, p_brand, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2")
def q_two_hop(spark, sf_dir):
    """What customers reach over their orders: two links, duplicates kept and counted."""
    seeds = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    links = _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    far = k.two_hops(seeds, links, _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "o_custkey", "l_orderkey")
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return far.join(part, "l_partkey").groupBy(F.col("o_custkey").alias("c_custkey"), "p_brand").agg(F.count("*").alias("n"))


@query("SELECT coalesce(p_type, '?') AS p_type, coalesce(s_name, '?') AS s_name, count(*) AS n, sum(CAST(round(l_quantity) AS BIGINT)) AS quantity FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey < 13 GROUP BY 1, 2")
def q_star_left(spark, sf_dir):
    """Facts with optional dimensions and a default for what is missing."""
    part = _t(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    supplier = _t(spark, sf_dir, "supplier").where("s_nationkey < 13").select(F.col("s_suppkey").cast("long").alias("l_suppkey"), "s_name")
    facts = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(part, "l_partkey", "left").join(supplier, "l_suppkey", "left")
    return facts.groupBy(F.coalesce("p_type", F.lit("?")).alias("p_type"), F.coalesce("s_name", F.lit("?")).alias("s_name")).agg(F.count("*").alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("quantity"))


@query("""SELECT o_orderstatus, count(*) AS n_orders, count(*) FILTER (n > 4) AS n_long, count(*) FILTER (coalesce(n, 0) = 0) AS n_empty, CAST(sum(n) AS BIGINT) AS n_lines, CAST(100 * count(*) FILTER (n > 4) // count(*) AS BIGINT) AS pct_long
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def q_conditional_agg(spark, sf_dir):
    """Totals and conditional counts of parts against their whole."""
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left")
    out = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), F.count_if(F.col("n") > 4).alias("n_long"), F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("n_empty"), F.sum("n").alias("n_lines"))
    return out.withColumn("pct_long", F.floor(100 * F.col("n_long") / F.col("n_orders")).cast("long"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(turn || ':' || role || ':' || length(text), '|' ORDER BY turn) AS document FROM conversations GROUP BY 1")
def q_nested_doc(spark, sf_dir):
    """Conversations as nested documents: an ordered list of turns."""
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("size")))).alias("turns"))
    line = lambda t: F.concat_ws(":", t["turn"].cast("string"), t["role"], t["size"].cast("string"))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", line), "|").alias("document"))


@query("""SELECT event_id, '[' || (event_id % 9) || '-' || (event_id % 9 + 2) || '.5]' || event_type || CASE WHEN event_id % 2 = 0 THEN ' [' || (event_id % 9 + 3) || '-' || (event_id % 9 + 4) || '] ' || user_id ELSE '' END AS line,
CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS n_cues, CAST(event_id % 9 AS DOUBLE) AS first_begin, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS last_text FROM events""")
def q_regex_cues(spark, sf_dir):
    """Timed segments of marked-up lines."""
    line = F.expr("concat('[', event_id % 9, '-', event_id % 9 + 2, '.5]', event_type, CASE WHEN event_id % 2 = 0 THEN concat(' [', event_id % 9 + 3, '-', event_id % 9 + 4, '] ', user_id) ELSE '' END)")
    found = _t(spark, sf_dir, "events").select("event_id", line.alias("line")).withColumn("c", tx.cues(F.col("line"), F.lit(0.0), F.lit(1.0)))
    return found.select("event_id", "line", F.size("c").alias("n_cues"), F.get("c", F.lit(0))["begin"].alias("first_begin"), F.element_at("c", -1)["text"].alias("last_text"))


@query("SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM (SELECT event_id, (event_id * 7919) % 90000000 AS ms FROM events)")
def q_srt_time(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", tx.srt_time((F.col("event_id") * 7919) % 90_000_000).alias("stamp"))


@query("SELECT page_id, CASE WHEN s = '' THEN 'x' ELSE s END AS safe, CASE WHEN f = '' THEN 'misc' ELSE f END AS family FROM (SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), '_') AS s, regexp_extract(url, '^([a-z]+)', 1) AS f FROM pages)")
def q_safe_name(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tx.safe_name(F.col("url")).alias("safe"), tx.family(F.col("url")).alias("family"))


@query("SELECT source, CAST(min(doc_id) AS BIGINT) AS first_id, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS BIGINT) AS index FROM documents GROUP BY 1")
def q_first_seen_index(spark, sf_dir):
    """Dense numbers of sources in order of appearance."""
    documents = _t(spark, sf_dir, "documents")
    first = documents.groupBy("source").agg(F.min("doc_id").alias("first_id"))
    return k.first_seen_index(documents, "source", ["doc_id"]).join(first, "source")


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY f) AS path FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def q_ordered_distinct(spark, sf_dir):
    """Each user's kinds of event in order of appearance."""
    return k.ordered_distinct(_t(spark, sf_dir, "events"), ["user_id"], "event_type", ["event_id"]).select("user_id", F.array_join("values", ">").alias("path"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'patched ' || p_partkey ELSE p_name END AS p_name, false AS missing FROM part
UNION ALL SELECT -p_partkey - 1, 'patched ' || p_partkey, true FROM part WHERE p_partkey % 50 = 0""")
def q_apply_patches(spark, sf_dir):
    """A table of values with some replaced by key, and the patches that meet no row."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    new = F.concat(F.lit("patched "), F.col("p_partkey").cast("string")).alias("p_name")
    patches = part.where("p_partkey % 10 = 0").select("p_partkey", new).union(part.where("p_partkey % 50 = 0").select(-F.col("p_partkey") - 1, new))
    done, missing = k.apply_patches(part, patches, "p_partkey", "p_name")
    return done.withColumn("missing", F.lit(False)).unionByName(missing.select("p_partkey", F.col("_new").alias("p_name"), F.lit(True).alias("missing")))


@query("""WITH e AS (SELECT l_suppkey AS seq, l_partkey % 50 AS sound, l_orderkey AS tl, l_linenumber AS o FROM lineitem WHERE l_returnflag = 'A')
SELECT 'seq' || seq AS full_name, CAST(sound AS BIGINT) AS wem_id, CAST(n AS BIGINT) AS n, 't' || lpad(CAST(tl AS VARCHAR), 12, '0') AS timeline, o AS start, round(o / 30.0, 3) AS start_s
FROM (SELECT seq, sound, count(*) AS n, min(tl) AS tl FROM e GROUP BY ALL) f JOIN (SELECT seq, sound, tl, min(o) AS o FROM e GROUP BY ALL) USING (seq, sound, tl)""")
def q_sequence_events(spark, sf_dir):
    """Lines with the first event that refers to their sequence and plays their sound: orders are timelines, suppliers sequences."""
    item = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    ref = lambda kind, id_: F.struct(F.lit(kind).alias("kind"), id_.cast("long").alias("id"))
    event = item.select(
        F.concat(F.lit("t"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("full_name"), F.col("l_linenumber").alias("event_ord"), F.lit(conversations.DIALOGUE_EVENT).alias("cls"), F.col("l_linenumber").alias("start"), F.lit(30).alias("duration"), F.lit("g").alias("guid"),
        F.array(ref(conversations.TO_SEQUENCE, F.col("l_suppkey")), ref(conversations.TO_SOUND, F.col("l_partkey") % 50)).alias("refs"),
    )
    ids = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.concat(F.lit("seq"), F.col("s_suppkey").cast("string")).alias("name"))
    line = item.groupBy(F.concat(F.lit("seq"), F.col("l_suppkey").cast("string")).alias("full_name"), (F.col("l_partkey") % 50).cast("long").alias("wem_id")).agg(F.count("*").alias("n"))
    return conversations.timed_in_sequence(line, conversations.sequence_events(event, ids)).select("full_name", "wem_id", "n", "timeline", "start", "start_s")


@query("""SELECT 'con_' || user_id AS conversation, CASE WHEN user_id % 3 = 0 THEN 'mq' || user_id % 7 END AS quest, CASE WHEN user_id % 3 = 0 THEN 'facts' END AS source, CAST(count(DISTINCT event_type) AS BIGINT) AS sequences, count(*) AS lines,
count(*) FILTER (event_id % 2 = 0) AS audio, count(*) FILTER (event_id % 5 = 0) AS subtitle_cues, CAST(user_id % 4 AS BIGINT) AS graphs,
CASE WHEN user_id % 3 = 0 THEN 'quests/mq' || user_id % 7 ELSE 'loose/con' END || '/con_' || user_id AS folder FROM events GROUP BY user_id""")
def q_conversation_index(spark, sf_dir):
    """The index of conversations: users are conversations, their kinds of event sequences, events lines."""
    own = F.concat(F.lit("con_"), F.col("user_id").cast("string"))
    event = _t(spark, sf_dir, "events").select(own.alias("conv"), "user_id", F.concat_ws("/", own, "event_type").alias("full_name"), "event_id", "event_type")
    line = event.select("full_name", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("wem"), F.when(F.col("event_id") % 5 == 0, F.lit(1.0)).alias("start_s"), F.lit(1.0).alias("duration_s"), F.lit("said").alias("text"), F.lit("").alias("subtitle"))
    users = event.select("conv", "user_id").distinct()
    quest = users.where("user_id % 3 = 0").select("conv", F.concat(F.lit("mq"), (F.col("user_id") % 7).cast("string")).alias("quest"), F.lit("facts").alias("quest_source"))
    graphs = users.where("user_id % 4 > 0").select("conv", F.explode(F.sequence(F.lit(1), (F.col("user_id") % 4).cast("int"))).alias("ord"))
    return conversations.index(event.select("conv", "full_name").distinct(), line, quest, graphs)


@query("SELECT l_returnflag, l_linestatus, r_regionkey, n FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) CROSS JOIN region")
def q_variants_by_level(spark, sf_dir):
    """Every combination of few variants and levels: both sides are a handful of rows by their keys."""
    variants = _t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    levels = _t(spark, sf_dir, "region").groupBy().agg(F.collect_set("r_regionkey").alias("all"))
    return variants.withColumn("one", F.lit(1)).join(levels.withColumn("one", F.lit(1)), "one").select("l_returnflag", "l_linestatus", F.explode("all").alias("r_regionkey"), "n")


@query("SELECT doc_id, '0x' || lower(lpad(to_hex(doc_id), 16, '0')) AS hex_id, n_chars, round(n_chars / 30.0, 3) AS seconds FROM documents")
def q_hex_and_frames(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.hex_id(F.col("doc_id")).alias("hex_id"), "n_chars", tx.frames_to_seconds(F.col("n_chars")).alias("seconds"))


@query("SELECT page_id, NOT (p LIKE '/%' OR p = '' OR contains(p, '//') OR p LIKE '%/') AS safe FROM (SELECT page_id, substr(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), 2) AS p FROM pages)")
def q_output_path_safe(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tx.path_is_safe(F.substring(_path(F.col("url")), 2, 2**30)).alias("safe"))


@query()
def q_checksums(spark, sf_dir):
    """CRC-32 and FNV-1a of texts (no SQL: DuckDB has neither)."""
    data = F.col("text").cast("binary")
    return _t(spark, sf_dir, "documents").select("doc_id", F.crc32(data).alias("crc32"), tx.fnv1a32(data).alias("fnv1a32"))


@query("SELECT doc_id, text, false AS damaged FROM documents")
def q_archive_roundtrip(spark, sf_dir):
    """Documents packed into archives, scanned, read back and checked against their checksums."""
    catalog, folder = _archived(spark, sf_dir)
    content = read_files(catalog, catalog.blobs(spark, folder), catalog.file).join(catalog.info(), ["toc_id", "file_idx"])
    number = F.regexp_extract("full_name", r"(\d+)\.txt$", 1).cast("long")
    return content.select(number.alias("doc_id"), F.col("content").cast("string").alias("text"), (F.col("crc32") != F.col("info_crc32")).alias("damaged"))



#: What is changed in a sound archive, one byte each, and the rule that it then breaks: section, place, new value.
DAMAGE = (("chunks", 2, 1, "reserved byte is zero"), ("chunks", 1, 9, "archive exists"), ("metadata", 0, 7, "magic"))


@query("SELECT * FROM (VALUES ('reserved byte is zero', 1), ('archive exists', 1), ('magic', 1)) t(rule, n_tocs)")
def q_archive_violations(spark, sf_dir):
    """Rules of ``DAMAGE`` that fail on one damaged archive each; sound ones break none."""
    folder = fresh_dir(spark, "damaged")
    rows = _t(spark, sf_dir, "region").select(F.concat(F.lit("a/"), "r_name").alias("name"), F.col("r_name").cast("binary").alias("content")).orderBy("name").collect()
    toc, blob = layout.pack_archive([(r["name"], bytes(r["content"])) for r in rows], "x.rmdblob", 1, compress=False)
    header = dict(zip(layout.HEADER_WORDS, np.frombuffer(toc, layout.U32, 22).tolist(), strict=True))
    storage.write_whole(f"{folder}/sound/x.rmdtoc", toc)
    storage.write_whole(f"{folder}/sound/x.rmdblob", blob)
    for n, (section, at, value, _) in enumerate(DAMAGE):
        place = layout.HEADER_SIZE + 16 + header[f"{section}_off"] + at
        storage.write_whole(f"{folder}/{n}/x.rmdtoc", toc[:place] + bytes([value]) + toc[place + 1 :])
    found = violations(Catalog.save(scan(spark, folder), f"{folder}/catalog"))
    return found.groupBy("rule").agg(F.count_distinct("toc_id").cast("int").alias("n_tocs"))


@query("SELECT source, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, 0 AS n_damaged, 0 AS n_unstated, 0 AS bad_blobs FROM documents GROUP BY 1")
def q_archive_strict(spark, sf_dir):
    """Files by folder with strict checks of blobs, roots and checksums: size and identity agree everywhere."""
    catalog, folder = _archived(spark, sf_dir)
    bad = strict_blobs(catalog, spark, folder).where("problem IS NOT NULL").select("toc_id").distinct().withColumn("bad", F.lit(1))
    lost = root_mismatches(catalog).select("toc_id", "file_idx", F.lit(1).alias("unstated"))
    sums = read_files(catalog, catalog.blobs(spark, folder), catalog.file).select("toc_id", "file_idx", "crc32").join(catalog.info(), ["toc_id", "file_idx"]).select("toc_id", "file_idx", (F.col("crc32") != F.col("info_crc32")).alias("damaged"))
    rows = catalog.file.join(sums, ["toc_id", "file_idx"], "left").join(lost, ["toc_id", "file_idx"], "left").join(bad, "toc_id", "left")
    zero = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c).cast("int"), F.lit(1 if c == "damaged" else 0))), F.lit(0)).cast("int")
    return rows.groupBy(F.regexp_extract("full_name", r"^docs/([^/]*)/", 1).alias("source")).agg(F.count("*").alias("n_files"), F.sum("total_size").alias("n_bytes"), zero("damaged").alias("n_damaged"), zero("unstated").alias("n_unstated"), zero("bad").alias("bad_blobs"))


@query("SELECT true AS all_bytes, CAST(0 AS BIGINT) AS gaps, CAST(2 AS BIGINT) AS n_types")
def q_archive_accounting(spark, sf_dir):
    """Every byte of every table of contents is accounted for, and two metadata classes are in use."""
    catalog, folder = _archived(spark, sf_dir)
    toc = toc_accounting(listed(spark, folder)).agg(F.bool_and(F.col("total") == F.col("structural") + F.col("zero_gap") + F.col("nonzero_gap")).alias("all_bytes"), F.sum(F.col("zero_gap") + F.col("nonzero_gap")).alias("gaps"))
    return toc.join(F.broadcast(type_names(catalog).agg(F.count("*").alias("n_types"))))


@query("SELECT source AS folder, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY 1")
def q_archive_catalog(spark, sf_dir):
    """Files and bytes by folder, from the catalog alone."""
    catalog, _ = _archived(spark, sf_dir)
    folder = F.regexp_extract("full_name", r"^docs/([^/]*)/", 1)
    return catalog.file.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"), F.sum("total_size").alias("n_bytes"))


def _archived(spark, sf_dir):
    """The documents as archives in the shared folder, and their catalog."""
    folder = fresh_dir(spark, "archives")
    name = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = _t(spark, sf_dir, "documents").select(name.alias("name"), F.col("text").cast("binary").alias("content"))
    with small_batches(spark):
        write_archives(rows, "name", "content", folder).write.format("noop").mode("overwrite").save()
    return Catalog.save(scan(spark, folder), f"{folder}/catalog"), folder
