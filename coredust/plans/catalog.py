"""The queries over the driver's tables and their equivalents in SQL.

Each query applies one of the package's helpers to generic tables, so that what runs on extracted kernel objects can be
compared row by row with an independent formulation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..functions import scalars
from ..operators import filters, relational, scan, timeline

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, folder))

        _queries[f.__name__] = run
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- cross-views, differences and comparisons ---------------------------------------------------------------------

CROSSVIEW = """
SELECT p_partkey, bool_or(src = 1) AS listed, bool_or(src = 2) AS scanned, bool_or(src = 3) AS branded FROM (
  SELECT DISTINCT l_partkey AS p_partkey, 1 AS src FROM lineitem WHERE l_quantity > 45
  UNION ALL SELECT p_partkey, 2 FROM part WHERE p_retailprice < 950
  UNION ALL SELECT p_partkey, 3 FROM part WHERE p_brand = 'Brand#1') GROUP BY p_partkey"""


@query(CROSSVIEW)
def crossview_presence(t):
    listed = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return relational.crossview({"listed": listed, "scanned": t.part.filter("p_retailprice < 950"), "branded": t.part.filter("p_brand = 'Brand#1'")}, "p_partkey")


@query("SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def list_minus_scan(t):
    found = t.lineitem.filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return relational.listed_not_found(t.part.select("p_partkey", "p_name"), found, "p_partkey")


_RUNS = "a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'O')"


def _two(t):
    cols = ["l_orderkey", "l_linenumber", "l_quantity"]
    return t.lineitem.filter("l_linestatus = 'F'").select(*cols), t.lineitem.filter("l_linestatus = 'O'").select(*cols)


@query(f"WITH {_RUNS} SELECT * FROM a WHERE l_orderkey NOT IN (SELECT l_orderkey FROM b)")
def compare_only(t):
    return relational.compare(*_two(t), ["l_orderkey"], "only")


@query(f"WITH {_RUNS} SELECT * FROM a WHERE l_orderkey IN (SELECT l_orderkey FROM b)")
def compare_common(t):
    return relational.compare(*_two(t), ["l_orderkey"], "common")


@query(f"WITH {_RUNS} SELECT a.*, l_orderkey NOT IN (SELECT l_orderkey FROM b) AS is_new FROM a")
def compare_mark(t):
    return relational.compare(*_two(t), ["l_orderkey"], "mark")


# --- address lookups ----------------------------------------------------------------------------------------------

BANDS = "bands AS (SELECT p_partkey AS band, p_retailprice * 400 - 360000 + 20000 AS lo, p_retailprice * 400 - 360000 + 20000 + p_size * 100 AS hi FROM part)"


def _bands(t):
    base = F.col("p_retailprice") * 400 - 360000 + 20000
    return t.part.select(F.col("p_partkey").alias("band"), base.alias("lo"), (base + F.col("p_size") * 100).alias("hi"))


@query(f"WITH {BANDS} SELECT o_orderkey, o_totalprice, (SELECT min(band) FROM bands WHERE o_totalprice >= lo AND o_totalprice < hi) AS band FROM orders")
def module_lookup_first(t):
    return relational.lookup_first(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", _bands(t), "lo", "hi", "band", "band", 2500)


@query(f"WITH {BANDS} SELECT o_orderkey, o_totalprice, band, lo, hi FROM orders JOIN bands ON o_totalprice BETWEEN lo AND hi")
def module_lookup_all(t):
    return relational.lookup_all(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", _bands(t), "lo", "hi", 2500)


@query(f"WITH {BANDS} SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM bands WHERE o_totalprice >= lo AND o_totalprice < hi)")
def orphan_range(t):
    return relational.outside_ranges(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", _bands(t), "lo", "hi", 2500)


@query("""
SELECT e.event_id, e.user_id, e.ts, m.event_id AS last_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') m ON e.user_id = m.user_id AND e.ts >= m.ts""")
def symbol_asof(t):
    e = t.events
    points = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return relational.last_before(points, e.filter("event_type = 'view'"), "user_id", "ts", "event_id")


@query("""
SELECT o.o_orderkey, n.p_partkey, n.p_name FROM orders o JOIN part n ON o.o_orderkey BETWEEN n.p_partkey AND n.p_partkey + n.p_size % 4""")
def symbols_at(t):
    p = t.part.select("p_partkey", "p_name", F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size") % 4).alias("hi"))
    return relational.lookup_all(t.orders.select("o_orderkey"), "o_orderkey", p, "lo", "hi", 4).select("o_orderkey", "p_partkey", "p_name")


# --- groups, runs, offsets ----------------------------------------------------------------------------------------


@query("""
SELECT o_custkey, o_orderpriority, count(*) AS n_members, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS members
FROM orders GROUP BY 1, 2 HAVING count(*) >= 4""")
def shared_key_groups(t):
    return relational.shared_groups(t.orders, ["o_custkey", "o_orderpriority"], "o_orderkey", 4)


@query("""
SELECT * FROM (SELECT *, max(n_rows) OVER (PARTITION BY p_type) AS top_rows FROM (SELECT p_type, p_name, count(*) AS n_rows FROM part GROUP BY 1, 2)) WHERE n_rows < top_rows""")
def minority_impl(t):
    return relational.minority(t.part, "p_type", "p_name")


@query("""
WITH d AS (SELECT DISTINCT user_id, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS h FROM events),
g AS (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS k FROM d)
SELECT user_id, min(h) AS run_start, max(h) + 1 AS run_end, count(*) AS n_parts FROM g GROUP BY user_id, k""")
def run_coalesce(t):
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3_600_000_000)
    return relational.runs(t.events.select("user_id", hour.alias("h")).distinct(), ["user_id"], "h")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS file_offset FROM lineitem""")
def running_offset(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]
    return relational.running_offset(t.lineitem, ["l_orderkey"], order, "l_quantity").select(*cols, "file_offset")


@query("""
SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pass, ts, event_id) AS n FROM (
  SELECT 1 AS pass, user_id, event_id, ts FROM events WHERE event_type = 'error' UNION ALL SELECT 0, user_id, event_id, ts FROM events WHERE event_type = 'signup')) WHERE n = 1""")
def dedupe_first(t):
    cols = ["user_id", "event_id", "ts"]
    forward = t.events.filter("event_type = 'signup'").select(F.lit(0).alias("pass"), *cols)
    backward = t.events.filter("event_type = 'error'").select(F.lit(1).alias("pass"), *cols)
    return relational.first_seen(forward.unionByName(backward), "user_id", ["pass", "ts", "event_id"]).drop("pass")


# --- trees and chains ---------------------------------------------------------------------------------------------

TREE = """
RECURSIVE tr AS (
  SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS depth, printf('%016X', o_orderkey) AS path FROM orders WHERE o_orderkey = 0
  UNION ALL SELECT o.o_orderkey, t.depth + 1, t.path || '/' || printf('%016X', o.o_orderkey) FROM orders o JOIN tr t ON o.o_orderkey // 2 = t.id AND o.o_orderkey > 0)"""


def _tree(t):
    nodes = t.orders.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("up"))
    return relational.tree_paths(nodes, "id", "up")


@query(f"WITH {TREE} SELECT id, depth, path FROM tr")
def process_tree(t):
    return _tree(t)


FORESTS = """
RECURSIVE e AS (
  SELECT 'a' AS image, o_orderkey AS id, o_orderkey // 2 AS up FROM orders UNION ALL SELECT 'b', -o_orderkey, -(o_orderkey // 3) FROM orders
  UNION ALL SELECT 'c', o_custkey, CASE WHEN o_custkey % 10 = 1 THEN NULL ELSE o_custkey - 1 END FROM (SELECT DISTINCT o_custkey FROM orders)),
tr AS (
  SELECT image, id, CAST(0 AS BIGINT) AS depth, printf('%016X', id) AS path FROM e WHERE up IS NULL OR up = id OR NOT EXISTS (SELECT 1 FROM e AS x WHERE x.image = e.image AND x.id = e.up)
  UNION ALL SELECT e.image, e.id, t.depth + 1, t.path || '/' || printf('%016X', e.id) FROM e JOIN tr t ON e.image = t.image AND e.up = t.id AND e.up <> e.id)"""


@query(f"WITH {FORESTS} SELECT image, id, depth, path FROM tr")
def process_forests(t):
    """Trees of three images side by side, one with ids that are negative as a kernel's addresses are."""
    o = t.orders
    a = o.select(F.lit("a").alias("image"), F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("up"))
    b = o.select(F.lit("b").alias("image"), (-F.col("o_orderkey")).alias("id"), (-F.floor(F.col("o_orderkey") / 3)).cast("long").alias("up"))
    c = o.select("o_custkey").distinct().select(F.lit("c").alias("image"), F.col("o_custkey").alias("id"), F.when(F.col("o_custkey") % 10 != 1, F.col("o_custkey") - 1).alias("up"))
    return relational.tree_paths(a.unionByName(b).unionByName(c), "id", "up", ["image"])


@query(f"WITH {TREE} SELECT depth, count(*) AS n_rows, max(path) AS last_path FROM tr GROUP BY depth")
def tree_depth_path(t):
    return _tree(t).groupBy("depth").agg(F.count(F.lit(1)).alias("n_rows"), F.max("path").alias("last_path"))


@query(f"""
WITH {TREE}, hit AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 495000),
up AS (SELECT DISTINCT CAST('0x' || x AS BIGINT) AS id FROM (SELECT unnest(string_split(path, '/')) AS x FROM tr JOIN hit USING (id)))
SELECT tr.id, depth, tr.id NOT IN (SELECT id FROM hit) AS is_context FROM tr JOIN up ON tr.id = up.id""")
def tree_filter_context(t):
    return relational.with_ancestors(_tree(t), "id", t.orders.filter("o_totalprice > 495000").select(F.col("o_orderkey").alias("id")))


@query("""
SELECT event_id, first_value(event_id) OVER w AS head, CAST(row_number() OVER w - 1 AS BIGINT) AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def list_walk(t):
    from pyspark.sql import Window

    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return relational.chain_positions(t.events.select("event_id", after.alias("next_id")), "event_id", "next_id")


@query("""
WITH RECURSIVE w AS (SELECT c_custkey AS id, c_custkey AS root, CAST(0 AS BIGINT) AS hops FROM customer WHERE c_nationkey = 3
  UNION ALL SELECT c.c_custkey, w.root, w.hops + 1 FROM w JOIN customer c ON c.c_custkey = w.id * 2 + 1)
SELECT root, max(hops) AS n_hops, count(*) AS n_nodes FROM w GROUP BY root""")
def recursive_walk(t):
    t.customer.createOrReplaceTempView("coredust_customer")
    return t.spark.sql("""
      WITH RECURSIVE w(id, root, hops) MAX RECURSION LEVEL 200 AS (SELECT c_custkey, c_custkey, 0L FROM coredust_customer WHERE c_nationkey = 3
        UNION ALL SELECT c.c_custkey, w.root, w.hops + 1 FROM w JOIN coredust_customer c ON c.c_custkey = w.id * 2 + 1)
      SELECT root, max(hops) AS n_hops, count(*) AS n_nodes FROM w GROUP BY root""")


# --- fixed tables, bits and bytes ---------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, slot, n_nationkey * 28 + slot AS handler FROM nation, (SELECT unnest(range(28)) AS slot)")
def slot_explode(t):
    return relational.slots(t.nation.select("n_nationkey", "n_name"), 28).withColumn("handler", F.col("n_nationkey") * 28 + F.col("slot"))


FLAGS = ("READ", "WRITE", "EXEC", "SHARED", "GUARD", "NOCACHE")


@query("SELECT p_partkey, p_size, array_to_string(list_filter([" + ", ".join(f"CASE WHEN (p_size >> {i}) & 1 = 1 THEN '{n}' END" for i, n in enumerate(FLAGS)) + "], lambda x: x IS NOT NULL), '|') AS flags FROM part")
def flags_decode(t):
    return t.part.select("p_partkey", "p_size", relational.flag_names(F.col("p_size"), FLAGS).alias("flags"))


@query("SELECT c_custkey, c_custkey AS id, -c_custkey * 7919 AS addr, CAST(c_nationkey AS BIGINT) AS kind, c_mktsegment AS name FROM customer")
def struct_decode_le(t):
    blob = scalars.pack([("u4", F.col("c_custkey")), ("i8", -F.col("c_custkey") * 7919), ("u2", F.col("c_nationkey")), ("s16", F.col("c_mktsegment"))])
    d = t.customer.select("c_custkey", blob.alias("raw"))
    return d.select("c_custkey", scalars.uint(F.col("raw"), 0, 4).alias("id"), scalars.sint(F.col("raw"), 4, 8).alias("addr"), scalars.uint(F.col("raw"), 12, 2).alias("kind"), scalars.cstring(F.col("raw"), 14, 16).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 250000 THEN 'unreadable' WHEN o_orderstatus = 'P' THEN 'not_available' END AS reason FROM orders")
def absent_reasons(t):
    price, reasons = scalars.absent(F.col("o_totalprice"), [(scalars.UNREADABLE, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000)), (scalars.NOT_AVAILABLE, F.col("o_orderstatus") == "P")])
    return t.orders.select("o_orderkey", price.alias("price"), reasons.alias("reason"))


@query("""
WITH p AS (SELECT doc_id, rn, unnest(string_split(text, 'ation')) AS part, generate_subscripts(string_split(text, 'ation'), 1) AS i, len(string_split(text, 'ation')) AS n FROM (SELECT *, row_number() OVER () AS rn FROM documents))
SELECT doc_id, 'passage' AS pattern, hit_offset FROM (
  SELECT doc_id, i, n, CAST(sum(strlen(part) + 5) OVER (PARTITION BY rn ORDER BY i) - 5 AS BIGINT) AS hit_offset FROM p) WHERE i < n""")
def chunk_scan_literal(t):
    """Byte offsets in all texts. The literal cannot overlap itself, so splitting by it finds the same places."""
    return scan.scan(scan.chunked(t.documents, "doc_id", "text", 1024, 16), "doc_id", {"passage": b"ation"}, 1024)


@query(r"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_hits, CAST(sum(length(w)) AS BIGINT) AS hit_chars FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS w FROM documents) GROUP BY doc_id""")
def chunk_scan_regex(t):
    """A word of any length that the data holds: matches go on from chunk to chunk, up to the overlap."""
    chunks = scan.chunked(t.documents, "doc_id", "text", 1 << 14, 1 << 14)
    hits = scan.regex_scan(chunks, ["doc_id"], {"word": rb"[A-Z][a-z]+"}, 1 << 14, 1 << 14)
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("hit_bytes").cast("long").alias("hit_chars"))


_COUNTS = ", ".join(f"CAST((strlen(text) - strlen(replace(text, '{s}', ''))) // {len(s)} AS BIGINT) AS n_{n}" for n, s in (("a", "http"), ("b", "ing "), ("c", " | ")))


@query(f"SELECT * FROM (SELECT doc_id, {_COUNTS} FROM documents) WHERE CAST(n_a > 0 AS INT) + CAST(n_b > 0 AS INT) + CAST(n_c > 0 AS INT) >= 2")
def rule_scan(t):
    return scan.rule(t.documents, "text", {"a": "http", "b": "ing ", "c": " | "}, 2).select("doc_id", "n_a", "n_b", "n_c")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def strings_owner(t):
    b = t.benchmark.select("item_id", F.col("text").alias("passage"))
    return scan.owners(b, "passage", t.documents.select("doc_id", "text"), "text", "doc_id").select("item_id", "doc_id")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '/([a-z][a-z])/', 1) AS lang, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages")
def banner_extract(t):
    e = lambda p: F.regexp_extract("url", p, 1)
    return t.pages.select("page_id", e("^https?://([^/?#]+)").alias("host"), e("/([a-z][a-z])/").alias("lang"), e("/([0-9]+)").cast("long").alias("number"))


@query("SELECT event_id, 'k' AS env_key, CAST(json_extract(props, '$.k') AS VARCHAR) AS env_value FROM events")
def env_explode(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("env_key", "env_value"))


@query("SELECT event_id, string_split(event_type || '=' || user_id, '=')[1] AS name, string_split(event_type || '=' || user_id, '=')[2] AS value FROM events")
def kv_split(t):
    kv = F.split(F.concat_ws("=", "event_type", F.col("user_id").cast("string")), "=")
    return t.events.select("event_id", kv[0].alias("name"), kv[1].alias("value"))


@query(r"""
SELECT page_id, last_part, page_lang, last_part <> '' AND NOT contains(page_lang, 'en') AS is_odd FROM (
  SELECT page_id, list_extract(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', ''), '/'), -1) AS last_part, regexp_extract(html, 'lang="([a-z]+)"', 1) AS page_lang FROM pages)""")
def basename_spoof(t):
    clean = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    d = t.pages.select("page_id", scalars.basename(clean).alias("last_part"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("page_lang"))
    return d.withColumn("is_odd", (F.col("last_part") != "") & ~F.contains(F.col("page_lang"), F.lit("en")))


@query("SELECT s_suppkey, 'S-1-5-80-' || " + " || '-' || ".join(f"CAST(CAST('0x' || substr(h, {8 * i + 7}, 2) || substr(h, {8 * i + 5}, 2) || substr(h, {8 * i + 3}, 2) || substr(h, {8 * i + 1}, 2) AS BIGINT) AS VARCHAR)" for i in range(5)) + " AS sid FROM (SELECT s_suppkey, sha1(upper(s_name)) AS h FROM supplier)")
def service_sid(t):
    return t.supplier.select("s_suppkey", scalars.service_sid(F.upper("s_name").cast("binary")).alias("sid"))


@query("SELECT doc_id, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def digest_md5(t):
    return t.documents.select("doc_id", F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("n_bytes"))


# --- filters and views --------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(p_name, 'widget') OR contains(p_brand, 'Brand#1')")
def filter_or(t):
    return filters.cli_filter(t.part.select("p_partkey", "p_name", "p_brand"), ["+name,widget", "brand,Brand#1"])


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(p_name, '^(small|red) [a-r]')")
def filter_regex(t):
    return filters.cli_filter(t.part.select("p_partkey", "p_name", "p_brand"), ["+P_NAME,^(small|red) [a-r]!"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT contains(o_orderpriority, 'LOW')")
def filter_exclude(t):
    return filters.cli_filter(t.orders.select("o_orderkey", "o_orderpriority"), ["-priority,LOW"])


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(CAST(p_partkey AS VARCHAR), '77') OR contains(p_name, '77') OR contains(p_type, '77')")
def filter_anycol(t):
    return filters.cli_filter(t.part.select("p_partkey", "p_name", "p_type"), ["77"])


@query("SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), 'ring') AND p_size >= 30 AND NOT contains(lower(p_type), 'eco')")
def view_filter_and(t):
    return filters.view_filter(t.part, {"p_name": "RING", "p_size": ">=30", "p_type": "!eco"}).select("p_partkey", "p_name", "p_size")


@query("SELECT event_id, value FROM events WHERE value < 12.5")
def view_cmp_num(t):
    return filters.view_filter(t.events, {"value": "< 12.5"}).select("event_id", "value")


@query("SELECT event_id, event_type FROM events WHERE lower(event_type) = 'error'")
def view_exact_ci(t):
    return filters.view_filter(t.events, {"event_type": "=ERROR"}).select("event_id", "event_type")


@query("SELECT event_id, last_value FROM (SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_value FROM events) WHERE last_value IS NULL")
def view_absent(t):
    from pyspark.sql import Window

    d = t.events.select("event_id", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("last_value"))
    return filters.view_filter(d, {"last_value": "-"})


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'nd#2') OR contains(lower(p_brand), 'nd#2')")
def view_text_search(t):
    return filters.text_search(t.part.select("p_partkey", "p_name", "p_brand"), "ND#2", ["p_name", "p_brand"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'")
def view_time_range(t):
    return filters.time_range(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate"], "1997-01-01 00:00:00", "1997-03-31 00:00:00")


_SORTED = "SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY lower(o_orderpriority), o_totalprice DESC, o_orderkey) AS row_no FROM orders"


@query(f"SELECT * FROM ({_SORTED}) WHERE row_no <= 100")
def view_sort_topk(t):
    return filters.top_rows(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), [("o_orderpriority", False), ("o_totalprice", True)], "o_orderkey", 0, 100)


@query(f"SELECT * FROM ({_SORTED}) WHERE row_no > 200 AND row_no <= 250")
def view_page(t):
    return filters.top_rows(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), [("o_orderpriority", False), ("o_totalprice", True)], "o_orderkey", 200, 50)


# --- timelines ----------------------------------------------------------------------------------------------------

MERGED = """
merged AS (
  SELECT 'orders' AS plugin, 'Order ' || o_orderkey AS description, 'Created' AS kind, o_orderdate AS time FROM orders
  UNION ALL SELECT 'lineitem', 'Order ' || l_orderkey, 'Modified', l_shipdate FROM lineitem
  UNION ALL SELECT 'events', 'User ' || user_id, CASE WHEN event_type = 'view' THEN 'Accessed' ELSE 'Changed' END, ts FROM events)"""
PIVOTED = "pivoted AS (SELECT plugin, description, " + ", ".join(f"min(time) FILTER (kind = '{k}') AS {k.lower()}_date" for k in timeline.KINDS) + " FROM merged GROUP BY 1, 2)"


def _merged(t):
    part = lambda df, name, text, kind, time: df.select(F.lit(name).alias("plugin"), text.alias("description"), kind.alias("kind"), F.col(time).alias("time"))
    label = lambda word, c: F.concat_ws(" ", F.lit(word), F.col(c).cast("string"))
    return timeline.merge([
        part(t.orders, "orders", label("Order", "o_orderkey"), F.lit("Created"), "o_orderdate"), part(t.lineitem, "lineitem", label("Order", "l_orderkey"), F.lit("Modified"), "l_shipdate"),
        part(t.events, "events", label("User", "user_id"), F.when(F.col("event_type") == "view", "Accessed").otherwise("Changed"), "ts"),
    ])


@query(f"WITH {MERGED}, {PIVOTED} SELECT * FROM pivoted")
def timeline_merge(t):
    return timeline.pivoted(_merged(t))


_SEC = lambda c: f"CAST(coalesce(CAST(floor(epoch({c})) AS BIGINT), 0) AS VARCHAR)"


@query(f"WITH {MERGED}, {PIVOTED} SELECT '0|' || plugin || ' - ' || description || '|0|0|0|0|0|' || {_SEC('accessed_date')} || '|' || {_SEC('modified_date')} || '|' || {_SEC('changed_date')} || '|' || {_SEC('created_date')} AS line FROM pivoted")
def timeline_body(t):
    d = timeline.pivoted(_merged(t))
    return d.select(timeline.body_line(d).alias("line"))


@query("SELECT CAST(least(floor((value - 0.0) * 50 / (500.0 - 0.0)), 49) AS BIGINT) AS bin, count(*) AS n_rows FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
def timeline_hist(t):
    return timeline.histogram(t.events, F.col("value"), 0.0, 500.0, 50)


@query("SELECT event_type, CAST(least(floor((value - 0.0) * 50 / (500.0 - 0.0)), 49) AS BIGINT) AS bin, count(*) AS n_rows FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1, 2")
def timeline_hist_stacked(t):
    return timeline.histogram(t.events, F.col("value"), 0.0, 500.0, 50, ["event_type"])


@query("""
WITH c AS (SELECT event_type, count(*) AS n_rows FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, event_type) AS k FROM c)
SELECT CASE WHEN k <= 2 THEN event_type ELSE 'other' END AS event_type, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM r GROUP BY 1""")
def hist_top_other(t):
    return timeline.top_and_other(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows")), "event_type", "n_rows", 2)


@query("""
WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
q AS (SELECT min(value) AS a, max(value) AS z, min(value) FILTER (i = CAST(floor((n - 1) * 0.005) AS BIGINT)) AS l, min(value) FILTER (i = CAST(floor((n - 1) * 0.995) AS BIGINT)) AS h FROM s)
SELECT CASE WHEN h - l < (z - a) * 0.2 THEN l ELSE a END AS lo, CASE WHEN h - l < (z - a) * 0.2 THEN h ELSE z END AS hi, h - l < (z - a) * 0.2 AS focused FROM q""")
def hist_focus(t):
    return timeline.focus(t.events, "value")


# --- rules and statistics -----------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type, value, lag(event_type) OVER w AS parent_type, date_diff('microsecond', lag(ts) OVER w, ts) AS age_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, 'error after purchase' AS title, 'high' AS severity FROM e WHERE event_type = 'error' AND parent_type = 'purchase'
UNION ALL SELECT event_id, 'quick repeat', 'low' FROM e WHERE event_type = parent_type AND age_us < 3600000000
UNION ALL SELECT event_id, 'large value', 'medium' FROM e WHERE value > 200""")
def triage_rules(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = t.events.withColumn("parent_type", F.lag("event_type").over(w)).withColumn("age_us", us("ts") - F.lag(us("ts")).over(w))
    return scalars.triage(e, [
        ("error after purchase", "high", (F.col("event_type") == "error") & (F.col("parent_type") == "purchase")),
        ("quick repeat", "low", (F.col("event_type") == F.col("parent_type")) & (F.col("age_us") < 3_600_000_000)),
        ("large value", "medium", F.col("value") > 200),
    ]).select("event_id", "title", "severity")


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (l_returnflag = 'A') AS valid_pages, count(*) FILTER (l_returnflag = 'R') AS swapped_pages,
       count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS large_pages, count(DISTINCT l_suppkey) AS n_frames FROM lineitem""")
def page_stats(t):
    r, s = F.col("l_returnflag"), F.col("l_linestatus")
    return t.lineitem.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(r == "A").alias("valid_pages"), F.count_if(r == "R").alias("swapped_pages"), F.count_if((r == "N") & (s == "O")).alias("large_pages"), F.countDistinct("l_suppkey").alias("n_frames"))


@query("SELECT r_regionkey, r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS children, count(*) AS n_children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def json_children(t):
    kids = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("k"), F.count(F.lit(1)).alias("n_children"))
    d = t.region.join(kids, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select("r_regionkey", "r_name", F.array_join("k.n_name", ",").alias("children"), "n_children")


from . import families  # noqa: E402, F401  (it registers more queries)
