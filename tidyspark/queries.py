"""Queries over the driver's tables, each with its SQL twin where SQL can tell it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .functions.digests import digest
from .operators import directories, lint, rank, records, relations, sieve, tree
from .operators.stage import once
from .plans import parsing, pipeline, query_language, requery
from .plans.config import Config
from .sinks import formats, scripts
from .sources.results import with_cached

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: source/lang/doc_id, the first two sources tagged."""
    return records.as_records(_table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", "doc_id"), F.col("text"), is_tagged=F.col("source").isin("src0", "src1"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have a text; a null or empty one is none."""
    return documents(spark, sf_dir).filter("size >= 1")


_DOC = "SELECT *, concat_ws('/', source, lang, doc_id) AS path, strlen(text) AS size, source IN ('src0', 'src1') AS tagged, lower(CAST(doc_id AS VARCHAR)) AS base FROM documents WHERE strlen(text) >= 1"
_RANK = "row_number() OVER (PARTITION BY text ORDER BY NOT tagged, base, path)"
_NAMED = Config(rank="a")


def _group(cfg: Config = _NAMED) -> list[str]:
    return sieve.group_keys(cfg)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("path", "size", "checksum", "rank_in_group", "twins", "is_original")


def _members_sql(original: str = "rk = 1", keep: str = "true", having: str = "true") -> str:
    return f"""WITH d AS ({_DOC}), m AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS twins,
        max(CAST(tagged AS INT)) OVER (PARTITION BY text) AS any_tagged, min(CAST(tagged AS INT)) OVER (PARTITION BY text) AS all_tagged FROM d),
        o AS (SELECT *, {original} AS orig FROM m WHERE twins > 1 AND {having}),
        p AS (SELECT *, min(CAST(orig AS INT)) OVER (PARTITION BY text) AS all_orig FROM o)
        SELECT path, size, sha256(text) AS checksum, rk AS rank_in_group, twins, orig AS is_original FROM p WHERE all_orig = 0 AND {keep}"""


@query(f"WITH d AS ({_DOC}) SELECT sha256(text) AS checksum, min(size) AS size, count(*) AS twins FROM d GROUP BY text HAVING count(*) > 1")
def dup_groups_documents(spark, sf_dir):
    return sieve.sieve(documents(spark, sf_dir), Config()).groupBy("checksum").agg(F.min("size").alias("size"), F.count("*").alias("twins"))


@query(_members_sql())
def dup_ranked_documents(spark, sf_dir):
    return _shown(sieve.duplicates(documents(spark, sf_dir), _NAMED))


@query(_members_sql("rk = 1 OR tagged", having="all_tagged = 0"))
def keep_all_tagged_documents(spark, sf_dir):
    return _shown(sieve.duplicates(documents(spark, sf_dir), Config(rank="a", keep_all_tagged=True)))


@query(_members_sql(having="any_tagged = 1"))
def must_match_tagged_documents(spark, sf_dir):
    return _shown(sieve.duplicates(documents(spark, sf_dir), Config(rank="a", must_match_tagged=True)))


@query(_members_sql(having="all_tagged = 0").replace("ORDER BY NOT tagged", "ORDER BY tagged"))
def must_match_untagged_documents(spark, sf_dir):
    return _shown(sieve.duplicates(documents(spark, sf_dir), Config(rank="a", must_match_untagged=True)))


@query(_members_sql("rk = 1 OR NOT tagged", having="any_tagged = 1").replace("ORDER BY NOT tagged", "ORDER BY tagged"))
def keep_all_untagged_documents(spark, sf_dir):
    return _shown(sieve.duplicates(documents(spark, sf_dir), Config(rank="a", keep_all_untagged=True)))


@query(_members_sql())
def paranoid_documents(spark, sf_dir):
    return _shown(sieve.duplicates(documents(spark, sf_dir), Config(rank="a", algorithm="paranoid")))


@query(f"""WITH d AS ({_DOC}), t AS (SELECT path, size, encode(text) AS raw FROM d),
        l1 AS (SELECT *, sha256(array_slice(raw, 1, 16384)) AS link1 FROM t),
        l2 AS (SELECT *, CASE WHEN size > 16384 THEN sha256(encode(link1) || array_slice(raw, 16385, 1048576)) ELSE link1 END AS link2 FROM l1),
        l3 AS (SELECT *, CASE WHEN size > 1048576 THEN sha256(encode(link2) || array_slice(raw, 1048577, 67108864)) ELSE link2 END AS link3 FROM l2),
        l4 AS (SELECT *, CASE WHEN size > 67108864 THEN sha256(encode(link3) || array_slice(raw, 67108865, size)) ELSE link3 END AS checksum FROM l3)
        SELECT path, size, checksum FROM (SELECT *, count(*) OVER (PARTITION BY size, checksum) AS n FROM l4) WHERE n > 1""")
def chained_documents(spark, sf_dir):
    return sieve.sieve(documents(spark, sf_dir), Config(algorithm="sha256-chain")).select("path", "size", "checksum")


@query(_members_sql())
def prefix_sieve_documents(spark, sf_dir):
    return _shown(sieve.duplicates(documents(spark, sf_dir), Config(rank="a", prefix_bytes=64)))


@query(f"""WITH d AS ({_DOC}), s AS (SELECT *, least(size, 80) AS eff, substr(hex(encode(text)), 33, 2 * (least(size, 80) - 16)) AS part FROM d WHERE size > 16)
SELECT path, eff AS eff_size, sha256(unhex(part)) AS checksum FROM (SELECT *, count(*) OVER (PARTITION BY eff, part) AS n FROM s) WHERE n > 1""")
def clamped_dups_documents(spark, sf_dir):
    cfg = Config(clamp_low=parsing.clamp("16"), clamp_high=parsing.clamp("80"))
    return sieve.sieve(documents(spark, sf_dir), cfg).select("path", "eff_size", "checksum")


@query(f"WITH d AS ({_DOC}) SELECT path, size FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM d) WHERE n = 1")
def unique_documents(spark, sf_dir):
    return sieve.uniques(texts(spark, sf_dir), Config()).select("path", "size")


@query(f"WITH d AS ({_DOC}) SELECT path, size FROM (SELECT *, count(*) OVER (PARTITION BY size) AS n FROM d) WHERE n > 1")
def size_prune_documents(spark, sf_dir):
    cfg = Config()
    return sieve.qualified(sieve.prepared(documents(spark, sf_dir), cfg), cfg, sieve.size_keys(cfg)).select("path", "size")


@query(f"WITH d AS ({_DOC}) SELECT path, size FROM d WHERE size BETWEEN 1024 AND 3000")
def size_range_documents(spark, sf_dir):
    return records.selected(documents(spark, sf_dir), Config(size=parsing.size_range("1kb-3k"))).select("path", "size")


def _digest_query(algorithm: str, sql: str | None = None) -> None:
    def run(spark, sf_dir):
        return relations.hash_list(documents(spark, sf_dir), algorithm)

    run.__name__ = f"digest_{algorithm.replace('-', '_')}_documents"
    query(f"SELECT concat_ws('/', source, lang, doc_id) AS path, {sql or algorithm}(text) AS checksum FROM documents" if sql != "" else None)(run)


for _name in ("md5", "sha1", "sha256"):
    _digest_query(_name)
for _name in ("sha384", "sha512", "sha3-256", "sha3-512", "blake2b", "blake2s", "xxhash", "cumulative"):
    _digest_query(_name, "")


@query("SELECT concat_ws('/', source, lang, doc_id) AS path, i AS block, sha256(unhex(substr(hex(encode(text)), 1 + 2048 * i, 2048))) AS checksum FROM documents, unnest(range(0, greatest(1, (strlen(text) + 1023) // 1024))) AS t(i)")
def block_digests_documents(spark, sf_dir):
    out = relations.block_digests(documents(spark, sf_dir), 1024)
    return out.select("path", F.col("block").cast("long").alias("block"), "checksum")


# Names.  Parts as records: p_partkey/p_name, the blanks of the name as dots; the content is the brand.


_PART = "SELECT *, replace(p_name, ' ', '.') AS name, concat_ws('/', p_partkey, replace(p_name, ' ', '.')) AS path, p_brand AS content FROM part"


def _name_sql(key: str, content: str = "content") -> str:
    return f"WITH d AS ({_PART}) SELECT path, n AS twins FROM (SELECT *, count(*) OVER (PARTITION BY {content}, {key}) AS n FROM d) WHERE n > 1"


def _name_query(spark, sf_dir, content: str = "p_brand", **how) -> DataFrame:
    cfg = Config(**how)
    found = records.as_records(_table(spark, sf_dir, "part"), F.concat_ws("/", F.col("p_partkey"), F.replace(F.col("p_name"), F.lit(" "), F.lit("."))), F.expr(content))
    return sieve.duplicates(found, cfg).select("path", "twins")


_BRAND_SIZE = "concat(p_brand, '-', p_size)"  # few parts share it, so that names make a difference


@query(_name_sql("lower(name)"))
def match_basename_parts(spark, sf_dir):
    return _name_query(spark, sf_dir, match_basename=True)


@query(_name_sql("CASE WHEN contains(name, '.') THEN lower(list_last(string_split(name, '.'))) END", _BRAND_SIZE))
def match_extension_parts(spark, sf_dir):
    return _name_query(spark, sf_dir, _BRAND_SIZE, match_extension=True)


@query(_name_sql("lower(CASE WHEN contains(name, '.') THEN regexp_replace(name, '[^.]*$', '') ELSE name END)", _BRAND_SIZE))
def match_stem_parts(spark, sf_dir):
    return _name_query(spark, sf_dir, _BRAND_SIZE, match_stem=True)


@query(f"""WITH d AS ({_PART}), h AS (SELECT *, first_value(path) OVER w AS head, lower(first_value(name) OVER w) AS head_name, count(*) OVER (PARTITION BY content) AS n FROM d WINDOW w AS (PARTITION BY content ORDER BY lower(name), path)),
k AS (SELECT * FROM h WHERE n > 1 AND (path = head OR lower(name) <> head_name))
SELECT path, twins FROM (SELECT path, count(*) OVER (PARTITION BY content) AS twins FROM k) WHERE twins > 1""")
def unmatched_basename_parts(spark, sf_dir):
    return _name_query(spark, sf_dir, differing_basename=True, rank="a")


# Times.  Events as records: the content is who did what.


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    return records.as_records(df, F.concat_ws("/", "user_id", "event_id"), F.concat_ws("|", "user_id", "event_type"), mtime=F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


_EVENT = "SELECT *, concat_ws('/', user_id, event_id) AS path, concat_ws('|', user_id, event_type) AS content, epoch_us(ts) / 1e6 AS mtime FROM events"


@query(f"""WITH d AS ({_EVENT}), g AS (SELECT *, CASE WHEN mtime - lag(mtime) OVER (PARTITION BY content ORDER BY mtime, path) > 86400.000001 THEN 1 ELSE 0 END AS cut FROM d),
i AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY content ORDER BY mtime, path) AS BIGINT) AS island FROM g)
SELECT path, island, n AS twins FROM (SELECT *, count(*) OVER (PARTITION BY content, island) AS n FROM i) WHERE n > 1""")
def mtime_window_events(spark, sf_dir):
    return sieve.duplicates(events(spark, sf_dir), Config(mtime_window=86400)).select("path", "island", "twins")


@query(f"""WITH d AS ({_EVENT})
SELECT path, n AS twins FROM (SELECT *, count(*) OVER w AS n, max(mtime) OVER w AS latest FROM d WINDOW w AS (PARTITION BY content)) WHERE n > 1 AND latest >= 1706486400""")
def newer_than_events(spark, sf_dir):
    """Half of the groups have a member of the last two days."""
    return sieve.duplicates(events(spark, sf_dir), Config(newer_than=parsing.stamp("2024-01-29T00:00:00+00:00"))).select("path", "twins")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def moving_mean_events(spark, sf_dir):
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select("event_id", F.round(C.moving_mean(F.col("value"), by_time, 5), 6).alias("mean"))


# Lint.


@query("SELECT o_orderkey, l_linenumber, CASE WHEN size = 0 THEN 'emptyfile' WHEN size >= 10 THEN 'duplicate_file' END AS type FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, CAST(floor(l_quantity * l_discount * 10) AS BIGINT) AS size FROM lineitem)")
def classified_lines(spark, sf_dir):
    sized = _table(spark, sf_dir, "lineitem").withColumn("size", F.floor(F.col("l_quantity") * F.col("l_discount") * 10))
    return lint.classified(sized, Config(size=(10, parsing.LONG_MAX))).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "type")


@query("SELECT concat('c/', c_custkey) AS path, 'emptydir' AS type FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def empty_dirs_customers(spark, sf_dir):
    dirs = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c/"), F.col("c_custkey")).alias("path"))
    files = _table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).select(F.concat_ws("/", F.lit("c"), F.col("o_custkey"), F.col("o_orderkey")).alias("path"))
    return lint.empty_dirs(dirs, files)


@query("SELECT o_orderkey, 'badlink' AS type FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def dangling_orders(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return lint.dangling(_table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey")), customers, "key").select("o_orderkey", "type")


@query("""SELECT type, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM (SELECT l_orderkey, CASE WHEN p_partkey IS NULL AND s_suppkey IS NULL THEN 'badugid' WHEN p_partkey IS NULL THEN 'baduid' WHEN s_suppkey IS NULL THEN 'badgid' END AS type
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size >= 10) ON p_partkey = l_partkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) ON s_suppkey = l_suppkey) GROUP BY type""")
def bad_ids_lineitem(spark, sf_dir):
    users = _table(spark, sf_dir, "part").filter("p_size >= 10").select(F.col("p_partkey").alias("uid"))
    groups = _table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("gid"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("uid"), F.col("l_suppkey").alias("gid"))
    return lint.bad_ids(lines, users, groups).groupBy("type").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


# Links.  Lines as records: the file is (order, part), so repeated pairs are hard links.


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem")
    path = F.concat_ws("/", F.lit("o"), "l_orderkey", F.concat_ws("_", "l_linenumber", "l_partkey", "l_suppkey"))
    inode = F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")
    return records.as_records(df, path, F.concat("l_returnflag", "l_linestatus"), inode=inode, parent_inode=F.col("l_orderkey"), path_index=F.col("l_linenumber"), link_count=F.lit(2), l_orderkey=F.col("l_orderkey"), l_suppkey=F.col("l_suppkey"))


_LINE = "SELECT *, concat_ws('/', 'o', l_orderkey, concat_ws('_', l_linenumber, l_partkey, l_suppkey)) AS path, concat(l_returnflag, l_linestatus) AS content, l_orderkey * 1000000 + l_partkey AS inode FROM lineitem"


@query(f"WITH d AS ({_LINE}) SELECT path, inode FROM (SELECT *, row_number() OVER (PARTITION BY inode ORDER BY l_linenumber, path) AS k FROM d) WHERE k = 1")
def hardlink_once_lines(spark, sf_dir):
    return records.one_per_inode(lines(spark, sf_dir), F.col("path_index")).select("path", "inode")


@query(f"""WITH d AS ({_LINE}), u AS (SELECT path, inode, l_orderkey, l_linenumber FROM d UNION ALL SELECT concat('again', substr(path, 2)), inode, l_orderkey, l_linenumber - 2 FROM d WHERE l_linenumber % 3 = 0)
SELECT path, inode FROM (SELECT *, row_number() OVER (PARTITION BY inode, l_orderkey, list_last(string_split(path, '/')) ORDER BY l_linenumber, path) AS k FROM u) WHERE k = 1""")
def path_doubles_lines(spark, sf_dir):
    """A third of the lines is reached by a second way."""
    once_more = lines(spark, sf_dir).filter("path_index % 3 = 0").withColumn("path", F.concat(F.lit("again"), F.expr("substr(path, 2)"))).withColumn("path_index", F.col("path_index") - 2)
    return records.without_path_doubles(lines(spark, sf_dir).unionByName(once_more), F.col("path_index")).select("path", "inode")


@query(f"WITH d AS ({_LINE}) SELECT path, 2 - count(*) OVER (PARTITION BY inode) AS outer_link_count FROM d")
def outer_links_lines(spark, sf_dir):
    return sieve.prepared(lines(spark, sf_dir), Config()).select("path", F.col("outer_link_count").cast("long").alias("outer_link_count"))


@query(f"""WITH d AS ({_LINE}) SELECT a.path AS a_path, b.path AS b_path, CASE WHEN a.path = b.path THEN 6 WHEN a.inode = b.inode THEN 8 ELSE 1 END AS link_code
FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.path < b.path""")
def link_relation_lines(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_orderkey", "l_suppkey", F.struct("path", "size", "dev", "inode", "parent_inode", "is_symlink").alias("r"))
    pairs = df.withColumnRenamed("r", "a").join(df.withColumnRenamed("r", "b"), ["l_orderkey", "l_suppkey"]).filter("a.path < b.path")
    return relations.link_relation(pairs).select(F.col("a.path").alias("a_path"), F.col("b.path").alias("b_path"), "link_code")


_FOOTER = """WITH d AS ({base}), m AS (SELECT *, count(*) OVER (PARTITION BY content) AS n, row_number() OVER (PARTITION BY content ORDER BY lower(list_last(string_split(path, '/'))), path) AS rk FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY inode, content ORDER BY rk) AS link, 2 - count(*) OVER (PARTITION BY inode) AS outside FROM m WHERE n > 1)
SELECT count(*) FILTER (rk > 1) AS duplicates, count(DISTINCT content) AS duplicate_sets, CAST(sum(strlen(content)) FILTER (rk = 1) AS BIGINT) AS original_bytes,
CAST(sum(strlen(content)) FILTER (rk > 1) AS BIGINT) AS duplicate_bytes, CAST(coalesce(sum(strlen(content)) FILTER (rk > 1 AND link = 1 AND outside <= 0), 0) AS BIGINT) AS total_lint_size FROM f"""


@query(_FOOTER.format(base=f"SELECT DISTINCT path, content, inode FROM ({_LINE})"))
def footer_metrics_lines(spark, sf_dir):
    single = lines(spark, sf_dir).dropDuplicates(["path"])
    return rank.totals(rank.mark_originals(sieve.sieve(single, _NAMED), _NAMED, _group()), _NAMED, _group())


# Directories.


def _orders(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).dropDuplicates(["path"])


@query(f"""WITH d AS (SELECT DISTINCT path, content, l_orderkey FROM ({_LINE})), s AS (SELECT l_orderkey, list_sort(list(content)) AS sig, count(*) AS n FROM d GROUP BY l_orderkey),
t AS (SELECT *, count(*) OVER (PARTITION BY sig) AS twins FROM s)
SELECT concat('o/', l_orderkey) AS dir, n AS n_children, twins FROM t WHERE twins > 1""")
def dup_dirs_orders(spark, sf_dir):
    files = _orders(spark, sf_dir)
    return directories.duplicate_dirs(files, sieve.sieve(files, _NAMED), _NAMED).select("dir", "n_children", "twins")


def _numbered_lines(spark, sf_dir) -> DataFrame:
    """Orders as directories, a file for each line number; every fifth order is tagged."""
    one = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("content"))
    return records.as_records(one, F.concat_ws("/", F.lit("o"), "l_orderkey", "l_linenumber"), F.col("content"), is_tagged=F.col("l_orderkey") % 5 == 0)


_NUMBERED = "SELECT l_orderkey, l_linenumber, min(concat(l_returnflag, l_linestatus)) AS content FROM lineitem GROUP BY ALL"


@query(f"""WITH s AS (SELECT l_orderkey, list_sort(list(concat(l_linenumber, '=', content))) AS sig, count(*) AS n FROM ({_NUMBERED}) GROUP BY l_orderkey),
t AS (SELECT *, count(*) OVER (PARTITION BY sig) AS twins FROM s)
SELECT concat('o/', l_orderkey) AS dir, n AS n_children, twins FROM t WHERE twins > 1""")
def dup_dirs_layout_orders(spark, sf_dir):
    files = _numbered_lines(spark, sf_dir)
    cfg = Config(rank="a", honour_layout=True)
    return directories.duplicate_dirs(files, sieve.sieve(files, cfg), cfg).select("dir", "n_children", "twins")


@query(f"""WITH s AS (SELECT l_orderkey, list_sort(list(content)) AS sig, count(*) * CAST(l_orderkey % 5 = 0 AS INT) AS tagged FROM ({_NUMBERED}) GROUP BY l_orderkey),
t AS (SELECT *, count(*) OVER w AS twins, row_number() OVER (PARTITION BY sig ORDER BY tagged DESC, CAST(l_orderkey AS VARCHAR)) AS rk, min(tagged) OVER w AS least FROM s WINDOW w AS (PARTITION BY sig))
SELECT concat('o/', l_orderkey) AS dir, rk = 1 OR tagged > 0 AS is_original FROM t WHERE twins > 1 AND least = 0""")
def protected_dirs_orders(spark, sf_dir):
    """With all tagged files kept a directory of these alone is an original, and a group without an untagged one goes."""
    files = _numbered_lines(spark, sf_dir)
    cfg = Config(rank="a", keep_all_tagged=True)
    return directories.duplicate_dirs(files, sieve.sieve(files, cfg), cfg).select("dir", "is_original")


_PILED = "SELECT l_orderkey, l_linenumber, CASE WHEN q < 4 THEN repeat('ab', CAST(q AS INT)) END AS content FROM (SELECT l_orderkey, l_linenumber, CAST(min(l_quantity) AS BIGINT) % 5 AS q FROM lineitem GROUP BY ALL)"


@query(f"""WITH s AS (SELECT l_orderkey, list_sort(list(content)) AS sig, count(*) AS n, min(coalesce(strlen(content) >= 4, false)) AS known FROM ({_PILED}) WHERE content IS NULL OR content <> '' GROUP BY l_orderkey),
t AS (SELECT *, count(*) OVER (PARTITION BY sig) AS twins FROM s WHERE known)
SELECT concat('o/', l_orderkey) AS dir, n AS n_children, twins FROM t WHERE twins > 1""")
def dup_dirs_filtered_orders(spark, sf_dir):
    """Lines outside the size range, and such as can't be read, have no duplicate but count: an order that holds one is no copy.  Empty ones don't count."""
    one = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_quantity").cast("long") % 5).cast("int").alias("q"))
    one = one.withColumn("content", F.when(F.col("q") < 4, F.expr("repeat('ab', q)")))
    files = records.as_records(one, F.concat_ws("/", F.lit("o"), "l_orderkey", "l_linenumber"), F.col("content"))
    report = pipeline.run(files, Config(rank="a", merge_directories=True, size=(4, parsing.LONG_MAX)))
    return report.directories.select("dir", "n_children", "twins")


def _mirrored(spark, sf_dir) -> DataFrame:
    """Every order twice, below x and below y."""
    one = _numbered_lines(spark, sf_dir).select("path", "content")
    both = one.select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("top"), "path", "content")
    return records.as_records(both, F.concat(F.col("top"), F.expr("substr(path, 2)")), F.col("content"))


_MIRROR = f"""WITH f AS (SELECT concat('x/', l_orderkey) AS dir, concat('x/', l_orderkey, '/', l_linenumber) AS path, content FROM ({_NUMBERED})),
s AS (SELECT dir, list_sort(list(content)) AS sig, count(*) AS n FROM f GROUP BY dir), t AS (SELECT *, count(*) OVER (PARTITION BY sig) AS twins, row_number() OVER (PARTITION BY sig ORDER BY dir) AS rk FROM s),
l AS (SELECT f.path, f.content FROM f JOIN t USING (dir) WHERE twins = 1 OR rk = 1), m AS (SELECT *, count(*) OVER (PARTITION BY content) AS twins, row_number() OVER (PARTITION BY content ORDER BY list_last(string_split(path, '/')), path) AS rk FROM l)"""


@query(f"""{_MIRROR} SELECT dir, n AS n_children, twins, rk = 1 AS is_original FROM t WHERE twins > 1
UNION ALL SELECT 'x', (SELECT count(*) FROM f), 2, true UNION ALL SELECT 'y', (SELECT count(*) FROM f), 2, false""")
def dup_dirs_nested_orders(spark, sf_dir):
    """Of two equal trees one is closed and the other, the original, stays open: its own duplicate directories are reported, too."""
    files = _mirrored(spark, sf_dir)
    return directories.duplicate_dirs(files, sieve.sieve(files, _NAMED), _NAMED).select("dir", "n_children", "twins", "is_original")


@query(f"{_MIRROR} SELECT path, twins, rk AS rank_in_group, rk = 1 AS is_original FROM m WHERE twins > 1")
def leftovers_orders(spark, sf_dir):
    files = _mirrored(spark, sf_dir)
    members = once(sieve.sieve(files, _NAMED))
    return directories.leftovers(members, directories.duplicate_dirs(files, members, _NAMED), _NAMED, _group()).select("path", "twins", "rank_in_group", "is_original")


@query(f"{_MIRROR} SELECT path, 'unique_file' AS type FROM (SELECT path FROM f UNION ALL SELECT concat('y', substr(path, 2)) FROM f) WHERE path NOT IN (SELECT path FROM m WHERE twins > 1)")
def unfinished_orders(spark, sf_dir):
    files = _mirrored(spark, sf_dir)
    members = once(sieve.sieve(files, _NAMED))
    left = directories.leftovers(members, directories.duplicate_dirs(files, members, _NAMED), _NAMED, _group())
    return directories.unfinished(members, left).select("path", "type")


@query(f"""WITH s AS (SELECT l_orderkey, list_sort(list(content)) AS sig, count(*) AS n FROM ({_NUMBERED}) GROUP BY l_orderkey), t AS (SELECT *, count(*) OVER (PARTITION BY sig) AS twins FROM s)
SELECT concat('o/', l_orderkey) AS dir, n AS n_children, twins FROM t WHERE twins > 1""")
def packed_dirs_orders(spark, sf_dir):
    """Duplicate directories from a stored result without them."""
    files = _numbered_lines(spark, sf_dir)
    result = once(sieve.duplicates(files, _NAMED))
    return requery.packed(files.drop("content"), result, _NAMED).select("dir", "n_children", "twins")


@query(f"""WITH s AS (SELECT l_orderkey, list_sort(list(content)) AS sig FROM ({_NUMBERED}) GROUP BY l_orderkey), t AS (SELECT *, count(*) OVER (PARTITION BY sig) AS twins FROM s)
SELECT concat_ws('/', 'o', l_orderkey, l_linenumber) AS path, sha256(content) AS checksum, 'duplicate_file' AS type FROM ({_NUMBERED}) JOIN t USING (l_orderkey) WHERE twins > 1""")
def unpacked_dirs_orders(spark, sf_dir):
    """Duplicate files from a result with directories."""
    files = _numbered_lines(spark, sf_dir)
    members = once(sieve.sieve(files, _NAMED))
    dirs = once(directories.duplicate_dirs(files, members, _NAMED))
    inside = directories.parts(members, dirs).select("type", "path", "checksum")
    return requery.unpacked(inside.unionByName(dirs.select("type", F.col("dir").alias("path"), F.col("signature").alias("checksum")))).select("path", "checksum", "type")


@query(f"""WITH d AS (SELECT DISTINCT path, content, l_orderkey FROM ({_LINE})), s AS (SELECT l_orderkey, list_sort(list(content)) AS sig FROM d GROUP BY l_orderkey),
t AS (SELECT *, count(*) OVER (PARTITION BY sig) AS twins FROM s)
SELECT path, concat('o/', l_orderkey) AS parent_path FROM d JOIN t USING (l_orderkey) WHERE twins > 1""")
def parts_of_directories_orders(spark, sf_dir):
    files = _orders(spark, sf_dir)
    dirs = directories.duplicate_dirs(files, sieve.sieve(files, _NAMED), _NAMED)
    return directories.parts(files.drop("content"), dirs).select("path", "parent_path")


@query("""WITH p AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, strlen(html) AS size FROM pages), s AS (SELECT string_split(path, '/') AS parts, size FROM p),
a AS (SELECT array_to_string(parts[1:i], '/') AS path, size FROM s, unnest(range(1, len(parts))) AS t(i))
SELECT path, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM a WHERE path <> '' GROUP BY path""")
def tree_rollup_pages(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return tree.roll_up(_table(spark, sf_dir, "pages").select(path.alias("path"), F.octet_length("html").cast("long").alias("size")))


@query("""WITH n AS (SELECT n_nationkey, n_regionkey AS region, CAST(count(*) AS DOUBLE) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT region, sum(customers) AS whole, count(*) AS k FROM n GROUP BY region)
SELECT n_nationkey, round(customers / whole, 9) AS ratio FROM n JOIN r USING (region) WHERE k > 1 AND customers / whole >= 1.0 / 512""")
def ratio_to_parent_nations(spark, sf_dir):
    joined = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    children = joined.groupBy("n_nationkey", F.col("n_regionkey").alias("region")).agg(F.count("*").cast("double").alias("customers"))
    parents = joined.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").cast("double").alias("customers"))
    return tree.ratios(parents, children, "region", "customers").select("n_nationkey", F.round("ratio", 9).alias("ratio"))


# Group order, sets and re-query.


@query(f"""WITH d AS ({_DOC}), m AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n FROM d), h AS (SELECT text, n, size, path FROM m WHERE n > 1 AND rk = 1)
SELECT sha256(text) AS checksum, row_number() OVER (ORDER BY n DESC, size * (n - 1), path) AS group_rank FROM h""")
def group_order_documents(spark, sf_dir):
    found = rank.order_groups(sieve.duplicates(documents(spark, sf_dir), _NAMED), "Ns", _group())
    return found.filter("rank_in_group = 1").select("checksum", "group_rank")


def _results(spark, sf_dir) -> list[DataFrame]:
    """What earlier runs over English and over other documents reported: groups of equal checksums on each side."""
    known = documents(spark, sf_dir).select("path", "size", "depth", "mtime", digest(F.col("content"), "sha256").alias("checksum")).filter("size >= 1")
    known = known.withColumn("en", F.contains("path", F.lit("/en/")))
    heads = known.groupBy("en", "checksum").agg(F.count("*").alias("n"), F.min("path").alias("head")).filter("n >= 2")
    found = known.join(heads, ["en", "checksum"]).select(F.lit("duplicate_file").alias("type"), "path", "size", "depth", "mtime", "checksum", (F.col("path") == F.col("head")).alias("is_original"), "en")
    stored = once(found, "results")
    return [stored.filter("en").drop("en"), stored.filter("NOT en").drop("en")]


_TWO_RESULTS = f"WITH d AS ({_DOC}), e AS (SELECT *, lang = 'en' AS en FROM d), r AS (SELECT *, count(*) OVER (PARTITION BY en, text) AS n FROM e)"


@query(f"{_TWO_RESULTS}, k AS (SELECT * FROM r WHERE n > 1), m AS (SELECT *, count(*) OVER (PARTITION BY text) AS twins, row_number() OVER (PARTITION BY text ORDER BY base, path) AS rk FROM k) SELECT path, sha256(text) AS checksum, twins, rk AS rank_in_group, rk = 1 AS is_original FROM m")
def requery_union_documents(spark, sf_dir):
    found = requery.requery(_results(spark, sf_dir), _NAMED)
    return found.select("path", "checksum", "twins", "rank_in_group", "is_original")


@query(f"{_TWO_RESULTS}, k AS (SELECT * FROM r WHERE n > 1 AND size BETWEEN 500 AND 4000), m AS (SELECT *, count(*) OVER (PARTITION BY text) AS twins FROM k) SELECT path, twins FROM m WHERE twins > 1")
def requery_filter_documents(spark, sf_dir):
    cfg = Config(rank="a", size=parsing.size_range("500-4k"))
    return requery.requery(_results(spark, sf_dir), cfg).select("path", "twins")


@query(f"""WITH d AS ({_DOC}) SELECT path, CASE WHEN starts_with(path, 'src1/en/') THEN 2 WHEN starts_with(path, 'src1/') THEN 0 ELSE 1 END AS path_index, starts_with(path, 'src1/en/') AS is_tagged
FROM d WHERE starts_with(path, 'src1/') OR starts_with(path, 'src2/')""")
def assigned_roots_documents(spark, sf_dir):
    return requery.assigned(documents(spark, sf_dir).drop("path_index", "is_tagged"), [("src1", 0, False), ("src2", 1, False), ("src1/en", 2, True)]).select("path", "path_index", "is_tagged")


@query(f"WITH d AS ({_DOC}), m AS (SELECT *, count(*) OVER (PARTITION BY text) AS n, max(CAST(tagged AS INT)) OVER (PARTITION BY text) AS a, min(CAST(tagged AS INT)) OVER (PARTITION BY text) AS b FROM d) SELECT path FROM m WHERE n > 1 AND a = 1 AND b = 0")
def in_both_sides_documents(spark, sf_dir):
    return relations.in_both(sieve.sieve(documents(spark, sf_dir), _NAMED), F.col("is_tagged"), ["checksum"]).select("path")


@query(f"""WITH d AS ({_DOC}), c AS (SELECT min(text) AS text FROM (SELECT text FROM d GROUP BY text HAVING count(*) > 1)), same AS (SELECT d.text FROM d JOIN c USING (text))
SELECT 'all' AS asked, count(*) AS n, count(DISTINCT text) AS contents, count(DISTINCT text) = 1 AS is_equal FROM d
UNION ALL SELECT 'same', count(*), count(DISTINCT text), true FROM same UNION ALL SELECT 'one missing', count(*), count(DISTINCT text), false FROM same""")
def equal_verdict_documents(spark, sf_dir):
    """All documents, those of one content, and these with one more asked for."""
    found = documents(spark, sf_dir).filter("size >= 1")
    least = found.groupBy("content").agg(F.count("*").alias("n")).filter("n > 1").agg(F.min("content").alias("content"))
    same = found.join(F.broadcast(least), "content")  # one row
    n, k = found.count(), same.count()
    told = [relations.equal_verdict(rows, asked).withColumn("asked", F.lit(name)) for name, rows, asked in (("all", found, n), ("same", same, k), ("one missing", same, k + 1))]
    return relations.union_results(told).select("asked", "n", "contents", "is_equal")


@query(f"""WITH s AS (SELECT l_orderkey AS o, list_sort(list(content)) AS sig, min(content) AS least, count(*) AS n FROM ({_NUMBERED}) GROUP BY l_orderkey),
p AS (SELECT s.*, lead(o) OVER (ORDER BY o) AS o2, lead(sig) OVER (ORDER BY o) AS sig2 FROM s)
SELECT concat('dirs ', o) AS ask, 2 AS n, sig = sig2 AS is_equal FROM p WHERE o2 IS NOT NULL
UNION ALL SELECT concat('mixed ', o), 2, false FROM s UNION ALL SELECT concat('missing ', o), 2, false FROM s UNION ALL SELECT concat('alone ', o), 1, false FROM s""")
def equal_entries_orders(spark, sf_dir):
    """Each order's directory against the next one's, against its own first line, against nothing, and alone."""
    files = _numbered_lines(spark, sf_dir)
    orders = files.select(F.expr("CAST(split(path, '/')[1] AS BIGINT)").alias("o")).distinct()
    following = rank.in_ranges(orders, [F.col("o")])
    ends = following.groupBy("__part").agg(F.min("o").alias("__first"))
    ends = ends.withColumn("__next", F.lead("__first").over(Window.orderBy("__part"))).drop("__first")  # a row for each range
    following = following.join(ends, "__part").withColumn("o2", F.coalesce(F.lead("o").over(Window.partitionBy("__part").orderBy("__at")), "__next"))
    at = lambda c: F.concat_ws("/", F.lit("o"), c)
    told = lambda name, *paths: F.array(*(F.struct(F.concat_ws(" ", F.lit(name), "o").alias("ask"), p.alias("path")) for p in paths))
    pairs = following.filter("o2 IS NOT NULL").select(F.explode(told("dirs", at("o"), at("o2"))).alias("x"))
    first = files.groupBy(F.expr("CAST(split(path, '/')[1] AS BIGINT)").alias("o")).agg(F.min("path").alias("line"))
    others = first.select(F.explode(F.concat(told("mixed", at("o"), F.col("line")), told("missing", at("o"), F.concat(at("o"), F.lit("/none"))), told("alone", at("o")))).alias("x"))
    asked = pairs.unionByName(others).select("x.*")
    return relations.equal_entries(files.withColumn("checksum", digest(F.col("content"), "sha256")), asked)


@query("SELECT concat_ws('/', source, lang, doc_id) AS path, strlen(text) AS size FROM documents WHERE (strlen(text) BETWEEN 1024 AND 2048 OR strlen(text) BETWEEN 4096 AND 5120) AND (contains(source, 'rc1'))")
def query_language_documents(spark, sf_dir):
    return query_language.query(documents(spark, sf_dir), "size:1K-2K,4K-5K RC1").select("path", "size")


@query(f"""WITH d AS ({_DOC}), c AS (SELECT path, size, CASE WHEN lang = 'de' THEN sha256(substr(text, 1, 40)) ELSE sha256(text) END AS checksum FROM d)
SELECT path, checksum, n AS twins FROM (SELECT *, count(*) OVER (PARTITION BY size, checksum) AS n FROM c) WHERE n > 1""")
def cached_checksums_documents(spark, sf_dir):
    """Checksums of German documents come from a cache, of their first 40 characters: they are believed and not read again."""
    found = documents(spark, sf_dir).filter("size >= 1")
    cache = found.filter(F.contains("path", F.lit("/de/"))).select("dev", "inode", F.lit("sha256").alias("algorithm"), F.sha2(F.substring("content", 1, 40), 256).alias("checksum"), "mtime")
    return sieve.duplicates(with_cached(found, cache, "sha256"), Config(rank="a")).select("path", "checksum", "twins")


@query(f"WITH d AS ({_DOC}) SELECT path, tagged AS is_original FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM d) WHERE n = 1")
def unique_originals_documents(spark, sf_dir):
    """With all tagged ones kept, unique documents of the other side are no originals."""
    return sieve.uniques(documents(spark, sf_dir).filter("size >= 1"), Config(keep_all_tagged=True)).select("path", "is_original")


@query(f"WITH d AS ({_DOC}) SELECT path, CASE WHEN same > 1 THEN sha256(text) END AS checksum FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n, count(*) OVER (PARTITION BY size) AS same FROM d) WHERE n = 1")
def unfinished_checksums_documents(spark, sf_dir):
    """Unique documents with the checksums of those that had to be read."""
    return sieve.uniques(documents(spark, sf_dir).filter("size >= 1"), Config(write_unfinished=True)).select("path", "checksum")


@query(f"WITH d AS ({_DOC}) SELECT path, n AS twins FROM (SELECT *, count(*) OVER (PARTITION BY text, doc_id % 2) AS n FROM d) WHERE n > 1")
def symlinks_apart_documents(spark, sf_dir):
    """Every other document stands for a link: links and files don't match."""
    found = documents(spark, sf_dir).withColumn("is_symlink", F.expr("CAST(split(path, '/')[2] AS BIGINT) % 2 = 1"))
    return sieve.duplicates(found.filter("size >= 1"), Config(rank="a")).select("path", "twins")


@query(f"""WITH d AS ({_DOC}), s AS (SELECT *, CAST(floor(size * 0.25) AS BIGINT) AS low, CAST(floor(size * 0.75) AS BIGINT) AS high FROM d), c AS (SELECT path, high AS eff_size, low, substr(hex(encode(text)), 1 + 2 * low, 2 * (high - low)) AS part FROM s WHERE low < high)
SELECT path, eff_size, sha256(unhex(part)) AS checksum FROM (SELECT *, count(*) OVER (PARTITION BY eff_size, low, part) AS n FROM c) WHERE n > 1""")
def clamped_shares_documents(spark, sf_dir):
    return sieve.sieve(documents(spark, sf_dir).filter("size >= 1"), Config(clamp_low=parsing.clamp("25%"), clamp_high=parsing.clamp(".75"))).select("path", "eff_size", "checksum")


def _ranked(spark, sf_dir) -> DataFrame:
    """Documents with times, links and roots that differ inside groups."""
    n = F.col("doc_id")
    path = F.concat_ws("/", "source", F.when(n % 2 == 0, F.concat("lang", F.lit("/in"))).otherwise(F.col("lang")), n.cast("string"))
    return records.as_records(_table(spark, sf_dir, "documents").filter("octet_length(text) >= 1"), path, F.col("text"), mtime=(n % 3).cast("double"), link_count=(n % 4 + 1).cast("int"), path_index=(n % 3).cast("int"))


_ORDERS = {
    "mA": "doc_id % 3, base DESC", "MA": "doc_id % 3 DESC, base DESC", "lm": "strlen(base), doc_id % 3", "LM": "strlen(base) DESC, doc_id % 3 DESC", "dA": "doc_id % 2 DESC, base DESC", "Da": "doc_id % 2, base", "ha": "doc_id % 4, base", "Ha": "doc_id % 4 DESC, base",
    "oA": "doc_id % 4, base DESC", "OA": "doc_id % 4 DESC, base DESC", "pA": "doc_id % 3, base DESC", "Pa": "doc_id % 3 DESC, base", "x<[02468]$>A": "base NOT SIMILAR TO '.*[02468]', base DESC", "X<[02468]$>a": "base SIMILAR TO '.*[02468]', base", "r</in/>A": "doc_id % 2, base DESC",
    "R</in/>a": "doc_id % 2 DESC, base", "pOma": "doc_id % 3, doc_id % 4 DESC, doc_id % 3, base",
}


def _rank_query(spec: str, order: str) -> None:
    def run(spark, sf_dir):
        return sieve.duplicates(_ranked(spark, sf_dir), Config(rank=spec)).select("path", "rank_in_group", "is_original")

    letters = [spec[0], *spec.rpartition(">")[2]] if "<" in spec else list(spec)
    run.__name__ = "rank" + "".join(f"_{c.lower()}_down" if c.isupper() else f"_{c}" for c in letters) + "_documents"
    query(f"""WITH d AS (SELECT *, concat_ws('/', source, CASE WHEN doc_id % 2 = 0 THEN concat(lang, '/in') ELSE lang END, CAST(doc_id AS VARCHAR)) AS path, CAST(doc_id AS VARCHAR) AS base FROM documents WHERE strlen(text) >= 1),
m AS (SELECT *, count(*) OVER (PARTITION BY text) AS n, row_number() OVER (PARTITION BY text ORDER BY {order}, path) AS rk FROM d)
SELECT path, rk AS rank_in_group, rk = 1 AS is_original FROM m WHERE n > 1""")(run)


for _spec, _order in _ORDERS.items():
    _rank_query(_spec, _order)


@query(f"""WITH d AS (SELECT DISTINCT path, content, inode FROM ({_LINE})), m AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY lower(list_last(string_split(path, '/'))), path) = 1 AS orig FROM d)
SELECT path, max(CAST(orig AS INT)) OVER (PARTITION BY content, inode) = 1 AS is_original FROM m""")
def keep_hardlinked_lines(spark, sf_dir):
    single = lines(spark, sf_dir).dropDuplicates(["path"])
    cfg = Config(rank="a", keep_hardlinked=True)
    return rank.mark_originals(once(sieve.sieve(single, cfg), "members"), cfg, _group(cfg)).select("path", "is_original")


@query(f"""WITH d AS ({_DOC}), k AS (SELECT *, CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END AS kind, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n FROM d), h AS (SELECT * FROM k WHERE n > 1 AND rk = 1)
SELECT sha256(text) AS checksum, row_number() OVER (ORDER BY kind, size * (n - 1) DESC, path) AS group_rank FROM h""")
def group_types_documents(spark, sf_dir):
    """Types come first in the order of groups: other lint, parts of directories, directories, files."""
    found = once(sieve.duplicates(documents(spark, sf_dir), _NAMED))
    heads = found.filter("rank_in_group = 1").select("checksum", F.split("path", "/")[1].alias("lang"))
    kind = F.when(F.col("lang") == "en", "duplicate_file").when(F.col("lang") == "de", "duplicate_dir").when(F.col("lang") == "fr", "part_of_directory").otherwise("emptyfile")
    typed = found.drop("type").join(heads, "checksum").withColumn("type", kind).drop("lang")
    return rank.order_groups(typed, "S", _group()).filter("rank_in_group = 1").select("checksum", "group_rank")


_TYPES = "['badlink', 'emptydir', 'emptyfile', 'nonstripped', 'baduid', 'badgid', 'badugid']"


@query(f"SELECT o_orderkey, {_TYPES}[o_orderkey % 7 + 1] AS type, CAST(o_orderkey % 7 AS INT) AS lint_rank FROM orders WHERE epoch_us(o_orderdate) / 1e6 >= 852076800 AND o_orderkey % 3 <> 0")
def reported_lint_orders(spark, sf_dir):
    """Orders as lint of seven types: new enough, and not protected by a tag."""
    kinds = F.array(*(F.lit(t) for t in parsing.LINT_TYPES[:7]))
    found = _table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(kinds, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("type"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("mtime"), (F.col("o_orderkey") % 3 == 0).alias("is_tagged"))
    return lint.reported(found, Config(newer_than=852076800.0, keep_all_tagged=True)).select("o_orderkey", "type", "lint_rank")


@query(f"SELECT o_orderkey, CASE {_TYPES}[o_orderkey % 7 + 1] WHEN 'emptydir' THEN 'remove_dir' WHEN 'emptyfile' THEN 'remove' WHEN 'badlink' THEN 'remove' WHEN 'nonstripped' THEN 'strip' WHEN 'baduid' THEN 'set_user' WHEN 'badgid' THEN 'set_group' ELSE 'set_user_and_group' END AS action FROM orders")
def lint_actions_orders(spark, sf_dir):
    kinds = F.array(*(F.lit(t) for t in parsing.LINT_TYPES[:7]))
    return formats.lint_actions(_table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(kinds, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("type"))).select("o_orderkey", "action")


@query(f"WITH d AS ({_LINE}) SELECT path, l_linenumber AS line FROM d WHERE l_suppkey % 10 NOT IN (3, 4)")
def known_devices_lines(spark, sf_dir):
    """Lines on devices by supplier, two of which hold file systems that are left out."""
    mounts = spark.range(10).select(F.col("id").alias("dev"), F.col("id").isin(3, 4).alias("is_ignored"))
    found = lines(spark, sf_dir).withColumn("dev", F.col("l_suppkey") % 10)
    return records.on_known_devices(found, mounts).select("path", F.col("path_index").alias("line"))


@query(f"WITH d AS ({_DOC}), m AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n FROM d) SELECT path, rk = 1 AS is_original FROM m WHERE n > 1 AND abs(doc_id % 3 * 0.04) <= 0.05")
def still_there_documents(spark, sf_dir):
    """A stored result, of which a third has been changed since."""
    result = sieve.duplicates(documents(spark, sf_dir), _NAMED)
    now = documents(spark, sf_dir).select("path", (F.expr("CAST(split(path, '/')[2] AS BIGINT) % 3") * 0.04).alias("mtime"))
    return requery.still_there(result, now).select("path", "is_original")


@query(f"WITH d AS ({_DOC}), m AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n FROM d) SELECT CAST(sum(CASE WHEN rk = 1 THEN 0 WHEN lang = 'de' THEN doc_id % 5 + 1 ELSE 1 END) AS BIGINT) AS duplicates, count(DISTINCT (lang = 'de', text)) AS duplicate_sets, CAST(sum(size) FILTER (rk > 1) AS BIGINT) AS duplicate_bytes FROM m WHERE n > 1")
def result_statistics_documents(spark, sf_dir):
    """German rows stand for directories, which count their files."""
    german = F.contains("path", F.lit("/de/"))
    result = sieve.duplicates(documents(spark, sf_dir), _NAMED).withColumn("type", F.when(german, "duplicate_dir").otherwise("duplicate_file"))
    return requery.statistics(result.withColumn("n_children", F.expr("CAST(split(path, '/')[2] AS BIGINT) % 5 + 1")))


@query(f"WITH d AS ({_DOC}), m AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n FROM d), l AS (SELECT path, doc_id % 2 = 0 AS is_original FROM d WHERE doc_id % 3 = 0) SELECT path, CASE WHEN l.path LIKE 'src1/%' THEN NOT l.is_original ELSE l.is_original END AS is_original FROM m JOIN l USING (path) WHERE n > 1")
def allowed_and_toggled_documents(spark, sf_dir):
    """A result cut down to an allow-list with its own verdicts, of which those of one source are turned over."""
    number = F.expr("CAST(split(path, '/')[2] AS BIGINT)")
    allow = documents(spark, sf_dir).filter(number % 3 == 0).select("path", (number % 2 == 0).alias("is_original"))
    listed = tree.allowed(sieve.duplicates(documents(spark, sf_dir), _NAMED), allow)
    return tree.toggled(listed, F.startswith("path", F.lit("src1/"))).select("path", "is_original")


@query(f"WITH d AS ({_DOC}), c AS (SELECT min(sha256(text)) AS checksum FROM (SELECT text FROM d GROUP BY text HAVING count(*) > 1)) SELECT path FROM d, c WHERE sha256(text) = c.checksum")
def group_lookup_documents(spark, sf_dir):
    found = once(sieve.duplicates(documents(spark, sf_dir), _NAMED))
    return tree.of_group(found, found.agg(F.min("checksum")).first()[0]).select("path")


@query("SELECT concat_ws('/', source, lang, doc_id) AS path FROM documents WHERE CAST(doc_id % 4000 AS DOUBLE) * 86400 BETWEEN 8640000 AND 17280000 AND contains(lang, 'e')")
def query_dates_documents(spark, sf_dir):
    """Terms of one letter are no filter; dates may be text or seconds."""
    found = documents(spark, sf_dir).withColumn("mtime", (F.expr("CAST(split(path, '/')[2] AS BIGINT)") % 4000).cast("double") * 86400)
    return query_language.query(found.filter(F.contains(F.split("path", "/")[1], F.lit("e"))), "mtime:1970-04-11T00:00:00-17280000 x").select("path")


# Scalars.


@query(f"""SELECT page_id, list_last(string_split(url, '/')) AS base, CASE WHEN contains(list_last(string_split(url, '/')), '.') THEN list_last(string_split(list_last(string_split(url, '/')), '.')) END AS ext,
len(string_split(regexp_replace(url, '/+$', ''), '/')) - 1 AS depth, regexp_matches(url, '(^|/)\\.') AS hidden, strlen(url) AS bytes, concat('''', replace(url, '''', '''"''"'''), '''') AS quoted, replace(url, 'http', 'x') AS replaced FROM pages""")
def path_functions_pages(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id", C.basename(url).alias("base"), C.extension(url).alias("ext"), C.path_depth(url).cast("long").alias("depth"), C.is_hidden(url).alias("hidden"), C.byte_length(url).alias("bytes"), C.shell_quote(url).alias("quoted"),
        C.replace_text(url, "http", "x").alias("replaced"),
    )


@query("""SELECT o_orderkey, CASE WHEN s < 512 THEN format('{:d} B', s) WHEN s < 524288 THEN format('{:.2f} KB', s / 1024.0) WHEN s < 536870912 THEN format('{:.2f} MB', s / 1048576.0) ELSE format('{:.2f} GB', s / 1073741824.0) END AS human
FROM (SELECT o_orderkey, CAST(o_orderkey * 100 * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 10007 END AS BIGINT) AS s FROM orders)""")
def human_size_orders(spark, sf_dir):
    size = F.col("o_orderkey") * 100 * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(10007)
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.human_size(size.cast("long")).alias("human"))


@query("""SELECT o_orderkey, CASE WHEN s < 1024 THEN format('{:.1f} B', s) WHEN s < 1048576 THEN format('{:.1f} KB', s / 1024.0) ELSE format('{:.1f} MB', s / 1048576.0) END AS human, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_us(o_orderdate) AS back,
CASE WHEN abs(o_totalprice - 100000) <= 5000 THEN 0 WHEN o_totalprice < 100000 THEN -1 ELSE 1 END AS compared, regexp_matches(o_orderpriority, '^[12]') AS urgent, CAST(floor(100 * (o_orderkey % 120) / 120) AS BIGINT) AS percent, to_json(concat(o_orderpriority, '"', chr(10), o_orderstatus)) AS quoted
FROM (SELECT *, CAST(o_orderkey * 97 AS DOUBLE) AS s FROM orders)""")
def scalar_functions_orders(spark, sf_dir):
    stamp = F.col("o_orderdate").cast("timestamp")
    iso = C.to_iso(stamp)
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", C.human_size_steps((F.col("o_orderkey") * 97).cast("double")).alias("human"), iso.alias("iso"), F.unix_micros(C.from_iso(iso)).alias("back"), C.compare_close(F.col("o_totalprice"), F.lit(100000.0), 5000.0).alias("compared"),
        C.matches(F.col("o_orderpriority"), "^[12]").alias("urgent"), C.progress_percent(F.col("o_orderkey") % 120, F.lit(120)).cast("long").alias("percent"), C.json_string(F.concat("o_orderpriority", F.lit('"\n'), "o_orderstatus")).alias("quoted"),
    )


# Sinks as plans.


@query(f"WITH d AS ({_DOC}), m AS (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM d) SELECT 'duplicate_file' AS type, path, size, sha256(text) AS checksum FROM m WHERE n > 1")
def csv_rows_documents(spark, sf_dir):
    return formats.csv_rows(sieve.duplicates(documents(spark, sf_dir), _NAMED))


@query(f"WITH d AS ({_DOC}), m AS (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM d) SELECT path AS value FROM m WHERE n = 1")
def uniques_sink_documents(spark, sf_dir):
    return formats.unique_paths(sieve.uniques(texts(spark, sf_dir), _NAMED))


@query(f"WITH d AS ({_DOC}), m AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n FROM d) SELECT sha256(text) AS checksum, rk AS rank_in_group, concat(path, chr(10), CASE WHEN rk = n THEN chr(10) ELSE '' END) AS value FROM m WHERE n > 1")
def blocks_sink_documents(spark, sf_dir):
    return formats.blocks(sieve.duplicates(documents(spark, sf_dir), _NAMED), _group()).select("checksum", "rank_in_group", "value")


_DEVICE = "CAST(substr(source, 4) AS INT) % 3"


@query(f"""WITH d AS ({_DOC}), m AS (SELECT *, {_DEVICE} AS dev, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n FROM d), h AS (SELECT text, path AS head, dev AS head_dev FROM m WHERE rk = 1)
SELECT path, head AS original_path, CASE WHEN rk = 1 THEN 'keep' WHEN dev = head_dev AND dev = 0 THEN 'clone' WHEN dev = head_dev THEN 'hardlink' ELSE 'symlink' END AS action FROM m JOIN h USING (text) WHERE n > 1""")
def action_plan_documents(spark, sf_dir):
    """Three devices, one of which can share extents."""
    found = documents(spark, sf_dir).withColumn("dev", F.expr("CAST(substr(split(path, '/')[0], 4) AS INT) % 3").cast("long"))
    capable = spark.range(1).select(F.col("id").alias("dev"))
    return formats.actions(sieve.duplicates(found, _NAMED), _group(), formats.PRESETS["clone"], reflink_devices=capable).select("path", "original_path", "action")


@query(f"WITH d AS ({_DOC}), m AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n, first_value(path) OVER (PARTITION BY text ORDER BY NOT tagged, base, path) AS head FROM d) SELECT concat(CASE WHEN rk = 1 THEN 'keep' ELSE 'remove' END, ' ', chr(39), path, chr(39), ' ', chr(39), head, chr(39)) AS value FROM m WHERE n > 1")
def script_lines_documents(spark, sf_dir):
    return scripts.script_lines(formats.actions(sieve.duplicates(documents(spark, sf_dir), _NAMED), _group()))


@query(f"WITH d AS ({_DOC}), m AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n FROM d) SELECT 'duplicate_file' AS type, path, size, sha256(text) AS checksum, rk = 1 AS is_original, n AS twins, 100 AS progress FROM m WHERE n > 1")
def json_sink_documents(spark, sf_dir):
    """The lines of the JSON result, read back."""
    written = formats.json_lines(sieve.duplicates(documents(spark, sf_dir), _NAMED))
    return written.select(F.from_json("value", "type string, path string, size long, checksum string, is_original boolean, twins long, progress int").alias("r")).select("r.*")


@query(f"""WITH d AS ({_DOC}), m AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n FROM d), s AS (SELECT count(*) FILTER (rk > 1) AS duplicates, count(DISTINCT text) AS duplicate_sets, CAST(sum(size) FILTER (rk > 1) AS BIGINT) AS extra FROM m WHERE n > 1)
SELECT (SELECT count(*) FROM d) AS total_files, duplicates, duplicate_sets, CASE WHEN extra < 512 THEN format('{{:d}} B', extra) WHEN extra < 524288 THEN format('{{:.2f}} KB', extra / 1024.0) ELSE format('{{:.2f}} MB', extra / 1048576.0) END AS size FROM s""")
def summary_documents(spark, sf_dir):
    found = documents(spark, sf_dir).filter("size >= 1")
    return formats.summary(sieve.duplicates(found, _NAMED), _group(), found.count(), [("json", "r.json")]).drop("outputs")


@query(f"""WITH d AS ({_DOC}), m AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n FROM d),
s AS (SELECT CAST(sum(size) FILTER (n > 1 AND rk = 1) AS BIGINT) AS original_bytes, CAST(sum(size) FILTER (n > 1 AND rk > 1) AS BIGINT) AS duplicate_bytes, CAST(sum(size) FILTER (n = 1) AS BIGINT) AS unique_bytes, CAST(sum(size) AS BIGINT) AS read_bytes FROM m)
SELECT original_bytes, duplicate_bytes, unique_bytes, read_bytes, round(duplicate_bytes / read_bytes, 9) AS read_ratio, round(duplicate_bytes / (original_bytes + duplicate_bytes + unique_bytes), 9) AS total_ratio FROM s""")
def stats_documents(spark, sf_dir):
    found = documents(spark, sf_dir).filter("size >= 1")
    members = once(sieve.duplicates(found, _NAMED))
    told = formats.stats(members, sieve.uniques(found, _NAMED, members), found.select(F.col("size").alias("bytes")))
    return told.withColumn("read_ratio", F.round("read_ratio", 9)).withColumn("total_ratio", F.round("total_ratio", 9))


@query(f"""WITH d AS ({_DOC}), m AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY text) AS n FROM d)
SELECT (SELECT count(*) FROM d) AS total_files, count(*) FILTER (rk > 1) AS duplicates, count(DISTINCT text) AS duplicate_sets, CAST(coalesce(sum(size) FILTER (rk > 1), 0) AS BIGINT) AS duplicate_bytes FROM m WHERE n > 1""")
def report_documents(spark, sf_dir):
    return pipeline.run(documents(spark, sf_dir), _NAMED).footer.select("total_files", "duplicates", "duplicate_sets", "duplicate_bytes")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup_ranked_documents(spark, sf_dir)
