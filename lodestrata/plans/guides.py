"""Queries on what documents are made of: the driver's tables as entities, files and changes of a tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import behavioral as B
from lodestrata.operators import convention as V
from lodestrata.operators import guide as D
from lodestrata.operators import risk as R
from lodestrata.operators import sessions
from lodestrata.plans.behavioral import BUS, PAIRS, pairs
from lodestrata.plans.registry import register
from lodestrata.plans.texts import NAMES, names
from lodestrata.plans.views import MODIFIES, modifies, table, with_

#: Parts are entities in files by brand and size.
ENT = """en AS (SELECT p_partkey AS id, CASE WHEN p_size = 50 THEN 'main.rs' ELSE 'src/' || ['store', 'my_query', 'render-x', 'core', 'zed_lib'][p_partkey % 5 + 1] || '/' || lower(replace(p_brand, '#', '_')) || '/m' || p_size || CASE WHEN p_size % 5 = 0 THEN '_test.rs' ELSE '.rs' END END AS path,
CASE p_partkey % 3 WHEN 0 THEN 'Type' ELSE 'Function' END AS kind, CASE p_partkey % 11 WHEN 0 THEN 'new' WHEN 1 THEN 'fmt' ELSE 'f' || p_partkey END AS leaf, CASE WHEN p_partkey % 7 > 0 THEN round(p_retailprice / 2500, 4) ELSE 0 END AS score, p_size * 10 AS size FROM part)"""


def entities(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    top = F.element_at(F.array(*map(F.lit, ["store", "my_query", "render-x", "core", "zed_lib"])), (k % 5).cast("int") + 1)
    path = F.concat(F.lit("src/"), top, F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/m"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 5 == 0, "_test.rs").otherwise(".rs"))
    path = F.when(F.col("p_size") == 50, "main.rs").otherwise(path)
    leaf = F.when(k % 11 == 0, "new").when(k % 11 == 1, "fmt").otherwise(F.concat(F.lit("f"), k.cast("string")))
    return p.select(
        k.alias("id"), path.alias("path"), F.when(k % 3 == 0, "Type").otherwise("Function").alias("kind"), F.concat(path, F.lit("::"), leaf).alias("name"),
        F.when(k % 7 > 0, F.round(F.col("p_retailprice") / 2500, 4)).otherwise(0.0).alias("score"), (F.col("p_size") * 10).alias("size"),
    )


DIR = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END"


@register("f13_kind_words", "SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'Function' WHEN 1 THEN 'Type' WHEN 2 THEN 'Type' WHEN 3 THEN 'Module' WHEN 4 THEN 'Contributor' WHEN 5 THEN 'PullRequest' WHEN 6 THEN 'ExternalDep' WHEN 7 THEN 'Document' WHEN 8 THEN 'File' WHEN 9 THEN 'Commit' WHEN 10 THEN 'Issue' END AS kind FROM part")
def f13(spark, d):
    words = F.array(*map(F.lit, ["FN", "struct", "Class", "dir", "author", "pr", "dep", "doc", "file", "commit", "ISSUE", "thing"]))
    return table(spark, d, "part").select("p_partkey", D.kind_of(F.element_at(words, (F.col("p_partkey") % 12).cast("int") + 1)).alias("kind"))


@register("f14_section_projection", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def f14(spark, d):
    return D.project(table(spark, d, "part"), ["p_partkey", "p_name"], {"metrics": ["p_size", "p_retailprice"], "origin": ["p_brand", "p_type"]}, ["metrics", "unknown"])


@register("k4_counted_entities", with_(ENT) + "SELECT path || '::' || leaf AS name, score, (SELECT count(*) FROM en WHERE kind = 'Type') AS total FROM en WHERE kind = 'Type' ORDER BY name, score LIMIT 20")
def k4(spark, d):
    return D.counted(entities(spark, d).filter("kind = 'Type'").select("name", "score"), 20, F.col("name"), F.col("score"))


CLASS = "CASE WHEN score > 0.5 THEN 'FoundationalStable' WHEN score > 0.4 THEN 'Background' END"


@register("k6_load_bearing", with_(ENT) + f"SELECT leaf AS entity, path || '::' || leaf AS name, round(score, 2) AS score, coalesce({CLASS}, 'Unknown') AS classification FROM en ORDER BY en.score DESC, name LIMIT 20")
def k6a(spark, d):
    return D.load_bearing(entities(spark, d).withColumn("classification", F.when(F.col("score") > 0.5, "FoundationalStable").when(F.col("score") > 0.4, "Background")))


@register("k6_danger_zones", with_(MODIFIES) + f", b AS ({BUS.replace('WITH RECURSIVE ' + MODIFIES, 'WITH ' + MODIFIES)}), t AS (SELECT file, count(*) AS total FROM m WHERE file % 3 > 0 GROUP BY file), c AS (SELECT b.file, coalesce(total, 0) AS total, CASE WHEN b.file % 2 = 0 THEN 1 ELSE bus_factor END AS bus_factor, top_contributor_share FROM b LEFT JOIN t USING (file)) SELECT file, total, bus_factor, round(top_contributor_share * 100) AS top_share FROM c WHERE bus_factor <= 1 AND total >= 3 ORDER BY total DESC, file LIMIT 10")
def k6b(spark, d):
    """Every other file is taken to have one contributor, as the tables have none of these."""
    m = modifies(spark, d)
    b = B.contributor_concentration(m).withColumn("bus_factor", F.when(F.col("file") % 2 == 0, 1).otherwise(F.col("bus_factor")))
    return D.danger_zones(b, m.filter("file % 3 > 0").groupBy("file").agg(F.count(F.lit(1)).alias("total")))


@register("k6_change_pairs", with_(PAIRS.replace("{c}", "0.05::DOUBLE")) + ", q AS (SELECT file, partner, confidence, row_number() OVER (PARTITION BY file ORDER BY confidence DESC, co_occurrences DESC, partner) AS r FROM (SELECT a AS file, b AS partner, co_occurrences, confidence FROM pr UNION ALL SELECT b, a, co_occurrences, confidence FROM pr)) SELECT least(file, partner) AS a, greatest(file, partner) AS b, round(max(confidence), 6) AS confidence FROM q WHERE r <= 3 GROUP BY 1, 2 ORDER BY max(q.confidence) DESC, a, b LIMIT 5")
def k6c(spark, d):
    return D.strongest_partners(B.cochange_partners(pairs(spark, d))).withColumn("confidence", F.round("confidence", 6))


@register("k8_concepts", with_(ENT) + "SELECT leaf AS concept, path AS file, round(CASE WHEN id % 4 > 0 THEN score ELSE 0 END, 2) AS salience, CASE WHEN id % 2 = 0 THEN 'About ' || id END AS description FROM en WHERE kind = 'Type' ORDER BY CASE WHEN id % 4 > 0 THEN score ELSE 0 END DESC, path || '::' || leaf LIMIT 20")
def k8(spark, d):
    e = entities(spark, d)
    t = e.filter("kind = 'Type'").select("id", "name", F.col("path").alias("file"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("About "), F.col("id").cast("string"), F.lit("\nand more"))).alias("doc"))
    return D.concepts(t, e.filter("id % 4 > 0").select("id", "score"))


@register("u5_modules", with_(ENT) + "SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS module FROM en WHERE contains(path, '/')")
def u5(spark, d):
    return D.modules_of(entities(spark, d).select(F.col("path").alias("file")))


@register("a27_module_map", with_(ENT) + f"SELECT {DIR} AS module, count(DISTINCT path) AS files, count_if(kind = 'Function') AS functions, count_if(kind = 'Type') AS types FROM en GROUP BY 1")
def a27(spark, d):
    return D.module_map(entities(spark, d))


@register("a28_topology_counts", "SELECT count_if(k IN (0, 4)) AS added, count_if(k IN (1, 5)) AS modified, count_if(k = 2) AS deleted, count_if(k = 3) AS renamed FROM (SELECT p_partkey % 7 AS k FROM part)")
def a28(spark, d):
    words = F.array(*map(F.lit, ["A", "M", "D", "R100", "C75", "T", "X"]))
    return D.topology(table(spark, d, "part").select(F.element_at(words, (F.col("p_partkey") % 7).cast("int") + 1).alias("status")))


@register("r1_build_commands", "SELECT DISTINCT trim(c) AS command FROM (SELECT ' make ' || lower(p_type) || ' ' AS c FROM part UNION ALL SELECT 'run ' || p_size || CASE WHEN p_size % 4 = 0 THEN ' | tee x' ELSE '' END FROM part) WHERE length(trim(c)) > 2 AND NOT contains(c, '|')")
def r1(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.explode(F.array(F.concat(F.lit(" make "), F.lower("p_type"), F.lit(" ")), F.concat(F.lit("run "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 4 == 0, " | tee x").otherwise("")))).alias("command"))
    return D.build_commands(c, spark.range(1).select(F.lit("Cargo.toml").alias("path")))


@register("r1_default_commands", "SELECT unnest(['cargo build', 'cargo test', 'pip install -e .', 'pytest']) AS command")
def r1b(spark, d):
    p = table(spark, d, "part").select(F.lit("|").alias("command"))
    return D.build_commands(p, spark.range(1).select(F.explode(F.array(F.lit("Cargo.toml"), F.lit("pyproject.toml"), F.lit("src/go.mod"))).alias("path")))


@register("r5_languages", "SELECT lang AS language, count(*) AS files, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 1) AS percent FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def r5(spark, d):
    return D.languages(table(spark, d, "documents").select(F.col("lang").alias("language")))


#: An order's session modifies files by supplier, under a folder by its priority.
TASKS = "ta AS (SELECT f AS files, count(*) AS frequency FROM (SELECT l_orderkey, list_sort(list(DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN 'src/a' || l_suppkey % 3 || '/x.rs' ELSE 'lib' || l_suppkey % 2 || '.py' END)) AS f FROM lineitem GROUP BY l_orderkey) GROUP BY f HAVING count(*) >= 2)"


@register("r6_common_tasks", with_(TASKS) + "SELECT CASE WHEN files[1] LIKE 'src/%' THEN CASE WHEN len(files) = 1 THEN 'modify src/' || substr(files[1], 5, 2) ELSE 'modify src/a' END ELSE 'modify .py files' END AS task, array_to_string(files[1:3], ',') AS files, frequency FROM ta ORDER BY frequency DESC, array_to_string(ta.files, chr(10)) LIMIT 10")
def r6(spark, d):
    s = F.col("l_suppkey")
    file = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("src/a"), (s % 3).cast("string"), F.lit("/x.rs"))).otherwise(F.concat(F.lit("lib"), (s % 2).cast("string"), F.lit(".py")))
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), file.alias("file"), F.lit(True).alias("modified"))
    return D.common_tasks(sessions.task_patterns(refs)).withColumn("files", F.array_join("files", ","))


@register("r8_vocabulary", "WITH n AS (SELECT event_id % 40 AS file, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 2), e AS (SELECT p_partkey % 40 AS file, list_sort(list(DISTINCT p_brand)) AS b FROM part GROUP BY 1) SELECT file, array_to_string(b[1:3], ',') AS entities, n AS reference_count FROM n JOIN e USING (file) ORDER BY n DESC, file LIMIT 20")
def r8(spark, d):
    refs = table(spark, d, "events").select((F.col("event_id") % 40).alias("file"))
    e = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("file"), F.concat(F.lit("x.rs::"), "p_brand").alias("name"))
    return D.vocabulary(sessions.domain_vocabulary(refs, e)).withColumn("entities", F.array_join("entities", ","))


@register("r9_decisions", "SELECT 'docs/' || CASE p_size % 4 WHEN 0 THEN 'ADR-' WHEN 1 THEN 'my-decision-' ELSE 'note-' END || p_partkey AS name, p_name AS title FROM part WHERE p_size % 4 < 2")
def r9(spark, d):
    k = F.col("p_size") % 4
    return D.decisions(table(spark, d, "part").select(F.concat(F.lit("docs/"), F.when(k == 0, "ADR-").when(k == 1, "my-decision-").otherwise("note-"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("title")))


@register("r10_key_entities", with_(ENT) + f"SELECT * FROM (SELECT {DIR} AS module, leaf AS entity, path, score, CAST(row_number() OVER (PARTITION BY {DIR} ORDER BY score DESC, leaf, path) AS INT) AS rank FROM en WHERE score > 0 AND leaf NOT IN ('new', 'fmt', 'default')) WHERE rank <= 20")
def r10(spark, d):
    return D.key_entities(entities(spark, d))


#: Lines' parts import each other by number.
IMPORTS = ENT + f", ip AS (SELECT DISTINCT a.path AS importer, b.path AS imported FROM lineitem JOIN en a ON a.id = l_partkey JOIN en b ON b.id = l_partkey * 7 % (SELECT count(*) FROM part) + 1), dd AS (SELECT DISTINCT {DIR.replace('path', 'importer')} AS src, {DIR.replace('path', 'imported')} AS dst FROM ip)"


def import_paths(spark, d):
    e, n = entities(spark, d).select("id", "path"), table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"))
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct().crossJoin(F.broadcast(n))  # one row
    j = li.join(e, "id").select(F.col("path").alias("importer"), (F.col("id") * 7 % F.col("n") + 1).alias("id"))
    return j.join(e, "id").select("importer", F.col("path").alias("imported")).distinct()


@register("r11_module_dependencies", with_(IMPORTS) + "SELECT module, coalesce(array_to_string(list_sort(list(DISTINCT t) FILTER (t IS NOT NULL)), ','), '') AS imports_from, coalesce(array_to_string(list_sort(list(DISTINCT f) FILTER (f IS NOT NULL)), ','), '') AS imported_by FROM (SELECT src AS module, dst AS t, NULL AS f FROM dd WHERE src <> dst UNION ALL SELECT dst, NULL, src FROM dd WHERE src <> dst) GROUP BY module")
def r11(spark, d):
    return D.module_dependencies(import_paths(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("imports_from", "imported_by")})


#: Suppliers are files of their nation.
PROFILE = with_(MODIFIES) + f""", b AS ({BUS.replace('WITH RECURSIVE ' + MODIFIES, 'WITH ' + MODIFIES)}), t AS (SELECT file, count(*) AS total FROM m GROUP BY file),
f AS (SELECT n_name AS module, s_suppkey AS file, total, bus_factor, s_acctbal AS score, CASE s_suppkey % 4 WHEN 0 THEN 'StableCore' WHEN 3 THEN NULL ELSE 'Volatile' END AS stability FROM t JOIN b USING (file) JOIN supplier ON s_suppkey = file JOIN nation ON n_nationkey = s_nationkey),
st AS (SELECT module, min({{'n': -n, 's': stability}}).s AS stability FROM (SELECT module, stability, count(*) AS n FROM f WHERE stability IS NOT NULL GROUP BY ALL) GROUP BY module),
pt AS (SELECT module, array_to_string(list_sort(list(DISTINCT other))[1:5], ',') AS changes_with FROM (SELECT a.module, c.module AS other FROM f a JOIN f c ON c.file = a.file + 1 OR c.file = a.file - 1) WHERE module <> other GROUP BY module)
SELECT f.module, count(*) AS files, CAST(sum(total) AS BIGINT) AS changes, CAST(sum(total) // count(*) AS BIGINT) AS mean_changes, min(bus_factor) AS min_bus_factor, max(score) AS peak_salience, any_value(st.stability) AS stability, any_value(changes_with) AS changes_with FROM f LEFT JOIN st USING (module) LEFT JOIN pt USING (module) GROUP BY f.module"""


@register("r12_module_profile", PROFILE)
def r12(spark, d):
    """A file changes with the ones that stand beside it."""
    m = modifies(spark, d)
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    at = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("file"), F.concat("n_name", F.lit("/"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_acctbal").alias("score"))
    k = F.col("file") % 4
    f = at.join(m.groupBy("file").agg(F.count(F.lit(1)).alias("total")), "file").join(B.contributor_concentration(m), "file").withColumn("stability", F.when(k == 0, "StableCore").when(k != 3, "Volatile"))
    p = f.select("path", F.explode(F.array(F.col("file") + 1, F.col("file") - 1)).alias("other")).join(f.select(F.col("file").alias("other"), F.col("path").alias("partner")), "other")
    return D.module_profile(f, p.select("path", "partner")).withColumn("changes_with", F.array_join("changes_with", ","))


@register("w7_recent_labels", with_(MODIFIES) + ", l AS (SELECT DISTINCT commit, ts FROM m ORDER BY ts DESC, commit DESC LIMIT 200), g AS (SELECT n_name AS module, 'c' || m.commit % 50 AS label, max(m.ts) AS ts FROM m SEMI JOIN l ON l.commit = m.commit JOIN supplier ON s_suppkey = m.file JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL) SELECT module, label, rank FROM (SELECT module, label, CAST(row_number() OVER (PARTITION BY module ORDER BY ts DESC, label) AS INT) AS rank FROM g) WHERE rank <= 5")
def w7(spark, d):
    m, s, n = modifies(spark, d), table(spark, d, "supplier"), table(spark, d, "nation")
    at = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("file"), F.concat("n_name", F.lit("/x")).alias("path"))
    return D.recent_labels(m.join(at, "file").select("commit", "ts", "path", F.concat(F.lit("c"), (F.col("commit") % 50).cast("string")).alias("label")))


@register("r17_requirements", "WITH r AS (SELECT l_orderkey AS issue, min(l_partkey) AS resolved_by FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1) SELECT o_orderkey AS issue, o_orderstatus AS state, resolved_by FROM orders LEFT JOIN r ON r.issue = o_orderkey ORDER BY o_orderkey LIMIT 50")
def r17(spark, d):
    i = table(spark, d, "orders").select(F.col("o_orderkey").alias("issue"), F.col("o_orderstatus").alias("state"))
    return D.requirements(i, table(spark, d, "lineitem").filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("issue"), F.col("l_partkey").alias("request")))


@register("a21_undocumented_prefixes", f"WITH l AS (SELECT string_split(name, '::')[-1] AS x FROM ({NAMES})), p AS (SELECT p AS part, count(*) AS count FROM l, (SELECT unnest(['create_', 'delete_', 'find_', 'from_', 'get_', 'handle_', 'has_', 'is_', 'new_', 'set_', 'test_', 'to_', 'update_', 'with_']) AS p) WHERE starts_with(x, p) GROUP BY p HAVING count(*) >= 5) SELECT part, count FROM p WHERE part NOT IN ('is_', 'handle_')")
def a21b(spark, d):
    rules = spark.range(1).select(F.explode(F.array(F.lit("Begin predicates with is_."), F.lit("Events: handle_event; never do_it."))).alias("content"))
    return D.undocumented_prefixes(V.affixes(names(spark, d)), rules)


@register("gr7_size_and_tests", with_(ENT) + """, f AS (SELECT path, max(size) AS size FROM en GROUP BY path), t AS (SELECT path FROM f WHERE path LIKE '%\\_test.rs' ESCAPE '\\' UNION SELECT replace(path, '_test.rs', '.rs') FROM f WHERE path LIKE '%\\_test.rs' ESCAPE '\\')
SELECT id, size / CAST((SELECT max(size) FROM f) AS DOUBLE) AS code_size, CASE WHEN path IN (SELECT path FROM t) THEN 1.0 ELSE 0.0 END::DOUBLE AS test_presence FROM (SELECT en.id, f.path, f.size FROM en LEFT JOIN f ON f.path = en.path AND en.kind = 'Function')""")
def gr7(spark, d):
    """A type's name isn't a path, so neither is known."""
    e = entities(spark, d)
    return D.size_and_tests(e.select("id", "kind", "name"), e.groupBy("path").agg(F.max("size").alias("size")))


@register("a25_cluster_labels", with_(ENT) + """, m AS (SELECT id % 37 AS community, path FROM en), n AS (SELECT community, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n FROM m WHERE contains(path, '/') GROUP BY ALL),
t AS (SELECT community, min({'n': -n, 'dir': dir}).dir AS dir FROM n GROUP BY community), l AS (SELECT community, CASE WHEN dir LIKE '%render%' THEN 'Output Rendering' WHEN dir LIKE '%store%' THEN 'Storage Layer' WHEN dir LIKE '%query%' THEN 'Query Engine' ELSE 'Brand ' || regexp_extract(dir, '_([0-9]+)$', 1) END AS label FROM t)
SELECT label, count(DISTINCT community) AS communities, count(*) AS files FROM m JOIN l USING (community) GROUP BY label""")
def a25(spark, d):
    m = entities(spark, d).select((F.col("id") % 37).alias("community"), F.col("path").alias("file"))
    return R.cluster_labels(m).select("label", F.size("communities").cast("long").alias("communities"), F.size("files").cast("long").alias("files"))
