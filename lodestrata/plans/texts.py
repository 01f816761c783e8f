"""Queries on texts, names, sessions, relations and streams in batch form."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import convention as V
from lodestrata.operators import search, sessions
from lodestrata.plans.registry import register
from lodestrata.plans.views import MODIFIES, modifies, table, with_

MARKS = ["actually", "didn't work", "doesn't work", "go back", "instead", "no,", "not right", "not what i", "revert", "roll back", "start over", "that broke", "that's not", "try again", "undo", "wrong", "/undo", "git checkout", "git reset", "git restore", "git revert", "git stash"]
MARK = " OR ".join(f"contains(lower(nt), '{m.replace(chr(39), chr(39) * 2)}')" for m in MARKS)
STYLE = r"""CASE WHEN x IS NULL OR x = '' THEN 'unknown' WHEN contains(x, '_') AND x = lower(x) THEN 'snake_case' WHEN contains(x, '_') AND x = upper(x) THEN 'SCREAMING_SNAKE_CASE' WHEN contains(x, '_') THEN 'mixed' WHEN regexp_matches(x, '^\p{Lu}') THEN 'PascalCase' WHEN regexp_matches(x, '^\p{Ll}') AND regexp_matches(x, '\p{Lu}') THEN 'camelCase' WHEN x = lower(x) THEN 'lowercase' ELSE 'mixed' END"""
NAMES = "SELECT unnest([p_name, replace(p_name, ' ', '_'), upper(replace(p_name, ' ', '_')), p_brand, p_type, 'mod::' || lower(replace(replace(p_brand, '#', ''), ' ', '')), 'A::b' || p_brand, 'x::' || ['get_', 'is_', 'test_', 'handle_', 'gets_', ''][p_size % 6 + 1] || lower(replace(p_name, ' ', '_')) || ['_test', '_error', '_utils', ''][p_partkey % 4 + 1]]) AS name FROM part"


def names(spark, d):
    p = table(spark, d, "part")
    us = F.replace("p_name", F.lit(" "), F.lit("_"))
    b = F.lower(F.replace(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" "), F.lit("")))
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int") + 1)
    own = F.concat(F.lit("x::"), pick(["get_", "is_", "test_", "handle_", "gets_", ""], F.col("p_size")), F.lower(us), pick(["_test", "_error", "_utils", ""], F.col("p_partkey")))
    return p.select(F.explode(F.array("p_name", us, F.upper(us), "p_brand", "p_type", F.concat(F.lit("mod::"), b), F.concat(F.lit("A::b"), "p_brand"), own)).alias("name"))


@register("a17_naming_distribution", f"SELECT convention, count(*) AS count, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS percentage, CAST(row_number() OVER (ORDER BY count(*) DESC, convention) AS INT) AS rank FROM (SELECT {STYLE} AS convention FROM (SELECT string_split(name, '::')[-1] AS x FROM ({NAMES}))) GROUP BY convention")
def a17(spark, d):
    return V.naming(names(spark, d))


@register(
    "a17_affixes",
    f"""WITH l AS (SELECT string_split(name, '::')[-1] AS x FROM ({NAMES})),
f AS (SELECT 'prefix' AS kind, p AS part FROM l, (SELECT unnest(['get_', 'set_', 'is_', 'has_', 'new_', 'from_', 'to_', 'with_', 'create_', 'delete_', 'update_', 'find_', 'test_', 'handle_']) AS p) WHERE starts_with(x, p)
UNION ALL SELECT 'suffix', p FROM l, (SELECT unnest(['_builder', '_config', '_error', '_factory', '_handler', '_impl', '_result', '_service', '_spec', '_test', '_utils']) AS p) WHERE suffix(x, p))
SELECT * FROM (SELECT kind, part, count(*) AS count, CAST(row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, part) AS INT) AS rank FROM f GROUP BY kind, part) WHERE rank <= 10""",
)
def a17b(spark, d):
    return V.affixes(names(spark, d))


PATHS = "SELECT CASE p_partkey % 6 WHEN 0 THEN 'src/' || p_brand || '/test_' || p_size || '.py' WHEN 1 THEN 'src/' || p_brand || '/' || p_size || '.py' WHEN 2 THEN './lib/a/b/' || p_size || '.test.ts' WHEN 3 THEN '/home/x/src/k' || p_size || '.rs' WHEN 4 THEN 'main.go' ELSE '/usr/a/b/c/' || p_size || '_test.go' END AS path FROM part"


def paths(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size").cast("string")
    k = F.col("p_partkey") % 6
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    b = F.col("p_brand")
    return p.select(F.when(k == 0, c("src/", b, "/test_", size, ".py")).when(k == 1, c("src/", b, "/", size, ".py")).when(k == 2, c("./lib/a/b/", size, ".test.ts")).when(k == 3, c("/home/x/src/k", size, ".rs")).when(k == 4, F.lit("main.go")).otherwise(c("/usr/a/b/c/", size, "_test.go")).alias("path"))


NAME = "string_split(path, '/')[-1]"
TEST = f"(starts_with(lower({NAME}), 'test_') OR regexp_matches(lower({NAME}), '(_test[.](rs|py|go)|[.](test|spec)[.](ts|js|tsx)|tests?[.]java)$') OR regexp_matches(path, '(^|/)(tests|test|__tests__)/'))"


@register("fn_paths", f"""SELECT DISTINCT path, coalesce(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS directory, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir_of, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' END AS language,
{TEST} AS is_test, contains(path, '/tests/') OR contains(path, '/test/') OR contains(path, '_test.') OR contains(path, 'test_') OR contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '_spec.') AS has_mark, contains(lower(path), 'test') OR contains(lower(path), 'spec') AS mentions,
CASE WHEN path LIKE '%/test\\_%' ESCAPE '\\' THEN replace(path, '/test_', '/') WHEN path LIKE '%.test.ts' THEN replace(path, '.test.ts', '.ts') WHEN path LIKE '%\\_test.go' ESCAPE '\\' THEN replace(path, '_test.go', '.go') END AS source,
CASE WHEN path LIKE './%' THEN substr(path, 3) WHEN path LIKE '/home/%' THEN 'src/' || string_split(path, '/src/')[2] WHEN path LIKE '/usr%' THEN 'b/c/' || string_split(path, '/')[-1] ELSE path END AS normal FROM ({PATHS})""")
def fn_paths(spark, d):
    p = F.col("path")
    return paths(spark, d).distinct().select(p, X.directory(p).alias("directory"), X.dir_of(p).alias("dir_of"), X.language(p).alias("language"), X.is_test_file(p).alias("is_test"), X.has_test_mark(p).alias("has_mark"), X.mentions_test(p).alias("mentions"), X.source_of_test(p).alias("source"), X.normal_path(p).alias("normal"))


@register(
    "a18_testing_pattern",
    f"""WITH t AS (SELECT path, contains(path, '/tests/') OR contains(path, '/test/') AS d, contains(path, 'test_') AS p, contains(path, '_test.') OR contains(path, '.test.') OR contains(path, '.spec.') AS s, contains(path, '_spec.') AS o, regexp_matches(path, '[.](rs|py|ts|tsx|js|jsx|go|java|rb|swift|kt|kts|cs|php|zig|lean)$') AS src FROM ({PATHS})),
g AS (SELECT count_if(d OR p OR s OR o) AS test_count, count_if(src AND NOT (d OR p OR s OR o)) AS source_count, bool_or(d) AS ad, bool_or(p) AS ap, bool_or(s) AS as_ FROM t)
SELECT test_count, source_count, CASE WHEN source_count > 0 THEN test_count / CAST(source_count AS DOUBLE) ELSE 0 END AS test_ratio, CASE WHEN ad THEN 'tests/ directory' WHEN as_ THEN '*_test.* / *.test.* / *.spec.*' WHEN ap THEN 'test_*' ELSE 'unknown' END AS test_file_pattern, NOT ad AND (as_ OR ap) AS co_located FROM g""",
)
def a18(spark, d):
    return V.testing(paths(spark, d))


@register("fn_text_measures", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS INT) AS words, (length(text) - length(replace(text, 'the', ''))) / 3.0::DOUBLE AS the_count, strlen(trim(text)) >= 20 AS long_enough, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS lines FROM documents")
def fn_text(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.word_count(t).alias("words"), X.occurrences(t, "the").alias("the_count"), X.good_comment(t).alias("long_enough"), X.line_count(t).alias("lines"))


@register("fn_fnv1a64", "SELECT p_partkey, CAST(CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END AS BIGINT) AS hash, left(p_name, 10) AS prefix FROM (SELECT p_partkey, p_name, list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM part)")
def fn_fnv(spark, d):
    return table(spark, d, "part").select("p_partkey", X.fnv1a64("p_name").alias("hash"), X.byte_prefix(10)("p_name").alias("prefix"))


@register("src27_issue_refs", "SELECT o_orderkey, [o_orderkey % 50, o_custkey % 50] AS refs FROM orders WHERE o_orderkey % 50 <> o_custkey % 50 UNION ALL SELECT o_orderkey, [o_orderkey % 50] FROM orders WHERE o_orderkey % 50 = o_custkey % 50")
def src27(spark, d):
    body = F.concat(F.lit("Fixes #"), F.col("o_orderkey") % 50, F.lit(" see #99, and closes: #"), F.col("o_custkey") % 50, F.lit(" disclose #7"))
    return table(spark, d, "orders").select("o_orderkey", X.issue_refs(body).alias("refs")).withColumn("refs", F.when(F.col("o_orderkey") < 0, None).otherwise(F.col("refs")))


@register("src30_remotes", "SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^https?://[^/:]+/[^/]+/[^/]+$')")
def src30(spark, d):
    p = table(spark, d, "pages").filter(F.col("url").rlike("^https?://[^/:]+/[^/]+/[^/]+$"))
    return p.select("page_id", X.remote_of(F.col("url"))["host"].alias("host"))


@register("src17_documents", r"SELECT doc_id, coalesce(trim(regexp_replace(list_filter(l, lambda x: regexp_matches(x, '^#\s'))[1], '^#\s+', '')), doc_id || '.md') AS title, len(list_filter(l, lambda x: regexp_matches(x, '^#{2,3}\s'))) AS sections, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS INT) AS words FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN '# Title ' || doc_id || chr(10) || '## One' || chr(10) || text || chr(10) || '### Two' ELSE text END, chr(10)) AS l, CASE WHEN doc_id % 3 = 0 THEN '# Title ' || doc_id || chr(10) || '## One' || chr(10) || text || chr(10) || '### Two' ELSE text END AS text FROM documents)")
def src17(spark, d):
    """Every third document gets headings, as the tables have none."""
    from lodestrata.sources import files

    n = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Title "), n, F.lit("\n## One\n"), "text", F.lit("\n### Two"))).otherwise(F.col("text"))
    m = files.documents(table(spark, d, "documents").select(F.concat(n, F.lit(".md")).alias("path"), text.alias("content")))
    return m.select(F.regexp_replace("path", r"\.md$", "").cast("long").alias("doc_id"), "title", F.size("sections").cast("long").alias("sections"), F.col("word_count").alias("words"))


TERMS = ["the", "and", "oring", "thion"]


def _bm25() -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(sorted(TERMS)))
    df = ", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
    s = " + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))" for i in range(len(TERMS)))
    hit = " + ".join(f"tf{i}" for i in range(len(TERMS)))
    return f"WITH b AS (SELECT doc_id, len(t) AS len, {tf} FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents)), s AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM b) SELECT doc_id, round({s}, 6) AS score FROM b, s WHERE {hit} > 0"


@register("search_bm25", _bm25())
def bm25(spark, d):
    return search.bm25(table(spark, d, "documents"), TERMS, None)


@register("search_bm25_topk", _bm25() + " ORDER BY score DESC, doc_id LIMIT 20")
def bm25k(spark, d):
    return search.bm25(table(spark, d, "documents"), TERMS, 20)


@register("search_inverted_index", "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term HAVING count(*) >= 3")
def index(spark, d):
    return search.terms(table(spark, d, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).filter("df >= 3")


@register("src21_corrections", f"SELECT conv_id AS session, turn AS pos, coalesce(nr = 'user' AND ({MARK}), false) AS had_correction FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant'")
def src21(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", "text", F.lit(None).cast("array<string>").alias("modified"))
    return sessions.corrections(c)


INTER = "it AS (SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS i, ts, event_id % 40 AS f, event_type FROM events)"


def interactions(spark, d):
    e = table(spark, d, "events")
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    f = (F.col("event_id") % 40).cast("string")
    return e.select(F.col("user_id").alias("session"), i.alias("i"), "ts", F.array(f).alias("referenced"), F.when(F.col("event_type") == "click", F.array(f)).otherwise(F.array().cast("array<string>")).alias("modified"), (F.col("event_type") == "error").alias("had_correction"), F.lit(1).alias("tool_uses"))


@register("src22_reverts", with_(INTER) + """, c AS (SELECT session, i, f FROM it WHERE event_type = 'click'),
h AS (SELECT DISTINCT a.session, a.i FROM c a JOIN c b ON b.session = a.session AND b.f = a.f AND b.i > a.i WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.session = a.session AND x.i > a.i AND x.i < b.i AND x.i - a.i >= 30))
SELECT it.session, it.i, h.i IS NOT NULL AS reverted FROM it LEFT JOIN h ON h.session = it.session AND h.i = it.i""")
def src22(spark, d):
    return sessions.reverts(interactions(spark, d), 30)


@register("src23_session_rollup", with_(INTER) + "SELECT session, count(*) AS interactions, count_if(event_type = 'error') AS corrections, count(*) AS tool_uses, CAST(count(DISTINCT f) AS INT) AS referenced_files, CAST(count(DISTINCT CASE WHEN event_type = 'click' THEN f END) AS INT) AS modified_files, round(count_if(event_type = 'error') / CAST(count(*) AS DOUBLE), 6) AS correction_rate FROM it GROUP BY session")
def src23(spark, d):
    return sessions.rollup(interactions(spark, d)).drop("started")


@register("src24_near_commits", "WITH s AS (SELECT user_id AS session, event_id % 40 AS file, min(ts) OVER (PARTITION BY user_id) AS ts FROM events), n AS (SELECT session, count(DISTINCT file) AS n FROM s GROUP BY session), c AS (SELECT event_id AS commit, ts, event_id % 40 AS file FROM events WHERE event_type = 'purchase') SELECT s.session, c.commit, count(DISTINCT s.file) AS shared, round(count(DISTINCT s.file) / CAST(any_value(n.n) AS DOUBLE), 6) AS confidence FROM s JOIN c ON c.file = s.file AND c.ts >= s.ts AND c.ts <= s.ts + INTERVAL 24 HOUR JOIN n ON n.session = s.session GROUP BY ALL")
def src24(spark, d):
    e = table(spark, d, "events")
    s = e.select(F.col("user_id").alias("session"), F.min("ts").over(W.partitionBy("user_id")).alias("ts"), (F.col("event_id") % 40).alias("file"))
    c = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("commit"), "ts", (F.col("event_id") % 40).alias("file"))
    return sessions.near_commits(s, c)


REFS = "rf AS (SELECT user_id AS session, event_id % 40 AS file, event_type = 'click' AS modified FROM events)"


def refs(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 40).alias("file"), (F.col("event_type") == "click").alias("modified"))


@register("a13_prompt_hotspots", with_(REFS) + "SELECT file, count(*) AS reference_count, count_if(modified) AS modification_count, count(DISTINCT session) AS session_count FROM rf GROUP BY file")
def a13(spark, d):
    return sessions.prompt_hotspots(refs(spark, d))


@register("a14_correction_hotspots", "SELECT file, correction_count, n AS interaction_count, round(CASE WHEN n > 0 THEN correction_count / CAST(n AS DOUBLE) ELSE 0 END, 6) AS correction_rate, n > 0 AND correction_count / CAST(n AS DOUBLE) > 0.2 AND correction_count >= 2 AS is_confusion_zone FROM (SELECT file, correction_count, coalesce(n, 1) AS n FROM (SELECT event_id % 997 AS file, count_if(event_type = 'click') AS correction_count, CAST(sum(CASE WHEN event_type <> 'view' THEN event_id % 4 END) AS BIGINT) AS n FROM events GROUP BY 1)) WHERE correction_count > 0")
def a14(spark, d):
    uses = table(spark, d, "events").select((F.col("event_id") % 997).alias("file"), (F.col("event_type") == "click").cast("int").alias("corrections"), F.when(F.col("event_type") != "view", F.col("event_id") % 4).alias("interactions"))
    return sessions.correction_hotspots(uses)


@register("a15_task_patterns", "SELECT files, count(*) AS frequency FROM (SELECT o_orderkey, list_sort(list(DISTINCT l_suppkey % 8)) AS files FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey) GROUP BY files HAVING count(*) >= 2")
def a15(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), (F.col("l_suppkey") % 8).alias("file"), F.lit(True).alias("modified"))
    return sessions.task_patterns(r)


@register("a16_domain_vocabulary", with_(REFS) + "SELECT file, list_sort(list(DISTINCT p_brand)) AS entities, any_value(n) AS reference_count FROM (SELECT file, count(*) AS n FROM rf GROUP BY file HAVING count(*) >= 2) JOIN part ON p_partkey % 40 = file GROUP BY file")
def a16(spark, d):
    e = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("file"), F.col("p_brand").alias("name"))
    return sessions.domain_vocabulary(refs(spark, d), e)


#: Texts as sources: some marks are put between the words, as there are none in the tables.
CODE = "SELECT doc_id, ['rust', 'python', 'go', 'java', 'ruby', 'swift', 'zig', 'text'][doc_id % 8 + 1] AS language, replace(replace(replace(replace(text, ' the ', ' catch '), ' and ', ' raise '), ' of ', '.unwrap()?'), ' la ', ' try ') || CASE WHEN doc_id % 3 = 0 THEN ' if err != nil Result<T> rescue x except y throw z .expect(' ELSE '' END AS content FROM documents"
_MARKS = [("rust", "? operator", "?"), ("rust", ".unwrap()", ".unwrap()"), ("rust", ".expect()", ".expect("), ("rust", "Result<T, E>", "Result<"), ("python", "try/except", "except "), ("python", "raise", "raise "), ("java", "try/catch", "catch "), ("java", "throw", "throw "), ("go", "if err != nil", "if err != nil"), ("ruby", "rescue", "rescue "), ("ruby", "raise", "raise "), ("swift", "do/catch", "catch "), ("swift", "throw", "throw "), ("swift", "try", "try "), ("zig", "try", "try "), ("zig", "catch", "catch ")]
ERRORS = f"WITH c AS ({CODE}), e AS (" + " UNION ALL ".join(f"SELECT language, '{n}' AS pattern, (length(content) - length(replace(content, '{m}', ''))) // {len(m)} AS n FROM c WHERE language = '{lang}'" for lang, n, m in _MARKS) + "), g AS (SELECT language, pattern, CAST(sum(n) AS BIGINT) AS count FROM e GROUP BY ALL HAVING sum(n) > 0)"


def code(spark, d):
    t = F.col("text")
    for a, b in ((" the ", " catch "), (" and ", " raise "), (" of ", ".unwrap()?"), (" la ", " try ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    lang = F.element_at(F.array(*map(F.lit, ["rust", "python", "go", "java", "ruby", "swift", "zig", "text"])), (F.col("doc_id") % 8).cast("int") + 1)
    return table(spark, d, "documents").select(lang.alias("language"), F.concat(t, F.when(F.col("doc_id") % 3 == 0, " if err != nil Result<T> rescue x except y throw z .expect(").otherwise("")).alias("content"))


@register("a19_error_marks", ERRORS + " SELECT * FROM g")
def a19(spark, d):
    return V.error_handling(code(spark, d))


@register("a19_error_approach", ERRORS + " SELECT pattern AS dominant_pattern, CASE WHEN contains(pattern, 'Result') OR contains(pattern, '?') THEN 'Result/Option type' WHEN contains(pattern, 'try') OR contains(pattern, 'except') THEN 'Exceptions' WHEN contains(pattern, 'if err') THEN 'Error return codes' ELSE 'mixed' END AS approach FROM (SELECT pattern, sum(count) AS n FROM g GROUP BY pattern ORDER BY n DESC, pattern LIMIT 1)")
def a19b(spark, d):
    return V.error_approach(V.error_handling(code(spark, d)))


@register("a21_rule_validation", "WITH f AS (SELECT lang AS language, source AS convention, count(*) AS count FROM documents GROUP BY ALL), t AS (SELECT language, convention AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY count DESC, convention) AS r FROM f) WHERE r = 1), s AS (SELECT unnest(['en', 'de', 'xx']) AS language, 'src0' AS convention) SELECT s.language, s.convention, dominant, CASE WHEN dominant IS NULL THEN 'unknown' WHEN dominant = s.convention THEN 'validated' ELSE 'drifted' END AS status FROM s LEFT JOIN t USING (language)")
def a21(spark, d):
    found = table(spark, d, "documents").groupBy(F.col("lang").alias("language"), F.col("source").alias("convention")).agg(F.count(F.lit(1)).alias("count"))
    stated = spark.range(1).select(F.explode(F.array(F.lit("en"), F.lit("de"), F.lit("xx"))).alias("language"), F.lit("src0").alias("convention"))
    return V.rule_validation(stated, found)


@register("event_windows", "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.unix_micros(F.col("w.start")).alias("start_us"), "event_type", "n", "total")


@register("contributor_sessions", "SELECT user_id, sid, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS length_us FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL")
def user_sessions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("new", F.when(F.col("us") - F.lag("us").over(w) <= 12 * 3_600_000_000, 0).otherwise(1)).withColumn("sid", F.sum("new").over(w))
    return e.groupBy("user_id", "sid").agg(F.count(F.lit(1)).alias("n"), (F.max("us") - F.min("us")).alias("length_us"))
