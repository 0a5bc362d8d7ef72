"""Queries over whole tables for every operator, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import decon, dedup, joins, lid, minhash, minhash_plain, mixture, splits, stats, translate, verify
from textloom.operators.components import components
from textloom.schemas import RELEASE, enforce
from textloom.sources import files, release
from textloom.workspace import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


# ---- SQL fragments --------------------------------------------------------------------------------------------------
def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sig(x: str) -> str:
    low = f"lower(replace({x}, 'և', 'եւ'))"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({low}, '\\p{{P}}', '', 'g'), '\\p{{Nd}}', '0', 'g'), '\\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"[w for w in string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' ') if w <> '']"


def _grams(w: str, n: int) -> str:
    return f"CASE WHEN len({w}) >= {n} THEN list_distinct([array_to_string({w}[i:i + {n - 1}], ' ') for i in range(1, len({w}) - {n - 2})]) ELSE [] END"


def _grams_short(w: str, n: int) -> str:
    return f"CASE WHEN len({w}) >= {n} THEN list_distinct([array_to_string({w}[i:i + {n - 1}], ' ') for i in range(1, len({w}) - {n - 2})]) ELSE [array_to_string({w}, ' ')] END"


def _seeded(seed: int, x: str) -> str:
    return f"md5('{seed}|' || {x}::VARCHAR)"


_SIGNED = f"SELECT doc_id, text, {_sig('text')} AS sig FROM documents"
_SPLIT_SQL = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test_iid' END"


def _split(df: DataFrame) -> DataFrame:
    m = F.col("doc_id") % 10
    return df.withColumn("split", F.when(m < 8, "train").when(m == 8, "val").otherwise("test_iid"))


# ---- cleaning and text functions ------------------------------------------------------------------------------------
@query(
    f"""WITH c AS (SELECT conv_id, turn, {_strip('role')} AS a, {_strip('text')} AS b FROM conversations),
    r AS (SELECT conv_id, turn, a, b, regexp_replace(regexp_replace(nfc_normalize(a || chr(10) || b), '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM c)
    SELECT conv_id, turn, text FROM r WHERE a <> '' AND b <> '' AND length(text) >= 100"""
)
def clean_document(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_document(F.col("role"), F.col("text")).alias("text"))
    return rows.where(F.col("text").isNotNull())


@query(f"SELECT doc_id, {_sig('text')} AS sig FROM documents")
def signature_view(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.signature_view(F.col("text")).alias("sig"))


@query("SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(text), '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents")
def release_view(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.release_view(F.col("text")).alias("text"))


@query(f"WITH w AS (SELECT doc_id, {_words(_sig('text'))} AS w FROM documents), g AS (SELECT doc_id, {_grams_short('w', 5)} AS g FROM w) SELECT doc_id, len(g)::BIGINT AS n, list_min(g) AS first FROM g")
def shingles_5(spark, sf_dir):
    g = T.ngrams(T.words(T.signature_view(F.col("text"))), 5, short=True)
    return _t(spark, sf_dir, "documents").select("doc_id", g.alias("g")).select("doc_id", F.size("g").cast("long").alias("n"), F.array_min("g").alias("first"))


@query(f"WITH w AS (SELECT doc_id, {_words(_sig('text'))} AS w FROM documents), g AS (SELECT doc_id, {_grams('w', 13)} AS g FROM w) SELECT doc_id, len(g)::BIGINT AS n, list_min(g) AS first FROM g")
def ngrams_13(spark, sf_dir):
    g = T.ngrams(T.words(T.signature_view(F.col("text"))), 13)
    return _t(spark, sf_dir, "documents").select("doc_id", g.alias("g")).select("doc_id", F.size("g").cast("long").alias("n"), F.array_min("g").alias("first"))


@query(
    f"""WITH s AS (SELECT doc_id, {_sig('text')} AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) >= 30 THEN len(list_distinct([substr(s, i, 30) for i in range(1, length(s) - 28)])) ELSE 1 END::BIGINT AS n FROM s"""
)
def char_shingles_30(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(T.char_ngrams(T.signature_view(F.col("text")), 30)).cast("long").alias("n"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN strftime(o_orderdate, '%Y-%m') >= '1998-01' THEN strftime(o_orderdate, '%Y-%m') ELSE 'unknown' END AS month,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, coalesce(nullif(o_orderpriority, ''), 'unknown') AS source FROM orders"""
)
def month_and_source(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(F.col("o_orderkey").alias("id"), T.month_of(F.date_format(ts, "yyyy-MM-dd")).alias("month"), T.iso(ts).alias("iso"), T.source_or_unknown(F.col("o_orderpriority")).alias("source"))


@query(
    f"""SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1000) AS snippet, translate(left(text, 200), '"' || chr(10), '''' || ' ') AS csv, strlen(text)::BIGINT AS bytes,
    nullif({_strip('source')}, '') AS source FROM documents"""
)
def snippets(spark, sf_dir):
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", T.snippet(t).alias("snippet"), T.csv_safe(t).alias("csv"), F.octet_length(t).cast("long").alias("bytes"), T.blank_to_null(F.col("source")).alias("source"))


@query(
    """WITH n AS (SELECT doc_id, regexp_extract_all(replace(text, '−', '-'), '[0-9][0-9,]*(?:\\.[0-9]+)?%?') AS a FROM documents)
    SELECT doc_id, CASE WHEN len(a) > 0 THEN rtrim(replace(replace(a[len(a)], ',', ''), '%', ''), '.') END AS number FROM n"""
)
def final_number(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.final_number(F.col("text")).alias("number"))


@query(
    f"""WITH l AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if {_strip('x')} <> ''] AS l, string_split(text, ':') AS c FROM documents),
    m AS (SELECT doc_id, coalesce({_strip('l[len(l)]')}, '') AS token, upper(left(regexp_replace({_strip('c[len(c)]')}, '^[()]+|[()]+$', '', 'g'), 1)) AS letter FROM l)
    SELECT doc_id, token, nullif(letter, '') AS letter FROM m"""
)
def final_token_and_letter(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.final_token(F.col("text")).alias("token"), T.choice_letter(F.col("text")).alias("letter"))


_ANSWER = "text || CASE WHEN doc_id % 3 = 0 THEN ' The Answer is (C).' WHEN doc_id % 3 = 1 THEN ' so \\boxed{B}' ELSE '' END"
_EXPECTED = "CASE WHEN doc_id % 7 = 0 THEN '(D)' WHEN doc_id % 7 = 1 THEN 'maybe' ELSE '' END"


@query(
    f"""WITH a AS (SELECT doc_id, right({_ANSWER}, 400) AS o, {_EXPECTED} AS e FROM documents)
    SELECT doc_id, CASE WHEN e <> '' THEN nullif(regexp_extract({_strip('e')}, '^\\(?([A-J])\\)?$', 1), '')
    ELSE coalesce(nullif(regexp_extract(o, '(?i)answer is \\(?([A-J])\\)?', 1), ''), nullif(regexp_extract(o, 'boxed\\{{?\\(?([A-J])\\)?\\}}?', 1), '')) END AS answer FROM a"""
)
def final_answer(spark, sf_dir):
    m3, m7 = F.col("doc_id") % 3, F.col("doc_id") % 7
    out = F.concat("text", F.when(m3 == 0, " The Answer is (C).").when(m3 == 1, " so \\boxed{B}").otherwise(""))
    expected = F.when(m7 == 0, "(D)").when(m7 == 1, "maybe").otherwise("")
    return _t(spark, sf_dir, "documents").select("doc_id", T.final_answer(out, expected).alias("answer"))


@query(
    f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 50) || '</think> ' || text ELSE text END AS o FROM documents)
    SELECT doc_id, left(CASE WHEN strpos(o, '</think>') > 0 THEN {_strip("substr(o, strpos(o, '</think>') + 8)")} ELSE right(o, 500) END, 1200) AS rest FROM a"""
)
def post_think(spark, sf_dir):
    o = F.when(F.col("doc_id") % 2 == 0, F.concat(F.left("text", F.lit(50)), F.lit("</think> "), "text")).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", T.post_think(o).alias("rest"))


@query("WITH a AS (SELECT doc_id, regexp_extract_all(text, '[1-5]') AS a FROM documents) SELECT doc_id, CASE WHEN len(a) > 0 THEN a[len(a)]::INTEGER END AS score FROM a")
def judge_score(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.last_score(F.col("text")).alias("score"))


@query("SELECT item_id, replace(text || ' ' || array_to_string(string_split(left(text, 20), ' '), ' '), chr(10), ' ') AS text FROM benchmark")
def benchmark_text(spark, sf_dir):
    options = F.split(F.left("text", F.lit(20)), " ")
    return _t(spark, sf_dir, "benchmark").select("item_id", T.benchmark_text(F.col("text"), options).alias("text"))


@query("SELECT doc_id, text, lang AS answer, 'os2' AS src FROM documents WHERE NOT contains(source, 'src1') AND length(text) >= 200")
def science_rows(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where(~F.col("source").contains("src1") & (F.char_length("text") >= 200))
    return files.science_rows(docs.withColumnRenamed("lang", "answer"), "os2", ("doc_id", "text", "answer"))


# ---- exact dedup, clusters, paragraphs ------------------------------------------------------------------------------
_EXACT = f"""s AS ({_SIGNED}), r AS (SELECT doc_id, sig, length(text) AS chars, row_number() OVER (PARTITION BY sig ORDER BY length(text) DESC, doc_id) AS k,
    count(*) OVER (PARTITION BY sig) AS count, min(doc_id) OVER (PARTITION BY sig) AS first_seen FROM s)"""


@query(f"WITH {_EXACT} SELECT doc_id, chars::BIGINT AS chars, count, first_seen FROM r WHERE k = 1")
def exact_dedup_survivors(spark, sf_dir):
    return dedup.exact_survivors(_t(spark, sf_dir, "documents"), T.signature_view(F.col("text"))).drop("sig")


@query(f"WITH {_EXACT} SELECT r.doc_id, d.text, d.lang, d.source, d.n_chars, r.count, r.first_seen FROM r JOIN documents d USING (doc_id) WHERE k = 1")
def exact_survivor_texts(spark, sf_dir):
    """The winners of exact de-duplication with their texts joined back."""
    docs = _t(spark, sf_dir, "documents")
    return dedup.with_texts(dedup.exact_survivors(docs, T.signature_view(F.col("text"))).drop("sig", "chars"), docs)


_BANDS, _ROWS = 4, 4
_PAIRS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(minhash_plain.coefficients(_BANDS * _ROWS)))
_LSH = f"""w AS (SELECT doc_id, {_words('sig')} AS w FROM r WHERE k = 1), g AS (SELECT doc_id, unnest({_grams_short('w', 5)}) AS g FROM w),
    h AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 7))::BIGINT AS h FROM g), c(p, a, b) AS (VALUES {_PAIRS}),
    m AS (SELECT doc_id, p, min((a * h + b) % {minhash_plain.PRIME}) AS m FROM h, c GROUP BY ALL),
    bk AS (SELECT doc_id, p // {_ROWS} AS band, string_agg(m::VARCHAR, '-' ORDER BY p) AS key FROM m GROUP BY ALL),
    e AS (SELECT DISTINCT x.a, bk.doc_id AS b FROM bk JOIN (SELECT band, key, min(doc_id) AS a FROM bk GROUP BY ALL HAVING count(*) > 1) x USING (band, key) WHERE bk.doc_id <> x.a)"""
_ROOTS = f"""{_LSH}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS seen FROM u UNION SELECT reach.node, u.b FROM reach JOIN u ON reach.seen = u.a),
    roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)"""
_CLUSTERED = f"""{_ROOTS}, named AS (SELECT r.*, coalesce(root, doc_id) AS cluster FROM r LEFT JOIN roots ON node = doc_id WHERE k = 1),
    best AS (SELECT doc_id, cluster AS dedup_cluster_id, sum(count) OVER (PARTITION BY cluster)::BIGINT AS cluster_size, count(*) OVER (PARTITION BY cluster) AS members,
    row_number() OVER (PARTITION BY cluster ORDER BY chars DESC, first_seen, doc_id) AS t FROM named)"""


def _signed(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """docs' ids, ``keep`` and sig, the text in signature view, which what follows computes once."""
    return docs.select(F.col("doc_id").alias("id"), *keep, T.signature_view(F.col("text")).alias("sig"))


def _production_bands(rows: DataFrame) -> DataFrame:
    """rows with bands in place of sig: 14 of 8 rows over 64-bit hashes, which SQL cannot follow."""
    return minhash.banded_texts(rows)


def _plain_hash() -> Column:
    return minhash_plain.least_hash(T.word_runs(F.col("sig"), 5))


def _reps_and_bands(spark, sf_dir, production: bool) -> tuple[DataFrame, DataFrame]:
    """Representatives and their bands. Texts are read once: bands depend on the signature, so any of its rows has them."""
    signed = _signed(_t(spark, sf_dir, "documents"), F.char_length("text").cast("long").alias("chars"))
    hashed = signed.select("id", "chars", F.sha2("sig", 256).alias("hash"), "sig")
    if production:
        rows, also = _production_bands(hashed), "bands"
    else:
        rows, also = hashed.select("id", "chars", "hash", _plain_hash().alias("h")), "h"
    reps = written(dedup.signed_survivors(rows.withColumnRenamed("hash", "sig"), also).withColumnRenamed("id", "doc_id"), "reps")
    placed = reps.select("doc_id", also)
    return reps.drop(also), placed if production else minhash_plain.with_bands(minhash_plain.least(placed), _BANDS, _ROWS)


def _clusters(spark, sf_dir, production: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Representatives, edges' roots and survivors, in the configuration that SQL can follow or in that of production."""
    reps, placed = _reps_and_bands(spark, sf_dir, production)
    roots = written(components(minhash.bucket_edges(placed)), "roots")
    return reps, roots, dedup.cluster_survivors(reps, roots)


@query(f"WITH {_EXACT}, {_LSH} SELECT a, b FROM e")
def minhash_candidate_pairs(spark, sf_dir):
    return minhash.bucket_edges(_reps_and_bands(spark, sf_dir, False)[1])


@query(f"WITH RECURSIVE {_EXACT}, {_ROOTS} SELECT node, root FROM roots")
def connected_components(spark, sf_dir):
    return _clusters(spark, sf_dir)[1]


@query(f"WITH RECURSIVE {_EXACT}, {_CLUSTERED} SELECT doc_id, dedup_cluster_id, cluster_size, members FROM best WHERE t = 1")
def fuzzy_survivors(spark, sf_dir):
    return _clusters(spark, sf_dir)[2]


@query(
    f"""WITH RECURSIVE {_EXACT}, {_CLUSTERED} SELECT sum(cluster_size)::BIGINT AS input_docs, (sum(cluster_size) - sum(members))::BIGINT AS exact_removed,
    (sum(members) - count(*))::BIGINT AS fuzzy_removed, count(*) AS survivors, count(*) FILTER (cluster_size > 1) AS clusters_over_1 FROM best WHERE t = 1"""
)
def dedup_stats(spark, sf_dir):
    reps, _, best = _clusters(spark, sf_dir)
    return dedup.dedup_stats(reps, best)


@query(f"WITH RECURSIVE {_EXACT}, {_CLUSTERED} SELECT dedup_cluster_id, cluster_size FROM best WHERE t = 1 ORDER BY cluster_size DESC, dedup_cluster_id LIMIT 50")
def topk_clusters(spark, sf_dir):
    return dedup.top_clusters(_clusters(spark, sf_dir)[2])


@query(f"WITH RECURSIVE {_EXACT}, {_CLUSTERED} SELECT cluster_size, count(*) AS clusters FROM best WHERE t = 1 GROUP BY cluster_size")
def cluster_hist(spark, sf_dir):
    return stats.cluster_histogram(_clusters(spark, sf_dir)[2])


@query(
    f"""WITH RECURSIVE {_EXACT}, {_ROOTS}, top AS (SELECT root, count(*) AS n FROM roots GROUP BY root ORDER BY n DESC, root LIMIT 20)
    SELECT root AS dedup_cluster_id, n, doc_id, left(text, 2000) AS head FROM roots JOIN top USING (root) JOIN documents ON doc_id = node"""
)
def cluster_sample(spark, sf_dir):
    return dedup.cluster_sample(_t(spark, sf_dir, "documents"), _clusters(spark, sf_dir)[1])


@query(
    f"""WITH RECURSIVE {_EXACT}, {_ROOTS}, top AS (SELECT root, count(*) AS n FROM roots GROUP BY root ORDER BY n DESC, root LIMIT 20)
    SELECT root AS dedup_cluster_id, count(*) AS sampled, translate(left(arg_min(text, doc_id), 200), '"' || chr(10), '''' || ' ') AS example
    FROM roots JOIN top USING (root) JOIN documents ON doc_id = node GROUP BY root"""
)
def cluster_review(spark, sf_dir):
    return dedup.cluster_review(dedup.cluster_sample(_t(spark, sf_dir, "documents"), _clusters(spark, sf_dir)[1]))


def _copies(spark, sf_dir) -> DataFrame:
    """doc_id, dup: whether another document has the same text."""
    copies = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return copies.join(copies.groupBy("h").agg((F.count("*") > 1).alias("dup")), "h").select("doc_id", "dup")


@query()
def production_lsh(spark, sf_dir):
    """14 bands of 8 rows over 64-bit hashes, as used in production; tests hold it against a plain version."""
    return components(minhash.bucket_edges(written(_production_bands(_signed(_t(spark, sf_dir, "documents"))), "bands"), "id"))


# The queries above follow SQL with 4 bands of 4 rows. Those below decide on near duplicates as production does.
@query()
def production_candidate_pairs(spark, sf_dir):
    return minhash.bucket_edges(_reps_and_bands(spark, sf_dir, True)[1])


@query()
def production_components(spark, sf_dir):
    return _clusters(spark, sf_dir, True)[1]


@query()
def production_survivors(spark, sf_dir):
    return _clusters(spark, sf_dir, True)[2]


@query()
def production_dedup_stats(spark, sf_dir):
    reps, _, best = _clusters(spark, sf_dir, True)
    return dedup.dedup_stats(reps, best)


@query()
def production_topk_clusters(spark, sf_dir):
    return dedup.top_clusters(_clusters(spark, sf_dir, True)[2])


@query()
def production_cluster_hist(spark, sf_dir):
    return stats.cluster_histogram(_clusters(spark, sf_dir, True)[2])


@query()
def production_cluster_sample(spark, sf_dir):
    return dedup.cluster_sample(_t(spark, sf_dir, "documents"), _clusters(spark, sf_dir, True)[1])


@query()
def production_cluster_review(spark, sf_dir):
    return dedup.cluster_review(dedup.cluster_sample(_t(spark, sf_dir, "documents"), _clusters(spark, sf_dir, True)[1]))


@query()
def production_audit_verdicts(spark, sf_dir):
    return joins.audit_verdicts(_t(spark, sf_dir, "documents"), _clusters(spark, sf_dir, True)[2])


@query()
def production_audit_agreement(spark, sf_dir):
    return joins.agreement(joins.audit_verdicts(_t(spark, sf_dir, "documents"), _clusters(spark, sf_dir, True)[2]), _copies(spark, sf_dir))


_PARTS = f"""p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    q AS (SELECT doc_id, pos, p, CASE WHEN len({_words('p')}) >= 13 THEN {_sig('p')} END AS key FROM p WHERE {_strip('p')} <> ''),
    f AS (SELECT key, count(DISTINCT doc_id) AS df, min(p) AS example FROM q WHERE key IS NOT NULL GROUP BY key)"""


@query(f"WITH {_PARTS} SELECT sha256(key) AS key, df, example FROM f")
def paragraph_df(spark, sf_dir):
    return dedup.paragraph_frequency(_t(spark, sf_dir, "documents"), "\n")


@query(
    f"""WITH {_PARTS}, j AS (SELECT q.doc_id, count(*) FILTER (f.df >= 3) AS removed, string_agg(p, chr(10) ORDER BY pos) FILTER (f.df IS NULL OR f.df < 3) AS kept FROM q LEFT JOIN f USING (key) GROUP BY q.doc_id),
    o AS (SELECT d.doc_id, CASE WHEN j.removed > 0 THEN coalesce(j.kept, '') ELSE d.text END AS text, coalesce(j.removed, 0) AS removed FROM documents d LEFT JOIN j USING (doc_id))
    SELECT doc_id, text, removed FROM o WHERE length(text) >= 100"""
)
def paragraph_strip(spark, sf_dir):
    return dedup.strip_boilerplate(_t(spark, sf_dir, "documents"), "\n", min_docs=3)


@query(
    f"""WITH {_PARTS}, j AS (SELECT q.doc_id, count(*) FILTER (f.df >= 3) AS removed, string_agg(p, chr(10) ORDER BY pos) FILTER (f.df IS NULL OR f.df < 3) AS kept FROM q LEFT JOIN f USING (key) GROUP BY q.doc_id),
    o AS (SELECT CASE WHEN j.removed > 0 THEN coalesce(j.kept, '') ELSE d.text END AS text, coalesce(j.removed, 0) AS removed FROM documents d LEFT JOIN j USING (doc_id))
    SELECT sum(removed)::BIGINT AS paragraphs_removed, count(*) FILTER (removed > 0) AS docs_touched, count(*) FILTER (coalesce(length(text), 0) < 100) AS docs_dropped FROM o"""
)
def paragraph_report(spark, sf_dir):
    return dedup.strip_report(_t(spark, sf_dir, "documents"), "\n", min_docs=3)


@query(f"WITH {_PARTS} SELECT left(example, 80) AS head, sum(df)::BIGINT AS df FROM f WHERE df >= 3 GROUP BY head ORDER BY df DESC, head LIMIT 20")
def boilerplate_top(spark, sf_dir):
    return dedup.boilerplate_top(_t(spark, sf_dir, "documents"), "\n", min_docs=3)


# ---- decontamination ------------------------------------------------------------------------------------------------
_HITS = f"""dw AS (SELECT doc_id, {_words(_sig('text'))} AS w FROM documents), dg AS (SELECT doc_id, unnest({_grams('w', 13)}) AS g FROM dw),
    bw AS (SELECT 'b' || (item_id % 10)::VARCHAR AS bench, {_words(_sig('text'))} AS w FROM benchmark), bg AS (SELECT DISTINCT bench, unnest({_grams('w', 13)}) AS g FROM bw),
    hits AS (SELECT DISTINCT doc_id, bench FROM dg JOIN bg USING (g))"""


def _bench(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").withColumn("bench", F.concat(F.lit("b"), (F.col("item_id") % 10).cast("string")))


def _hits(spark, sf_dir) -> DataFrame:
    return decon.hits(_t(spark, sf_dir, "documents"), written(decon.index(_bench(spark, sf_dir)), "grams"))


@query(f"WITH {_HITS} SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)")
def decon_survivors(spark, sf_dir):
    return decon.survivors(_t(spark, sf_dir, "documents"), _hits(spark, sf_dir)).select("doc_id", "text")


@query(f"WITH {_HITS} SELECT b.bench, count(hits.doc_id) AS hits FROM (SELECT DISTINCT bench FROM bw) b LEFT JOIN hits USING (bench) GROUP BY b.bench")
def decon_hits_by_bench(spark, sf_dir):
    return decon.hits_by_bench(_bench(spark, sf_dir), _hits(spark, sf_dir))


@query(f"WITH {_HITS} SELECT count(DISTINCT doc_id) AS dropped, (SELECT count(*) FROM documents) - count(DISTINCT doc_id) AS kept, count(*) AS bench_hits FROM hits")
def decon_stats(spark, sf_dir):
    return decon.stats(_t(spark, sf_dir, "documents"), _hits(spark, sf_dir))


# ---- labels, routes, samples, sets ----------------------------------------------------------------------------------
@query("SELECT lang AS lid, CASE WHEN lang IN ('en', 'fr') THEN 'keep' ELSE 'quarantine' END AS route, count(*) AS docs FROM documents GROUP BY ALL")
def lid_route_hist(spark, sf_dir):
    return stats.label_histogram(joins.route(_t(spark, sf_dir, "documents").withColumnRenamed("lang", "lid"), ("en", "fr")))


@query(
    """SELECT count(*) FILTER (quality = 1) AS kept, count(*) FILTER (quality IS NULL) AS missing, count(*) FILTER (quality <> 1) AS dropped
    FROM documents LEFT JOIN labels USING (doc_id)"""
)
def lid_label_lookup(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("pos"))
    found = joins.with_labels(_t(spark, sf_dir, "documents").select("doc_id"), labels, "pos")
    k = F.col("label")
    return found.agg(F.count_if(k == 1).alias("kept"), F.count_if(k.isNull()).alias("missing"), F.count_if(k != 1).alias("dropped"))


@query()
def lid_profile(spark, sf_dir):
    """The plug-in classifier on every row, trained on a few rows of each language; accuracy is tested.

    It reads the first 1,000 characters of a text with white space collapsed: that head is the operator's own definition.
    """
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = joins.stratified_sample(docs.where("lang IS NOT NULL"), "lang", 40).collect()
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r["lang"], []).append(r["text"])
    return docs.select("doc_id", "lang", lid.label(F.col("text"), lid.profile(samples), chars=1000).alias("l")).select("doc_id", "lang", F.col("l.label").alias("lid"))


@query(f"SELECT doc_id FROM documents WHERE ('0x' || substr({_seeded(42, 'doc_id')}, 1, 8))::BIGINT < {int(0.1 * (1 << 32))}")
def hash_sample(spark, sf_dir):
    return joins.hash_sample(_t(spark, sf_dir, "documents").select("doc_id"), 0.1)


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_seeded(42, 'doc_id')}, doc_id) <= 5")
def stratified_sample(spark, sf_dir):
    return joins.stratified_sample(_t(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5)


@query(f"SELECT doc_id FROM documents ORDER BY {_seeded(42, 'doc_id')}, doc_id LIMIT 100")
def random_sample(spark, sf_dir):
    return joins.random_sample(_t(spark, sf_dir, "documents").select("doc_id"), 100)


@query("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return joins.resume(_t(spark, sf_dir, "documents").select("doc_id", "text"), _t(spark, sf_dir, "labels"), id_col="doc_id")


@query("SELECT doc_id, documents.doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents) AS in_a, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS in_b FROM documents")
def set_flags(spark, sf_dir):
    return joins.set_flags(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").where("quality = 1"))


@query(f"WITH RECURSIVE {_EXACT}, {_CLUSTERED}, v AS (SELECT doc_id, cluster_size FROM best WHERE t = 1) SELECT d.doc_id, v.cluster_size IS NULL OR v.cluster_size > 1 AS dup FROM documents d LEFT JOIN v USING (doc_id)")
def audit_verdicts(spark, sf_dir):
    return joins.audit_verdicts(_t(spark, sf_dir, "documents"), _clusters(spark, sf_dir)[2])


@query(
    f"""WITH RECURSIVE {_EXACT}, {_CLUSTERED}, v AS (SELECT doc_id, cluster_size FROM best WHERE t = 1), a AS (SELECT d.doc_id, v.cluster_size IS NULL OR v.cluster_size > 1 AS x FROM documents d LEFT JOIN v USING (doc_id)),
    b AS (SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS y FROM documents)
    SELECT count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b, count(*) FILTER (NOT x AND NOT y) AS neither,
    round(count(*) FILTER (x = y) / count(*)::DOUBLE, 4) AS agreement FROM a JOIN b USING (doc_id)"""
)
def audit_agreement(spark, sf_dir):
    return joins.agreement(joins.audit_verdicts(_t(spark, sf_dir, "documents"), _clusters(spark, sf_dir)[2]), _copies(spark, sf_dir))


@query("WITH f AS (SELECT page_id, url, strlen(html) AS size FROM pages), c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f) SELECT page_id, url, size::BIGINT AS size FROM c WHERE before < 100000")
def byte_budget_take(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", F.octet_length("html").cast("long").alias("size"))
    return joins.byte_budget(pages, 100_000, "url")


@query("SELECT 'web_' || (row_number() OVER (ORDER BY url) - 1)::VARCHAR AS id, page_id FROM pages")
def numbered_ids(spark, sf_dir):
    # page_id places rows of one url, which SQL's order leaves open, so ids do not depend on partitions.
    return joins.numbered(_t(spark, sf_dir, "pages").select("page_id", "url"), "web", "url", "page_id").select("id", "page_id")


@query(
    """WITH w AS (SELECT unnest(string_split(text, ' ')) AS piece FROM documents), c AS (SELECT piece, count(*) AS score FROM w GROUP BY piece),
    b AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS piece FROM benchmark)
    SELECT piece, score FROM c WHERE NOT starts_with(piece, '<') AND length(piece) >= 2 AND piece NOT IN (SELECT piece FROM b) ORDER BY score DESC, piece DESC LIMIT 200"""
)
def new_vocabulary(spark, sf_dir):
    pieces = lambda name: _t(spark, sf_dir, name).select(F.explode(F.split("text", " ")).alias("piece"))
    return joins.new_pieces(pieces("documents").groupBy("piece").agg(F.count("*").alias("score")), pieces("benchmark").distinct(), 200)


# ---- splits and gates -----------------------------------------------------------------------------------------------
_DATED = "k AS (SELECT o_orderkey AS id, coalesce(nullif(o_orderpriority, ''), 'unknown') AS source, CASE WHEN strftime(o_orderdate, '%Y-%m') >= '1998-01' THEN strftime(o_orderdate, '%Y-%m') ELSE 'unknown' END AS month FROM orders)"


def _dated(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("post_date"))


@query(f"WITH {_DATED} SELECT DISTINCT month FROM k WHERE month <> 'unknown' ORDER BY month DESC LIMIT 2")
def tail_months(spark, sf_dir):
    return splits.tail_months(_dated(spark, sf_dir).select(T.month_of(F.col("post_date")).alias("month")))


def _quota_sql(name: str, left: str, source: str, n: int) -> str:
    return f"""{name}1 AS (SELECT source, month, n, {left} AS l, sum({left}) OVER () AS total FROM {source}), {name}2 AS (SELECT *, floor({n} * l::DOUBLE / total)::BIGINT AS share FROM {name}1 WHERE total > 0),
    {name}3 AS (SELECT *, {n} - sum(share) OVER () AS spare, sum(CASE WHEN l > share THEN 1 ELSE 0 END) OVER (ORDER BY source, month) AS turn FROM {name}2),
    {name} AS (SELECT source, month, least(share + CASE WHEN l > share AND turn <= spare THEN 1 ELSE 0 END, l) AS q FROM {name}3)"""


_ASSIGN = f"""{_DATED}, tm AS (SELECT DISTINCT month FROM k WHERE month <> 'unknown' ORDER BY month DESC LIMIT 2), m AS (SELECT *, month IN (SELECT month FROM tm) AS late, {_seeded(1337, 'id')} AS turn FROM k),
    late AS (SELECT id, source, month, CASE WHEN row_number() OVER (ORDER BY turn, id) <= 100 THEN 'test_tail' ELSE 'train' END AS split FROM m WHERE late),
    pool AS (SELECT *, row_number() OVER (PARTITION BY source, month ORDER BY turn, id) AS r FROM m WHERE NOT late), st AS (SELECT source, month, count(*) AS n FROM pool GROUP BY ALL),
    {_quota_sql('qv', 'n', 'st', 500)}, st2 AS (SELECT st.*, coalesce(q, 0) AS v FROM st LEFT JOIN qv USING (source, month)), {_quota_sql('qt', '(n - v)', 'st2', 500)},
    fin AS (SELECT id, source, month, split FROM late UNION ALL SELECT id, pool.source, pool.month, CASE WHEN r <= v THEN 'val' WHEN r <= v + coalesce(q, 0) THEN 'test_iid' ELSE 'train' END
    FROM pool JOIN st2 USING (source, month) LEFT JOIN qt USING (source, month))"""


@query(f"WITH {_ASSIGN} SELECT id, source, month, split FROM fin")
def split_assign(spark, sf_dir):
    return splits.assign(_dated(spark, sf_dir), 500, 500, 2, 100)


@query(f"WITH {_ASSIGN} SELECT split, count(*) AS docs, count(DISTINCT source) AS sources, count(DISTINCT month) AS months FROM fin GROUP BY split")
def split_counts(spark, sf_dir):
    return splits.split_counts(splits.assign(_dated(spark, sf_dir), 500, 500, 2, 100))


_OVERLAP = f"""s AS (SELECT DISTINCT {_SPLIT_SQL} AS s, {_sig('text')} AS h FROM documents), n AS (SELECT DISTINCT s FROM s),
    ov AS (SELECT x.s AS a, y.s AS b, (SELECT count(*) FROM s p JOIN s q USING (h) WHERE p.s = x.s AND q.s = y.s) AS shared FROM n x JOIN n y ON x.s < y.s)"""


@query(f"WITH {_OVERLAP} SELECT a, b, shared FROM ov")
def exact_overlap_matrix(spark, sf_dir):
    return verify.exact_overlaps(_split(_t(spark, sf_dir, "documents")))


@query(
    f"""WITH p AS (SELECT {_SPLIT_SQL} AS split, unnest(string_split(text, chr(10))) AS p FROM documents), h AS (SELECT split, {_sig('p')} AS h FROM p WHERE len({_words('p')}) >= 13),
    sm AS (SELECT DISTINCT split, h FROM h WHERE split <> 'train'), n AS (SELECT DISTINCT split FROM p WHERE split <> 'train'),
    c AS (SELECT sm.split, count(*) AS leaks FROM sm JOIN (SELECT h FROM h WHERE split = 'train') t USING (h) GROUP BY sm.split)
    SELECT n.split, coalesce(leaks, 0) AS leaks FROM n LEFT JOIN c USING (split)"""
)
def paragraph_leaks(spark, sf_dir):
    return verify.paragraph_leaks(_split(_t(spark, sf_dir, "documents")), sep="\n")


_NEAR = f"""r AS (SELECT doc_id, {_sig('text')} AS sig, 1 AS k, {_SPLIT_SQL} AS split FROM documents), {_LSH},
    x AS (SELECT bk.*, split FROM bk JOIN r USING (doc_id)), hit AS (SELECT DISTINCT split, doc_id FROM x WHERE split <> 'train' AND (band, key) IN (SELECT (band, key) FROM x WHERE split = 'train')),
    near AS (SELECT t.split, n, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / n::DOUBLE, 6) AS rate FROM (SELECT split, count(*) AS n FROM r WHERE split <> 'train' GROUP BY split) t LEFT JOIN (SELECT split, count(*) AS hits FROM hit GROUP BY split) USING (split))"""


def _near(spark, sf_dir, production: bool = False) -> DataFrame:
    signed = _signed(_split(_t(spark, sf_dir, "documents")), "split")
    if production:
        placed = written(_production_bands(signed), "bands")
    else:
        least = minhash_plain.least(signed.select("id", "split", _plain_hash().alias("h")), "id", ("split",))
        placed = minhash_plain.with_bands(written(least, "least"), _BANDS, _ROWS)
    return minhash.near_rate(placed.where("split = 'train'"), placed.where("split <> 'train'"), id_col="id")


@query(f"WITH {_NEAR} SELECT split, n, hits, rate FROM near")
def near_dup_rate(spark, sf_dir):
    return _near(spark, sf_dir)


@query(f"WITH {_NEAR}, {_OVERLAP.replace('s AS (', 'sg AS (', 1).replace('FROM s)', 'FROM sg)').replace('FROM s p JOIN s q', 'FROM sg p JOIN sg q')} SELECT (SELECT bool_and(shared = 0) FROM ov) AS exact_ok, (SELECT bool_and(rate < 0.001) FROM near) AS near_ok, (SELECT bool_and(shared = 0) FROM ov) AND (SELECT bool_and(rate < 0.001) FROM near) AS pass")
def gate_report(spark, sf_dir):
    return verify.gate_report(verify.exact_overlaps(_split(_t(spark, sf_dir, "documents"))), _near(spark, sf_dir))


@query()
def production_near_rate(spark, sf_dir):
    return _near(spark, sf_dir, True)


@query()
def production_gate_report(spark, sf_dir):
    return verify.gate_report(verify.exact_overlaps(_split(_t(spark, sf_dir, "documents"))), _near(spark, sf_dir, True))


# ---- statistics -----------------------------------------------------------------------------------------------------
@query(
    """WITH s AS (SELECT 0 AS stage_no, 'raw' AS stage, count(*) AS docs, sum(strlen(text)) AS bytes FROM documents UNION ALL SELECT 1, 'long', count(*), sum(strlen(text)) FROM documents WHERE length(text) >= 100
    UNION ALL SELECT 2, 'english', count(*), sum(strlen(text)) FROM documents WHERE length(text) >= 100 AND lang = 'en')
    SELECT stage_no, stage, docs, bytes::BIGINT AS bytes, round(100.0::DOUBLE * docs / nullif(lag(docs) OVER (ORDER BY stage_no), 0), 2) AS docs_pct_of_prev,
    round(100.0::DOUBLE * bytes / nullif(lag(bytes) OVER (ORDER BY stage_no), 0), 2) AS bytes_pct_of_prev FROM s"""
)
def funnel(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    size = F.octet_length("text").cast("long")
    stage = lambda no, name, df: df.agg(F.count("*").alias("docs"), F.sum(size).alias("bytes")).select(F.lit(no).alias("stage_no"), F.lit(name).alias("stage"), "docs", "bytes")
    long = docs.where(F.char_length("text") >= 100)
    return stats.funnel(stage(0, "raw", docs).unionByName(stage(1, "long", long)).unionByName(stage(2, "english", long.where("lang = 'en'"))))


_EDGES = "[" + ", ".join(f"{10 ** (i / 10)!r}::DOUBLE" for i in range(20, 55)) + "]"


@query(
    f"""WITH e AS (SELECT {_EDGES} AS e), b AS (SELECT CASE WHEN length(text)::DOUBLE = e[35] THEN 34 ELSE len([x for x in e if x <= length(text)]) END AS bin FROM documents, e)
    SELECT (bin - 1 + 20)::BIGINT AS bin, count(*) AS docs FROM b WHERE bin BETWEEN 1 AND 34 GROUP BY bin"""
)
def length_hist(spark, sf_dir):
    return stats.length_histogram(_t(spark, sf_dir, "documents"))


@query(
    """WITH l AS (SELECT list(length(text) ORDER BY length(text)) AS l, count(*) AS n, sum(length(text)) AS t FROM documents)
    SELECT n AS docs, l[n // 2 + 1]::BIGINT AS median_chars, l[floor(n * 0.9::DOUBLE)::BIGINT + 1]::BIGINT AS p90_chars, t::BIGINT AS total_chars FROM l"""
)
def length_stats(spark, sf_dir):
    return stats.length_stats(_t(spark, sf_dir, "documents"))


@query(f"WITH {_DATED} SELECT source, count(*) AS docs, round(avg(coalesce(CASE WHEN id % 5 = 0 THEN id % 7 END, 1)::DOUBLE), 3) AS mean_cluster_size FROM k GROUP BY source")
def source_stats(spark, sf_dir):
    return stats.by_source(_dated(spark, sf_dir).withColumn("cluster_size", F.when(F.col("id") % 5 == 0, F.col("id") % 7)))


@query(f"WITH {_DATED} SELECT month, count(*) AS docs, round(avg(coalesce(CASE WHEN id % 5 = 0 THEN id % 7 END, 1)::DOUBLE), 3) AS mean_cluster_size FROM k GROUP BY month")
def month_stats(spark, sf_dir):
    return stats.by_month(_dated(spark, sf_dir).withColumn("cluster_size", F.when(F.col("id") % 5 == 0, F.col("id") % 7)))


@query(
    """WITH c AS (SELECT len(regexp_extract_all(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.]+')) AS e,
    len(regexp_extract_all(text, '(\\+374|00374|0)\\s?\\p{Nd}{2}\\s?\\p{Nd}{2}\\s?\\p{Nd}{2}\\s?\\p{Nd}{2}')) AS p FROM documents)
    SELECT count(*) AS docs, sum(e)::BIGINT AS emails, count(*) FILTER (e > 0) AS docs_with_email, sum(p)::BIGINT AS phones_matched, count(*) FILTER (p > 0) AS docs_with_phone FROM c"""
)
def pii_scan(spark, sf_dir):
    return stats.pii_scan(_t(spark, sf_dir, "documents"))


@query(
    f"""WITH s AS (SELECT sum(len(string_split(text, ' '))) AS t, sum(len({_words('text')})) AS w, sum(strlen(text)) AS b FROM documents)
    SELECT 'spaces' AS tokenizer, round(t::DOUBLE / w, 4) AS tokens_per_word, round(t::DOUBLE / b, 4) AS tokens_per_byte, round(b::DOUBLE / t, 3) AS bytes_per_token FROM s"""
)
def fertility(spark, sf_dir):
    return stats.fertility(_t(spark, sf_dir, "documents"), F.size(F.split("text", " ")), "spaces")


@query(
    """WITH s AS (SELECT source AS panel, sum(length(text) * 0.7::DOUBLE) AS nll, sum(strlen(text)) AS bytes FROM documents GROUP BY source), e AS (SELECT panel, round(nll / ln(2::DOUBLE) / greatest(bytes, 1), 4) AS bpb FROM s)
    SELECT panel, bpb FROM e UNION ALL SELECT 'mean', round(avg(bpb), 4) FROM e"""
)
def bits_per_byte(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return stats.bits_per_byte(docs.select(F.col("source").alias("panel"), (F.char_length("text") * F.lit(0.7)).alias("nll"), F.octet_length("text").cast("long").alias("bytes")))


@query(f"SELECT doc_id, round(2.5::DOUBLE * len(string_split(text, ' ')) / strlen(text) / {math.log(2)!r}::DOUBLE, 6) AS bpb FROM documents WHERE strlen(text) > 0")
def bpb_of_loss(spark, sf_dir):
    e = stats.bits_per_byte_of_loss(F.lit(2.5), F.size(F.split("text", " ")), F.octet_length("text"))
    return _t(spark, sf_dir, "documents").where(F.octet_length("text") > 0).select("doc_id", F.round(e, 6).alias("bpb"))


@query("SELECT source, count(*) AS docs, round(sum(strlen(text)) / 1073741824::DOUBLE, 6) AS gib FROM documents WHERE length(text) >= 200 GROUP BY source")
def source_volume(spark, sf_dir):
    return stats.source_volume(_t(spark, sf_dir, "documents"))


@query("SELECT (SELECT count(*) FROM documents) AS docs, count(*) AS to_remove, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS rate FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1")
def removal_rate(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return stats.removal_rate(docs, docs.join(first, "doc_id", "left_anti"))


# ---- release --------------------------------------------------------------------------------------------------------
def _rows(spark, sf_dir) -> DataFrame:
    docs = _split(_t(spark, sf_dir, "documents"))
    twice = docs.where(F.col("doc_id") % 97 == 0).withColumn("split", F.lit("val"))
    return docs.unionByName(twice).select(F.col("doc_id").cast("string").alias("id"), "text", "source", "split", F.lit(1).alias("cluster_size"), "lang")


_ROWS_SQL = f"rw AS (SELECT doc_id::VARCHAR AS id, text, source, {_SPLIT_SQL} AS split FROM documents UNION ALL SELECT doc_id::VARCHAR, text, source, 'val' FROM documents WHERE doc_id % 97 = 0)"


@query(f"WITH {_ROWS_SQL} SELECT split, count(*) AS rows, sum(strlen(text))::BIGINT AS text_bytes FROM rw GROUP BY split")
def release_manifest(spark, sf_dir):
    return release.manifest(enforce(_rows(spark, sf_dir), RELEASE))


@query(
    f"""WITH {_ROWS_SQL} SELECT id, split, 'bad text' AS reason FROM rw WHERE text IS NULL OR length(text) < 100
    UNION ALL SELECT id, min(split), 'duplicate id' FROM rw GROUP BY id HAVING count(*) > 1"""
)
def release_violations(spark, sf_dir):
    return release.violations(_rows(spark, sf_dir))


@query(
    f"""WITH {_ROWS_SQL}, x AS (SELECT *, CASE WHEN source = 'src8' THEN 'val' ELSE split END AS expected FROM rw)
    SELECT id, split, 'bad text' AS reason FROM x WHERE text IS NULL OR length(text) < 100 UNION ALL SELECT id, min(split), 'duplicate id' FROM x GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT id, split, 'split mismatch' FROM x WHERE split IS DISTINCT FROM expected"""
)
def release_split_mismatch(spark, sf_dir):
    """Rows that stand in the table of another split than they say: here all of one source lie in that of val."""
    rows = _rows(spark, sf_dir)
    names = [r[0] for r in rows.select("split").distinct().collect()]
    off = (F.col("source") == "src8") & F.col("source").isNotNull()
    splits = {n: rows.where((off & F.lit(n == "val")) | (~F.coalesce(off, F.lit(False)) & (F.col("split") == n))) for n in names}
    return release.violations(release.of_splits(splits))


@query("SELECT lang AS panel, count(*) AS docs, sum(strlen(text))::BIGINT AS text_bytes, sum(len(string_split(text, ' ')))::BIGINT AS tokens FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def panel_manifest(spark, sf_dir):
    """Documents, bytes and tokens of a panel for each language."""
    docs = _t(spark, sf_dir, "documents")
    names = [r[0] for r in docs.where("lang IS NOT NULL").select("lang").distinct().collect()]
    return files.panel_manifest({n: docs.where(F.col("lang") == n) for n in names}, lambda text: F.size(F.split(text, " ")).cast("long"))


@query(f"WITH {_ROWS_SQL} SELECT id, text, source, NULL::VARCHAR AS url, NULL::VARCHAR AS topic, NULL::VARCHAR AS post_date, NULL::VARCHAR AS scrape_date, NULL::VARCHAR AS dedup_cluster_id, 1::INTEGER AS cluster_size, split FROM rw")
def release_schema(spark, sf_dir):
    return enforce(_rows(spark, sf_dir), RELEASE)


# ---- translation ----------------------------------------------------------------------------------------------------
_NUM = "[0-9][0-9,]*(?:\\.[0-9]+)?%?"
_MASK = f"""parts AS (SELECT doc_id, text, regexp_split_to_array(text, '{_NUM}') AS p FROM documents),
    masked AS (SELECT doc_id, text, p[1] || coalesce(array_to_string([ '⟦N' || i::VARCHAR || '⟧' || p[i + 1] for i in range(1, len(p))], ''), '') AS masked FROM parts)"""


@query(f"WITH {_MASK} SELECT doc_id, masked FROM masked")
def mask_numbers(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", translate.mask_numbers(F.col("text")).alias("masked"))


@query("SELECT doc_id, text AS restored, 'ok' AS gate FROM documents")
def mask_round_trip(spark, sf_dir):
    """Masking and unmasking give the text back, and what was masked passes the integrity gate."""
    m = _t(spark, sf_dir, "documents").select("doc_id", translate.mask(F.col("text")).alias("m"))
    return m.select("doc_id", translate.unmask(F.col("m.masked"), F.col("m.mapping")).alias("restored"), translate.integrity(F.col("m.masked"), F.col("m.mapping")).alias("gate"))


@query(
    """WITH n AS (SELECT doc_id, regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?%?') AS a FROM documents)
    SELECT doc_id, CASE WHEN len(a) = 0 THEN 'ok' ELSE 'stray digits introduced: ' || array_to_string(a[1:3], ',') END AS gate FROM n"""
)
def gate_integrity(spark, sf_dir):
    none = F.array().cast("array<struct<tok:string,val:string>>")
    return _t(spark, sf_dir, "documents").select("doc_id", translate.integrity(F.col("text"), none).alias("gate"))


@query(
    """SELECT doc_id, text || chr(10) || '⟦SEP⟧' || chr(10) || coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END, ''), n_chars::VARCHAR) AS doc,
    CASE WHEN doc_id % 2 = 0 THEN source ELSE n_chars::VARCHAR END AS second FROM documents"""
)
def item_text(spark, sf_dir):
    doc = translate.item_text(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""), F.col("n_chars"))
    return _t(spark, sf_dir, "documents").select("doc_id", doc.alias("doc")).select("doc_id", "doc", F.element_at(translate.two_parts(F.col("doc")), 2).alias("second"))


@query(
    """WITH p AS (SELECT doc_id, nullif(doc_id % 5, 4) AS pred, nullif(quality, 1) AS want, nullif(toxic, 1) AS src FROM labels)
    SELECT doc_id, CASE WHEN pred IS NOT DISTINCT FROM want THEN 'PASS' WHEN src IS DISTINCT FROM want THEN 'PASS_solver_limited' ELSE 'G2_mismatch' END AS stage FROM p"""
)
def g2_arbitration(spark, sf_dir):
    null = lambda c, v: F.nullif(c.cast("long"), F.lit(v).cast("long"))
    stage = translate.arbitrate(null(F.col("doc_id") % 5, 4), null(F.col("quality"), 1), null(F.col("toxic"), 1))
    return _t(spark, sf_dir, "labels").select("doc_id", stage.alias("stage"))


_VOTES = "v AS (SELECT doc_id AS id, unnest([CASE WHEN quality = 1 THEN ' yes.' ELSE 'no' END, CASE WHEN toxic = 0 THEN 'YES' END, CASE WHEN doc_id % 2 = 0 THEN 'Yes it is' ELSE 'NO' END]) AS vote FROM labels)"
_PANEL = f"{_VOTES}, pn AS (SELECT id, count(*) FILTER (upper({_strip('vote')}) LIKE 'YES%') AS votes FROM v GROUP BY id)"


def _panel(spark, sf_dir) -> DataFrame:
    votes = F.array(F.when(F.col("quality") == 1, " yes.").otherwise("no"), F.when(F.col("toxic") == 0, "YES"), F.when(F.col("doc_id") % 2 == 0, "Yes it is").otherwise("NO"))
    return translate.panel(_t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.explode(votes).alias("vote")))


@query(f"WITH {_PANEL} SELECT id, votes, CASE WHEN votes >= 2 THEN 'PASS' ELSE 'G2_panel_reject' END AS stage FROM pn")
def panel_vote(spark, sf_dir):
    return _panel(spark, sf_dir)


@query(f"WITH {_PANEL} SELECT CASE WHEN votes >= 2 THEN 'PASS' ELSE 'G2_panel_reject' END AS stage, count(*) AS items FROM pn GROUP BY stage")
def stage_counts(spark, sf_dir):
    return translate.stage_counts(_panel(spark, sf_dir))


@query(
    """WITH s AS (SELECT source AS stage, nullif(doc_id % 6, 0) AS score FROM documents)
    SELECT stage, count(*) AS n, round(avg(score::DOUBLE), 2) AS mean, round(count(*) FILTER (score >= 4) / count(*)::DOUBLE, 3) AS adequate_ge4, count(*) FILTER (score = 1) AS score_1, count(*) FILTER (score = 2) AS score_2,
    count(*) FILTER (score = 3) AS score_3, count(*) FILTER (score = 4) AS score_4, count(*) FILTER (score = 5) AS score_5 FROM s WHERE score IS NOT NULL GROUP BY stage"""
)
def audit_summary(spark, sf_dir):
    return translate.audit_summary(_t(spark, sf_dir, "documents").select(F.col("source").alias("stage"), F.nullif(F.col("doc_id") % 6, F.lit(0).cast("long")).alias("score")))


# ---- mixing and packing ---------------------------------------------------------------------------------------------
_SHARES = {"en": 0.69, "fr": 0.2, "de": 0.06, "es": 0.05}


def _draw_sql(steps: int) -> str:
    edges, at, cases = [], 0.0, []
    for name, share in _SHARES.items():
        at += share
        edges.append((name, at))
    cases = " ".join(f"WHEN u < {e!r}::DOUBLE THEN '{n}'" for n, e in edges[:-1])
    u = f"(('0x' || substr(md5('42|' || step::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * {edges[-1][1]!r}::DOUBLE)"
    return f"dr AS (SELECT step, CASE {cases} ELSE '{edges[-1][0]}' END AS lang FROM (SELECT step, {u} AS u FROM range({steps}) t(step)))"


@query(
    f"""WITH {_draw_sql(2000)}, n AS (SELECT step, lang, row_number() OVER (PARTITION BY lang ORDER BY step) - 1 AS k FROM dr), d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS c FROM documents)
    SELECT step, n.lang, doc_id FROM n JOIN d ON n.lang = d.lang AND k % c = r"""
)
def mixture_interleave(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    return mixture.interleave(docs, mixture.draws(spark, _SHARES, 2000), "lang").select("step", "lang", "doc_id")


_LIMIT = f"(SELECT (2 * max(c / share) + 1000)::BIGINT FROM d JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in _SHARES.items())}) s(lang, share) USING (lang))"


@query(
    f"""WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS c FROM documents),
    {_draw_sql(0).replace('range(0) t(step)', f'(SELECT unnest(range({_LIMIT})) AS step)')}, n AS (SELECT step, lang, row_number() OVER (PARTITION BY lang ORDER BY step) - 1 AS k FROM dr),
    stop AS (SELECT max(step) AS last FROM n JOIN d ON n.lang = d.lang AND k = c - 1 AND r = 0)
    SELECT step, n.lang, doc_id FROM n JOIN d ON n.lang = d.lang AND k % c = r WHERE step <= (SELECT last FROM stop)"""
)
def mixture_exhausted(spark, sf_dir):
    """Mixing goes on until every source has been seen whole; short ones repeat."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    drawn = mixture.draws(spark, _SHARES, mixture.steps_until_exhausted(docs, _SHARES, "lang"))
    return mixture.interleave(docs, drawn, "lang").select("step", "lang", "doc_id")


@query(
    """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, [length(w) for w in string_split(text, ' ')] AS ids FROM documents),
    f AS (SELECT pos // 64 AS seq_batch, flatten(list(list_append(ids, 0) ORDER BY pos)) AS a FROM d GROUP BY seq_batch), s AS (SELECT seq_batch, a, unnest(range(len(a) // 512)) AS seq FROM f)
    SELECT seq_batch::BIGINT AS seq_batch, seq::BIGINT AS seq, array_to_string(a[seq * 512 + 1 : seq * 512 + 512], ',') AS ids FROM s"""
)
def sequence_pack(spark, sf_dir):
    docs = mixture.with_position(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    ids = docs.select("pos", F.transform(F.split("text", " "), lambda w: F.char_length(w)).alias("ids"))
    return mixture.pack_sequences(ids, 512).select("seq_batch", "seq", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT doc_id FROM documents ORDER BY doc_id OFFSET 100")
def skip_offset(spark, sf_dir):
    return mixture.skip(_t(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id")


@query(
    """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
    SELECT doc_id, (pos // 200 * 200 + row_number() OVER (PARTITION BY pos // 200 ORDER BY md5('42|' || pos::VARCHAR), pos) - 1)::BIGINT AS shuffled FROM p"""
)
def buffer_shuffle(spark, sf_dir):
    return mixture.buffer_shuffle(mixture.with_position(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id"), 200).select("doc_id", "shuffled")


@query("SELECT doc_id, len([x for x in string_split(text, '') if true])::BIGINT AS n FROM documents WHERE false UNION ALL SELECT doc_id, strlen(text)::BIGINT FROM documents")
def tokenize_bytes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(mixture.tokenize(F.col("text"))).cast("long").alias("n"))


@query(
    """WITH p AS (SELECT vec_id, 'p' || (vec_id % 7)::VARCHAR AS piece FROM embeddings), e AS (SELECT piece, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings JOIN p USING (vec_id))
    SELECT piece, dim::BIGINT AS dim, round(avg(v::DOUBLE), 6) AS value FROM e GROUP BY ALL"""
)
def embedding_mean(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    parts = v.select("vec_id", F.concat(F.lit("p"), (F.col("vec_id") % 7).cast("string")).alias("piece"))
    return mixture.mean_embedding(parts, v).withColumn("value", F.round("value", 6))
