"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    out = shard_documents(_docs(spark, sf_dir), 24)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import decode, encode

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode(_docs(spark, sf_dir).select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    return decode(coded, path, pattern).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import count_tokens

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import near_vectors

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, learn

    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = learn(docs.filter(~F.col("held_out")))
    return identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    out = remove_repeats(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packed import fresh_folder, read_ids, write_ids

    folder = fresh_folder(spark)
    write_ids(_docs(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), folder, end=2)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sortmeans import sort_means

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return sort_means(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_groups, words_of

    words = words_of(_docs(spark, sf_dir).select("doc_id", "text"))
    return spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_url_filters, op3_byte_bpe, op4_token_counts, op5_quality_rules, op6_hnsw_dedup, op7_jaccard_join, op8_mixing, op9_language_id, op10_suffix_array, op11_packed_ids, op12_sort_means, op13_spelling)}



def _sort_means_sql(rounds: int = 3) -> str:
    """Every distance of every round, without a scan order."""
    parts = [
        """k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k ORDER BY h LIMIT 16))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, arg_min(c, 16 * d + c) AS c, min(d) AS d FROM (
          SELECT rid, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i]))) AS BIGINT) AS d FROM k, c{r} m) GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (
              SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT a.c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r} a JOIN k ON k.rid = a.rid) GROUP BY c, i) GROUP BY c) n ON n.c = o.c)""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN k ON k.rid = a.rid JOIN c{rounds} m ON m.c = a.c"""


ORACLE = {
    "op12_sort_means": _sort_means_sql(),
    # The checksum byte by byte; near words by what is left when a character goes.
    "op13_spelling": """
        WITH RECURSIVE tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
          SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        runs AS MATERIALIZED (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents)),
        keyed AS (SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
        bytes AS (SELECT run, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substring(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM keyed),
        sums AS MATERIALIZED (SELECT run, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(tab.t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM bytes, tab),
        counted AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM sums)
          WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
        less AS MATERIALIZED (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS v FROM (SELECT word, unnest(range(length(word))) AS i FROM counted)),
        pairs AS MATERIALIZED (
          SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
          UNION SELECT l.word, c.word FROM less l JOIN counted c ON c.word = l.v UNION SELECT c.word, l.word FROM less l JOIN counted c ON c.word = l.v),
        best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM pairs JOIN counted c ON c.word = b GROUP BY a),
        formed AS MATERIALIZED (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * c.n THEN form END AS form, CASE WHEN form_n >= 10 * c.n THEN form_n END AS form_n FROM counted c LEFT JOIN best ON best.word = c.word),
        walk AS (SELECT word, word AS root, 0 AS depth FROM formed UNION ALL SELECT w.word, f.form, depth + 1 FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(root, depth) AS root FROM walk GROUP BY word) r ON r.word = f.word""",
    "op2_url_filters": """
        WITH p AS (
          SELECT page_id,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
          FROM pages),
        r AS (
          SELECT *, CASE
              WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
          FROM p)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN ends_with(path, '.exe') OR ends_with(path, '.zip') OR contains(path, '/wp-admin/')
              OR starts_with(host, 'ads.') OR ends_with(host, '.doubleclick.net') OR host = 'doubleclick.net' THEN 'block'
            ELSE 'allow' END AS verdict
        FROM r""",
    # Documents of a host with the same set of normalised lines are one; lines are compared as texts, not by hash.
    "op5_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
        tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM (
          SELECT rid, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE c IS NOT NULL),
        rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM tri, (VALUES (0), (1), (2)) x(k) WHERE tri.n > 1 GROUP BY rid),
        lines AS (SELECT rid, source, line, lower(array_to_string(words, ' ')) AS norm, len(words) AS n FROM (
          SELECT rid, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM (SELECT rid, source, unnest(string_split(t, chr(10))) AS line FROM d)) WHERE len(words) > 0),
        docs AS (SELECT rid, source, md5(array_to_string(list_sort(list_distinct(list(norm))), chr(10))) AS sig FROM lines GROUP BY rid, source),
        hosts AS (SELECT source, count(DISTINCT sig) AS n FROM docs GROUP BY source),
        often AS (SELECT l.source, l.norm FROM lines l JOIN docs s ON s.rid = l.rid JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source
          GROUP BY l.source, l.norm, h.n HAVING count(DISTINCT sig) > 10 AND count(DISTINCT sig) > 0.01 * h.n),
        gone AS (SELECT rid, sum(n) AS n FROM lines l JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.norm = l.norm GROUP BY rid),
        dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
        f AS (SELECT d.rid, doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
          length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone
          FROM d LEFT JOIN rep ON rep.rid = d.rid LEFT JOIN dup ON dup.rid = d.rid LEFT JOIN gone ON gone.rid = d.rid)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
          NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone >= 0.5 * n_words AS kept FROM f""",
    # Every pair's cosine, and everything that is reached by links.
    "op6_hnsw_dedup": """
        WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        s AS (SELECT * FROM e WHERE len(v) > 0 AND list_count(v) = len(v) AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS (SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
        r AS (SELECT rid, rid AS t FROM e UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.t)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, c.low AS component_id, coalesce(e.vec_id = c.low, false) AS kept
        FROM e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) x ON x.a = e.rid
        JOIN (SELECT r.rid, min(o.vec_id) AS low FROM r JOIN e o ON o.rid = r.t GROUP BY r.rid) c ON c.rid = e.rid""",
    # All pairs that share a run of five words, and everything that is reached by links.
    "op7_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        sh AS (SELECT DISTINCT rid, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT rid, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM d WHERE len(words) > 0)),
        n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
        p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS met FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE met >= 0.8 * (x.n + y.n - met) - 1e-9),
        r AS (SELECT rid, rid AS t FROM d UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.t)
        SELECT d.doc_id, c.low AS class_id, coalesce(k.n, 0) AS n_links FROM d LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = d.rid
        JOIN (SELECT r.rid, min(o.doc_id) AS low FROM r JOIN d o ON o.rid = r.t GROUP BY r.rid) c ON c.rid = d.rid""",
    # Bytes as hexadecimal digits; texts are cut in pieces of 100 bytes first, so that no place is sought from a text's start.
    "op10_suffix_array": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT rid, doc_id, k, substring(h, 200 * k + 1, 298) AS piece, length(h) // 2 AS n FROM (SELECT *, unnest(range(0, greatest(1, (length(h) // 2 + 99) // 100))) AS k FROM d)),
        b AS (SELECT rid, doc_id, n, 100 * k + j AS p, substring(piece, 2 * j + 1, 2) AS byte, CASE WHEN 100 * k + j + 50 <= n THEN substring(piece, 2 * j + 1, 100) END AS str
          FROM (SELECT *, unnest(range(0, least(100, n - 100 * k))) AS j FROM c)),
        f AS (SELECT str, min(coalesce(doc_id, 9223372036854775807)) AS low FROM b WHERE str IS NOT NULL GROUP BY str HAVING count(*) > 1),
        g AS (SELECT b.rid, p, byte, coalesce(max(CASE WHEN low < coalesce(doc_id, 9223372036854775807) THEN p END) OVER (PARTITION BY b.rid ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
          FROM b LEFT JOIN f ON f.str = b.str),
        s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY p), false) AS starts FROM g),
        t AS (SELECT rid, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM s GROUP BY rid)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t ON t.rid = d.rid""",
}
