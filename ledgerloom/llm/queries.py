"""The queries of the subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._shared import written
from ledgerloom.llm import exact_dedup, fingerprints, jaccard_join, lm_scoring, mixing, packing, phrases, quality, substring_dedup, topk_search, toxicity, variants, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.captures(table(spark, sf_dir, "pages"))
    # What the result needs of each capture is read twice; its payload isn't written again for that.
    found = warc.with_payload_size(written(captures.select("capture_id", F.col("response").dropFields("body").alias("response")), "captures"))
    return found.select(
        warc.source_id(F.col("capture_id")).cast("long").alias("page_id"),
        "payload_bytes",
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        warc.source_id(F.col("response.refers_to")).cast("long").alias("refers_to"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(table(spark, sf_dir, "documents"), links=True)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op8_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_top(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents, repeated so that sources come near the square root of their shares."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy_no", "text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("hits")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited(table(spark, sf_dir, "documents")).withColumn("edited_fingerprint", fingerprints.fingerprint(F.col("edited")))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.printed(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.printed(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_exact_topk_search": op8_exact_topk_search,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_phrases": op11_phrases,
    "op12_fingerprints": op12_fingerprints,
    "op13_variants": op13_variants,
}

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {10 * w + 1}, 10))::BIGINT >> {35 - 5 * i}) & 31)::INT, 1)" for w in range(4) for i in range(8))

SQL = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
        SELECT page_id, strlen(body) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM m""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(range(1, len(w) - 11)) AS i, w FROM d),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p),
        f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (k) WHERE first < doc_id),
        l AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN l USING (doc_id)""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS k FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
        r AS (SELECT doc_id AS x, doc_id AS z FROM documents UNION SELECT e.x, r.z FROM e JOIN r ON r.x = e.y WHERE r.z < e.x),
        c AS (SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(z) AS component_id
              FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY d.doc_id),
        f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(array_to_string(list_sort(k), chr(1)))) AS first FROM (SELECT doc_id, list(k) AS k FROM s GROUP BY doc_id)),
        l AS (SELECT component_id, count(*) AS n_links FROM e JOIN f p ON p.doc_id = e.x JOIN f q ON q.doc_id = e.y JOIN c ON c.doc_id = e.x
              WHERE e.x = p.first AND e.y = q.first AND e.x < e.y GROUP BY component_id)
        SELECT doc_id, n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM c LEFT JOIN l USING (component_id)""",
    "op8_exact_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_mixing": """
        WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        r AS (SELECT source, pow(n, 0.5) * ((SELECT sum(n) FROM s)::DOUBLE / (SELECT sum(pow(n, 0.5)) FROM s)) / n AS rate FROM s),
        parts AS (SELECT source, rate, greatest(1, ceil(rate / 64.0)::INT) AS parts FROM r),
        cdf AS (
            SELECT source, parts, list(total ORDER BY k) AS cdf FROM (
                SELECT source, parts, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS total
                FROM parts, range(0, 192) t(k)) GROUP BY source, parts),
        c AS (
            SELECT doc_id, d.source, text, list_sum(list_transform(range(0, parts), lambda i:
                len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('17:' || doc_id || ':' || i), 1, 13))::BIGINT / pow(2, 52))))) AS n
            FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)
        SELECT doc_id, source, unnest(range(0, n::BIGINT))::INT AS copy_no, text FROM c""",
    "op11_phrases": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
        w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) t(k)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
        s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
              FROM c JOIN f x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(c.w[:cut], ' ')
              JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        h AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT DISTINCT lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
        r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longest IS NULL OR 100 * longest < 50 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_fingerprints": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS a, row_number() OVER (ORDER BY doc_id) AS pos FROM documents),
        x AS (SELECT *, length(a) // 2 AS half, coalesce(lead(a) OVER (ORDER BY pos), first(a) OVER (ORDER BY pos)) AS following, coalesce(lead(pos) OVER (ORDER BY pos), 1) AS next_pos FROM d),
        e AS (SELECT *, left(a, length(a) - half) || left(following, half) AS b FROM x),
        t AS (SELECT pos, 0 AS v, a AS t FROM e UNION ALL SELECT pos, 1, b FROM e),
        w AS (SELECT pos, v, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
        s AS (SELECT pos, v, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT pos, v, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
        b AS (SELECT pos, v, ('0x' || left(h, 2))::INT AS bin, right(min(h), 1) AS digit FROM s GROUP BY pos, v, bin),
        j AS (SELECT pos, v, unnest(range(256)) AS j FROM (SELECT DISTINCT pos, v FROM b)),
        gaps AS (SELECT j.* FROM j ANTI JOIN b ON b.pos = j.pos AND b.v = j.v AND b.bin = j.j),
        probes AS (SELECT j, t, (j * (('0x' || left(md5(t::VARCHAR), 2))::INT | 1) + ('0x' || substr(md5(t::VARCHAR), 3, 2))::INT) % 256 AS s FROM range(256) x(j), range(48) y(t)),
        early AS (SELECT g.pos, g.v, g.j, arg_min(b.digit, p.t) AS digit FROM gaps g JOIN probes p USING (j) JOIN b ON b.pos = g.pos AND b.v = g.v AND b.bin = p.s GROUP BY ALL),
        late AS (SELECT g.pos, g.v, g.j, arg_min(b.digit, md5(g.j || '~' || b.bin)) AS digit FROM (SELECT * FROM gaps ANTI JOIN early USING (pos, v, j)) g JOIN b ON b.pos = g.pos AND b.v = g.v GROUP BY ALL),
        f AS (SELECT pos, v, string_agg(digit, '' ORDER BY j) AS f FROM (SELECT pos, v, bin AS j, digit FROM b UNION ALL SELECT * FROM early UNION ALL SELECT * FROM late) GROUP BY pos, v),
        r AS (SELECT e.*, coalesce(p.f, '') AS fa, coalesce(q.f, '') AS fb, coalesce(n.f, '') AS fn FROM e LEFT JOIN f p ON p.pos = e.pos AND p.v = 0 LEFT JOIN f q ON q.pos = e.pos AND q.v = 1 LEFT JOIN f n ON n.pos = e.next_pos AND n.v = 0)
        SELECT doc_id, length(a) AS n_chars, sha256(b) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
               CASE WHEN fa = fb THEN 1.0::DOUBLE WHEN fa = '' OR fb = '' THEN 0.0 ELSE greatest(0.0::DOUBLE, (len(list_filter(range(1, 257), lambda i: fa[i] = fb[i])) / 256.0::DOUBLE - 0.0625::DOUBLE) / 0.9375::DOUBLE) END AS near_edited,
               CASE WHEN fa = fn THEN 1.0::DOUBLE WHEN fa = '' OR fn = '' THEN 0.0 ELSE greatest(0.0::DOUBLE, (len(list_filter(range(1, 257), lambda i: fa[i] = fn[i])) / 256.0::DOUBLE - 0.0625::DOUBLE) / 0.9375::DOUBLE) END AS near_next
        FROM r""",
    "op13_variants": r"""
        WITH RECURSIVE tab AS (SELECT list(list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab FROM range(256) x(b)),
        r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        x AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r WHERE length(run) >= 7),
        h AS (SELECT run, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM x, tab),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
        v AS MATERIALIZED (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
        p AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
        g AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) AS k, left(word, i - 1) || substr(word, i + 1) AS shorter FROM p),
        e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
              UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = g.shorter
              UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.shorter),
        b AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n, min(near) FILTER (near_n = top) AS near FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top FROM e) GROUP BY word),
        f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
        c AS (SELECT word, word AS root, 0 AS d FROM f UNION ALL SELECT c.word, f.form, d + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT word, n, n_near, form, form_n, (SELECT arg_max(c.root, c.d) FROM c WHERE c.word = f.word) AS root FROM f""",
}
