"""The queries that apply the operators of this package to their whole tables, and their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents")).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages")).withColumn("words", F.array_join("words", " "))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pathloom.llm.bpe import encode_table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.ann import search

    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.line_dedup import drop_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs).select("doc_id", "source", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_url_filter, op3_bpe, op4_ann, op5_line_dedup, op6_license_scan, op7_near_dup, op8_toxicity, op9_decontamination, op10_substring_dedup)}

#: (doc_id, p, word): the words of documents, separated by ASCII white space, numbered from 1.
_WORDS = """d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x09-\\x0D ]+'), lambda x: x <> '') w FROM documents),
        words AS (SELECT doc_id, unnest(generate_series(1, len(w))) p, unnest(w) word FROM d)"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _run(n: int) -> str:
    """SQL for the n words from a word on, null where the document ends before."""
    return " || ' ' || ".join(f"lead(word, {k}) OVER o" if k else "word" for k in range(n))


ORACLES = {
    "op7_near_dup": f"""
        WITH RECURSIVE {_WORDS.format(text=_LOWER)},
        runs AS (SELECT doc_id, {_run(3)} AS k FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        s AS (SELECT DISTINCT doc_id, k FROM runs WHERE k IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
        n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
        met AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id a, doc_id b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, c.component_id, c.component_id = d.doc_id kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) component_id FROM reach GROUP BY a) c ON c.a = d.doc_id""",
    "op10_substring_dedup": f"""
        WITH {_WORDS.format(text="text")},
        runs AS (SELECT doc_id, p, {_run(13)} AS k FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        firsts AS (SELECT k, min(doc_id) f FROM runs WHERE k IS NOT NULL GROUP BY k),
        starts AS (SELECT doc_id, p FROM runs JOIN firsts USING (k) WHERE f < doc_id),
        gone AS (SELECT DISTINCT doc_id, p + j p FROM starts, range(13) t(j)),
        kept AS (SELECT doc_id, count(*) n, string_agg(word, ' ' ORDER BY p) t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT n_words, (len(w) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_line_dedup": """
        WITH d AS (SELECT doc_id, coalesce(source, '') host, source, text FROM documents),
        l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) line FROM d WHERE text IS NOT NULL),
        k AS (SELECT doc_id, host, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) line FROM l),
        c AS (SELECT host, line, count(DISTINCT doc_id) n FROM k WHERE line <> '' GROUP BY ALL),
        t AS (SELECT host, count(*) total FROM d GROUP BY ALL),
        b AS (SELECT c.host, list(line) bad FROM c JOIN t USING (host) WHERE n >= 5 AND n > 0.08 * total GROUP BY ALL),
        f AS (SELECT doc_id, source, text, string_split(text, chr(10)) ls,
                list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) kept
              FROM d LEFT JOIN b USING (host))
        SELECT doc_id, source, coalesce(len(ls), 0)::INT n_lines, coalesce(len(ls) - len(kept), 0)::INT n_removed,
          CASE WHEN text IS NOT NULL THEN sha256(array_to_string(kept, chr(10))) END kept_sha256 FROM f""",
}
