"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backuplake.llm import license_scan, prefix_trie, repetition
from backuplake.sources.bindings import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; every machine has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


ORACLES["op1_license_scan"] = license_scan.oracle()


@query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest whole-number products of every fiftieth vector with all others."""
    from backuplake.llm import topk

    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


ORACLES["op2_topk"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id,
                  CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
           FROM e q JOIN e c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    from backuplake.llm import packing

    packed = packing.pack(read(spark, sf_dir, "documents"), tokenizer(WORDS), end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the texts decoded from them, as digests."""
    from backuplake.llm import bpe

    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer(WORDS))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    from backuplake.llm import language

    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs, language.fold(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(language.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document, named by its smallest id."""
    from backuplake.llm import near_dedup

    return near_dedup.classes(read(spark, sf_dir, "documents"))


# Weighted Jaccard similarity of all pairs that share a shingle, and the components of the links.
ORACLES["op6_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
     k AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN '!' || text ELSE array_to_string(ws, ' ') END AS k, ws FROM w),
     f AS (SELECT k, min(doc_id) AS rep, any_value(ws) AS ws FROM k GROUP BY k),
     sh AS (SELECT rep, array_to_string(ws[i : i + 4], ' ') AS s
            FROM (SELECT rep, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM f WHERE len(ws) > 0)),
     c AS (SELECT rep, s, count(*) AS n FROM sh GROUP BY rep, s),
     z AS (SELECT rep, sum(n) AS n FROM c GROUP BY rep),
     o AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.s = b.s AND a.rep < b.rep GROUP BY a.rep, b.rep),
     l AS (SELECT a, b FROM o JOIN z za ON za.rep = a JOIN z zb ON zb.rep = b WHERE common >= 0.8::DOUBLE * (za.n + zb.n - common)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT rep AS node, rep AS root FROM f UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT doc_id, class_id FROM (SELECT node, min(root) AS class_id FROM r GROUP BY node) JOIN f ON rep = node JOIN k USING (k)
"""


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of two thirds of them."""
    from backuplake.llm import language, quality

    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), language.fold(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(language.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as Arrow files and read back."""
    from backuplake.llm import token_files

    folder = token_files.new_folder(spark)
    manifest = token_files.write(read(spark, sf_dir, "documents"), tokenizer(BYTES), folder, end_id=0)
    return token_files.read(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and read back."""
    from backuplake.llm import warc

    records = warc.round_trip(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every fiftieth vector, by cosine."""
    from backuplake.llm import ann

    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item, by weighted terms."""
    from backuplake.llm import lexical

    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
             lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts FROM documents WHERE text IS NOT NULL),
     b AS (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
             lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t FROM benchmark WHERE text IS NOT NULL),
     q AS (SELECT item_id, t, count(*) AS reps FROM b GROUP BY ALL),
     n AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
     f AS (SELECT r, doc_id, size, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS size, unnest(ts) AS t FROM d)
           WHERE t IN (SELECT t FROM q) GROUP BY ALL),
     w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n.n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT t, count(*) AS df FROM f GROUP BY t), n),
     s AS (SELECT item_id, doc_id, r, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n.n) // n.l)))) AS BIGINT) AS score
           FROM f JOIN w USING (t) JOIN q USING (t), n GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@query
def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is repeated n-grams and lines, and whether that is too much."""
    counts = repetition.measure(read(spark, sf_dir, "documents"))
    return counts.select("doc_id", *repetition.COUNTS, "base_failed", "kept")


ORACLES["op12_repetition"] = repetition.oracle()


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared prefix of the rebuilt conversations, and what sharing it saves."""
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = prefix_trie.ORACLE


_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {s}) & 31 AS BIGINT) + 1, 1)"
ORACLES["op9_warc"] = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n,
                  coalesce(html, '') AS body FROM pages),
     f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(
           [CAST('0x' || substr(h, i * 5 + 1, 5) AS BIGINT)], lambda v: {" || ".join(_LETTER.format(s=s) for s in (15, 10, 5, 0))}),
           'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (body)
"""


def load() -> tuple[dict, dict]:
    return QUERIES, ORACLES
