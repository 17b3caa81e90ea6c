"""The registered queries of this subpackage, their SQL forms, and their parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Piece model of the box; where others keep it is a parameter.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MIX_WEIGHTS = [5, 2, 1]




def held_out() -> Column:
    """Whether no model may learn from a row."""
    return F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; labelled pages are those whose id is a labelled document's."""
    from .url_filter import judge_urls, mine_rules

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(pages, mine_rules(pages.join(labels, "page_id")), URL_RULES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, learn

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.select("doc_id", "text", "lang").filter(~held_out())))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("quality"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECES) -> DataFrame:
    """Ids of each text, their number, and a digest of the text that decoding them gives."""
    from .pieces import decode, encode, load

    model = load(model_path)
    found = decode(encode(table(spark, sf_dir, "documents"), model), model)
    return found.select(F.col("id").alias("doc_id"), "ids", F.size("ids").alias("n_ids"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir), MIX_WEIGHTS)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import neighbours

    # these vectors have no structure that a curve could keep, so the exact pass follows
    found = neighbours(table(spark, sf_dir, "embeddings"), F.expr("id % 100 = 0"), complete=True)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: A conversation whose texts hold the template's control strings.
TRICKY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(turns.unionByName(spark.createDataFrame(TRICKY, turns.schema))))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the documents that are not held out."""
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, toxicity

    docs = table(spark, sf_dir, "documents")
    found = toxicity(docs, learn(docs, toxic_labels(spark, sf_dir)))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed passages as "start:end" in characters of the original text, and the text that is left."""
    from .substring_dedup import drop_repeated_units

    found = drop_repeated_units(table(spark, sf_dir, "documents"), min_words=15, passage=51)
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select(F.col("id").alias("doc_id"), "n_units", F.size("removed").alias("n_removed"), spans.alias("removed"), "text")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_neighbours": op6_neighbours,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {
    "op6_neighbours": """
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (
            SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
            FROM e q JOIN e c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
        SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op7_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') AS body,
                   replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') AS head
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               cast(sum(length('### ' || head || ': ' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op9_substring_dedup": r"""
        WITH p AS (
            SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i
            FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n.!?,;:]+|[.!?,;:]+|\n') AS parts FROM documents)
        ), q AS (
            SELECT doc_id, i, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                   CASE WHEN regexp_matches(part, '^[^\n.!?,;:]') THEN trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) ELSE '' END AS plain
            FROM p
        ), u AS (
            SELECT doc_id, i, plain, len(string_split(plain, ' ')) AS words, lag(plain) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM q WHERE plain != ''
        ), f AS (
            SELECT *, before IS NOT NULL AND min(doc_id) OVER (PARTITION BY before, plain) < doc_id AS linked,
                   words >= 15 AND min(doc_id) OVER (PARTITION BY plain) < doc_id AS repeated,
                   coalesce(lag(words) OVER (PARTITION BY doc_id ORDER BY i), 0) AS ahead, coalesce(lead(words) OVER (PARTITION BY doc_id ORDER BY i), 0) AS behind
            FROM u
        ), g AS (
            SELECT *, count(*) FILTER (NOT linked) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f
        ), r AS (
            SELECT doc_id, run, min(i) AS lo, max(i) AS hi FROM g GROUP BY doc_id, run HAVING (count(*) > 1 OR bool_or(repeated)) AND sum(words) >= 15 AND arg_min(ahead, i) + sum(words) + arg_max(behind, i) >= 51
        ), m AS (
            SELECT q.doc_id, q.i, q.part, q.start, r.run FROM q LEFT JOIN r ON q.doc_id = r.doc_id AND q.i >= r.lo AND (q.i <= r.hi OR q.i = r.hi + 1 AND regexp_matches(q.part, '^[.!?,;:]'))
        ), s AS (
            SELECT doc_id, count(*) AS n, string_agg(lo || ':' || hi, ',' ORDER BY lo) AS spans
            FROM (SELECT doc_id, cast(min(start) AS BIGINT) AS lo, cast(max(start + length(part)) AS BIGINT) AS hi FROM m WHERE run IS NOT NULL GROUP BY doc_id, run) GROUP BY doc_id
        ), t AS (
            SELECT doc_id, coalesce(string_agg(part, '' ORDER BY i) FILTER (run IS NULL), '') AS text FROM m GROUP BY doc_id
        ), c AS (
            SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id
        )
        SELECT d.doc_id, cast(coalesce(c.n, 0) AS INTEGER) AS n_units, cast(coalesce(s.n, 0) AS INTEGER) AS n_removed, coalesce(s.spans, '') AS removed, coalesce(t.text, '') AS text
        FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
