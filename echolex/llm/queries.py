"""The queries of this subpackage, each over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolex.llm import bpe, components, format_duplicates, lookalikes, near_duplicates, packing, shared_spans
from echolex.session import Scratch
from echolex.sources.tables import table

#: The container that documents are put into.
CONTAINER = "middle"
#: Characters of a shared span.
SPAN = 200
#: Similarity of near-duplicate phrases, on sets of GRAM characters.
SIMILARITY, GRAM = 0.6, 3


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.word_groups(table(spark, folder, "word_groups"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = format_duplicates.copies(table(spark, folder, "dictionary"))
    return found.where("id <> class_id").select(F.col("class_id").alias("keep_ord"), F.col("id").alias("copy_ord"))


def p3_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    rows = format_duplicates.collapse(table(spark, folder, "dictionary").select("ord", "word", "phonemes", "lang"))
    return rows.select("ord", "word", "n_copies")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(table(spark, folder, "phrases"), n=GRAM, threshold=SIMILARITY)
    return pairs.select(F.col("a").alias("phrase_id_a"), F.col("b").alias("phrase_id_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_groups(table(spark, folder, "phrases"), n=GRAM, threshold=SIMILARITY)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, keys, symbols = (table(spark, folder, t) for t in ("dictionary", "sound_keys", "ipa_symbols"))
    return lookalikes.match_reference(rows, keys, symbols)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.count_tokens(table(spark, folder, "documents"))


def _capacity(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "containers").where(F.col("container_name") == CONTAINER).first()["capacity"]


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = bpe.count_tokens(table(spark, folder, "documents"))
    return packing.pack(sizes, _capacity(spark, folder))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """For each document: whether every token is in one piece and each piece but the last is full, whether all of its
    containers hold what they can, and whether no more than a hundredth of the containers, and one, could be spared."""
    capacity = _capacity(spark, folder)
    sizes = Scratch(spark, "check").cut(bpe.count_tokens(table(spark, folder, "documents")))
    pieces = packing.pack(sizes, capacity)
    length = F.col("to_token") - F.col("from_token")
    held = pieces.groupBy("container_id").agg(F.sum(length).alias("held"))
    placed = (F.col("from_token") == F.col("piece") * capacity) & (F.col("to_token") == F.least("n_tokens", (F.col("piece") + 1) * capacity))
    pieces = pieces.join(held, "container_id").join(sizes, "doc_id")
    docs = pieces.groupBy("doc_id", "n_tokens").agg(
        F.every(placed).alias("placed"), F.count_distinct("piece").alias("different"), F.count(F.lit(1)).alias("n"), F.sum(length).alias("sum"), F.max("held").alias("most")
    )
    least = F.ceil(F.sum("n_tokens") / capacity)
    need = sizes.agg(least.alias("least")).crossJoin(held.agg(F.count(F.lit(1)).alias("used"), F.max("container_id").alias("last")))  # one row
    whole = F.col("placed") & (F.col("n") == F.col("different")) & (F.col("sum") == F.col("n_tokens"))
    tight = (F.col("used") <= 1.01 * F.col("least") + 1) & (F.col("last") + 1 <= 1.01 * F.col("least") + 1)
    return docs.crossJoin(need).select("doc_id", whole.alias("whole"), (F.col("most") <= capacity).alias("fits"), tight.alias("tight"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, folder, "documents"), SPAN)


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return shared_spans.shared_share(documents, shared_spans.shared_spans(documents, SPAN))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (p1_found, p3_found, p3_collapsed, p4_found, p4_groups, p5_found, p6_ids, p6_counts, p7_containers, p7_check, p8_found, p8_share)
    return {f.__name__: f for f in made}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _p5_sql() -> str:
    symbols = " abcdefghijklmnopqrstuvwxyzãäæçðõöøĩŋœɑɔəɛɣɪɲɵɸɾʁʃʊʌʒʰʲˈˌːθχḛḭẽ" + "̥̩̰̃"
    table = lookalikes.likeness(symbols)
    dropped = lookalikes.undrawn()
    return f"""
        WITH looked AS (
          SELECT ord, phonemes, nfc_normalize(translate(phonemes, {_quoted("".join(table) + dropped)},
                 {_quoted("".join(table.values()))})) AS looks FROM dictionary WHERE phonemes IS NOT NULL)
        SELECT l.ord, k.key_id FROM looked l JOIN sound_keys k ON l.looks = k.phonemes WHERE l.phonemes <> k.phonemes"""


def _spans_sql() -> str:
    return f"""
        windows AS (
          SELECT doc_id, s, md5(substring(text, s + 1, {SPAN})) AS digest
          FROM (SELECT doc_id, text, unnest(range(0, length(text) - {SPAN - 1})) AS s FROM documents
                WHERE length(text) >= {SPAN})),
        shared AS (
          SELECT digest FROM windows GROUP BY digest HAVING min(doc_id) <> max(doc_id)),
        covered AS (
          SELECT doc_id, s, max(s + {SPAN}) OVER (PARTITION BY doc_id ORDER BY s
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
          FROM windows SEMI JOIN shared USING (digest)),
        numbered AS (
          SELECT doc_id, s, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run
          FROM covered),
        runs AS (
          SELECT doc_id, min(s)::BIGINT AS start_pos, max(s + {SPAN})::BIGINT AS end_pos
          FROM numbered GROUP BY doc_id, run)"""


_PARTS = r"list_sort(list_transform(list_filter(regexp_split_to_array(word, '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: lower(x)))"
_CLASSES = f"""
    cases AS (
      SELECT ord, lang, phonemes, array_to_string({_PARTS}, ' ') AS written FROM dictionary
      WHERE word IS NOT NULL AND lang IS NOT NULL AND phonemes IS NOT NULL),
    classes AS (
      SELECT lang, phonemes, written, min(ord) AS keep_ord, count(*) AS copies FROM cases
      WHERE written <> '' GROUP BY ALL HAVING count(*) > 1)"""


_PHRASE_PAIRS = f"""
    grams AS (
      SELECT DISTINCT phrase_id, substring(phonemes, i::INT, {GRAM}) AS gram
      FROM (SELECT phrase_id, phonemes, unnest(range(1, length(phonemes) - {GRAM - 2})) AS i FROM phrases
            WHERE length(phonemes) >= {GRAM})),
    sizes AS (SELECT phrase_id, count(*) AS n FROM grams GROUP BY phrase_id),
    common AS (
      SELECT x.phrase_id AS a, y.phrase_id AS b, count(*) AS n
      FROM grams x JOIN grams y ON x.gram = y.gram AND x.phrase_id < y.phrase_id GROUP BY ALL),
    pairs AS (
      SELECT c.a, c.b FROM common c JOIN sizes x ON x.phrase_id = c.a JOIN sizes y ON y.phrase_id = c.b
      WHERE 10 * c.n >= {round(10 * SIMILARITY)} * (x.n + y.n - c.n))"""


def oracle_sql() -> dict[str, str]:
    """p6 and p7 have no SQL: byte-pair merges and bin packing are held against other implementations in the tests."""
    return {
        "p1_found": """
            WITH RECURSIVE edges AS (
              SELECT DISTINCT list_min(w) AS a, unnest(w) AS b
              FROM (SELECT list_distinct(list_filter(words, lambda x: x IS NOT NULL AND x <> '')) AS w FROM word_groups)
              WHERE len(w) > 1),
            arcs AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
            reached(word, other) AS (
              SELECT a, a FROM arcs UNION SELECT r.word, arcs.b FROM reached r JOIN arcs ON arcs.a = r.other)
            SELECT word, min(other) AS group_word FROM reached GROUP BY word""",
        "p3_found": f"""
            WITH {_CLASSES}
            SELECT keep_ord, ord AS copy_ord FROM cases JOIN classes USING (lang, phonemes, written) WHERE ord <> keep_ord""",
        "p3_collapsed": f"""
            WITH {_CLASSES},
            found AS (SELECT ord, keep_ord, copies FROM cases JOIN classes USING (lang, phonemes, written))
            SELECT d.ord, d.word, coalesce(f.copies, 1)::BIGINT AS n_copies
            FROM dictionary d LEFT JOIN found f ON d.ord = f.ord WHERE f.keep_ord IS NULL OR f.keep_ord = d.ord""",
        "p4_found": f"WITH {_PHRASE_PAIRS} SELECT a AS phrase_id_a, b AS phrase_id_b FROM pairs",
        "p4_groups": f"""
            WITH RECURSIVE {_PHRASE_PAIRS},
            links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
            reached(phrase_id, other) AS (
              SELECT a, a FROM links UNION SELECT r.phrase_id, links.b FROM reached r JOIN links ON links.a = r.other),
            least AS (SELECT phrase_id, min(other) AS group_id FROM reached GROUP BY phrase_id),
            counts AS (SELECT a AS phrase_id, count(*) AS n FROM links GROUP BY a)
            SELECT phrase_id, coalesce(group_id, phrase_id) AS group_id, coalesce(n, 0)::BIGINT AS n_links
            FROM phrases LEFT JOIN least USING (phrase_id) LEFT JOIN counts USING (phrase_id)""",
        "p5_found": _p5_sql(),
        "p7_check": "SELECT doc_id, true AS whole, true AS fits, true AS tight FROM documents",
        "p8_found": f"WITH {_spans_sql()} SELECT doc_id, start_pos, end_pos FROM runs",
        "p8_share": f"""
            WITH {_spans_sql()},
            found AS (SELECT doc_id, sum(end_pos - start_pos)::BIGINT AS n FROM runs GROUP BY doc_id)
            SELECT d.doc_id, coalesce(length(d.text), 0)::BIGINT AS n_chars, coalesce(f.n, 0)::BIGINT AS shared_chars,
                   CASE WHEN length(d.text) > 0 THEN coalesce(f.n, 0) / length(d.text) ELSE 0.0 END::DOUBLE AS share
            FROM documents d LEFT JOIN found f USING (doc_id)""",
    }
