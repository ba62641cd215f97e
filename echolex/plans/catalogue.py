"""The core's queries over the test tables, each over whole tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolex.functions import phonetics, text
from echolex.operators import detect, groups, homophones, languages, malformed, phonemise, similar
from echolex.sources import text as files
from echolex.sources.tables import table

#: The bounds of the word-length query.
SHORTEST, LONGEST = 5, 10
#: Every row whose `ord` is divisible by this is a query of the search.
SEARCHED = 50


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return malformed.bad_rows(table(spark, folder, "raw_lines"), table(spark, folder, "voices")).select("line_id", "reason")


def p2_rows(spark: SparkSession, folder: str) -> DataFrame:
    good = malformed.good_rows(table(spark, folder, "raw_lines"), table(spark, folder, "voices"))
    return good.select("line_id", "word", "phonemes", "lang", "freq", F.col("added").cast("string").alias("added"))


def normalize_phonemes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dictionary").select("ord", phonetics.normalize("phonemes").alias("phonemes"))


def squeeze_runs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dictionary").select("ord", text.squeeze("phonemes").alias("phonemes"))


def grapheme_lengths(spark: SparkSession, folder: str) -> DataFrame:
    n = text.graphemes("word").cast("bigint")
    return table(spark, folder, "dictionary").select("ord", n.alias("n_graphemes"), F.length("word").cast("bigint").alias("n_points"))


def word_length_filter(spark: SparkSession, folder: str) -> DataFrame:
    return files.word_length(table(spark, folder, "dictionary").select("ord", "word"), SHORTEST, LONGEST)


def trimmed_entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "word_list").select("ord", text.trim("entry").alias("word"))
    return rows.where(F.length("word") > 0)


def entry_tokens(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.posexplode(text.tokens("entry")).alias("nth", "token")
    return table(spark, folder, "word_list").select("ord", parts).withColumn("nth", F.col("nth").cast("bigint"))


def dictionary_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_lines").select(F.col("line_id").alias("ord"), F.col("raw").alias("line"))
    return files.parse_dictionary(rows)


def dictionary_lines(spark: SparkSession, folder: str) -> DataFrame:
    return files.dictionary_lines(table(spark, folder, "dictionary").dropna(subset=["word", "phonemes"]))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    n = F.size(text.string_lines("text")).cast("bigint")
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", n.alias("n_lines"))


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select(F.explode(text.words_of("text")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _as_text(found: DataFrame) -> DataFrame:
    return found.withColumn("words", F.array_join("words", "|"))


def homophone_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _as_text(homophones.homophones(table(spark, folder, "dictionary")))


def homophone_members(spark: SparkSession, folder: str) -> DataFrame:
    return homophones.homophone_members(table(spark, folder, "dictionary"))


def homophone_groups_normalized(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dictionary").select("word", phonetics.normalize("phonemes").alias("phonemes"))
    return _as_text(homophones.homophones(rows))


def homophone_groups_bounded(spark: SparkSession, folder: str) -> DataFrame:
    return _as_text(homophones.homophones(files.word_length(table(spark, folder, "dictionary"), SHORTEST, LONGEST)))


def cross_homophones(spark: SparkSession, folder: str) -> DataFrame:
    return _as_text(homophones.cross_homophones(table(spark, folder, "dictionary")))


def homophone_count(spark: SparkSession, folder: str) -> DataFrame:
    found = homophones.homophones(table(spark, folder, "dictionary"))
    return found.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.size("words")), F.lit(0)).cast("bigint").alias("words"))


def finished_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "word_groups").select("set_id", "words")
    return _as_text(homophones.finish_groups(rows))


def words_by_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "word_list").where("entry IS NOT NULL")
    held = homophones.multimap(rows, "list_key", "entry", "ord")
    return held.select("list_key", F.array_join("values", "|").alias("entries"))


def entries_by_list(spark: SparkSession, folder: str) -> DataFrame:
    return homophones.multimap_rows(table(spark, folder, "word_list").where("entry IS NOT NULL"), "list_key", "entry", "ord")


def dictionary_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of each run of one language, with its other columns."""
    rows = table(spark, folder, "dictionary").select("ord", "lang", "word", "phonemes", "freq", F.lit("all").alias("same"))
    return homophones.squeeze_rows(rows, "lang", "ord")


def constant_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dictionary").select("ord", "word", "phonemes", F.lit("all").alias("same"))
    return homophones.squeeze_rows(rows, "same", "ord")


def language_runs(spark: SparkSession, folder: str) -> DataFrame:
    return homophones.squeeze_rows(table(spark, folder, "dictionary").select("ord", "lang"), "lang", "ord")


def languages_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dictionary").where("lang IS NOT NULL")
    return languages.first_seen(rows, "lang", "ord")


def _pairs(found: DataFrame) -> DataFrame:
    return found.select("ord", "match_ord", F.col("distance").cast("bigint").alias("distance"))


def similar_pairs_d1(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(similar.similar_pairs(table(spark, folder, "dictionary"), distance=1))


def similar_pairs_d2(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(similar.similar_pairs(table(spark, folder, "dictionary"), distance=2))


def _sides(spark: SparkSession, folder: str) -> list[DataFrame]:
    rows = table(spark, folder, "dictionary")
    return [rows.where(F.col("src") == i) for i in (0, 1)]


def cross_similar_d1(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(similar.similar_pairs(*_sides(spark, folder), distance=1))


def similar_lists_d1(spark: SparkSession, folder: str) -> DataFrame:
    found = similar.similar_lists(similar.similar_pairs(table(spark, folder, "dictionary"), distance=1))
    return found.withColumn("matches", F.array_join("matches", "|"))


def lookup_similar(spark: SparkSession, folder: str) -> DataFrame:
    """The rows within one edit of the pronunciation that most rows have."""
    rows = table(spark, folder, "dictionary")
    counts = rows.where("phonemes <> ''").groupBy("phonemes").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.orderBy(F.desc("n"), "phonemes").first()["phonemes"]
    return similar.lookup(rows, usual, 1).select("ord", "word", "phonemes")


def search_similar_d1(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dictionary")
    return _pairs(similar.search(rows.where(F.col("ord") % SEARCHED == 0), rows, 1))


def cluster_similar(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "dictionary").select("phonemes")
    pairs = similar.similar_keys(keys, keys, 1).where("a <> b")
    return groups.component_labels(pairs).select(F.col("item").alias("phonemes"), "label")


def merged_members(spark: SparkSession, folder: str) -> DataFrame:
    return groups.merged_members(table(spark, folder, "word_groups"))


def merge_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _as_text(groups.merge_groups(table(spark, folder, "word_groups")))


def default_voices(spark: SparkSession, folder: str) -> DataFrame:
    return languages.default_voices(table(spark, folder, "voices"))


def voices_by_language(spark: SparkSession, folder: str) -> DataFrame:
    held = languages.voices_by_language(table(spark, folder, "voices"))
    names = F.array_join(F.transform("voices", lambda v: v["filename"]), "|")
    return held.select("lang", names.alias("filenames"))


def catalogue_report(spark: SparkSession, folder: str) -> DataFrame:
    report = languages.catalogue_report(table(spark, folder, "voices"))
    return report.withColumn("nth", F.col("nth").cast("bigint"))


def language_codes(spark: SparkSession, folder: str) -> DataFrame:
    """How many dictionary rows each code of the table has."""
    rows = table(spark, folder, "dictionary").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    codes = languages.code_table(spark)
    return codes.join(rows, codes["code"] == rows["lang"], "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def dictionary_voices(spark: SparkSession, folder: str) -> DataFrame:
    """Every dictionary row with its language's default voice; null where there is none."""
    best = languages.default_voices(table(spark, folder, "voices")).select("lang", "filename")
    return table(spark, folder, "dictionary").select("ord", "lang").join(best, "lang", "left").select("ord", "filename")


def phonemize_words(spark: SparkSession, folder: str) -> DataFrame:
    return phonemise.phonemise(table(spark, folder, "word_list"), phonemise.Rules("de"))


def phonemize_by_language(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dictionary").select("ord", "word", "lang").withColumnRenamed("word", "entry")
    return phonemise.phonemise_by_language(rows, "entry", "lang")


def language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    known = detect.profiles(table(spark, folder, "documents"))
    return known.withColumn("rank", F.col("rank").cast("bigint"))


def detect_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return detect.cross_detect(documents).select(F.col("id").alias("doc_id"), "language")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        p2_found, p2_rows, normalize_phonemes, squeeze_runs, grapheme_lengths, word_length_filter, trimmed_entries,
        entry_tokens, dictionary_parse, dictionary_lines, document_lines, document_words, homophone_groups,
        homophone_groups_normalized, homophone_groups_bounded, cross_homophones, homophone_count, finished_groups,
        words_by_list, entries_by_list, homophone_members, dictionary_runs, constant_runs, merged_members, language_runs, languages_first_seen, similar_pairs_d1, similar_pairs_d2, cross_similar_d1,
        similar_lists_d1, lookup_similar, search_similar_d1, cluster_similar, merge_groups, default_voices,
        voices_by_language, catalogue_report, language_codes, dictionary_voices, phonemize_words, phonemize_by_language, language_profiles,
        detect_language,
    )
    return {f.__name__: f for f in made}


WHITE = r"[\s\x{0B}\x{85}\p{Z}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def _squeeze(c: str) -> str:
    chars = f"string_split({c}, '')"
    return f"array_to_string(list_filter({chars}, lambda c, i: i = 1 OR c <> {chars}[i - 1]), '')"


def _normalize(c: str) -> str:
    bare = rf"regexp_replace({c}, '[\x{{02B0}}-\x{{036F}}\s\x{{0B}}\x{{85}}\p{{Z}}]', '', 'g')"
    return _squeeze(f"translate({bare}, '{phonetics.FROM}', '{phonetics.TO}')")


def _homophones(rows: str, extra: str = "") -> str:
    return f"""
        SELECT phonemes, array_to_string(list_sort(list(DISTINCT word)), '|') AS words FROM ({rows})
        WHERE word IS NOT NULL AND phonemes IS NOT NULL
        GROUP BY phonemes HAVING count(DISTINCT word) > 1 {extra}"""


def _near(left: str, right: str) -> str:
    """CTE `near(a, b, distance)` of keys within one edit, by deletions with their place: exact without `levenshtein`."""

    def less(rows: str) -> str:
        return f"""SELECT k, i, substring(k, 1, i - 1) || substring(k, i + 1) AS rest
                   FROM (SELECT k, unnest(range(1, length(k) + 1))::INT AS i FROM {rows})"""

    return f"""
        ka AS (SELECT DISTINCT phonemes AS k FROM {left} WHERE phonemes IS NOT NULL),
        kb AS (SELECT DISTINCT phonemes AS k FROM {right} WHERE phonemes IS NOT NULL),
        la AS ({less("ka")}), lb AS ({less("kb")}),
        near AS (
          SELECT ka.k AS a, kb.k AS b, 0 AS distance FROM ka JOIN kb ON ka.k = kb.k
          UNION SELECT la.k, lb.k, 1 FROM la JOIN lb ON la.i = lb.i AND la.rest = lb.rest AND la.k <> lb.k
          UNION SELECT la.k, kb.k, 1 FROM la JOIN kb ON la.rest = kb.k
          UNION SELECT ka.k, lb.k, 1 FROM ka JOIN lb ON ka.k = lb.rest)"""


def _similar(left: str, right: str) -> str:
    return f"""
        WITH {_near(left, right)}
        SELECT x.ord, y.ord AS match_ord, distance::BIGINT AS distance
        FROM {left} x JOIN near ON x.phonemes = a JOIN {right} y ON y.phonemes = b
        WHERE x.word IS NOT NULL AND y.word IS NOT NULL AND (x.word <> y.word OR x.phonemes <> y.phonemes)"""


def _similar_twice() -> str:
    """Pairs within two edits: candidates share a string left after up to two deletions. The edit distance of bytes is
    that of code points once the different characters of a pair are mapped to single bytes."""
    less = "list_distinct(flatten(list_transform({0}, lambda s: list_transform(range(1, length(s) + 1), lambda i: substring(s, 1, i::INT - 1) || substring(s, i::INT + 1)))))"
    ascii_ = "".join(chr(c) for c in range(48, 127) if chr(c) not in "'\\")
    return f"""
        WITH keys AS (SELECT DISTINCT phonemes AS k FROM dictionary WHERE phonemes IS NOT NULL),
        once AS (SELECT k, {less.format("[k]")} AS one FROM keys),
        probes AS (SELECT DISTINCT k, unnest(list_concat([k], one, {less.format("one")})) AS probe FROM once),
        candidates AS (
          SELECT DISTINCT x.k AS a, y.k AS b FROM probes x JOIN probes y USING (probe) WHERE abs(length(x.k) - length(y.k)) <= 2),
        mapped AS (SELECT a, b, array_to_string(list_sort(list_distinct(string_split(a || b, ''))), '') AS chars FROM candidates),
        near AS (
          SELECT a, b, levenshtein(translate(a, chars, left('{ascii_}', length(chars))), translate(b, chars, left('{ascii_}', length(chars)))) AS distance
          FROM mapped WHERE CASE WHEN length(chars) > {len(ascii_)} THEN error('too many characters') ELSE true END)
        SELECT x.ord, y.ord AS match_ord, distance::BIGINT AS distance
        FROM dictionary x JOIN near ON x.phonemes = a AND distance <= 2 JOIN dictionary y ON y.phonemes = b
        WHERE x.word IS NOT NULL AND y.word IS NOT NULL AND (x.word <> y.word OR x.phonemes <> y.phonemes)"""


def _phonemes_sql(entries: str, keep: str) -> str:
    """The rules of the phonemiser, applied in order."""

    def said(rules: list[tuple[str, str]]) -> str:
        out = "lower(word)"
        for pattern, sound in rules:
            out = f"regexp_replace({out}, '{pattern}', '{sound.replace('$', chr(92))}', 'g')"
        return out

    cases = " ".join(f"WHEN lang = '{lang}' THEN {said(rules + phonemise.COMMON)}" for lang, rules in phonemise.RULES.items())
    return f"""
        SELECT ord, {keep}word, phonemes FROM (
          SELECT ord, lang, word, CASE {cases} ELSE {said(phonemise.COMMON)} END AS phonemes
          FROM (SELECT ord, lang, {_trim("entry")} AS word FROM ({entries})) WHERE word <> '') WHERE phonemes <> ''"""


_QUOTED = '"(?:[^"]|"")*"'
_FIELD = f'(?:{_QUOTED}|[^"\\t][^\\t]*|)'


def _parsed_sql() -> str:
    values = [
        _trim(f"""CASE WHEN starts_with(f[{i}], '"') THEN replace(f[{i}][2:-2], '""', '"') ELSE f[{i}] END""") for i in range(1, 6)
    ]
    named = ", ".join(f"CASE WHEN row THEN {v} END AS {name}" for v, name in zip(values, malformed.FIELDS))
    return rf"""
        kept AS (
          SELECT line_id, raw, regexp_full_match(raw, '(?s){_FIELD}(?:\t{_FIELD})*') AS quoted,
                 regexp_full_match(raw, '(?s){_FIELD}(?:\t{_FIELD}){{4}}') AS row
          FROM raw_lines WHERE raw IS NOT NULL AND NOT regexp_full_match(raw, '{WHITE}*')),
        split AS (
          SELECT *, list_transform(regexp_extract_all(chr(9) || raw, '(?s)\t{_FIELD}'), lambda x: substring(x, 2)) AS f FROM kept),
        parsed AS (SELECT line_id, quoted, row, {named} FROM split),
        judged AS (
          SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT row THEN 'columns'
            WHEN word = '' OR contains(word, chr(65533)) THEN 'word'
            WHEN phonemes = '' OR contains(phonemes, chr(65533)) OR regexp_matches(phonemes, '[0-9]') THEN 'phonemes'
            WHEN lang NOT IN (SELECT lang FROM voices WHERE lang IS NOT NULL) THEN 'lang'
            WHEN NOT regexp_full_match(freq, '[0-9]{{1,9}}') THEN 'freq'
            WHEN NOT regexp_full_match(added, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR TRY_CAST(added AS DATE) IS NULL
              OR starts_with(added, '0000') THEN 'added' END AS reason
          FROM parsed)"""


def _detect_sql() -> str:
    """`detect_language` in full: halves, profiles, confirmed labels, scores and scripts."""

    def grams(rows: str) -> str:
        """(key, gram, n) of (key, text)."""
        return rf"""
          SELECT key, gram, sum(n) AS n FROM (
            SELECT key, n, substring(w, i::INT, 3) AS gram FROM (
              SELECT key, n, w, unnest(range(1, length(w) - 1)) AS i FROM (
                SELECT key, ' ' || word || ' ' AS w, count(*) AS n
                FROM (SELECT key, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS word FROM ({rows}))
                WHERE word <> '' GROUP BY ALL))) GROUP BY ALL"""

    scripts = " ".join(
        rf"WHEN len(regexp_extract_all(outside, '\p{{{script}}}')) * {3 if script == 'Hiragana' else 2} > letters THEN '{code}'"
        for script, code in detect.SCRIPTS.items()
    )
    early = detect.PROFILE + 1
    return rf"""
        WITH labelled AS (
          SELECT doc_id, nullif(lower({_trim("lang")}), '') AS label, text, md5(text) AS hash FROM documents),
        parity AS (SELECT *, contains('13579bdf', right(hash, 1))::INT AS odd FROM labelled),
        ends AS (SELECT label AS l, max(hash) AS high, min(odd) <> max(odd) AS mixed, count(text) AS n FROM parity GROUP BY label),
        docs AS (
          SELECT doc_id, label, text, n, coalesce(CASE WHEN mixed THEN odd ELSE (hash = high)::INT END, odd, 0) AS half
          FROM parity JOIN ends ON label IS NOT DISTINCT FROM l),
        learnt AS (
          SELECT (1 - left(key, 1)::INT) AS half, substring(key, 2) AS lang, gram, rank FROM (
            SELECT key, gram, row_number() OVER (PARTITION BY key ORDER BY n DESC, gram) AS rank FROM (
              {grams("SELECT half || label AS key, text FROM docs WHERE label IS NOT NULL AND text IS NOT NULL")}))
          WHERE rank <= {detect.PROFILE}),
        own AS MATERIALIZED ({grams("SELECT doc_id AS key, text FROM docs WHERE text IS NOT NULL")}),
        scored AS (
          SELECT doc_id, label, d.n, lang, sum(o.n * ({early} - rank)) AS score
          FROM docs d JOIN own o ON o.key = d.doc_id JOIN learnt l ON l.half = d.half AND l.gram = o.gram GROUP BY ALL),
        votes AS (
          SELECT s.label, s.doc_id, max(CASE WHEN lang = s.label THEN score END) >= max(score) AS won
          FROM scored s JOIN ends r ON r.l = s.lang WHERE s.label IS NOT NULL AND r.n >= s.n GROUP BY ALL),
        confirmed AS (
          SELECT l AS lang FROM ends LEFT JOIN votes ON votes.label = l WHERE l IS NOT NULL
          GROUP BY l, n HAVING 2 * count(*) FILTER (won) >= n),
        kept AS (
          SELECT lang FROM confirmed UNION SELECT l FROM ends WHERE l IS NOT NULL AND NOT EXISTS (FROM confirmed)),
        chosen AS (SELECT * FROM learnt SEMI JOIN kept USING (lang)),
        shared AS (
          SELECT half, gram, {early} - max(rank) AS least FROM chosen GROUP BY half, gram
          HAVING count(*) > 1 AND count(*) = (SELECT count(DISTINCT lang) FROM chosen c WHERE c.half = chosen.half)),
        plain AS (
          SELECT half, lang, gram, rank + coalesce(least, 0) AS rank FROM chosen LEFT JOIN shared USING (half, gram)
          WHERE rank + coalesce(least, 0) <= {detect.PROFILE}),
        final AS (
          SELECT doc_id, lang, sum(o.n * ({early} - rank)) AS score
          FROM docs d JOIN own o ON o.key = d.doc_id JOIN plain p ON p.half = d.half AND p.gram = o.gram GROUP BY ALL),
        ranked AS (
          SELECT doc_id, list(lang ORDER BY score DESC, lang) AS langs, list(score ORDER BY score DESC, lang) AS scores
          FROM final GROUP BY doc_id),
        letters AS (
          SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\P{{L}}+', '', 'g')) AS letters,
                 regexp_replace(coalesce(text, ''), '[\p{{Latin}}\P{{L}}]+', '', 'g') AS outside FROM documents)
        SELECT doc_id, coalesce(
            CASE WHEN length(outside) * 3 > letters THEN CASE {scripts} END END,
            CASE WHEN letters >= {detect.LEAST_LETTERS}
              AND 100 * letters * scores[1] >= ({detect.LEAD} * letters + {detect.SHORT}) * coalesce(scores[2], 0) THEN langs[1] END) AS language
        FROM letters LEFT JOIN ranked USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Every query of the core has its SQL."""
    finished = "list_sort(list_distinct(list_filter(words, lambda x: x IS NOT NULL)))"
    merged = """
        WITH RECURSIVE held AS (
          SELECT set_id, list_filter(words, lambda x: x IS NOT NULL AND x <> '') AS w FROM word_groups),
        edges AS (SELECT DISTINCT w[1] AS a, unnest(w) AS b FROM held WHERE len(w) > 0),
        arcs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        reached(item, other) AS (
          SELECT a, a FROM arcs UNION SELECT r.item, arcs.b FROM reached r JOIN arcs ON arcs.a = r.other),
        labels AS (SELECT item, min(other) AS label FROM reached GROUP BY item)"""
    return {
        "p2_found": f"WITH {_parsed_sql()} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
        "p2_rows": f"""WITH {_parsed_sql()}
            SELECT line_id, word, phonemes, lang, freq::INT AS freq, added FROM judged WHERE reason IS NULL""",
        "normalize_phonemes": f"SELECT ord, {_normalize('phonemes')} AS phonemes FROM dictionary",
        "squeeze_runs": f"SELECT ord, {_squeeze('phonemes')} AS phonemes FROM dictionary",
        "grapheme_lengths": """SELECT ord, length_grapheme(word)::BIGINT AS n_graphemes, length(word)::BIGINT AS n_points
            FROM dictionary""",
        "word_length_filter": f"""SELECT ord, word FROM dictionary
            WHERE length_grapheme(word) BETWEEN {SHORTEST} AND {LONGEST}""",
        "trimmed_entries": f"SELECT ord, word FROM (SELECT ord, {_trim('entry')} AS word FROM word_list) WHERE word <> ''",
        "entry_tokens": f"""
            SELECT ord, (i - 1)::BIGINT AS nth, w[i] AS token FROM (
              SELECT ord, w, unnest(range(1, len(w) + 1)) AS i FROM (
                SELECT ord, list_filter(regexp_split_to_array(entry, '{WHITE}+'), lambda x: x <> '') AS w FROM word_list))""",
        "dictionary_parse": f"""
            SELECT ord, {_trim("split_part(line, chr(9), 1)")} AS word,
                   {_trim("substring(line, strpos(line, chr(9)) + 1)")} AS phonemes
            FROM (SELECT line_id AS ord, {_trim("raw")} AS line FROM raw_lines) WHERE contains(line, chr(9))""",
        "dictionary_lines": """SELECT word || chr(9) || phonemes AS value FROM dictionary
            WHERE word IS NOT NULL AND phonemes IS NOT NULL""",
        "document_lines": """
            SELECT doc_id, (len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END)::BIGINT AS n_lines
            FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l
                  FROM documents WHERE text IS NOT NULL)""",
        "document_words": r"""
            SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents)
            WHERE word <> '' GROUP BY word""",
        "homophone_groups": _homophones("FROM dictionary"),
        "homophone_members": """SELECT DISTINCT phonemes, word FROM dictionary WHERE word IS NOT NULL AND phonemes IN (
            SELECT phonemes FROM dictionary GROUP BY phonemes HAVING count(DISTINCT word) > 1)""",
        "homophone_groups_normalized": _homophones(f"SELECT word, {_normalize('phonemes')} AS phonemes FROM dictionary"),
        "homophone_groups_bounded": _homophones(
            f"FROM dictionary WHERE length_grapheme(word) BETWEEN {SHORTEST} AND {LONGEST}"
        ),
        "cross_homophones": _homophones("FROM dictionary WHERE src IS NOT NULL", "AND count(DISTINCT src) = 2"),
        "homophone_count": f"""SELECT count(*) AS groups, coalesce(sum(len(string_split(words, '|'))), 0)::BIGINT AS words
            FROM ({_homophones("FROM dictionary")})""",
        "finished_groups": f"""SELECT set_id, array_to_string({finished}, '|') AS words FROM word_groups
            WHERE len({finished}) > 1""",
        "words_by_list": """SELECT list_key, string_agg(entry, '|' ORDER BY ord) AS entries FROM word_list
            WHERE entry IS NOT NULL GROUP BY list_key""",
        "entries_by_list": """SELECT list_key, entry, row_number() OVER (PARTITION BY list_key ORDER BY ord) - 1 AS nth
            FROM word_list WHERE entry IS NOT NULL""",
        "dictionary_runs": """
            SELECT ord, lang, word, phonemes, freq, 'all' AS same FROM dictionary
            QUALIFY lang IS DISTINCT FROM lag(lang) OVER (ORDER BY ord) OR row_number() OVER (ORDER BY ord) = 1""",
        "constant_runs": "SELECT ord, word, phonemes, 'all' AS same FROM dictionary ORDER BY ord LIMIT 1",
        "language_runs": """
            SELECT ord, lang FROM (SELECT ord, lang, lag(lang) OVER (ORDER BY ord) AS prev,
              row_number() OVER (ORDER BY ord) AS nth FROM dictionary) WHERE nth = 1 OR lang IS DISTINCT FROM prev""",
        "languages_first_seen": "SELECT lang, min(ord) AS ord FROM dictionary WHERE lang IS NOT NULL GROUP BY lang",
        "similar_pairs_d1": _similar("dictionary", "dictionary"),
        "similar_pairs_d2": _similar_twice(),
        "cross_similar_d1": _similar("(SELECT * FROM dictionary WHERE src = 0)", "(SELECT * FROM dictionary WHERE src = 1)"),
        "similar_lists_d1": f"""
            SELECT p.ord, x.word, string_agg(y.word, '|' ORDER BY p.match_ord) AS matches
            FROM ({_similar("dictionary", "dictionary")}) p JOIN dictionary x ON x.ord = p.ord
            JOIN dictionary y ON y.ord = p.match_ord GROUP BY p.ord, x.word""",
        "lookup_similar": f"""
            WITH {_near("(SELECT phonemes FROM dictionary WHERE phonemes <> '' GROUP BY phonemes ORDER BY count(*) DESC, phonemes LIMIT 1)", "dictionary")}
            SELECT ord, word, phonemes FROM dictionary WHERE phonemes IN (SELECT b FROM near)""",
        "search_similar_d1": f"""
            WITH {_near(f"(SELECT * FROM dictionary WHERE ord % {SEARCHED} = 0)", "dictionary")}
            SELECT x.ord, y.ord AS match_ord, distance::BIGINT AS distance
            FROM dictionary x JOIN near ON x.phonemes = a JOIN dictionary y ON y.phonemes = b WHERE x.ord % {SEARCHED} = 0""",
        "cluster_similar": f"""
            WITH RECURSIVE {_near("dictionary", "dictionary")},
            links AS (SELECT a, b FROM near WHERE a <> b),
            reached(phonemes, other) AS (
              SELECT a, a FROM links UNION SELECT r.phonemes, links.b FROM reached r JOIN links ON links.a = r.other)
            SELECT phonemes, min(other) AS label FROM reached GROUP BY phonemes""",
        "merge_groups": f"""{merged}
            SELECT string_agg(item, '|' ORDER BY item) AS words FROM labels GROUP BY label HAVING count(*) > 1""",
        "merged_members": f"{merged} SELECT item, label FROM labels",
        "default_voices": """SELECT lang, filename, priority FROM voices WHERE lang IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY lang ORDER BY priority DESC, filename) = 1""",
        "voices_by_language": """SELECT lang, string_agg(filename, '|' ORDER BY priority DESC, filename) AS filenames
            FROM voices WHERE lang IS NOT NULL GROUP BY lang""",
        "catalogue_report": """
            SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY priority DESC, filename) - 1)::BIGINT AS nth,
              repeat(' ', w - strlen(filename)) || filename || ' ' || lpad(priority::VARCHAR, w::INT, ' ') AS line
            FROM voices, (SELECT greatest(8, max(strlen(filename))) AS w FROM voices) WHERE lang IS NOT NULL""",
        "language_codes": f"""
            SELECT code, count(lang) AS n
            FROM (SELECT unnest({list(languages.LANGUAGE_CODES.values())}) AS code)
            LEFT JOIN dictionary ON lang = code GROUP BY code""",
        "dictionary_voices": """
            SELECT ord, filename FROM dictionary LEFT JOIN (
              SELECT lang, filename FROM voices QUALIFY row_number() OVER (PARTITION BY lang ORDER BY priority DESC, filename) = 1)
            USING (lang)""",
        "phonemize_words": _phonemes_sql("SELECT ord, 'de' AS lang, entry FROM word_list", ""),
        "phonemize_by_language": _phonemes_sql("SELECT ord, lang, word AS entry FROM dictionary", "lang, "),
        "detect_language": _detect_sql(),
        "language_profiles": rf"""
            WITH words AS (
              SELECT lang, ' ' || word || ' ' AS w, count(*) AS n
              FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS word FROM documents
                    WHERE lang IS NOT NULL) WHERE word <> '' GROUP BY ALL),
            grams AS (
              SELECT lang, gram, sum(n) AS n
              FROM (SELECT lang, n, substring(w, i::INT, 3) AS gram FROM (SELECT lang, n, w, unnest(range(1, length(w) - 1)) AS i FROM words))
              GROUP BY ALL)
            SELECT lang, gram, rank FROM (
              SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank FROM grams)
            WHERE rank <= {detect.PROFILE}""",
    }
