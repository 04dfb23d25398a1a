"""The registered queries of this package, and the SQL that must give the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate.llm import (
    bpe, curriculum, decontaminate, hard_negatives, html_text, importance, licenses, line_rules, ngram_join,
    quotes, substrings, token_counts, vector_codes,
)
from reelstate.llm.common import table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


LINE_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), word AS (
    SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
           string_split(text, chr(10)) AS ls
    FROM docs
), line AS (
    SELECT rid, doc_id, source, text, ls[p] AS raw,
           lower(trim(regexp_replace(ls[p], '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
           len(list_filter(regexp_split_to_array(ls[p], '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
    FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS p FROM word)
    WHERE regexp_matches(ls[p], '[^\x20\x09-\x0D]')
), dup AS (
    SELECT rid, count(*) - count(DISTINCT raw) AS n_dup_lines FROM line GROUP BY rid
), win AS (
    SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS w
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM word)
), twice AS (
    SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, w) > 1
), rep AS (
    SELECT rid, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid
), often AS (
    SELECT l.source, l.line, min({'d': l.doc_id, 't': l.text}) AS first
    FROM line l GROUP BY l.source, l.line
    HAVING count(DISTINCT l.text) > 10
), gone AS (
    SELECT l.rid, sum(l.n) AS n_removed_words
    FROM line l JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.line = l.line
    WHERE NOT (l.doc_id IS NOT DISTINCT FROM o.first.d AND l.text = o.first.t)
    GROUP BY l.rid
), base AS (
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
           CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT)
               AS n_symbols,
           coalesce(n_dup_lines, 0) AS n_dup_lines,
           CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
           CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
    FROM word w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND n_words - n_removed_words >= 0.2 * n_words AS kept
FROM base
"""


@query(LINE_SQL)
def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of all documents, boilerplate lines counted across documents."""
    return line_rules.verdicts(table(spark, sf_dir, "documents"))


@query(LINE_SQL)
def op3_fixed_limit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules with their limit given by name."""
    return line_rules.verdicts(table(spark, sf_dir, "documents"), least=10, share=0)


@query()
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in a window of a benchmark item."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))
    return found.drop("hit_words")


@query()
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded through the table of their distinct words."""
    return bpe.encoded(table(spark, sf_dir, "documents"), with_ids=False, with_text=False)


@query()
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in a window seen earlier."""
    return substrings.removals(table(spark, sf_dir, "documents"))


@query()
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents that share four fifths of their word 5-grams."""
    return ngram_join.linked(table(spark, sf_dir, "documents"))


QUOTE_SQL = r"""
WITH RECURSIVE msg AS (
    SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text
    FROM conversations
), raw AS (
    SELECT rid, p, ls[p] AS line,
           length(regexp_replace(regexp_extract(ls[p], '^[ \t]*((?:>[ \t]*)+)', 1), '[^>]', '', 'g'))
               AS level,
           regexp_replace(ls[p], '^[ \t]*((?:>[ \t]*)+)', '') AS body
    FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS p
          FROM (SELECT rid, string_split(translate(text, chr(1), ' '), chr(10)) AS ls FROM msg))
), line AS (
    SELECT rid, p, body,
           CASE WHEN coalesce(lead(level) OVER (PARTITION BY rid ORDER BY p), 0) > level
                     AND regexp_matches(body, '(?i)^[ \t]*(?:on [^\n]* wrote|[^\n]* wrote|-+ *original message *-+)[ \t]*:?[ \t]*$')
                THEN -1 ELSE level END AS level
    FROM raw
), run AS (
    SELECT *, p - row_number() OVER (PARTITION BY rid, level ORDER BY p) AS island FROM line
), passage AS (
    SELECT rid, level, row_number() OVER (PARTITION BY rid, level ORDER BY min(p)) AS no,
           min(p) AS spot, string_agg(body, chr(10) ORDER BY p) AS text
    FROM run WHERE level >= 0 GROUP BY rid, level, island
    HAVING trim(regexp_replace(string_agg(body, ' '), '[\x20\x09-\x0D]+', ' ', 'g')) <> ''
), para AS (
    SELECT rid, level, no, unnest(range(1, len(ps) + 1)) AS q, ps
    FROM (SELECT *, regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n') AS ps FROM passage)
), piece AS (
    SELECT rid, level, no, 0 AS par, 0 AS part, text FROM passage
    UNION ALL
    SELECT rid, level, no, q, 0, ps[q] FROM para
    UNION ALL
    SELECT rid, level, no, q, p, ls[p]
    FROM (SELECT rid, level, no, q, ls, unnest(range(1, len(ls) + 1)) AS p
          FROM (SELECT *, string_split(ps[q], chr(10)) AS ls FROM para))
    UNION ALL
    SELECT rid, 0, 0, -1, -1, string_agg(text, chr(10) ORDER BY spot) FROM passage WHERE level = 0
    GROUP BY rid
), norm AS (
    SELECT DISTINCT conv_id, turn, level, no, par, part,
           lower(trim(regexp_replace(p.text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS text
    FROM piece p JOIN msg m ON m.rid = p.rid
), said AS (
    SELECT conv_id, text, min(turn) AS original FROM norm
    WHERE level = 0 AND text <> '' AND turn IS NOT NULL GROUP BY conv_id, text
), hit AS (
    SELECT n.conv_id, n.turn, level, no, par, part, length(n.text) AS chars, original
    FROM norm n JOIN said s ON s.conv_id = n.conv_id AND s.text = n.text AND s.original < n.turn
    WHERE level > 0
), link AS (
    SELECT * FROM hit h WHERE NOT EXISTS (
        SELECT 1 FROM hit w WHERE w.conv_id = h.conv_id AND w.turn = h.turn AND w.level = h.level
        AND w.no = h.no AND (w.par = 0 AND h.par > 0 OR w.par = h.par AND w.part = 0 AND h.part > 0))
), vote AS (
    SELECT conv_id, turn, level, original, sum(chars) AS chars, count(*) AS n FROM link
    GROUP BY conv_id, turn, level, original
), answer AS (
    SELECT conv_id, turn, sum(n) AS n_linked,
           arg_max(original, {'level': -level, 'chars': chars, 'original': original}) AS reply_to
    FROM vote GROUP BY conv_id, turn
), thread AS (
    SELECT conv_id, turn, reply_to AS up, 1 AS depth FROM answer
    UNION ALL
    SELECT t.conv_id, t.turn, a.reply_to, t.depth + 1
    FROM thread t JOIN answer a ON a.conv_id = t.conv_id AND a.turn = t.up
), top AS (
    SELECT conv_id, turn, min(up) AS thread, max(depth) AS depth FROM thread GROUP BY conv_id, turn
), own AS (
    SELECT rid, greatest(max(level), 0) AS max_level,
           count(*) FILTER (WHERE level > 0) AS n_quoted_lines,
           string_agg(body, chr(10) ORDER BY p) FILTER (WHERE level = 0) AS text
    FROM line GROUP BY rid
)
SELECT m.conv_id, m.turn, m.role,
       CASE WHEN o.max_level > 0 THEN regexp_replace(regexp_replace(coalesce(o.text, ''),
            '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')
            ELSE m.text END AS own_text,
       CAST(o.max_level AS BIGINT) AS max_level, o.n_quoted_lines,
       CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, reply_to,
       coalesce(thread, m.turn) AS thread, CAST(coalesce(depth, 0) AS BIGINT) AS depth
FROM msg m JOIN own o USING (rid)
LEFT JOIN answer a ON a.conv_id = m.conv_id AND a.turn = m.turn
LEFT JOIN top t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""


@query(QUOTE_SQL)
def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own text, answered message and thread of all messages, in reply order."""
    return quotes.reply_ordered(quotes.linked(table(spark, sf_dir, "conversations")))


_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', '{text}')"
                           for i, (label, text) in enumerate(licenses.TEMPLATES))
_PHRASE_ROWS = ", ".join(f"(['{phrase.replace(' ', chr(39) + ', ' + chr(39))}'], '{label}')"
                         for phrase, label in licenses.PHRASES.items())
LICENSE_SQL = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '{_NOT_WORD}'), lambda x: x <> '') AS ws
    FROM documents
), phrase(pw, label) AS (VALUES {_PHRASE_ROWS}),
place AS (
    SELECT rid, label, i - 1 AS start
    FROM (SELECT rid, ws, pw, label, unnest(range(1, len(ws) + 1)) AS i FROM doc, phrase)
    WHERE ws[i:i + len(pw) - 1] = pw
), base AS (
    SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
           list(DISTINCT label) AS ls
    FROM place GROUP BY rid
), template AS (
    SELECT id, label, list_distinct(list_filter(
        regexp_split_to_array(lower(text), '{_NOT_WORD}'), lambda x: x <> '')) AS tw
    FROM (VALUES {_TEMPLATE_ROWS}) AS t(id, label, text)
), part AS (
    SELECT rid, unnest(string_split(text, chr(10))) AS part FROM doc
    UNION ALL
    SELECT rid, unnest(regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n')) FROM doc
), held AS (
    SELECT rid, label, len(list_intersect(bw, tw)) / len(tw) AS contained
    FROM (SELECT rid, list_filter(regexp_split_to_array(translate(part,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '{_NOT_WORD}'), lambda x: x <> '') AS bw FROM part), template
    WHERE len(list_intersect(bw, tw)) >= 0.8 * len(tw) - 1e-9
), best AS (
    SELECT rid, list(DISTINCT label) AS ls, max(contained) AS score FROM held GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       first_word, last_word,
       array_to_string(list_sort(coalesce(b.ls, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(h.ls, [])))), ',')
           AS labels,
       coalesce(score, 0.0) AS score
FROM doc LEFT JOIN base b USING (rid) LEFT JOIN best h USING (rid)
"""


@query(LICENSE_SQL)
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents, in lines and in notices over several lines."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query(LICENSE_SQL)
def op7_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan with its blocks given by name."""
    return licenses.scanned(table(spark, sf_dir, "documents"), paragraphs=True)


@query()
def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighted by the models of good and of all text, and the sample drawn."""
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all lines of all documents, the documents encoded as a whole."""
    return token_counts.counted(table(spark, sf_dir, "documents"))


@query()
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


def _book(of: str, before: str) -> str:
    """The codebook after a round: floors of means; unused entries stay."""
    means = ", ".join(f"CAST(floor(sum(x{i}) / count(*)) AS BIGINT) AS x{i}" for i in range(1, 5))
    kept = ", ".join(f"coalesce(n.x{i}, b.x{i}) AS x{i}" for i in range(1, 5))
    return f"""(
    SELECT b.p, b.e, {kept} FROM {before} b
    LEFT JOIN (SELECT p, e, {means} FROM part JOIN {of} USING (rid, p) GROUP BY p, e) n
    ON n.p = b.p AND n.e = b.e
)"""


def _codes(book: str) -> str:
    """Each part's nearest entry, the lowest of equals, and its distance."""
    far = " + ".join(f"(part.x{i} - b.x{i}) * (part.x{i} - b.x{i})" for i in range(1, 5))
    return f"""(
    SELECT rid, p, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d
    FROM (SELECT rid, part.p AS p, b.e AS e, {far} AS d FROM part JOIN {book} b ON b.p = part.p)
    GROUP BY rid, p
)"""


CODES_SQL = f"""
WITH kept AS (
    SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding,
        lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
    SELECT rid, vec_id, p, v[p * 4 + 1] AS x1, v[p * 4 + 2] AS x2, v[p * 4 + 3] AS x3, v[p * 4 + 4] AS x4
    FROM kept, range(16) AS parts(p)
), first AS (
    SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64
), b0 AS (
    SELECT p, e, x1, x2, x3, x4 FROM part JOIN first USING (rid)
), a0 AS {_codes("b0")}, b1 AS {_book("a0", "b0")}, a1 AS {_codes("b1")}, b2 AS {_book("a1", "b1")},
a2 AS {_codes("b2")}, book AS (
    SELECT sha256(string_agg(x1 || ',' || x2 || ',' || x3 || ',' || x4, ',' ORDER BY p, e)) AS books FROM b2
), row AS (
    SELECT rid, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM a2 GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       books AS codebooks_sha256
FROM row JOIN kept USING (rid), book
"""


@query(CODES_SQL)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors coded by parts, the codebooks trained on all of them."""
    return vector_codes.reported(table(spark, sf_dir, "embeddings"))


MIX_SQL = r"""
WITH doc AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS place
    FROM documents
), src AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS total,
           CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS kind, kind + 1.0::DOUBLE AS weight
    FROM doc GROUP BY source
), filled AS (
    SELECT *, sum(CAST(total AS DOUBLE)) OVER () AS every,
           coalesce(sum(3.0::DOUBLE * total) OVER (ORDER BY total / weight, source ROWS BETWEEN UNBOUNDED PRECEDING
               AND 1 PRECEDING), 0) AS fixed,
           sum(weight) OVER (ORDER BY total / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM src
), level AS (
    SELECT every - fixed AS words, rest AS weights FROM filled
    WHERE weight * (every - fixed) / rest <= 3.0::DOUBLE * total ORDER BY fixed LIMIT 1
), target AS (
    SELECT source, total, kind, weight, least(weight * words / weights, 3.0::DOUBLE * total) AS target
    FROM src, level
), laid AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
    FROM doc
), placed AS (
    SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS wanted,
           CASE WHEN size > 0 AND start < wanted
                THEN weight * CAST(start AS DOUBLE) / CAST(wanted AS DOUBLE) END AS demand,
           [0.0::DOUBLE, 0, CASE WHEN demand >= 1 THEN 0.5 ELSE 0 END][kind + 1] AS leg,
           [1.0::DOUBLE, 3, 2][kind + 1] AS high,
           [0.0::DOUBLE, -2, CASE WHEN demand >= 1 THEN 8 ELSE 0 END][kind + 1] AS slope,
           demand - CASE WHEN leg > 0 THEN 1 ELSE 0 END AS over
    FROM laid JOIN target USING (source)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, total AS source_size, target,
       CAST(greatest(0, least(size, wanted - start)) + greatest(0, least(size, wanted - start - total))
            + greatest(0, least(size, wanted - start - 2 * total)) AS BIGINT) AS taken,
       leg + CASE WHEN over <= 0 THEN 0 ELSE 2 * over / (high + sqrt(high * high + 2 * slope * over)) END AS position
FROM placed
"""


@query(MIX_SQL)
def op13_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that a mix of their sources takes, in the order of training."""
    found = curriculum.placed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "position")


NEGATIVES_SQL = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), kept AS (
    SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1
), part AS (
    SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM kept
), score AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, sum(a.x * b.x) AS score
    FROM part a JOIN part b ON a.i = b.i AND a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0 GROUP BY ALL
), positive AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM score WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (
           PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, CAST(positive_score AS BIGINT) AS positive_score,
       CAST(score AS BIGINT) AS negative_score
FROM positive JOIN score USING (anchor_id)
WHERE NOT alike AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""


@query(NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, searched for among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(vectors.withColumn("label", moved))
