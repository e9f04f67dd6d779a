"""One query per training-data operator, with its DuckDB statement where SQL can
state it. Each query reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, embedding_dedup, filter_audit, html_extract, language_id, mixing, ngram_join, packing, quality_fm, quality_rules, substring_dedup, suffix_dedup
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, text, len({WORDS_SQL}) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s),
m AS (SELECT *, most / weight AS meets, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
t AS (SELECT *, (total - CAST(coalesce(sum(most) OVER (ORDER BY meets, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(weight) OVER (ORDER BY meets, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM m),
g AS (SELECT source, source_size, least(CAST(most AS DOUBLE), weight * (SELECT arg_min(level, (meets, nth)) FROM t WHERE level <= meets)) AS target,
    (CAST(('0x' || substr(md5(coalesce(source, '')), 1, 4)) AS BIGINT) + 0.5::DOUBLE) / 65536 AS off FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.off, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id) - 1 AS rank
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * greatest(0, least(3, floor(rate * (rank + 1) + off) - floor(rate * rank + off))) AS BIGINT) AS taken
FROM r
"""

RULES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM (SELECT doc_id, unnest(list(i)) AS i FROM win GROUP BY doc_id, win HAVING count(*) > 1)) GROUP BY doc_id),
ln AS (SELECT doc_id, host, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)),
l AS (SELECT doc_id, host, line, md5(array_to_string(ws, ' ')) AS h, len(ws) AS n FROM ln WHERE len(ws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
sets AS (SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list(h))), '')) AS line_set FROM l GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT line_set) AS host_docs FROM l JOIN sets USING (doc_id) GROUP BY host),
often AS (SELECT host, h FROM (SELECT host, h, count(DISTINCT line_set) AS line_docs FROM l JOIN sets USING (doc_id) GROUP BY host, h)
    JOIN hosts USING (host) WHERE line_docs > {quality_rules.MIN_LINE_DOCS} AND line_docs * 100 > {quality_rules.LINE_DOCS_PCT} * host_docs),
gone AS (SELECT doc_id, sum(n) AS n FROM l JOIN often USING (host, h) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS words_on_frequent_lines
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  (n_words - words_on_frequent_lines) * 100 < {quality_rules.KEEP_PCT} * n_words AS depleted,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT ((n_words - words_on_frequent_lines) * 100 < {quality_rules.KEEP_PCT} * n_words) AS kept
FROM f
"""


EMBEDDING_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN links USING (vec_id)
"""


PHRASES_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, unnest(range(1, 6)) AS r(m)),
f AS (SELECT lang, list_slice(ws, i, i + m - 1) AS ph, m, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, ph, m, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.ph, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.ph = list_slice(c.ph, 1, k) JOIN f y ON y.lang = c.lang AND y.ph = list_slice(c.ph, k + 1, c.m) JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
q AS (SELECT lang, ph, m, f, unnest(range(2, m)) AS j FROM f WHERE m > 2),
inside AS (SELECT lang, list_slice(ph, i, i + j - 1) AS ph, max(f) AS longer FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM q) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN inside ON inside.lang = b.lang AND inside.ph = b.ph
  WHERE coalesce(100 * longer < 100 * a, true))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000
"""

AUDIT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents),
m AS (SELECT doc_id, part, list_value(len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)) AS fails FROM d),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(CASE WHEN good THEN 1 END) AS good, count(CASE WHEN toxic THEN 1 END) AS toxic
  FROM m LEFT JOIN lab USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(range(1, 6)) AS v),
o AS (SELECT [a.v, b.v, c.v, d.v, e.v] AS f FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
st AS (SELECT f, array_to_string(list_transform(f, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT c.*, st.filter_order, st.step, st.f[st.step] AS filter, fails[st.f[st.step]] AS here,
    list_bool_or(list_transform(list_slice(st.f, 1, st.step - 1), lambda x: fails[x])) AS before FROM c, st),
t AS (SELECT part, filter_order, step, filter,
    sum(CASE WHEN NOT here AND NOT coalesce(before, false) THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT coalesce(before, false) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND before THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN here AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND NOT coalesce(before, false) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN here AND NOT coalesce(before, false) THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM t
"""


@register("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeat a smaller document, per document."""
    d = suffix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                    F.sha2("kept", 256).alias("kept_sha256"))


@register("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = language_id.fit(docs.filter(F.coalesce(~held_out, F.lit(True))))
    out = language_id.predict(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@register("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in windows that repeat an earlier one, per document."""
    d = substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op4_mixing", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all documents takes from each."""
    c = mixing.copies(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register("op5_ngram_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 3-word shingles and similarity 0.9."""
    return ngram_join.components(table(spark, sf_dir, "documents"))


@register("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op7_html_extract")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@register("op8_embedding_dedup", EMBEDDING_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


@register("op9_quality_rules", RULES_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@register("op10_quality_fm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from three quarters of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    labels = table(spark, sf_dir, "labels").filter(F.col("quality").isNotNull() & ~held_out).select(F.col("doc_id").alias("id"), "quality")
    model = quality_fm.fit(docs.join(labels, F.col("doc_id") == F.col("id")))
    out = quality_fm.score(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@register("op11_collocations", PHRASES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


@register("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and their bytes."""
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), offsets=False)
    d = byte_bpe.decode(ids)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op13_filter_audit", AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in every order."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
