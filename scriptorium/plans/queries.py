"""Queries over the tables, one per operator, and SQL that gives the same rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions import urls as U
from scriptorium.functions import vectors as V
from scriptorium.operators import answers, batches, chunking, corpus, index, rerankers, search
from scriptorium.session import cut, shared_folder, table
from scriptorium.sources import books, html, records, web

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return register


def pages_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, a key once; only what a query names is read."""
    return table(spark, sf_dir, "pages")


# Documents stand for page records: the language and book are theirs, every fifth is of the demo edition.
# --- statistics
@query("SELECT lang, edition, count(*) AS pages, sum(length(text)) AS chars FROM (SELECT DISTINCT page_id, lang, edition, text FROM pages) GROUP BY lang, edition")
def corpus_page_stats(spark, sf_dir):
    # lengths move, not texts
    return corpus.page_stats(pages_(spark, sf_dir).select("page_id", "lang", "edition", F.length("text").alias("n")).distinct(), F.col("n"))


@query("SELECT source, count(*) AS docs, sum(n_chars) AS chars FROM documents GROUP BY source")
def corpus_char_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("SELECT chapter, count(*) AS pages FROM (SELECT DISTINCT page_id, chapter FROM pages WHERE lang = 'cs' AND edition = 'full') GROUP BY chapter ORDER BY chapter NULLS LAST")
def chapter_counts_nulls_last(spark, sf_dir):
    return corpus.chapter_counts(pages_(spark, sf_dir).select("page_id", "lang", "edition", "chapter").distinct())


@query("SELECT DISTINCT book FROM pages WHERE book <> '' ORDER BY book")
def distinct_books(spark, sf_dir):
    return corpus.books(pages_(spark, sf_dir))


@query("SELECT id, lang, edition FROM (SELECT DISTINCT id, lang, edition FROM chunks) WHERE lang = 'cs' AND edition IN ('full')")
def edition_lang_mask(spark, sf_dir):
    return search.mask(table(spark, sf_dir, "chunks").select("id", "lang", "edition"), "cs", ("full",)).distinct()


@query("SELECT DISTINCT p.page_id, p.edition_key, e.lang, e.edition FROM pages p JOIN editions e ON p.edition_key = e.edition_key")
def edition_lookup(spark, sf_dir):
    # four rows, fixed
    return pages_(spark, sf_dir).select("page_id", "edition_key").join(F.broadcast(table(spark, sf_dir, "editions")), "edition_key").select("page_id", "edition_key", "lang", "edition").distinct()


# --- words
FOLDED = "strip_accents(w)"
TOKENS = """
toks AS (
  SELECT {key}, unnest(list_transform(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: NOT regexp_full_match(w, '\\p{{Nd}}{{5,}}')), lambda w: strip_accents(w))) AS t FROM {source}
), terms AS (
  SELECT {key}, t AS term FROM toks UNION ALL SELECT {key}, t[1:6] AS term FROM toks WHERE length(t) > 6
)"""


def terms(key: str, text: str, source: str, name: str = "") -> str:
    out = TOKENS.format(key=key, text=text, source=source)
    return out.replace("toks", f"{name}toks").replace("terms AS", f"{name}terms AS") if name else out


@query(f"WITH {terms('doc_id', 'text', 'documents')} SELECT term, count(*) AS n FROM terms GROUP BY term")
def tokenize_terms(spark, sf_dir):
    return index.term_rows(table(spark, sf_dir, "documents"), "doc_id").groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {terms('doc_id', 'text', 'documents')} SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY term, doc_id")
def doc_term_freq(spark, sf_dir):
    return index.postings(table(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {terms('doc_id', 'text', 'documents')} SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN terms t USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id")
def doc_length(spark, sf_dir):
    return index.doc_len(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id")


@query(f"WITH {terms('doc_id', 'text', 'documents')} SELECT term, count(DISTINCT doc_id) AS df FROM terms GROUP BY term")
def term_document_freq(spark, sf_dir):
    # one row per document and distinct term, deduplicated within the document before the shuffle
    rows = index.token_rows(table(spark, sf_dir, "documents"), "doc_id").select(F.explode(F.array_distinct("tokens")).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {terms('doc_id', 'text', 'documents')}, l AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN terms t USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM l")
def corpus_avgdl(spark, sf_dir):
    stats = index.corpus_stats(index.doc_len(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id"))
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"))


CS, EN = (", ".join(f"'{w}'" for w in ws) for ws in (X.CS_WORDS, X.EN_WORDS))
W = "[ \\t\\r\\n\\x0b\\f]"
GUESS = f"""
CASE WHEN regexp_matches(text, '[{X.CS_LETTERS}]') THEN 'cs'
WHEN len(list_filter(ws, lambda w: w IN ({CS}))) > len(list_filter(ws, lambda w: w IN ({EN}))) THEN 'cs' ELSE 'en' END"""
WORDS = f"""list_transform(regexp_split_to_array(lower(text), '{W}+'), lambda w: regexp_replace(w, '^[?.,!:;()"'']+|[?.,!:;()"'']+$', '', 'g'))"""


@query(f"SELECT doc_id, {GUESS} AS guess FROM (SELECT doc_id, text, {WORDS} AS ws FROM documents WHERE text IS NOT NULL)")
def guess_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.guess_lang("text").alias("guess"))


@query(f"SELECT lang, {GUESS} AS guess, count(*) AS n FROM (SELECT lang, text, {WORDS} AS ws FROM lang_samples) GROUP BY ALL")
def guess_language_confusion(spark, sf_dir):
    return table(spark, sf_dir, "lang_samples").select("lang", X.guess_lang("text").alias("guess")).groupBy("lang", "guess").agg(F.count("*").alias("n"))


SPLIT = f"string_split(regexp_replace({{0}}, '([.!?]){W}+([A-ZÁ-Ž0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


@query(f"SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, {SPLIT.format('text')} AS s FROM documents WHERE text IS NOT NULL)")
def split_sentences(spark, sf_dir):
    s = X.sentences("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(s).cast("long").alias("n"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"))


PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array({{0}}, '\\n{W}*\\n'), lambda p: regexp_replace(p, '^{W}+|{W}+$', '', 'g')), lambda p: p <> '')"


@query(f"SELECT DISTINCT page_id, len(p) AS n, sha1(array_to_string(p, chr(1))) AS digest FROM (SELECT page_id, {PARAGRAPHS.format('text')} AS p FROM pages)")
def split_paragraphs(spark, sf_dir):
    p = X.paragraphs("text")
    return pages_(spark, sf_dir).select("page_id", F.size(p).cast("long").alias("n"), F.sha1(F.array_join(p, "\x01")).alias("digest")).distinct()


@query(f"""
SELECT DISTINCT page_id, regexp_extract(l, '^(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,2}})', 1) AS number, l AS line
FROM (SELECT page_id, unnest(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^{W}+|{W}+$', '', 'g'))) AS l FROM pages)
WHERE regexp_matches(l, '^(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,2}})[ \\t]+([A-ZÁ-Ž][^\\n]{{2,90}})$') AND NOT regexp_matches(l, '[.,;]$')""")
def numbered_headings(spark, sf_dir):
    return pages_(spark, sf_dir).select("page_id", F.explode(X.headings_in("text")).alias("h")).select("page_id", "h.number", "h.line").distinct()


@query("SELECT DISTINCT page_id, round((length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{FFFD}\\x{2303}\\x{270F}]', '', 'g'))) / length(text)::DOUBLE, 9) AS ratio FROM pages WHERE length(text) > 0")
def broken_ratio(spark, sf_dir):
    return pages_(spark, sf_dir).where("length(text) > 0").select("page_id", F.round(X.broken_ratio("text"), 9).alias("ratio")).distinct()


CLEAN = f"""array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, chr(160), ' '), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\n{W}*\\n'),
lambda p: regexp_replace(regexp_replace(regexp_replace(p, '{W}*\\n{W}*', ' ', 'g'), '[ \\t]+', ' ', 'g'), '^{W}+|{W}+$', '', 'g')), lambda p: p <> ''), chr(10) || chr(10))"""


@query(f"SELECT DISTINCT page_id, sha1({CLEAN}) AS digest FROM pages WHERE content_type = 'application/pdf'")
def clean_pdf_text(spark, sf_dir):
    return pages_(spark, sf_dir).where("content_type = 'application/pdf'").select("page_id", F.sha1(X.clean_pdf_text("text")).alias("digest")).distinct()


@query("SELECT DISTINCT page_id, NOT regexp_matches(title, '(?i)^\\s*(kapitola|chapter|část|part|podkapitola|subchapter|untitled|obsah|contents)?\\s*[\\d.\\s-]*\\s*$') AS telling, nullif(regexp_extract(title, '\\b(\\d{1,2}\\.\\d{1,2}(?:\\.\\d+)?)\\b', 1), '') AS printed FROM pages")
def title_facts(spark, sf_dir):
    return pages_(spark, sf_dir).select("page_id", (~X.is_generic_title("title")).alias("telling"), X.section_number("title").alias("printed")).distinct()


# --- urls and the crawl
@query("SELECT DISTINCT url, regexp_extract(url, '^https://ucebnice\\.example/podklady/(online-priprava(?:-en)?(?:-demo)?)/', 1) AS edition_key FROM crawl_log WHERE regexp_matches(url, '^https://ucebnice\\.example/podklady/(online-priprava(?:-en)?(?:-demo)?)/')")
def url_scope_filter(spark, sf_dir):
    return table(spark, sf_dir, "crawl_log").where(U.in_scope("url")).select("url", U.edition_key("url").alias("edition_key")).distinct()


@query("SELECT DISTINCT url, regexp_matches(lower(url), '(\\.html?|\\.txt|/)$') AS fetchable, regexp_matches(regexp_extract(string_split(url, '#')[1], '([^/?]*)(?:\\?.*)?$', 1), '(?i)^(frame\\d+|nadpis\\d+\\w*|index|mapa_stranek|default|obsah\\d+\\w*|obrazky\\d*|nahledy\\d*|foto\\d+\\w*)\\.html?$') AS chrome FROM crawl_log")
def url_fetchable(spark, sf_dir):
    return table(spark, sf_dir, "crawl_log").select("url").distinct().select("url", U.fetchable("url").alias("fetchable"), U.is_chrome("url").alias("chrome"))


@query("SELECT DISTINCT page_id, string_split(url, '#')[1] AS base FROM pages")
def url_fragment_strip(spark, sf_dir):
    return pages_(spark, sf_dir).select("page_id", U.without_fragment("url").alias("base")).distinct()


@query("SELECT url, fetch_id, status FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at, fetch_id, status) AS r FROM crawl_log) WHERE r = 1")
def url_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "crawl_log").select("url", "fetched_at", "fetch_id", "status")
    return corpus.first_seen(rows, "url", ["fetched_at", "fetch_id"]).select("url", "fetch_id", "status")


@query("SELECT status, count(*) AS n FROM (SELECT DISTINCT * FROM crawl_log) GROUP BY status")
def crawl_outcome_counts(spark, sf_dir):
    return corpus.outcomes(table(spark, sf_dir, "crawl_log").distinct())


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT url, unnest(links) AS t FROM pages), bfs AS (
  SELECT DISTINCT url, 0 AS depth FROM pages WHERE chapter = 1
  UNION SELECT e.t, depth + 1 FROM bfs JOIN e ON bfs.url = e.url WHERE depth < 6
) SELECT url, min(depth) AS depth FROM bfs GROUP BY url""")
def link_bfs_depth(spark, sf_dir):
    pages = pages_(spark, sf_dir)
    links = pages.select("url", F.explode("links").alias("to")).distinct()
    return corpus.breadth_first(links, pages.where("chapter = 1").select("url"), 6)


@query("""
SELECT DISTINCT page_id, cs.chapter AS chapter, cs.section AS section FROM (SELECT page_id, CASE WHEN printed IS NOT NULL THEN {'chapter': string_split(printed, '.')[1]::INT, 'section': printed}
 ELSE {'chapter': ch, 'section': CASE WHEN ch IS NOT NULL AND regexp_matches(name, '(?i)^text') AND digits[length(ch::VARCHAR) + 1:] <> '' THEN ch::VARCHAR || '.' || digits[length(ch::VARCHAR) + 1:] END} END AS cs
FROM (SELECT *, coalesce(folder, CASE WHEN length(digits) = 1 OR digits[1:2]::INT > 13 THEN digits[1:1]::INT ELSE digits[1:2]::INT END) AS ch
FROM (SELECT page_id, nullif(regexp_extract(title, '\\b(\\d{1,2}\\.\\d{1,2}(?:\\.\\d+)?)\\b', 1), '') AS printed, nullif(regexp_extract(url, '/kap(\\d+)/', 1), '')::INT AS folder,
 regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS name, nullif(regexp_extract(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '(?i)^(?:text|o|obsah|liter)(\\d+)', 1), '') AS digits FROM pages)))""")
def chapter_section_rule(spark, sf_dir):
    rows = pages_(spark, sf_dir).select("page_id", X.chapter_section("url", F.col("title"), F.lit(None).cast("string")).alias("cs"))
    return rows.select("page_id", "cs.chapter", "cs.section").distinct()


# --- chunks
@query()
def chunk_windows(spark, sf_dir):
    return chunking.windows(pages_(spark, sf_dir), "page_id", "text").select("page_id", "ordinal", F.length("body").alias("n"), F.sha1("body").alias("digest")).distinct()


PIECES = f"""
par AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS pi, p FROM (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT page_id, {PARAGRAPHS.format('text')} AS ps FROM (SELECT DISTINCT page_id, text FROM pages)))),
long AS (SELECT page_id, pi, list_reduce(list_transform({SPLIT.format('p')}, lambda s: {{'out': []::VARCHAR[], 'buf': s}}),
  lambda a, x: CASE WHEN length(a.buf) + length(x.buf) > 1400 AND a.buf <> '' THEN {{'out': list_append(a.out, regexp_replace(a.buf, '^{W}+|{W}+$', '', 'g')), 'buf': x.buf}}
   ELSE {{'out': a.out, 'buf': regexp_replace(a.buf || ' ' || x.buf, '^{W}+|{W}+$', '', 'g')}} END) AS r FROM par WHERE length(p) > 1400),
pieces AS (SELECT page_id, pi, 0 AS k, p FROM par WHERE length(p) <= 1400 UNION ALL
  SELECT page_id, pi, generate_subscripts(o, 1) AS k, unnest(o) AS p FROM (SELECT page_id, pi, CASE WHEN r.buf <> '' THEN list_append(r.out, r.buf) ELSE r.out END AS o FROM long)),
folded AS (SELECT page_id, list_reduce(list({{'out': []::VARCHAR[], 'buf': [p], 'size': length(p) + 2, 'carry': ''}} ORDER BY pi, k), lambda a, x: CASE WHEN a.size + x.size - 2 > 1400 AND a.size > 200 THEN
  CASE WHEN length(trim(array_to_string(a.buf, chr(10) || chr(10)))) < 80 OR trim(array_to_string(a.buf, chr(10) || chr(10))) = a.carry
   THEN {{'out': a.out, 'buf': list_concat(CASE WHEN a.carry = '' THEN []::VARCHAR[] ELSE [a.carry] END, x.buf), 'size': length(a.carry) + x.size, 'carry': a.carry}}
   ELSE {{'out': list_append(a.out, trim(array_to_string(a.buf, chr(10) || chr(10)))),
     'buf': [trim(array_to_string(a.buf, chr(10) || chr(10)))[-200:][strpos(trim(array_to_string(a.buf, chr(10) || chr(10)))[-200:], ' ') + 1:]] || x.buf,
     'size': length(trim(array_to_string(a.buf, chr(10) || chr(10)))[-200:][strpos(trim(array_to_string(a.buf, chr(10) || chr(10)))[-200:], ' ') + 1:]) + x.size,
     'carry': trim(array_to_string(a.buf, chr(10) || chr(10)))[-200:][strpos(trim(array_to_string(a.buf, chr(10) || chr(10)))[-200:], ' ') + 1:]}} END
  ELSE {{'out': a.out, 'buf': list_concat(a.buf, x.buf), 'size': a.size + x.size, 'carry': a.carry}} END) AS r FROM pieces GROUP BY page_id),
done AS (SELECT page_id, CASE WHEN length(trim(array_to_string(r.buf, chr(10) || chr(10)))) < 80 OR trim(array_to_string(r.buf, chr(10) || chr(10))) = r.carry THEN r.out ELSE list_append(r.out, trim(array_to_string(r.buf, chr(10) || chr(10)))) END AS o FROM folded),
chunk AS (SELECT page_id, generate_subscripts(o, 1) - 1 AS ordinal, unnest(o) AS body FROM done)"""
SQL["chunk_windows"] = f"WITH {PIECES.strip()} SELECT page_id, ordinal, length(body) AS n, sha1(body) AS digest FROM chunk"


@query("SELECT DISTINCT page_url, ordinal, substr(sha1(page_url || '#' || ordinal::VARCHAR), 1, 16) AS made, id = substr(sha1(page_url || '#' || ordinal::VARCHAR), 1, 16) AS same FROM chunks")
def chunk_ids(spark, sf_dir):
    made = F.substring(F.sha1(F.concat("page_url", F.lit("#"), F.col("ordinal").cast("string"))), 1, 16)
    return table(spark, sf_dir, "chunks").select("page_url", "ordinal", made.alias("made"), (F.col("id") == made).alias("same")).distinct()


@query("SELECT DISTINCT page_id, concat_ws(' > ', coalesce(nullif(book, ''), CASE WHEN lang = 'cs' THEN 'Učebnice' ELSE 'Textbook' END), CASE WHEN lang = 'cs' THEN 'Kapitola ' ELSE 'Chapter ' END || chapter::VARCHAR, nullif(title, '')) AS crumb FROM pages")
def chunk_breadcrumbs(spark, sf_dir):
    return pages_(spark, sf_dir).select("page_id", chunking.breadcrumb(F.col("book"), F.col("lang"), F.col("chapter"), F.col("title")).alias("crumb")).distinct()


@query()
def chunk_records(spark, sf_dir):
    made = chunking.chunk_pages(pages_(spark, sf_dir).distinct())
    return made.select("id", "page_url", "lang", "edition", "chapter", "section", "title", "ordinal", F.sha1("text").alias("text"), F.sha1("body").alias("body"), F.size("images").cast("long").alias("n_images")).distinct()


SQL["chunk_records"] = f"""
WITH {PIECES.strip()}, p AS (SELECT DISTINCT page_id, url, lang, edition, chapter, section, title, book, len(images) AS n_images FROM pages)
SELECT DISTINCT substr(sha1(url || '#' || ordinal::VARCHAR), 1, 16) AS id, url AS page_url, lang, edition, chapter, section, title, ordinal,
 sha1(concat_ws(' > ', coalesce(nullif(book, ''), CASE WHEN lang = 'cs' THEN 'Učebnice' ELSE 'Textbook' END), CASE WHEN lang = 'cs' THEN 'Kapitola ' ELSE 'Chapter ' END || chapter::VARCHAR, nullif(title, '')) || chr(10) || chr(10) || body) AS text,
 sha1(body) AS body, n_images FROM chunk JOIN p USING (page_id)""".strip()


# --- search; the clean sentences are the questions, the title of every page with a chapter is an evaluation question
def chunks_(spark, sf_dir, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", *columns).distinct()


def questions_(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lang_samples").where("lang IN ('cs', 'en')").select(F.col("sample_id").alias("qid"), F.col("text").alias("q"))


_BUILT: dict[tuple, index.Tables] = {}
_VECTORS: dict[tuple, DataFrame] = {}


def index_(spark, sf_dir) -> index.Tables:
    """The lexical index of the chunks, built once for a state of the table and a session, as an engine's is."""
    return _once(_BUILT, spark, sf_dir, lambda: index.tables(chunks_(spark, sf_dir, "text"), cut))


def vectors_(spark, sf_dir) -> DataFrame:
    """The dense index of the chunks, their hashed bags of words, in the same way."""
    return _once(_VECTORS, spark, sf_dir, lambda: cut(hashed_(index_(spark, sf_dir).postings, "id")))


def _once(made: dict, spark, sf_dir, make):
    """What ``make`` gives for the chunks of a folder, until they change or the session ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/chunks.parquet")
    changed = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, sf_dir, changed)
    if key not in made:
        for old in [k for k in made if k[:2] == key[:2] or k[0] != key[0]]:
            del made[old]
        made[key] = make()
    return made[key]


def lexical_(spark, sf_dir, questions: DataFrame) -> DataFrame:
    """Scores of all chunks for ``questions``."""
    t = index_(spark, sf_dir)
    return search.bm25_scores(t.postings, t.doc_len, t.corpus_stats, search.question_terms(questions), df=t.term_stats)


def bm25_sql(questions: str) -> str:
    """Scores s(qid, id, score) of chunks for a table of questions (qid, q)."""
    return f"""
c AS (SELECT DISTINCT id, text FROM chunks), qs AS ({questions}),
{terms('id', 'text', 'c').strip()}, {terms('qid', 'q', 'qs', 'q').strip()},
qt AS (SELECT qid, term, count(*) AS times FROM qterms GROUP BY ALL), dl AS (SELECT c.id, count(t.term) AS dl FROM c LEFT JOIN terms t USING (id) GROUP BY c.id),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT term, id, count(*)::DOUBLE AS tf FROM terms WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT qid, id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (id) CROSS JOIN st GROUP BY qid, id)"""


SAMPLES = "SELECT sample_id AS qid, text AS q FROM lang_samples WHERE lang IN ('cs', 'en')"


def ranked(source: str, k: int, extra: str = "") -> str:
    return f"SELECT qid, id, score, r - 1 AS rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS r FROM {source} {extra}) WHERE r <= {k}"


@query(f"WITH {bm25_sql(SAMPLES).strip()} SELECT qid, id, round(score, 6) AS score, rank FROM ({ranked('s', 10)})")
def bm25_topk(spark, sf_dir):
    top = search.bm25_search(lexical_(spark, sf_dir, questions_(spark, sf_dir)), None, 10)
    return top.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {bm25_sql(SAMPLES).strip()}, f AS ({ranked('s', 160)}), m AS (SELECT DISTINCT id FROM chunks WHERE lang = 'cs' AND edition IN ('full')), g AS (SELECT f.qid, f.id, f.score FROM f JOIN m USING (id) WHERE score > 0) SELECT qid, id, rank FROM ({ranked('g', 40)})")
def bm25_filtered_overfetch(spark, sf_dir):
    allowed = search.mask(table(spark, sf_dir, "chunks"), "cs", ("full",)).select("id").distinct()
    return search.bm25_search(lexical_(spark, sf_dir, questions_(spark, sf_dir)), None, 40, allowed).select("qid", "id", "rank")


def dense_sql(k: int, where: str = "") -> str:
    return f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-9::DOUBLE)) AS e FROM v),
s AS (SELECT q.vec_id AS qid, d.vec_id AS id, list_dot_product(q.e, d.e) AS score FROM u q JOIN u d ON q.vec_id % 100 = 0 {where}), top AS ({ranked('s', k)})"""


@query(f"WITH {dense_sql(10).strip()} SELECT qid, id, round(score, 6) AS score, rank FROM top")
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    top = search.dense_search(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 10, "vec_id")
    return top.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {dense_sql(10, 'WHERE d.label IN (1, 2, 3)').strip()} SELECT qid, id, rank FROM top")
def dense_topk_masked(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.dense_search(e.where("label IN (1, 2, 3)"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 10, "vec_id").select("qid", "id", "rank")


@query("SELECT vec_id, round(list_aggregate(list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-9::DOUBLE)), 'sum'), 6) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def l2_normalise(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(V.l2_normalise("embedding"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# The dense side of the fusion is the hashed bag of words, in the JVM here and as slots in SQL.
def hashed_(post: DataFrame, key: str) -> DataFrame:
    """key, embedding: unit-length hashed bags of words of postings (term, key, tf)."""
    slot = F.conv(F.substring(F.md5("term"), 31, 2), 16, 10).cast("int") % 64
    n = post.groupBy(key, slot.alias("slot")).agg(F.sum("tf").cast("double").alias("n"))
    lists = n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))  # 64 at most
    return lists.select(key, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("size")).alias("embedding"))


def asked_(questions: DataFrame) -> DataFrame:
    return hashed_(search.question_terms(questions).withColumnRenamed("times", "tf"), "qid")


def dense_bow_(spark, sf_dir, questions: DataFrame, k: int) -> DataFrame:
    return search.dense_search(vectors_(spark, sf_dir), asked_(questions), k)


BOW = """
hd AS (SELECT id, ('0x' || substr(md5(term), 31, 2))::INT % 64 AS slot, count(*)::DOUBLE AS n FROM terms GROUP BY ALL), hq AS (SELECT qid, ('0x' || substr(md5(term), 31, 2))::INT % 64 AS slot, count(*)::DOUBLE AS n FROM qterms GROUP BY ALL),
zd AS (SELECT id, sqrt(sum(n * n)) AS z FROM hd GROUP BY id), zq AS (SELECT qid, sqrt(sum(n * n)) AS z FROM hq GROUP BY qid),
ds AS (SELECT qid, id, sum(hd.n / zd.z / (1 + 1e-9::DOUBLE) * (hq.n / zq.z / (1 + 1e-9::DOUBLE))) AS score FROM hq JOIN zq USING (qid) JOIN hd USING (slot) JOIN zd USING (id) GROUP BY qid, id)"""


def fused_sql(pool: int, dense: str = "ds", lexical: str = "s") -> str:
    return f"""
dn AS ({ranked(dense, 40)}), lx AS ({ranked(lexical, 40)}),
fu AS (SELECT coalesce(dn.qid, lx.qid) AS qid, coalesce(dn.id, lx.id) AS id, dn.rank AS dense_rank, lx.rank AS bm25_rank, coalesce(1.0::DOUBLE / (61 + dn.rank), 0) + coalesce(1.0::DOUBLE / (61 + lx.rank), 0) AS score FROM dn FULL JOIN lx ON dn.qid = lx.qid AND dn.id = lx.id),
po AS (SELECT qid, id, dense_rank, bm25_rank, score, r - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, id) AS r FROM fu) WHERE r <= {pool})"""


@query(f"WITH {bm25_sql(SAMPLES).strip()}, {BOW.strip()}, {fused_sql(12).strip()} SELECT qid, id, dense_rank, bm25_rank, round(score, 6) AS score, rank FROM po")
def rrf_fusion(spark, sf_dir):
    q = questions_(spark, sf_dir)
    out = search.fuse(dense_bow_(spark, sf_dir, q, 40), search.bm25_search(lexical_(spark, sf_dir, q), None, 40), 12)
    return out.select("qid", "id", "dense_rank", "bm25_rank", F.round("score", 6).alias("score"), "rank")


QOVERLAP = """
qd AS (SELECT DISTINCT qid, term FROM qterms), nq AS (SELECT qid, count(*) AS n FROM qd GROUP BY qid), bt AS (SELECT DISTINCT id, body FROM chunks WHERE id IN (SELECT id FROM po)),
btoks AS (SELECT id, unnest(list_transform(list_filter(regexp_extract_all(lower(body), '[\\p{L}\\p{N}_]+'), lambda w: NOT regexp_full_match(w, '\\p{Nd}{5,}')), lambda w: strip_accents(w))) AS t FROM bt),
bterms AS (SELECT DISTINCT id, t AS term FROM btoks UNION SELECT DISTINCT id, t[1:6] FROM btoks WHERE length(t) > 6),
ov AS (SELECT po.qid, po.id, po.rank, count(bterms.term)::DOUBLE / max(nq.n) AS rerank_score FROM po JOIN nq USING (qid) JOIN qd USING (qid) LEFT JOIN bterms ON bterms.id = po.id AND bterms.term = qd.term GROUP BY po.qid, po.id, po.rank),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 9) DESC, rank) - 1 AS rerank_rank FROM ov)"""


def _reranked(spark, sf_dir, fusion: str) -> DataFrame:
    q = questions_(spark, sf_dir)
    pool = search.fuse(dense_bow_(spark, sf_dir, q, 40), search.bm25_search(lexical_(spark, sf_dir, q), None, 40), 12)
    full = pool.join(q, "qid").join(chunks_(spark, sf_dir, "body"), "id").withColumn("rerank_score", search.overlap_score("q", "body"))
    return search.rerank(full, fusion).select("qid", "id", F.round("rerank_score", 6).alias("rerank_score"), "final_rank")


FULL_CS = f"m AS (SELECT DISTINCT id FROM chunks WHERE lang = 'cs' AND edition IN ('full')), dm AS (SELECT ds.* FROM ds JOIN m USING (id)), f AS ({ranked('s', 160)}), g AS (SELECT f.qid, f.id, f.score FROM f JOIN m USING (id) WHERE score > 0)"


@query(f"""
WITH {bm25_sql(SAMPLES).strip()}, {BOW.strip()}, {FULL_CS}, {fused_sql(12, "dm", "g").strip()}, {QOVERLAP.replace("body", "text").strip()},
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(1.0::DOUBLE / (61 + rerank_rank) + 1.0::DOUBLE / (61 + rank), 9) DESC, rerank_rank) - 1 AS final_rank FROM rr),
h AS (SELECT fr.qid, fr.final_rank AS rank, c.* FROM fr JOIN (SELECT DISTINCT id, page_url, ordinal, body FROM chunks) c USING (id) WHERE final_rank < 10),
l AS (SELECT qid, list_reduce(list([{{'rank': rank, 'id': id, 'page_url': page_url, 'ordinal': ordinal, 'body': body}}] ORDER BY rank),
 lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.page_url = x[1].page_url AND abs(k.ordinal - x[1].ordinal) = 1 AND (contains(x[1].body, right(k.body, 150)) OR contains(k.body, right(x[1].body, 150))))) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM h GROUP BY qid)
SELECT qid, generate_subscripts(kept, 1) AS n, unnest(list_transform(kept, lambda k: k.id)) AS id FROM l""")
def hybrid_topk(spark, sf_dir):
    """The main search path: both sides masked, fused, reranked, cut and without neighbours."""
    t, q = index_(spark, sf_dir), questions_(spark, sf_dir)
    chunks = table(spark, sf_dir, "chunks").drop("images").distinct()
    hits = search.hybrid(q, chunks, t.postings, t.doc_len, t.corpus_stats, vectors_(spark, sf_dir), asked_(q), "cs", ("full",), 10, rerankers.overlap, df=t.term_stats)
    return hits.select("qid", "n", "id")


PREFIX = f"WITH {bm25_sql(SAMPLES).strip()}, {BOW.strip()}, {fused_sql(12).strip()}, {QOVERLAP.strip()}"


@query(f"{PREFIX} SELECT qid, id, round(rerank_score, 6) AS rerank_score, row_number() OVER (PARTITION BY qid ORDER BY round(1.0::DOUBLE / (61 + rerank_rank) + 1.0::DOUBLE / (61 + rank), 9) DESC, rerank_rank) - 1 AS final_rank FROM rr")
def rerank_fusion_rrf(spark, sf_dir):
    return _reranked(spark, sf_dir, "rrf")


@query(f"{PREFIX} SELECT qid, id, round(rerank_score, 6) AS rerank_score, rerank_rank AS final_rank FROM rr")
def rerank_only_order(spark, sf_dir):
    return _reranked(spark, sf_dir, "rerank")


LOGPROBS = [(1, "Yes", -0.01), (1, "no", -5.2), (1, " YES ", -6.0), (2, "No", -0.02), (2, "yes", -4.9), (3, "maybe", -0.1), (4, "yes", -800.0), (4, "no", -0.1), (5, "yes", -0.7), (5, "no", -0.7)]


@query(f"""
SELECT qid, round(CASE WHEN d > -700 THEN 1 / (1 + exp(-d)) ELSE 0 END, 9) AS p FROM (SELECT qid, coalesce(max(lp) FILTER (t = 'yes') + ln(sum(exp(lp - my)) FILTER (t = 'yes')), -30) - coalesce(max(lp) FILTER (t = 'no') + ln(sum(exp(lp - mn)) FILTER (t = 'no')), -30) AS d
FROM (SELECT *, max(lp) FILTER (t = 'yes') OVER (PARTITION BY qid) AS my, max(lp) FILTER (t = 'no') OVER (PARTITION BY qid) AS mn FROM (SELECT qid, lower(trim(tok)) AS t, lp::DOUBLE AS lp FROM (VALUES {", ".join(map(str, LOGPROBS))}) AS v(qid, tok, lp))) GROUP BY qid)""")
def rerank_pyes(spark, sf_dir):
    rows = spark.createDataFrame(LOGPROBS, "qid int, token string, logprob double")
    return rows.groupBy("qid").agg(F.collect_list(F.struct("token", "logprob")).alias("l")).select("qid", F.round(V.yes_chance("l"), 9).alias("p"))


@query(f"""
WITH {bm25_sql(SAMPLES).strip()}, top AS ({ranked('s', 10)}), h AS (SELECT t.qid, t.rank, c.id, c.page_url, c.ordinal, c.body FROM top t JOIN (SELECT DISTINCT id, page_url, ordinal, body FROM chunks) c USING (id)),
l AS (SELECT qid, list_reduce(list([{{'rank': rank, 'id': id, 'page_url': page_url, 'ordinal': ordinal, 'body': body}}] ORDER BY rank),
 lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.page_url = x[1].page_url AND abs(k.ordinal - x[1].ordinal) = 1 AND (contains(x[1].body, right(k.body, 150)) OR contains(k.body, right(x[1].body, 150))))) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM h GROUP BY qid)
SELECT qid, generate_subscripts(kept, 1) AS n, unnest(list_transform(kept, lambda k: k.id)) AS id FROM l""")
def neighbour_dedupe(spark, sf_dir):
    top = search.bm25_search(lexical_(spark, sf_dir, questions_(spark, sf_dir)), None, 10)
    return search.dedupe_neighbours(top.join(chunks_(spark, sf_dir, "page_url", "ordinal", "body"), "id"), "rank").select("qid", "n", "id")


TITLES = "SELECT page_id AS qid, title AS q FROM (SELECT DISTINCT page_id, title FROM pages WHERE chapter IS NOT NULL)"


@query(f"""
WITH {bm25_sql(TITLES).strip()}, top AS ({ranked('s', 10)}), e AS (SELECT DISTINCT page_id AS qid, chapter, section FROM pages WHERE chapter IS NOT NULL),
j AS (SELECT e.qid, e.section AS want, coalesce(c.chapter = e.chapter, false) AS ok, coalesce(c.section = e.section, false) AS sec, top.rank FROM e LEFT JOIN top USING (qid) LEFT JOIN (SELECT DISTINCT id, chapter, section FROM chunks) c USING (id)),
g AS (SELECT qid, max((ok AND rank = 0)::INT) AS c1, max(ok::INT) AS ck, max((want IS NOT NULL)::INT) AS has, max((sec AND rank = 0)::INT) AS s1, max((sec AND rank < 3)::INT) AS s3 FROM j GROUP BY qid)
SELECT count(*) AS total, coalesce(sum(c1), 0)::BIGINT AS chapter_1, coalesce(sum(ck), 0)::BIGINT AS chapter_k, coalesce(sum(has), 0)::BIGINT AS sec_total, coalesce(sum(s1), 0)::BIGINT AS sec_1, coalesce(sum(s3), 0)::BIGINT AS sec_3 FROM g""")
def hit_at_k_chapter(spark, sf_dir):
    own = pages_(spark, sf_dir).where("chapter IS NOT NULL").select(F.col("page_id").alias("qid"), F.col("title").alias("q"), "chapter", "section").distinct()
    top = batches.bm25_many(table(spark, sf_dir, "chunks"), own.select("qid", "q").distinct(), 10).join(chunks_(spark, sf_dir, "chapter", "section"), "id")
    expected = own.select("qid", "chapter", F.when(F.col("section").isNotNull(), F.array("section")).alias("sections"))
    return corpus.hit_rates(top, expected, 10)


@query(f"WITH {dense_sql(11).strip()}, j AS (SELECT t.qid, t.rank, q.label = d.label AS ok FROM top t JOIN embeddings q ON q.vec_id = t.qid JOIN embeddings d ON d.vec_id = t.id WHERE t.qid <> t.id) SELECT qid, sum(ok::INT)::BIGINT AS same, count(*) AS n FROM j GROUP BY qid")
def hit_at_k_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    own = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("want"))
    top = search.dense_search(e, own.select("qid", "embedding"), 11, "vec_id").where("qid <> id")
    rows = top.join(own.select("qid", "want"), "qid").join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return rows.groupBy("qid").agg(F.sum((F.col("label") == F.col("want")).cast("int")).alias("same"), F.count("*").alias("n"))


# --- answers
HITS = f"top AS ({ranked('s', 3)}), h AS (SELECT t.qid, t.rank + 1 AS n, t.score, c.* FROM top t JOIN (SELECT DISTINCT id, lang, chapter, section, title, body, page_url FROM chunks) c USING (id))"


def _hits(spark, sf_dir, k: int = 3) -> DataFrame:
    top = search.bm25_search(lexical_(spark, sf_dir, questions_(spark, sf_dir)), None, k)
    return top.join(chunks_(spark, sf_dir, "lang", "chapter", "section", "title", "body", "page_url"), "id").withColumn("n", F.col("rank") + 1)


@query(f"""
WITH {bm25_sql(SAMPLES).strip()}, {HITS}, p AS (SELECT qid, string_agg('[' || n || '] (' || lang || ', ' || coalesce('chapter ' || chapter, '') || coalesce(', section ' || nullif(section, ''), '') || ') ' || title || chr(10) || substr(body, 1, 1000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS p FROM h GROUP BY qid)
SELECT qid, sha1('Source passages:' || chr(10) || chr(10) || coalesce(p, '') || chr(10) || chr(10) || '===' || chr(10) || chr(10) || 'Question: ' || q) AS digest FROM qs LEFT JOIN p USING (qid)""")
def prompt_assembly(spark, sf_dir):
    return answers.user_turns(_hits(spark, sf_dir), questions_(spark, sf_dir)).select("qid", F.sha1("prompt").alias("digest"))


@query(f"WITH {bm25_sql(SAMPLES).strip()}, {HITS} SELECT qid, n, title, chapter, section, page_url AS url, lang, NULL::VARCHAR AS book, NULL::DOUBLE AS rerank, round_even(score, 4) AS score FROM h")
def source_rows(spark, sf_dir):
    return answers.source_rows(_hits(spark, sf_dir))


CITED = [(1, "První [1], další [2, 3] a [9]."), (2, "None."), (3, "Both [1][3] and [2;1].")]
SOURCES = [(1, 1, "u1"), (1, 2, "u2"), (1, 3, "u3"), (3, 1, "w1"), (3, 2, "w2")]


@query(f"""
WITH a(qid, answer) AS (VALUES {", ".join(map(str, CITED))}), s(qid, n, url) AS (VALUES {", ".join(map(str, SOURCES))}),
l AS (SELECT qid, flatten(list_transform(regexp_extract_all(answer, '\\[(\\d+(?:[,;] ?\\d+)*)\\]', 1), lambda m: regexp_split_to_array(m, '[,;] ?'))) AS ns FROM a), x AS (SELECT qid, generate_subscripts(ns, 1) - 1 AS pos, unnest(ns)::INT AS n FROM l)
SELECT x.qid, x.n, x.pos, s.url FROM x LEFT JOIN s USING (qid, n)""")
def citation_refs(spark, sf_dir):
    return answers.citations(spark.createDataFrame(CITED, "qid int, answer string"), spark.createDataFrame(SOURCES, "qid int, n int, url string"))


@query("SELECT user_id AS conv_id, event_id AS turn, event_type AS role FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 8")
def history_last8(spark, sf_dir):
    turns = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("role"))
    return answers.last_turns(turns, 8)


@query(f"""
WITH {bm25_sql(SAMPLES).strip()}, {HITS} SELECT qid, to_json({{'question': q, 'answer': 'See [1].', 'backend': 'stub', 'lang': 'cs', 'n_sources': count(h.id), 'cached': false}})::VARCHAR AS json FROM qs LEFT JOIN h USING (qid) GROUP BY qid, q""")
def answer_json(spark, sf_dir):
    q = questions_(spark, sf_dir)
    n = _hits(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n"))
    doc = F.struct(F.col("q").alias("question"), F.lit("See [1].").alias("answer"), F.lit("stub").alias("backend"), F.lit("cs").alias("lang"), F.coalesce("n", F.lit(0)).alias("n_sources"), F.lit(False).alias("cached"))
    return q.join(n, "qid", "left").select("qid", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


@query("SELECT user_id AS conv_id, event_id AS turn, event_type AS role FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 4")
def history_last4(spark, sf_dir):
    turns = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("role"))
    return answers.last_turns(turns, 4)


@query(f"""
WITH {bm25_sql(SAMPLES).strip()}, {HITS}, l AS (SELECT qid, list({{'n': n, 'title': title, 'chapter': chapter, 'section': section, 'url': page_url, 'lang': lang, 'book': NULL::VARCHAR, 'rerank': NULL::DOUBLE, 'score': round_even(score, 4)}} ORDER BY n) AS sources FROM h GROUP BY qid)
SELECT qid, to_json({{'question': q, 'answer': 'See [1].', 'backend': 'stub', 'lang': 'cs', 'sources': sources, 'timings': MAP {{'retrieve': 0.12::DOUBLE, 'total': 1.5::DOUBLE}}, 'cached': false}})::VARCHAR AS json FROM qs JOIN l USING (qid)""")
def answer_documents(spark, sf_dir):
    """Answers as documents, by the operator that an engine's replies have the form of."""
    item = F.struct("n", "title", "chapter", "section", "url", "lang", "book", "rerank", "score")
    sources = answers.source_rows(_hits(spark, sf_dir)).groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("sources"))
    rows = questions_(spark, sf_dir).join(sources, "qid").select(
        "qid", F.col("q").alias("question"), F.lit("See [1].").alias("answer"), F.lit("stub").alias("backend"), F.lit("cs").alias("lang"), "sources",
        F.create_map(F.lit("retrieve"), F.lit(0.1234), F.lit("total"), F.lit(1.4999)).alias("timings"), F.lit(False).alias("cached"),
    )
    return answers.answer_json(rows)


@query("SELECT doc_id, greatest(1, least(50, n_chars)) AS k FROM documents WHERE n_chars IS NOT NULL")
def clamped(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars IS NOT NULL").select("doc_id", V.clamp("n_chars", 1, 50).alias("k"))


@query("SELECT status, count(n_bytes) AS n, median(n_bytes) AS median FROM crawl_log GROUP BY status")
def outcome_medians(spark, sf_dir):
    return corpus.medians(table(spark, sf_dir, "crawl_log"), "status", "n_bytes")


@query(f"""
WITH {bm25_sql("SELECT 0 AS qid, '' AS q").strip()} SELECT (SELECT count(*) FROM c) AS n_chunks, (SELECT count(*) FROM (SELECT DISTINCT term, id FROM terms)) AS n_postings, (SELECT count(DISTINCT term) FROM terms) AS n_terms,
(SELECT round(avg(dl), 6) FROM dl) AS avgdl, 64 AS dim, (SELECT count(*) FROM c) AS n_vectors""")
def index_build(spark, sf_dir):
    """The whole index written as tables below the shared folder, and what reading it again gives."""
    path = f"{shared_folder(spark)}/index-{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}"
    index.build(table(spark, sf_dir, "chunks").distinct(), index.HashedWords(), path)
    i = index.Index(spark, path)
    counts = i.postings.agg(F.count("*").alias("n_postings")).crossJoin(i.term_stats.agg(F.count("*").alias("n_terms"))).crossJoin(i.vectors.agg(F.count("*").alias("n_vectors")))  # one row each
    return i.corpus_stats.crossJoin(counts).select(F.lit(i.meta["n_chunks"]).cast("long").alias("n_chunks"), "n_postings", "n_terms", F.round("avgdl", 6).alias("avgdl"), F.lit(i.meta["dim"]).alias("dim"), "n_vectors")


@query("SELECT doc_id AS qid, seq, 'event: ' || event || chr(10) || 'data: ' || data || chr(10) || chr(10) AS frame FROM (SELECT doc_id, unnest([1, 2]) AS seq, unnest(['meta', 'done']) AS event, unnest([source, doc_id::VARCHAR]) AS data FROM documents)")
def sse_events(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("qid"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("meta").alias("event"), F.col("source").alias("data")), F.struct(F.lit(2).alias("seq"), F.lit("done").alias("event"), F.col("doc_id").cast("string").alias("data")))).alias("e"))
    return answers.frames(rows.select("qid", "e.*")).select("qid", "seq", "frame")


# --- books
FILE_N = "regexp_extract(url, '^([^#]*)#page=', 1) AS file, regexp_extract(url, '#page=(\\d+)$', 1)::INT AS n"


def book_pages_(spark, sf_dir) -> DataFrame:
    rows = pages_(spark, sf_dir).where("content_type = 'application/pdf'").select("page_id", "url", "text").distinct()
    # the earliest record of a page of a file
    one = corpus.first_seen(rows, "url", ["page_id"])
    return one.select("page_id", F.regexp_extract("url", "^([^#]*)#page=", 1).alias("file"), F.regexp_extract("url", r"#page=(\d+)$", 1).cast("int").alias("n"), "text")


BOOK_PAGES = f"b AS (SELECT page_id, {FILE_N}, text FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS r FROM (SELECT DISTINCT page_id, url, text FROM pages WHERE content_type = 'application/pdf')) WHERE r = 1)"


@query(f"""
WITH {BOOK_PAGES}, k AS (SELECT page_id, file, n, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^{W}+|{W}+$', '', 'g')), lambda s: regexp_matches(s, '^(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,2}})[ \\t]+([A-ZÁ-Ž][^\\n]{{2,90}})$') AND NOT regexp_matches(s, '[.,;]$'))[-1] AS h FROM b WHERE length(text) >= 80),
m AS (SELECT page_id, file, n, CASE WHEN h IS NOT NULL THEN {{'heading': h, 'number': regexp_extract(h, '^(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,2}})', 1)}} END AS mark FROM k), w AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING) AS l FROM m)
SELECT page_id, l.heading AS heading, string_split(l.number, '.')[1]::INT AS chapter, CASE WHEN contains(l.number, '.') THEN l.number END AS section FROM w""")
def heading_carry_forward(spark, sf_dir):
    return books.carry_headings(book_pages_(spark, sf_dir)).select("page_id", "heading", "chapter", "section")


@query(f"WITH {BOOK_PAGES} SELECT file, count(*) AS pages, count(*) FILTER (coalesce(length(text), 0) < 80) AS empty FROM b GROUP BY file")
def empty_pages(spark, sf_dir):
    return books.empty_pages(book_pages_(spark, sf_dir))


@query(f"""
WITH {BOOK_PAGES}, k AS (SELECT page_id, file, n, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^{W}+|{W}+$', '', 'g')), lambda s: regexp_matches(s, '^(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,2}})[ \\t]+([A-ZÁ-Ž][^\\n]{{2,90}})$') AND NOT regexp_matches(s, '[.,;]$'))[-1] AS h FROM b WHERE length(text) >= 80),
m AS (SELECT page_id, file, n, text, CASE WHEN h IS NOT NULL THEN {{'heading': h, 'number': regexp_extract(h, '^(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,2}})', 1)}} END AS mark FROM k), w AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING) AS l FROM m),
g AS (SELECT file, {GUESS} AS lang FROM (SELECT file, text, {WORDS} AS ws FROM (SELECT file, string_agg(text, chr(10) ORDER BY n) AS text FROM w WHERE n <= 20 GROUP BY file))),
x AS (SELECT w.*, coalesce(g.lang, 'en') AS lang, regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_extract(w.file, '([^/]*)$', 1), '\\.[^.]*$', ''), '^(\\d{{1,2}})?[_\\-\\s]*(.+?)$', 2), '[_\\-]+', ' ', 'g'), '^{W}+|{W}+$', '', 'g') AS book FROM w LEFT JOIN g USING (file))
SELECT 'file://' || file || '#page=' || n AS url, regexp_extract(file, '([^/]*)$', 1) AS path, lang, string_split(l.number, '.')[1]::INT AS chapter, CASE WHEN contains(l.number, '.') THEN l.number END AS section,
 coalesce(l.heading, book || ' – p. ' || n) AS title, sha1(text) AS text, book FROM x""")
def book_records(spark, sf_dir):
    """Page records of books, by the headings in their texts."""
    none = F.lit(None).cast("string")
    made = books.page_records(books.carry_headings(book_pages_(spark, sf_dir)), books.book_title(none, none, F.col("file")))
    return made.select("url", "path", "lang", "chapter", "section", "title", F.sha1("text").alias("text"), "book")


OUTLINE = [(0, 1, "1 Start", 1), (1, 2, "1.1 Base", 2), (2, 1, "2 Middle", 3), (3, 2, "2.1 More", 6), (4, 1, "3 Back", 5), (5, 2, "3.2 End", 9)]


@query(f"""
WITH {BOOK_PAGES}, o AS (SELECT pos, level, heading, start, sum((level = 1)::INT) OVER (ORDER BY pos) AS number FROM (VALUES {", ".join(map(str, OUTLINE))}) AS v(pos, level, heading, start)),
j AS (SELECT b.page_id, arg_max(o.heading, o.pos) AS heading, max(o.number) FILTER (level = 1) AS chapter FROM b LEFT JOIN o ON o.start <= b.n GROUP BY b.page_id)
SELECT page_id, heading, chapter::BIGINT AS chapter, nullif(regexp_extract(heading, '^\\s*(\\d{{1,2}}\\.\\d{{1,2}}(?:\\.\\d{{1,2}})?)\\b', 1), '') AS section FROM j""")
def outline_asof(spark, sf_dir):
    own = book_pages_(spark, sf_dir).select("page_id", "file", "n")
    marks = own.select("file").distinct().crossJoin(F.broadcast(spark.createDataFrame(OUTLINE, "pos int, level int, heading string, start int")))  # six rows, fixed
    return books.by_outline(own, marks).select("page_id", "heading", "chapter", "section")


LINES = [
    (1, "Left one", 0.08, 0.10, 0.45, 0.12), (1, "left two", 0.08, 0.13, 0.45, 0.15), (1, "Indented", 0.11, 0.16, 0.45, 0.18), (1, "Right one", 0.55, 0.10, 0.92, 0.12), (1, "Není-", 0.55, 0.13, 0.92, 0.15),
    (1, "li right", 0.55, 0.16, 0.92, 0.18), (2, "Wide line here", 0.08, 0.10, 0.92, 0.12), (2, "goes on", 0.08, 0.13, 0.92, 0.15), (2, "After a gap", 0.08, 0.25, 0.92, 0.27),
]
READ = [(1, "Left one left two\n\nIndented\n\nRight one Není-li right"), (2, "Wide line here goes on\n\nAfter a gap")]


@query("SELECT * FROM (VALUES {}) AS v(page, text)".format(", ".join("({}, '{}')".format(p, t.replace("\n", "' || chr(10) || '")) for p, t in READ)))
def reading_order_lines(spark, sf_dir):
    return books.reading_order(spark.createDataFrame(LINES, "page int, text string, x0 double, y0 double, x1 double, y1 double"))


HTML = """<html><head><title>Kapitola {n}.1</title><style>x</style></head><body title="{n}.1 Nadpis stránky"><h3>Úvod</h3><p>{body}</p><img src="obr/foto{n}.jpg"><img src="..\\sipka_vpred.GIF">
<a href="text{n}2.html#x">dál</a><a href="mailto:a@b.c">m</a><table><tr><td>a</td><td>b</td></tr></table></body></html>"""


def _html_rows(spark, sf_dir) -> DataFrame:
    """HTML around the text of every crawled page."""
    p = pages_(spark, sf_dir).where("content_type = 'text/html'").select("page_id", "url", "text").distinct()
    n = F.substring(F.col("page_id").cast("string"), 1, 1)
    parts = HTML.replace("{body}", "\x01").replace("{n}", "\x02")
    made = F.replace(F.replace(F.lit(parts), F.lit("\x02"), n), F.lit("\x01"), X.escape_html("text"))
    return p.select("page_id", "url", F.lit("").alias("path"), made.alias("html"))


@query("""
SELECT DISTINCT page_id, 'Kapitola ' || d || '.1' AS title, d || '.1 Nadpis stránky' AS body_title, 1 AS n_headings, regexp_replace(url, '[^/]*$', '') || 'obr/foto' || d || '.jpg' AS image, regexp_replace(url, '[^/]*$', '') || 'text' || d || '2.html' AS link
FROM (SELECT page_id, url, substr(page_id::VARCHAR, 1, 1) AS d FROM pages WHERE content_type = 'text/html')""")
def html_fields(spark, sf_dir):
    rows = html.parsed(_html_rows(spark, sf_dir))
    return rows.select("page_id", "title", "body_title", F.size("headings").alias("n_headings"), F.element_at("images", 1).alias("image"), F.element_at("links", 1).alias("link"))


@query("""
SELECT DISTINCT page_id, sha1(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(\\s*\\|\\s*){2,}', ' | ', 'g'), '\\s+$', '')) AS digest
FROM (SELECT page_id, 'Kapitola ' || substr(page_id::VARCHAR, 1, 1) || '.1' || chr(10) || chr(10) || 'Úvod' || chr(10) || chr(10) || replace(text, chr(160), ' ') || chr(10) || chr(10) || 'dálm' || chr(10) || chr(10) || 'a | b |' AS t FROM pages WHERE content_type = 'text/html')""")
def html_clean_text(spark, sf_dir):
    return html.parsed(_html_rows(spark, sf_dir)).select("page_id", F.sha1("text").alias("digest")).distinct()


@query("""
SELECT DISTINCT page_id, d::INT AS chapter, d || '.1' AS section, d || '.1 Nadpis stránky' AS title, edition_key, lang, edition
FROM (SELECT page_id, edition_key, substr(page_id::VARCHAR, 1, 1) AS d FROM pages WHERE content_type = 'text/html') JOIN editions USING (edition_key)""")
def html_pages(spark, sf_dir):
    """Page records, with what the lookup of the edition gives."""
    rows = _html_rows(spark, sf_dir)
    made = html.pages_from_html(rows.drop("page_id").distinct(), table(spark, sf_dir, "editions"))
    # the record has no key of its own; several fetches of a url give one page each
    keys = rows.select("page_id", "url", F.substring(F.col("page_id").cast("string"), 1, 1).cast("int").alias("d"))
    return made.select("url", "chapter", "section", "title", "edition_key", "lang", "edition").distinct().join(keys, "url").where("chapter = d").select("page_id", "chapter", "section", "title", "edition_key", "lang", "edition").distinct()


@query("SELECT DISTINCT page_id, len(regexp_extract_all(h, '(?i)(?:href|src)\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)) AS n FROM (SELECT page_id, '<a href=\"x.html\"><img src=y.gif>' || text AS h FROM pages)")
def html_link_counts(spark, sf_dir):
    raw = F.concat(F.lit('<a href="x.html"><img src=y.gif>'), F.col("text"))
    return pages_(spark, sf_dir).select("page_id", F.size(html.crawl_links(raw)).cast("long").alias("n")).distinct()


@query("SELECT page_id, list_sort(list_distinct(list_filter(images, lambda x: x <> '' AND NOT regexp_matches(x, '(?i)sipka|logo|spacer|blank')))) AS images FROM (SELECT DISTINCT page_id, images FROM pages)")
def content_images(spark, sf_dir):
    return pages_(spark, sf_dir).select("page_id", U.content_images("images").alias("images")).distinct()


@query("SELECT DISTINCT c.id, v.vec_id FROM chunks c JOIN chunk_vectors v ON v.chunk_id = c.id WHERE v.embedding IS NOT NULL")
def chunk_vector_join(spark, sf_dir):
    v = table(spark, sf_dir, "chunk_vectors").where("embedding IS NOT NULL").select("vec_id", F.col("chunk_id").alias("id")).distinct()
    return chunks_(spark, sf_dir).join(v, "id").select("id", "vec_id")


@query("SELECT DISTINCT c.id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunk_vectors v WHERE v.chunk_id = c.id AND v.embedding IS NOT NULL)")
def chunks_without_vector(spark, sf_dir):
    v = table(spark, sf_dir, "chunk_vectors").where("embedding IS NOT NULL").select(F.col("chunk_id").alias("id")).distinct()
    return chunks_(spark, sf_dir).join(v, "id", "left_anti")


@query("SELECT DISTINCT url FROM crawl_log WHERE url NOT IN (SELECT url FROM pages)")
def frontier_anti(spark, sf_dir):
    return table(spark, sf_dir, "crawl_log").select("url").distinct().join(pages_(spark, sf_dir).select("url").distinct(), "url", "left_anti")


@query("SELECT DISTINCT rec, url FROM (SELECT 'page' AS rec, url FROM pages UNION ALL SELECT 'log' AS rec, url FROM crawl_log)")
def union_of_records(spark, sf_dir):
    one = pages_(spark, sf_dir).select(F.lit("page").alias("rec"), "url").unionByName(table(spark, sf_dir, "crawl_log").select(F.lit("log").alias("rec"), "url"))
    return one.distinct()


@query("SELECT url, fetch_id, fresh FROM (SELECT url, fetched_at, fetch_id, status, max(fetched_at) FILTER (status IN ('fetched', 'cached')) OVER (PARTITION BY url) = fetched_at AS fresh FROM (SELECT DISTINCT url, fetched_at, fetch_id, status FROM crawl_log)) WHERE fresh")
def latest_good_fetch(spark, sf_dir):
    rows = table(spark, sf_dir, "crawl_log").select("url", "fetched_at", "fetch_id", "status").distinct()
    last = rows.where("status IN ('fetched', 'cached')").groupBy("url").agg(F.max("fetched_at").alias("last"))
    return rows.join(last, "url").where("fetched_at = last").select("url", "fetch_id", F.lit(True).alias("fresh"))


# --- single functions over whole tables
@query("SELECT DISTINCT page_id, regexp_matches(title, '(?i)^\\s*(obr[aá]zek|obr\\.|figure|figere|fig\\.|foto|photo|tabulka|table)\\b') AS figure FROM pages WHERE title IS NOT NULL")
def figure_titles(spark, sf_dir):
    return pages_(spark, sf_dir).where("title IS NOT NULL").select("page_id", X.is_figure_title("title").alias("figure")).distinct()


@query("SELECT DISTINCT page_id, sha1(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')) AS digest FROM pages")
def html_escaped(spark, sf_dir):
    return pages_(spark, sf_dir).select("page_id", F.sha1(X.escape_html("text")).alias("digest")).distinct()


@query("SELECT doc_id, source AS backend, coalesce(lang, '') || ':8b' AS model FROM documents")
def keys_split(spark, sf_dir):
    key = X.split_key(F.concat("source", F.lit(":"), F.coalesce("lang", F.lit("")), F.lit(":8b")))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("k")).select("doc_id", "k.backend", "k.model")


@query("SELECT sample_id, 'Instruct: Find passages that answer the question' || chr(10) || 'Query: ' || text AS question, 'query: ' || text AS e5, 'passage: ' || text AS passage, text AS plain FROM lang_samples")
def prompts_embedded(spark, sf_dir):
    t = F.col("text")
    rows = table(spark, sf_dir, "lang_samples")
    return rows.select("sample_id", index.prompt_text(t, "Qwen3-Embedding-8B", True).alias("question"), index.prompt_text(t, "e5-large", True).alias("e5"), index.prompt_text(t, "e5-large", False).alias("passage"), index.prompt_text(t, "bge-m3", True).alias("plain"))


@query(f"SELECT DISTINCT page_id, regexp_replace(text, '^{W}+|{W}+$', '', 'g') = '' OR (length(text) > 0 AND (length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{FFFD}}\\x{{2303}}\\x{{270F}}]', '', 'g'))) / length(text)::DOUBLE > 0.005) AS need FROM pages WHERE content_type = 'application/pdf'")
def ocr_needed(spark, sf_dir):
    return pages_(spark, sf_dir).where("content_type = 'application/pdf'").select("page_id", books.needs_ocr(F.col("text")).alias("need")).distinct()


@query(f"WITH {BOOK_PAGES} SELECT file, n, sha1(CASE WHEN n > 10 THEN 'recognised ' || page_id ELSE {CLEAN} END) AS digest FROM b")
def ocr_chosen(spark, sf_dir):
    """Recognised text where there is one, the text layer elsewhere; pages beyond the tenth have one here."""
    own = book_pages_(spark, sf_dir)
    ocr = own.where("n > 10").select("file", "n", F.concat(F.lit("recognised "), F.col("page_id").cast("string")).alias("text"))
    return books.chosen_text(own.withColumnRenamed("text", "raw"), ocr, "always").select("file", "n", F.sha1("text").alias("digest"))


@query(f"WITH {BOOK_PAGES} SELECT file, n FROM b WHERE n > 10")
def ocr_misses(spark, sf_dir):
    """Pages that the recognition cache doesn't hold; it holds the first ten of each file here."""
    own = book_pages_(spark, sf_dir).select("file", "n", F.sha1("file").alias("file_sha"), F.lit(200).alias("dpi"))
    return books.ocr_misses(own, own.where("n <= 10").select("file_sha", "dpi", "n")).select("file", "n")


@query("SELECT event_id, round(1.0::DOUBLE - value - 0.125::DOUBLE, 9) AS y0 FROM events")
def boxes_flipped(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(books.flip(F.col("value"), F.lit(0.125)), 9).alias("y0"))


@query(f"""
WITH {BOOK_PAGES}, s AS (SELECT DISTINCT file, regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM b)
SELECT file, nullif(regexp_extract(stem, '^(\\d{{1,2}})?[_\\-\\s]*(.+?)$', 1), '')::INT AS chapter, regexp_replace(regexp_replace(regexp_extract(stem, '^(\\d{{1,2}})?[_\\-\\s]*(.+?)$', 2), '[_\\-]+', ' ', 'g'), '^{W}+|{W}+$', '', 'g') AS title FROM s""")
def file_names(spark, sf_dir):
    own = book_pages_(spark, sf_dir).select("file").distinct()
    return own.select("file", books.file_parts(F.col("file")).alias("p")).select("file", "p.chapter", "p.title")


@query("SELECT DISTINCT page_id, chapter IS NULL AS frameset FROM pages WHERE content_type = 'text/html'")
def framesets(spark, sf_dir):
    """Documents with a frameset, which are no pages; those of pages without a chapter get one here."""
    rows = _html_rows(spark, sf_dir).join(pages_(spark, sf_dir).select("page_id", "chapter").distinct(), "page_id")
    made = rows.select("page_id", "url", "path", F.concat(F.when(F.col("chapter").isNull(), F.lit("<frameset cols=2></frameset>")).otherwise(F.lit("")), F.col("html")).alias("html"))
    return html.parsed(made).select("page_id", "frameset").distinct()


@query("SELECT DISTINCT url, sha1(text) AS digest FROM pages WHERE content_type = 'text/html'")
def documents_decoded(spark, sf_dir):
    """Bytes of a crawl as text, by the encoding that their header names."""
    rows = pages_(spark, sf_dir).where("content_type = 'text/html'").select("url", F.encode("text", "utf-8").alias("body"), F.lit("text/html; charset=utf-8").alias("content_type"))
    return web.documents(rows).select("url", F.sha1("html").alias("digest")).distinct()


SITE = "https://ucebnice.example/podklady/online-priprava/"


@query(f"""
SELECT '{SITE}' || n || '.html' AS url, CASE WHEN n = 35 THEN 'http_404' WHEN n IN (33, 43) THEN 'error' ELSE 'fetched' END AS status, floor(log2(n))::INT AS depth, n - 1 AS place FROM range(1, 51) AS t(n)""")
def crawl_walk(spark, sf_dir):
    """A crawl of a made site in which page n names pages 2n and 2n + 1, to a limit of fifty URLs; two fail and one isn't there."""

    def fetch(url):
        n = int(url.rsplit("/", 1)[1].split(".")[0])
        if n in (33, 43):
            raise OSError("reset")
        return (404, "", b"") if n == 35 else (200, "text/html", f'<a href="{2 * n}.html"><a href="{2 * n + 1}.html#x">'.encode())

    return corpus.crawl([f"{SITE}1.html"], fetch, spark, limit=50, wait=0).select("url", "status", "depth", "place")


@query("SELECT doc_id AS qid, seq, event, data FROM (SELECT doc_id, unnest([1, 2]) AS seq, unnest(['meta', 'done']) AS event, unnest([source, doc_id::VARCHAR]) AS data FROM documents)")
def sse_read(spark, sf_dir):
    """Frames as text, and read again."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(answers.frame(F.lit("meta"), F.col("source")), answers.frame(F.lit("done"), F.col("doc_id").cast("string")))
    rows = d.select(F.col("doc_id").alias("qid"), F.posexplode(answers.frame_parts(text)).alias("pos", "f"))
    return rows.select("qid", (F.col("pos") + 1).alias("seq"), "f.event", "f.data")


@query("SELECT DISTINCT url, path, edition_key, lang, edition, chapter, section, title, sha1(text) AS text, len(links) AS n_links, content_type, fetched_at, book FROM pages")
def pages_saved(spark, sf_dir):
    """Page records written as JSON lines and read again."""
    path = f"{shared_folder(spark)}/pages-{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}"
    records.save_pages(pages_(spark, sf_dir), path)
    own = records.load_pages(spark, path)
    return own.select("url", "path", "edition_key", "lang", "edition", "chapter", "section", "title", F.sha1("text").alias("text"), F.size("links").cast("long").alias("n_links"), "content_type", "fetched_at", "book").distinct()


@query("SELECT text AS q, lang, NULL::INT AS chapter, CASE WHEN lang = 'cs' THEN 1 END AS n_sections FROM lang_samples")
def questions_read(spark, sf_dir):
    """Evaluation questions from JSON lines in which keys are optional."""
    path = f"{shared_folder(spark)}/questions-{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}"
    rows = table(spark, sf_dir, "lang_samples").select(F.col("text").alias("q"), "lang", F.when(F.col("lang") == "cs", F.array(F.lit("1.1"))).alias("sections"))
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    return records.load_questions(spark, path).select("q", "lang", "chapter", F.when(F.col("sections").isNotNull(), F.size("sections")).alias("n_sections"))


@query("SELECT sha1('You help students with ' || string_agg(book, '; ' ORDER BY book) || '.' || chr(10) || chr(10) || '{}') AS digest FROM (SELECT DISTINCT book FROM pages WHERE book <> '')".format(answers.RULES.replace("'", "' || chr(39) || '")))
def system_prompts(spark, sf_dir):
    names = corpus.books(pages_(spark, sf_dir)).agg(F.array_join(F.array_sort(F.collect_list("book")), "; ").alias("names"))  # a name a book
    return names.select(F.sha1(F.concat(F.lit("You help students with "), "names", F.lit(answers.system_prompt(["\x01"]).split("\x01")[1]))).alias("digest"))
