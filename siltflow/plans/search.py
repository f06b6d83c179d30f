"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from .base import SQL_CORPUS, corpus, indexed, questions, sql_stems


def _search(**options):
    def run(spark, sf_dir):
        return R.search(indexed(spark, sf_dir), questions(spark, sf_dir), **options).select("qid", "rank", "url", "score", F.array_join("matched", " ").alias("matched"))

    return run


def doc_frequency(spark, sf_dir):
    return indexed(spark, sf_dir).df


def doc_length_stats(spark, sf_dir):
    return indexed(spark, sf_dir).stats.select("n", F.round("avg", 6).alias("avg_len"))


def term_frequency_weighted(spark, sf_dir):
    return indexed(spark, sf_dir).tf


def best_excerpt(spark, sf_dir):
    pages, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    return R.excerpts(R.search(indexed(spark, sf_dir), asked, limit=3), pages, asked)


QUERIES = {
    "bm25_search": _search(per_section=None),
    "bm25_section_cap": _search(limit=8, per_section=2),
    "bm25_kind_filter": _search(kinds=["en", "fr"]),
    "doc_frequency": doc_frequency,
    "doc_length_stats": doc_length_stats,
    "term_frequency_weighted": term_frequency_weighted,
    "best_excerpt": best_excerpt,
}

_STOP = ", ".join(f"'{s}'" for s in R.STOP_STEMS)
SQL_INDEX = f"""{SQL_CORPUS},
held AS (SELECT * FROM corpus WHERE trim(coalesce(text, '')) <> ''),
tokens AS (SELECT url, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word, 1 AS w FROM held UNION ALL SELECT url, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')), 3 FROM held),
asked AS (SELECT qid, list_zip(w, range(len(w))) AS z FROM (SELECT qid, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM questions)),
qwords AS (SELECT qid, x[1] AS word, x[2] AS pos FROM (SELECT qid, unnest(z) AS x FROM asked)),
every AS (SELECT word FROM tokens UNION SELECT word FROM qwords), {sql_stems("every")},
tf AS (SELECT url, term, sum(w)::BIGINT AS f FROM tokens JOIN stems USING (word) WHERE length(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY ALL),
lens AS (SELECT url, coalesce(sum(f), 0)::BIGINT AS len FROM held LEFT JOIN tf USING (url) GROUP BY url),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stats AS (SELECT count(*) AS n, avg(len) AS avg FROM lens),
qterms AS (SELECT qid, term, min(pos) AS pos FROM qwords JOIN stems USING (word) WHERE length(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY ALL),
hits AS (
  SELECT qid, url, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * len / avg))) AS raw, string_agg(term, ' ' ORDER BY pos) AS matched
  FROM qterms JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (url), stats GROUP BY qid, url),
scored AS (SELECT qid, url, section, kind, round(CASE WHEN overview THEN raw * 1.2 ELSE raw END, 6) AS score, matched FROM hits JOIN held USING (url))"""


def _sql_search(limit: int = 10, per_section: int | None = None, kinds: str = "") -> str:
    cap = f"WHERE place <= {per_section}" if per_section else ""
    where = f"AND kind IN ({kinds})" if kinds else ""
    return f"""WITH {SQL_INDEX},
placed AS (SELECT *, row_number() OVER (PARTITION BY qid, section ORDER BY score DESC, url) AS place FROM scored WHERE score > 0 {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, url)::INTEGER AS rank FROM placed {cap})
SELECT qid, rank, url, score, matched FROM ranked WHERE rank <= {limit}"""


SQL_TRUNCATE = """CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(
  CASE WHEN contains({h}, ' ') AND length({h}) - instr(reverse({h}), ' ') > 0.6 * {n} THEN left({h}, length({h}) - instr(reverse({h}), ' ')) ELSE {h} END,
  '[ \\t\\n\\r\\f\\x0B\\x{{A0}},;:–—-]+$', '') || '…' END"""


def sql_truncate(x: str, n: int) -> str:
    head = f"regexp_replace(left({x}, {n - 1}), '[ \\t\\n\\r\\f\\x0B\\x{{A0}}]+$', '')"
    return SQL_TRUNCATE.format(x=x, n=n, h=head)


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\x0B\\x{{A0}}]+', ' ', 'g'))"


def sql_sentences(x: str) -> str:
    return f"string_split(regexp_replace({sql_collapse(x)}, '([.!?]) +([A-Z0-9\"''“(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


ORACLES = {
    "bm25_search": _sql_search(),
    "bm25_section_cap": _sql_search(8, 2),
    "bm25_kind_filter": _sql_search(10, 2, "'en', 'fr'"),
    "doc_frequency": f"WITH {SQL_INDEX} SELECT term, df FROM df",
    "doc_length_stats": f"WITH {SQL_INDEX} SELECT n, round(avg, 6) AS avg_len FROM stats",
    "term_frequency_weighted": f"WITH {SQL_INDEX} SELECT url, term, f FROM tf",
    "best_excerpt": f"""WITH {SQL_INDEX},
placed AS (SELECT *, row_number() OVER (PARTITION BY qid, section ORDER BY score DESC, url) AS place FROM scored WHERE score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, url) AS rank FROM placed WHERE place <= 2),
top AS (SELECT qid, url, {sql_sentences("text")} AS s FROM ranked JOIN held USING (url) WHERE rank <= 3),
each AS (SELECT qid, url, x[1] AS s, x[2] AS i FROM (SELECT qid, url, unnest(list_zip(s, range(len(s)))) AS x FROM top)),
sw AS (SELECT qid, url, i, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS word FROM each),
n AS (SELECT qid, url, i, count(DISTINCT q.term) AS n FROM sw JOIN stems USING (word) JOIN qterms q USING (qid, term) GROUP BY ALL),
p AS (SELECT qid, url, i, s, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY qid, url ORDER BY i = 0 DESC, coalesce(n, 0) DESC, i) AS place FROM each LEFT JOIN n USING (qid, url, i)),
w AS (SELECT qid, url, string_agg(s, ' ' ORDER BY i) AS whole FROM p WHERE place <= 5 AND (i = 0 OR n > 0) GROUP BY ALL)
SELECT qid, url, {sql_truncate("whole", 700)} AS excerpt FROM w""",
}
